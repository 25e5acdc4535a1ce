"""Operator 4, chat formatting with a grammar round trip.

A turn becomes `<|turn|` level `|` role `|>` text `<|end|>`, and a conversation the text of its turns, one after another. The parser is
deterministic: a role ends at the first `|>`, a text at the first `<|end|>`. Every turn is first written as it is (level 0), the written form
is parsed again and compared with the source; while they differ, role and text are escaped one level more: level 1 replaces the marks
`<|` and `|>` (and `~`, which starts an escape), level 2 every `<` and `|`. So only turns with conflicting content are escaped, and a turn
leaves the operator only when its round trip is identical. The loss mask are the places of the assistant's texts in the formatted text.

Rows are dealt and sorted by conversation and written in one stream, so a task holds the text of one conversation, which is one row of the
result, and never all rows of a key beside it.

Defined results: a null text is empty, a null role is empty, turns that tie are ordered by role and text, repeated rows are
separate turns, each row without conv_id is a conversation of its own, further columns are ignored, an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame

OPEN, CLOSE, END = "<|turn|", "|>", "<|end|>"
#: Escapes by level, in the order in which they are written; they are read back in the opposite order.
ESCAPES = [(), (("~", "~0"), ("<|", "~1"), ("|>", "~2")), (("~", "~0"), ("<", "~1"), ("|", "~2"))]
TEST_TEXT = "</s>[INST] ok [/INST]"


def escape(text: str, level: int) -> str:
    for mark, written in ESCAPES[level]:
        text = text.replace(mark, written)
    return text


def unescape(text: str, level: int) -> str:
    for mark, written in reversed(ESCAPES[level]):
        text = text.replace(written, mark)
    return text


def written(role: str, text: str, level: int) -> str:
    return f"{OPEN}{level}|{escape(role, level)}{CLOSE}{escape(text, level)}{END}"


def parse_turn(formatted: str, at: int = 0) -> tuple[str, str, int, int, int, int]:
    """role, text, level, start and stop of the written text, and where the turn ends; raises where the grammar is not followed."""
    head = at + len(OPEN) + 2
    if not formatted.startswith(OPEN, at) or formatted[head - 2 : head - 1] not in ("0", "1", "2") or formatted[head - 1 : head] != "|":
        raise ValueError(f"no turn at character {at}")
    level = int(formatted[head - 2])
    close = formatted.find(CLOSE, head)
    stop = formatted.find(END, close + len(CLOSE))
    if close < 0 or stop < 0:
        raise ValueError(f"the turn at character {at} does not end")
    start = close + len(CLOSE)
    return unescape(formatted[head:close], level), unescape(formatted[start:stop], level), level, start, stop, stop + len(END)


def parse(formatted: str) -> list[tuple]:
    """parse_turn of each turn of a formatted text."""
    out, at = [], 0
    while at < len(formatted):
        out.append(parse_turn(formatted, at))
        at = out[-1][-1]
    return out


def render_turn(role: str, text: str) -> tuple[str, int, int]:
    """The written turn, at the first level whose round trip is identical, and where its text lies."""
    for level in range(len(ESCAPES)):
        out = written(role, text, level)
        try:
            got = parse_turn(out)
        except ValueError:
            continue
        if got[:2] == (role, text) and got[-1] == len(out):
            return out, got[3], got[4]
    raise AssertionError("no level keeps the turn")


def render(turns) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text of (role, text) and the loss mask: start and stop of each assistant's written text."""
    parts, mask, at = [], [], 0
    for role, text in turns:
        out, start, stop = render_turn(role, text)
        if role == "assistant":
            mask.append((at + start, at + stop))
        parts.append(out)
        at += len(out)
    return "".join(parts), mask


def read_back(formatted: str, mask) -> tuple[int, str, int, str, int]:
    """Turns, their digest, characters and digest of the text under the mask, characters of the formatted text."""
    turns = parse(formatted)
    level = {(start, stop): level for _, _, level, start, stop, _ in turns}
    every, loss, n = hashlib.sha256(), hashlib.sha256(), 0
    for role, text, *_ in turns:
        every.update(f"{role}\n{text}\n".encode())
    for span in mask:
        text = unescape(formatted[span[0] : span[1]], level[tuple(span)])
        loss.update(text.encode())
        n += len(text)
    return len(turns), every.hexdigest(), n, loss.hexdigest(), len(formatted)


def format_chats(rows: DataFrame) -> DataFrame:
    """conv_id, formatted, and the loss mask as starts and stops (code points), one row for each conversation."""
    rows = rows.selectExpr("cast(conv_id as long) conv_id", "cast(turn as long) turn", "coalesce(cast(role as string), '') role", "coalesce(cast(text as string), '') text")
    rows = rows.selectExpr("*", "coalesce(conv_id, xxhash64(turn, role, text)) dealt").repartition("dealt").sortWithinPartitions("conv_id", "turn", "role", "text")

    def write(batches):
        held, parts, starts, stops, at, any_ = None, [], [], [], 0, False
        done = []

        def close():
            done.append((held, "".join(parts), list(starts), list(stops)))
            parts.clear(), starts.clear(), stops.clear()

        def out():
            columns = list(zip(*done, strict=True)) or [[], [], [], []]
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.list_(pa.int64())), pa.array(columns[3], pa.list_(pa.int64()))], names=["conv_id", "formatted", "starts", "stops"])

        for batch in batches:
            size = 0
            for conv_id, role, text in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "role", "text")), strict=True):
                if any_ and (conv_id is None or conv_id != held):
                    size += at
                    close()
                    at = 0
                held, any_ = conv_id, True
                turn, start, stop = render_turn(role, text)
                if role == "assistant":
                    starts.append(at + start)
                    stops.append(at + stop)
                parts.append(turn)
                at += len(turn)
                if size > 16_000_000:
                    yield out()
                    size = 0
            yield out()
        if any_:
            close()
        yield out()

    return rows.select("conv_id", "role", "text").mapInArrow(write, "conv_id long, formatted string, starts array<long>, stops array<long>")


def digests(rows: DataFrame) -> DataFrame:
    """What read_back finds in the operator's output."""

    def read(batches):
        for batch in batches:
            got = [read_back(f, list(zip(a, b, strict=True))) for f, a, b in zip(*(batch.column(k).to_pylist() for k in ("formatted", "starts", "stops")), strict=True)]
            columns = list(zip(*got, strict=True)) or [[]] * 5
            types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return format_chats(rows).mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def query(spark, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame([(-1, 0, "user", TEST_TEXT), (-1, 1, "assistant", TEST_TEXT)], "conv_id long, turn long, role string, text string")
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return digests(rows.unionByName(own))
