"""Operator 8, token counts: the tokenizer compiled to two deterministic finite-state transducers that run over chunks.

The first finds the pre-tokens. Characters fall into classes (letter, number, white space, the apostrophe that may open a contraction,
...). One transition table over ten states decides, for each character, whether a pre-token begins there: the transition is
annotated with what it emits. Texts are joined, separated by a class that resets the machine, and cut into chunks of equal
length. A chunk's map takes each possible entry state to its exit state and to the number of pre-tokens that it emits;
the maps compose associatively, so a parallel prefix scan (log n rounds over all chunks at once) gives every chunk the
state in which it is entered, and a second run emits the boundaries.

The second is the merges, compiled over bytes (see Machine): each transition is annotated with the change of the token count. A pre-token
sends it back to its first state, so chunks that are cut at pre-tokens have constant maps, which compose by adding counts: all run at
once, and a running sum gives each text its tokens. All work is numpy over bounded blocks, one narrow pass, no shuffle.

Defined results: a null text is an empty one (0 bytes, 0 tokens); repeated rows count once per row; a null doc_id is
carried through; further columns are ignored. The marker of the vocabulary inside a text is one token.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from loomfold.llm.bpe import merge
from loomfold.llm.common import SPECIAL, cut, plain, read_ranks

LIMIT, CHUNK, BLOCK, LANE = 512, 128, 2_000_000, 256
#: States and pairs of tokens that a worker keeps; tokens that a state lists by name.
STATES, PAIRS, FEW = 100_000, 1_000_000, 32
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"

#: Input classes. Space and gap come before a visible character; blank before white space or the end. Tick opens 's 't 'm 'd, tick2 're 've 'll.
LETTER, NUMBER, OTHER, SPACE, GAP, BLANK, TICK, TICK2, RESET = range(9)
#: States: fresh (nothing open), in letters, numbers, others, after a space that joins what follows, in blanks, after a gap, in a contraction with one or two letters to come, after one.
FRESH, LETTERS, NUMBERS, OTHERS, JOIN, BLANKS, ALONE, ONE, TWO, DONE = range(10)


def compile_table() -> tuple[np.ndarray, np.ndarray]:
    """(next state, 1 where a pre-token begins) for each state and class."""
    go, emit = np.zeros((10, 9), np.uint8), np.zeros((10, 9), np.uint8)
    run = {LETTER: LETTERS, NUMBER: NUMBERS, OTHER: OTHERS, SPACE: JOIN, GAP: ALONE, BLANK: BLANKS, TICK: ONE, TICK2: TWO, RESET: FRESH}
    for state in range(10):
        for kind, to in run.items():
            begins = 1
            if kind in (LETTER, NUMBER, OTHER) and state in (to, JOIN) or kind == BLANK and state == BLANKS:
                begins = 0
            if kind in (TICK, TICK2) and state in (OTHERS, JOIN):
                to, begins = OTHERS, 0
            if state in (ONE, TWO) and kind != RESET:
                to, begins = (DONE if state == ONE else ONE), 0
            go[state, kind], emit[state, kind] = to, begins
    return go, emit


GO, EMIT = compile_table()
_KINDS: dict[str, np.ndarray] = {}


def kinds() -> np.ndarray:
    """Class of each code point, without looking ahead; 255 for white space."""
    if "all" not in _KINDS:
        out = np.full(0x110000, OTHER, np.uint8)
        points = [p for p in range(0x110000) if not 0xD800 <= p < 0xE000]
        every = "".join(map(chr, points))
        for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", 255)):
            for m in regex.finditer(pattern, every):
                out[points[m.start()] : points[m.end() - 1] + 1] = kind
        out[0xD800:0xE000] = RESET
        _KINDS["all"] = out
    return _KINDS["all"]


def classes(codes: np.ndarray) -> np.ndarray:
    """Input classes of a text's code points; a surrogate code point separates texts."""
    kind = kinds()[codes]
    ahead = np.append(kind[1:], RESET)
    white = kind == 255
    before_visible = (ahead != 255) & (ahead != RESET)
    kind = np.where(white, np.where(before_visible, np.where(codes == 32, SPACE, GAP), BLANK), kind).astype(np.uint8)
    at = np.flatnonzero(codes == 39)
    if len(at):
        padded = np.append(codes, [0, 0])
        a, b = padded[at + 1], padded[at + 2]
        kind[at[np.isin(a, [ord(c) for c in "stmd"])]] = TICK
        kind[at[((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))]] = TICK2
    return kind


def run(kind: np.ndarray) -> tuple[np.ndarray, int]:
    """Where pre-tokens begin, and how many the composed chunk maps emit in all (both from the state FRESH)."""
    n = -(-len(kind) // CHUNK)
    lanes = np.full(n * CHUNK, RESET, np.uint8)
    lanes[: len(kind)] = kind
    lanes = np.ascontiguousarray(lanes.reshape(n, CHUNK).T)
    flat, flat_emit = GO.ravel(), EMIT.ravel()
    exits = np.tile(np.arange(10, dtype=np.uint8), (n, 1))
    counts = np.zeros((n, 10), np.int64)
    for row in lanes:
        where = exits * np.uint8(9) + row[:, None]
        exits = flat[where]
        counts += flat_emit[where] & (row != RESET)[:, None]
    # inclusive scan over chunk maps: (f then g)(s) = g(f(s)), emitted f[s] + g[f(s)]
    step = 1
    while step < n:
        first = exits[:-step].astype(np.intp)
        counts[step:] = counts[:-step] + np.take_along_axis(counts[step:], first, 1)
        exits[step:] = np.take_along_axis(exits[step:], first, 1)
        step *= 2
    state = np.append(np.uint8(FRESH), exits[:-1, FRESH])
    begins = np.empty((CHUNK, n), np.uint8)
    for k, row in enumerate(lanes):
        where = state * np.uint8(9) + row
        begins[k] = flat_emit[where]
        state = flat[where]
    return begins.T.ravel()[: len(kind)].astype(bool) & (kind != RESET), int(counts[-1, FRESH]) if n else 0


class Machine:
    """The merges as a deterministic transducer over the bytes of a pre-token; transitions carry a change of the token count.

    A sequence of tokens is what the merges give if and only if each two neighbours are what the merges give for their own bytes. So the
    last token after a byte is the one token that ends there and agrees with the last token at the place where it begins. A state is all
    that later bytes can ask for: for each place from which a token may still grow, its distance back, the tokens that may (or, while these
    are more than FEW, the last token there and the bytes since), and the count there less the present one. States are made when they are
    first met, and kept by worker; beyond STATES of them the table is emptied, which changes no result.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.words = ranks, {r: w for w, r in ranks.items()}
        self.longer: dict[bytes, list[int] | None] = {}
        for word, rank in ranks.items():
            for k in range(1, len(word)):
                grown = self.longer.setdefault(word[:k], [])
                if grown is not None:
                    grown.append(rank)
                    if len(grown) > FEW:
                        self.longer[word[:k]] = None
        # the two parts that the last merge of a token joins
        self.halves = {}
        for word, rank in ranks.items():
            if len(word) > 1:
                parts = merge(word, ranks, rank)
                self.halves[rank] = (parts[0], parts[-1]) if len(parts) == 2 else None
        self.agrees: dict[int, bool] = {}
        self.clear()

    def clear(self) -> None:
        self.number: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.go, self.emit = np.full((1024, 256), -1, np.int32), np.zeros((1024, 256), np.int16)
        self.state(b"", [(0, -1, None, 0)])

    def state(self, tail: bytes, places: list[tuple]) -> int:
        key = tuple((back, (before, tail[len(tail) - back :]) if allowed is None else allowed, less) for back, before, allowed, less in places)
        n = self.number.get(key)
        if n is None:
            n = self.number[key] = len(self.states)
            self.states.append((tail, places))
            if n == len(self.go):
                self.go = np.concatenate([self.go, np.full_like(self.go, -1)])
                self.emit = np.concatenate([self.emit, np.zeros_like(self.emit)])
        return n

    def agree(self, left: int, right: int) -> bool:
        """Whether the merges keep two tokens apart: their last merges are undone, the later one first, until two inner parts would have been
        joined before (they do not agree) or bytes are left."""
        got = self.agrees.get(left << 32 | right)
        if got is not None:
            return got
        if len(self.agrees) > PAIRS:
            self.agrees.clear()
        a, b, limit, got = left, right, len(self.ranks) + 1, True
        while True:
            joined = self.ranks.get(self.words[a] + self.words[b])
            if joined is not None and joined < limit:
                got = False
                break
            undo_a, undo_b = self.halves.get(a, ()), self.halves.get(b, ())
            if undo_a is None or undo_b is None:  # a token that merges do not make of two parts
                got = merge(self.words[left] + self.words[right], self.ranks) == [left, right]
                break
            if undo_a and (not undo_b or a > b):
                limit, a = a, undo_a[1]
            elif undo_b:
                limit, b = b + 1, undo_b[0]
            else:
                break
        self.agrees[left << 32 | right] = got
        return got

    def compile(self, state: int, byte: int) -> None:
        """The transition of one state and byte. Places of a state come longest first."""
        tail, places = self.states[state]
        tail += bytes([byte])
        n, last, change = len(tail), None, 0
        for back, before, allowed, less in places:
            token = self.ranks.get(tail[n - back - 1 :])
            if token is not None and (token in allowed if allowed is not None else before < 0 or self.agree(before, token)):
                last, change = token, less + 1
                break
        kept = []
        for back, before, allowed, less in places:
            part = tail[n - back - 1 :]
            if allowed is None:
                allowed = self.longer.get(part, ())
                if allowed is not None:
                    allowed = tuple(t for t in allowed if before < 0 or self.agree(before, t))
            else:
                allowed = tuple(t for t in allowed if len(self.words[t]) > back + 1 and self.words[t].startswith(part))
            if allowed is None or allowed:
                kept.append((back + 1, before, allowed, less - change))
        tail = tail[n - kept[0][0] :] if kept else b""
        self.go[state, byte] = self.state(tail, [*kept, (0, last, None, 0)])
        self.emit[state, byte] = change

    def run(self, data: np.ndarray, begins: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The tokens of each lane data[start : start + length]; lanes begin at pre-tokens, so none needs another's state."""
        if len(self.states) > STATES:
            self.clear()
        order = np.argsort(-lengths, kind="stable")
        at, left = starts[order], lengths[order]
        state, total = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        active = np.searchsorted(-left, -np.arange(1, int(left.max(initial=0)) + 1), "right")
        for k, m in enumerate(active.tolist()):
            where = at[:m] + k
            own = state[:m]
            own[begins[where]] = 0
            edge = own * 256 + data[where]
            new = self.go.ravel()[edge]
            if (new < 0).any():
                for missing in np.unique(edge[new < 0]).tolist():
                    self.compile(*divmod(missing, 256))
                new = self.go.ravel()[edge]
            total[:m] += self.emit.ravel()[edge]
            state[:m] = new
        out = np.empty_like(total)
        out[order] = total
        return out


_MACHINES: dict[str, Machine] = {}


def machine(path: str | None = None) -> Machine:
    """The compiled vocabulary; one per Python worker."""
    import public_tokenizers

    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    if path not in _MACHINES:
        _MACHINES[path] = Machine(read_ranks(path))
    return _MACHINES[path]


class Counter:
    def __init__(self, path: str | None = None):
        self.machine = machine(path)

    def block(self, texts: list[str]) -> list[int]:
        """Tokens of each text, none of which holds the marker."""
        joined = "\n".join(texts)
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32).copy()
        data = np.frombuffer(joined.encode(), np.uint8)
        width = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
        place = np.append(0, np.cumsum(width))
        ends = np.cumsum([len(t) + 1 for t in texts])
        codes[ends[:-1] - 1] = 0xD800
        begins, emitted = run(classes(codes))
        firsts = np.flatnonzero(begins)
        if len(firsts) != emitted:
            raise AssertionError("the scan and the second run disagree")
        starts = place[firsts]
        flags = np.zeros(len(data), bool)
        flags[starts] = True
        # lanes: from the first pre-token of a text or of the next LANE bytes; the separator after a text belongs to none
        edges = np.searchsorted(firsts, np.append(0, ends))
        piece = np.searchsorted(ends, firsts, "right")
        new = np.ones(len(starts), bool)
        new[1:] = (piece[1:] != piece[:-1]) | (starts[1:] // LANE != starts[:-1] // LANE)
        heads = np.flatnonzero(new)
        stops = np.minimum(np.append(starts[heads[1:]], len(data)), place[ends - 1][piece[heads]])
        tokens = np.append(0, np.cumsum(self.machine.run(data, flags, starts[heads], stops - starts[heads])))
        return np.diff(tokens[np.searchsorted(heads, edges)]).tolist()

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of whole texts, in blocks of bounded size."""
        out, waiting, owners, size = [0] * len(texts), [], [], 0

        def flush():
            for k, n in zip(owners, self.block(waiting) if waiting else [], strict=True):
                out[k] += n

        for k, text in enumerate(texts):
            for i, part in enumerate(text.split(SPECIAL)):
                out[k] += i > 0
                for piece in cut(part):
                    waiting.append(piece)
                    owners.append(k)
                    size += len(piece) + 1
                    if size > BLOCK:
                        flush()
                        waiting, owners, size = [], [], 0
        flush()
        return out


def count_tokens(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    def map_texts(batches):
        counter = Counter()
        for batch in batches:
            texts = [plain(t) for t in batch.column(1).to_pylist()]
            n = counter.count(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(map_texts, SCHEMA)
