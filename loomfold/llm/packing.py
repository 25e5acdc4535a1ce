"""Operator 1, packing: hierarchical multi-length packing of documents into token windows.

Every document is tokenized whole and ended with `END`. Its full windows of 1,024 ids stand alone; the tail that is
left is routed to the smallest tier (128, 256, 512 or 1,024 ids) that holds it. Each tier is packed into windows of
its own size: the longest waiting tail opens a window, the gap is filled with the longest tails of this and of shorter
tiers that fit whole (best fit), and what is left of the gap by cutting one more tail. So every window is full, and its
length a power of two. What remains at the end of a partition and fills no window is closed as windows whose lengths
are powers of two. Sequences are then dealt to step groups of equal sizes, balanced by attention cost.

The work is one narrow pass over the input's partitions: no shuffle, memory bounded by `POOL` waiting tails, and a task
that is lost is simply run again on its own split. Ids are `partition << 33 | number within the partition`.

Defined results: a null or empty text is a document of one id, `END`; repeated rows are packed once per row;
a null doc_id is carried through; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from loomfold.llm.common import SPECIAL, SPECIAL_ID, cut, encoder, lean, plain

WINDOW, TIERS, END = 1024, (128, 256, 512, 1024), 0
#: Tails that wait in one task before they are packed; sequences that are balanced together; sequences in a step group.
POOL, BALANCED, GROUP = 4096, 1024, 32
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long, tier int, step_group long"


def token_ids(text: str | None, enc=None) -> np.ndarray:
    """The ids of a whole text; the marker of the vocabulary inside it is one id, as the library has it by default."""
    enc = enc or encoder()
    parts = []
    for k, part in enumerate(plain(text).split(SPECIAL)):
        if k:
            parts.append(np.array([SPECIAL_ID], np.uint32))
        parts += [enc.encode_to_numpy(piece, disallowed_special=()) for piece in cut(part) if piece]
    return np.concatenate(parts).astype(np.uint32) if parts else np.empty(0, np.uint32)


class Packer:
    """Packs one partition. A tail is (length, number): its ids wait in `ids` under that number."""

    def __init__(self, first_id: int):
        self.next, self.group = first_id, first_id // GROUP
        self.tails = {t: [] for t in TIERS}
        self.total = dict.fromkeys(TIERS, 0)
        self.ids: dict[int, tuple] = {}
        self.number = 0
        self.ready: list[tuple[int, list]] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        total, full = len(ids), len(ids) // WINDOW * WINDOW
        for at in range(0, full, WINDOW):
            self.ready.append((WINDOW, [(doc_id, at, ids[at : at + WINDOW], total)]))
        if total > full:
            self.put(doc_id, full, ids[full:].copy(), total)

    def put(self, doc_id, start, ids, total) -> None:
        self.ids[self.number] = (doc_id, start, ids, total)
        tier = next(t for t in TIERS if t >= len(ids))
        insort(self.tails[tier], (len(ids), self.number))
        self.total[tier] += len(ids)
        self.number += 1

    def take(self, most: int, below: int):
        """The longest waiting tail of at most `most` ids from tiers up to `below`, best fit first."""
        for tier in reversed(TIERS):
            row = self.tails[tier]
            if tier <= below and row and (k := bisect_right(row, (most, float("inf")))):
                return self.out(tier, k - 1)
        return None

    def out(self, tier: int, k: int):
        length, number = self.tails[tier].pop(k)
        self.total[tier] -= length
        return self.ids.pop(number)

    def split(self, need: int, below: int):
        """Cut a waiting tail: `need` ids of it, the rest waits on. None if no tail is longer."""
        for tier in TIERS:
            row = self.tails[tier]
            if tier <= below and row and row[-1][0] > need:
                doc_id, start, ids, total = self.out(tier, -1)
                self.put(doc_id, start + need, ids[need:], total)
                return doc_id, start, ids[:need], total
        return None

    def pack(self) -> None:
        """Pack what waits, from the longest tier down; stop when a tier no longer fills a window."""
        for tier in reversed(TIERS):
            while self.tails[tier]:
                if sum(self.total[t] for t in TIERS if t <= tier) < tier:
                    break
                window, gap = [], tier
                while gap and (tail := self.take(gap, tier) or self.split(gap, tier)):
                    window.append(tail)
                    gap -= len(tail[2])
                self.ready.append((tier, window))

    def finish(self) -> None:
        """The rest of the partition: windows of ever smaller powers of two, none padded."""
        self.pack()
        rest = [self.out(t, -1) for t in reversed(TIERS) for _ in range(len(self.tails[t]))]
        size = 1 << max(0, sum(len(t[2]) for t in rest).bit_length() - 1)
        window, gap = [], min(size, WINDOW)
        left = sum(len(t[2]) for t in rest)
        while rest:
            doc_id, start, ids, total = rest.pop(0)
            window.append((doc_id, start, ids[:gap], total))
            if len(ids) > gap:
                rest.insert(0, (doc_id, start + gap, ids[gap:], total))
            used = min(gap, len(ids))
            gap, left = gap - used, left - used
            if not gap:
                self.ready.append((sum(len(w[2]) for w in window), window))
                window, gap = [], min(WINDOW, 1 << max(0, left.bit_length() - 1))

    def rows(self):
        """Sequences that are ready, in step groups of nearly equal attention cost (snake order over descending costs)."""
        ready, self.ready = self.ready, []
        ready.sort(key=lambda s: -sum(len(w[2]) ** 2 for w in s[1]))
        groups = max(1, -(-len(ready) // GROUP))
        cols: list[list] = [[] for _ in range(9)]
        for k, (tier, window) in enumerate(ready):
            lap, place = divmod(k, groups)
            step = self.group + (place if lap % 2 == 0 else groups - 1 - place)
            offset = 0
            for doc_id, start, ids, total in window:
                row = (doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.next, offset, tier, step)
                for col, value in zip(cols, row, strict=True):
                    col.append(value)
                offset += len(ids)
            self.next += 1
        self.group += groups
        types = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)


def pack(docs: DataFrame) -> DataFrame:
    """One row for each piece of each document; see the module's text."""

    def run(batches):
        packer, enc = Packer((TaskContext.get().partitionId() if TaskContext.get() else 0) << 33), encoder()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                packer.add(doc_id, np.append(token_ids(text, enc), np.uint32(END)))
                if len(packer.ids) >= POOL:
                    packer.pack()
                if len(packer.ready) >= BALANCED:
                    yield packer.rows()
        packer.finish()
        yield packer.rows()

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(lean(run), SCHEMA)
