"""Which of many needles a text holds, in one pass over its bytes (C2, H2), whatever the case of ASCII letters.

Texts come as Arrow columns, so nothing is done row by row: at each byte the next WINDOW bytes are looked up among the needles' anchors, and only where one stands
are its needles compared in full. A needle's anchor is that of its windows which the fewest needles hold; needles shorter than a window are looked up by
their own length. The work grows with the bytes of the texts and with the places of anchors, never with texts times needles.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of an anchor, places looked at together, places times needles compared together.
WINDOW, SLICE, EXPANDED = 8, 1 << 20, 1 << 21
MIX = np.uint64(0x9E3779B97F4A7C15)
LOW = np.arange(256, dtype=np.uint8)
LOW[65:91] += 32


def _mask(n: np.ndarray) -> np.ndarray:
    """The first n bytes of a little-endian word, n up to 8."""
    n = np.minimum(n, 8).astype(np.uint64)
    return np.uint64(2**64 - 1) >> (np.uint64(64) - np.uint64(8) * n)


def _words(padded: np.ndarray) -> np.ndarray:
    """At each byte the word of eight bytes that begins there."""
    return np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))


class Needles:
    def __init__(self, needles: list[str]):
        self.texts = needles
        folded = [np.frombuffer(x.encode(), np.uint8) for x in needles]
        folded = [LOW[x].tobytes() for x in folded]
        self.sizes = np.fromiter(map(len, folded), np.int64, len(folded))
        self.most = int(self.sizes.max(initial=0))
        width = (self.most + 15) // 8
        padded = np.frombuffer(b"".join(x.ljust(width * 8, b"\0") for x in folded), "<u8").reshape(len(folded), width)
        self.packed = padded.astype(np.uint64)
        common = Counter(x[k : k + WINDOW] for x in folded for k in range(len(x) - WINDOW + 1))
        self.at = np.array([min(range(len(x) - WINDOW, -1, -1), key=lambda k: common[x[k : k + WINDOW]]) if len(x) >= WINDOW else 0 for x in folded], np.int64)  # noqa: B023
        keys = np.array([int.from_bytes(x[k : k + WINDOW], "little") for x, k in zip(folded, self.at.tolist(), strict=True)], np.uint64)
        self.empty = np.flatnonzero(self.sizes == 0)
        self.kinds = []
        for n in np.unique(np.minimum(self.sizes[self.sizes > 0], WINDOW)).tolist():
            own = np.flatnonzero(np.minimum(self.sizes, WINDOW) == n)
            own = own[np.argsort(keys[own], kind="stable")]
            known, first = np.unique(keys[own], return_index=True)
            bits = max(12, int(len(known)).bit_length() + 6)
            seen = np.zeros(1 << bits, bool)
            seen[(known * MIX) >> np.uint64(64 - bits)] = True
            self.kinds.append((_mask(np.array(n)), known, np.append(first, len(own)), own, np.uint64(64 - bits), seen))

    def _pairs(self, words, a: int, b: int):
        """Places of anchors from a to b, each with a needle that has the anchor; in parts."""
        for mask, known, first, own, shift, seen in self.kinds:
            keys = words[a:b] & mask
            at = np.flatnonzero(seen[(keys * MIX) >> shift])
            key = np.minimum(np.searchsorted(known, keys[at]), len(known) - 1)
            ok = known[key] == keys[at]
            at, key = at[ok] + a, key[ok]
            n = np.diff(first)[key]
            ends, done = np.cumsum(n), 0
            while done < len(at):
                upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + EXPANDED, "right")))
                m = n[done:upto]
                needle = own[np.arange(m.sum()) + np.repeat(first[key[done:upto]] - (np.cumsum(m) - m), m)]
                yield np.repeat(at[done:upto], m) - self.at[needle], needle
                done = upto

    def find(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Rows of a column of strings and the numbers of the needles that they hold, each pair once."""
        column = column.cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        size = int(offsets[-1] - offsets[0])
        flat = np.zeros(size + self.most + 16, np.uint8)
        if size:
            np.take(LOW, np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], out=flat[:size])
        words, edges = _words(flat), offsets - offsets[0]
        found = [np.zeros(0, np.int64)]
        for a in range(0, size, SLICE):
            for start, needle in self._pairs(words, a, min(a + SLICE, size)):
                row = np.searchsorted(edges, start, "right") - 1
                ok = (start >= 0) & (row >= 0)
                start, needle, row = start[ok], needle[ok], row[ok]
                ok = start + self.sizes[needle] <= edges[row + 1]
                start, needle, row = start[ok], needle[ok], row[ok]
                for k in range(self.packed.shape[1]):
                    rest = self.sizes[needle] - 8 * k
                    if not (rest > 0).any():
                        break
                    ok = (rest <= 0) | ((words[np.minimum(start + 8 * k, len(words) - 1)] & _mask(np.maximum(rest, 1))) == self.packed[needle, k])
                    start, needle, row = start[ok], needle[ok], row[ok]
                found.append(np.unique(row * len(self.texts) + needle))
        both = np.unique(np.concatenate(found))
        return both // max(1, len(self.texts)), both % max(1, len(self.texts))


def holding(rows: DataFrame, columns: list[str], needles: DataFrame, keep: list[str]) -> DataFrame:
    """`keep` of the rows, and needle: each needle that one of `columns` holds, whatever the case of ASCII letters, once for each row. `needles`: needle; null is held by
    nothing, an empty one by every text that is not null.

    The distinct needles are collected and brought to every task; texts are neither shuffled nor compared with every needle.
    """
    known = sorted(r.needle for r in needles.select("needle").filter("needle is not null").distinct().collect())
    shared = rows.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        index = Needles(shared.value)
        for batch in batches:
            pairs = []
            for c in columns:
                column = batch.column(batch.schema.get_field_index(c))
                row, needle = index.find(column)
                there = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
                row = np.concatenate([row, *[there for _ in index.empty]])
                needle = np.concatenate([needle, np.repeat(index.empty, len(there))])
                pairs.append(row * max(1, len(known)) + needle)
            both = np.unique(np.concatenate(pairs))
            row, needle = both // max(1, len(known)), both % max(1, len(known))
            out = batch.select(keep).take(pa.array(row))
            texts = pa.array(known, pa.string()).take(pa.array(needle))
            yield pa.RecordBatch.from_arrays([*out.columns, texts], names=[*keep, "needle"])

    shape = rows.select(*keep).schema.add("needle", "string")
    return rows.mapInArrow(run, shape)
