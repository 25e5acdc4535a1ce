"""Operator 10, byte-level BPE: a minimal perfect hash for pre-tokens of the vocabulary, a heap over linked bytes for the rest.

The hash is built once on the driver from the rank file (hash and displace: buckets, largest first, each with the
smallest displacement that sends its keys to free slots), so 50,256 words lie in 50,256 slots. A pre-token is
looked up by one probe and one comparison of bytes. A miss is encoded by merging the lowest rank first, the leftmost
among equals, with a heap of pairs over a doubly linked list of parts: n log n in the pre-token's length.
Results are kept per worker for the pre-tokens seen lately; the store is emptied when full, which changes no result.

Defined results: a null text is an empty one (no ids); repeated rows are encoded once per row; a null doc_id is carried
through; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from loomfold.llm.common import cut, plain, read_ranks

SCHEMA = "doc_id long, ids array<int>, decoded binary"
DIGEST_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
KEPT = 400_000


class PerfectHash:
    """Minimal perfect hash from words to ids. `words` holds the word of each slot, for the comparison."""

    def __init__(self, ranks: dict[bytes, int]):
        keys = list(ranks)
        self.n, self.buckets = max(1, len(keys)), max(1, len(keys) // 3)
        placed: dict[int, list] = {}
        for key in keys:
            h = xxhash.xxh3_128_intdigest(key)
            placed.setdefault((h >> 96) % self.buckets, []).append((h, key))
        self.shift = np.zeros(self.buckets, np.int32).tolist()
        self.words: list[bytes | None] = [None] * self.n
        self.ids = [0] * self.n
        for bucket in sorted(placed, key=lambda b: -len(placed[b])):
            shift = 0
            while True:
                slots = {self.slot(h, shift) for h, _ in placed[bucket]}
                if len(slots) == len(placed[bucket]) and all(self.words[s] is None for s in slots):
                    break
                shift += 1
            self.shift[bucket] = shift
            for h, key in placed[bucket]:
                s = self.slot(h, shift)
                self.words[s], self.ids[s] = key, ranks[key]

    def slot(self, h: int, shift: int) -> int:
        x = ((h & 0xFFFFFFFFFFFFFFFF) + shift * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
        return ((x ^ x >> 31) >> 7) % self.n

    def get(self, word: bytes) -> int | None:
        h = xxhash.xxh3_128_intdigest(word)
        s = self.slot(h, self.shift[(h >> 96) % self.buckets])
        return self.ids[s] if self.words[s] == word else None


class _Below:
    """Ranks without the merges from one rank on."""

    def __init__(self, ranks: dict[bytes, int], below: int):
        self.ranks, self.below = ranks, below

    def get(self, word: bytes) -> int | None:
        rank = self.ranks.get(word)
        return rank if rank is not None and rank < self.below else None

    def __getitem__(self, word: bytes) -> int:
        return self.ranks[word]


def merge(word: bytes, ranks: dict[bytes, int], below: int | None = None) -> list[int]:
    """The ids of one pre-token: lowest rank first, leftmost among equals. `below`: only merges of a lower rank."""
    if below is not None:
        ranks = _Below(ranks, below)
    n = len(word)
    end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    dead = bytearray(n)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i]
        if dead[i] or j >= n or end[j] != stop:
            continue
        end[i], after[i], dead[j] = stop, after[j], 1
        if after[i] < n:
            before[after[i]] = i
            if (r := ranks.get(word[i : end[after[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[after[i]]))
        if (k := before[i]) >= 0 and (r := ranks.get(word[k:stop])) is not None:
            heapq.heappush(heap, (r, k, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = after[i]
    return out


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str, table: PerfectHash | None = None):
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.table = table or PerfectHash(ranks)
        self.back = {v: k for k, v in ranks.items()}
        self.seen: dict[str, tuple] = {}

    def pre_token(self, word: str) -> tuple[str, int, bytes]:
        """Ids as decimals, their number, the bytes they decode to."""
        raw = word.encode()
        whole = self.table.get(raw)
        ids = merge(raw, self.ranks) if whole is None else [whole]
        return " ".join(map(str, ids)), len(ids), b"".join(map(self.back.__getitem__, ids))

    def text(self, text: str):
        """For each piece of the text, what its pre-tokens give."""
        for piece in cut(text):
            words = self.find(piece)
            if len(self.seen) > KEPT:
                self.seen.clear()
            seen = self.seen
            for word in set(words).difference(seen):
                seen[word] = self.pre_token(word)
            yield [seen[w] for w in words]

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for got in self.text(plain(text)) for x in got for i in x[0].split()]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.back.__getitem__, ids))

    def digest(self, text: str | None) -> tuple[int, str, str]:
        n, ids, raw, gap = 0, hashlib.sha256(), hashlib.sha256(), b""
        for got in self.text(plain(text)):
            if got:
                ids.update(gap + " ".join([x[0] for x in got]).encode())
                raw.update(b"".join([x[2] for x in got]))
                n, gap = n + sum([x[1] for x in got]), b" "
        return n, ids.hexdigest(), raw.hexdigest()


def _broadcast(docs: DataFrame, path: str | None):
    """Ranks and perfect hash: their size is the vocabulary's, whatever the corpus."""
    import public_tokenizers

    ranks = read_ranks(path or public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return docs.sparkSession.sparkContext.broadcast((ranks, public_tokenizers.PATTERN, PerfectHash(ranks)))


def _columns(docs: DataFrame) -> DataFrame:
    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids, and the bytes the ids decode to."""
    held = _broadcast(docs, path)

    def run(batches):
        codec = Codec(*held.value)
        for batch in batches:
            ids = [codec.encode(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([codec.decode(x) for x in ids], pa.binary())], names=["doc_id", "ids", "decoded"])

    return _columns(docs).mapInArrow(run, SCHEMA)


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The same round trip, with digests in place of the ids and bytes."""
    held = _broadcast(docs, path)

    def run(batches):
        codec = Codec(*held.value)
        for batch in batches:
            got = [codec.digest(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in got], pa.int64()), pa.array([x[1] for x in got], pa.string()), pa.array([x[2] for x in got], pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _columns(docs).mapInArrow(run, DIGEST_SCHEMA)
