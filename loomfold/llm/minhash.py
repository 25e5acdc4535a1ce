"""Operator 3, MinHash near-dedup: fast similarity sketches, banding, exact verification.

Texts with the same words are one node. A node's sketch has WIDTH coordinates of 16 bits: in round i < WIDTH each shingle is thrown to
one hashed bin with the value i plus a hash, in round WIDTH + i all of them go to bin i, and throwing stops when every bin is full; so every
coordinate is filled after at most 2 * WIDTH rounds, and sketches agree in a share of coordinates concentrated about the Jaccard
similarity. A band is ROWS coordinates in one long: BANDS bands of ROWS meet at 0.75 except with probability (1 - 0.75^ROWS)^BANDS, 5e-6.

Nodes that share a band are compared with the band's least node: a star, linear in the bucket. Buckets whose members are then all in one
component need nothing more, as each further link would join what is joined. Others get a second star about their greatest node, and
only in buckets that still hold several components are all pairs of different components looked at: in blocks of BLOCK entries, which compare
the sets of those pairs whose sketches agree in AGREE coordinates or more (at 0.75 all but 7e-6 do) and return a forest of the links
found, never the pairs. Every link is confirmed on full sets of 64-bit shingle hashes.

Nodes carry unique longs. Sets are made only of nodes that share a band, found again by doc_id and a hash of the text; that list is
broadcast only if it is counted as small.

Defined results: null, empty and blank texts have no shingles and are linked with nothing; rows of the same text are one component; a null
doc_id is larger than any other and is kept; a doc_id may stand for several texts; each row gives one row; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomfold.llm.common import BROADCAST_ROWS, durable, keyed, lean, plain, table, whole_groups, without
from loomfold.llm.components import components, merged

WORDS, WIDTH, BANDS, ROWS, AGREE, BLOCK, KEPT = 5, 128, 32, 4, 74, 512, 100_000
PRIME, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
#: Stands in the join key for a null doc_id.
NO_ID = 2**63 - 1
#: SQL of the keys that find a row again.
KEY = {"k": f"coalesce(cast(doc_id as long), {NO_ID})", "h": "xxhash64(cast(text as string))"}


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingles:
    def __init__(self):
        self.seen: dict[bytes, int] = {}

    def __call__(self, text: str) -> tuple[bytes | None, np.ndarray]:
        """The node (a digest of the words) and the sorted distinct 64-bit shingle hashes."""
        words = text.encode().lower().split()  # bytes: A-Z only, and the white space \x20 and \x09-\x0D
        if not words:
            return None, np.empty(0, np.uint64)
        if len(self.seen) > KEPT:
            self.seen.clear()
        for w in set(words).difference(self.seen):
            self.seen[w] = xxhash.xxh3_64_intdigest(w)
        ids = np.fromiter(map(self.seen.__getitem__, words), np.uint64, len(words))
        n = max(1, len(ids) - WORDS + 1)
        h = np.full(n, min(len(ids), WORDS), np.uint64)
        for k in range(min(len(ids), WORDS)):
            h = mix(h * PRIME + ids[k : k + n])
        return xxhash.xxh3_128_digest(b" ".join(words)), np.unique(h)


def sketch(x: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Fast similarity sketch of a non-empty set of hashes, 16 bits for each coordinate."""
    out = np.full(width, np.iinfo(np.uint64).max, np.uint64)
    step = max(1, 2048 // len(x))  # rounds thrown together; a later round never displaces the value of an earlier one

    def thrown(i: np.ndarray):
        h = mix(x[None, :] + ((i + np.uint64(1)) * PRIME)[:, None])
        return h, (i << np.uint64(48))[:, None] | (mix(h) >> np.uint64(16))

    for lo in range(0, width, step):
        h, value = thrown(np.arange(lo, min(lo + step, width), dtype=np.uint64))
        np.minimum.at(out, (h % np.uint64(width)).astype(np.intp).ravel(), value.ravel())
        if (out >> np.uint64(48) < np.uint64(width)).all():
            return mix(out).astype(np.uint16)
    empty = np.flatnonzero(out == np.iinfo(np.uint64).max)
    for lo in range(0, len(empty), step):
        bins = empty[lo : lo + step]
        out[bins] = thrown(bins.astype(np.uint64) + np.uint64(width))[1].min(axis=1)
    return mix(out).astype(np.uint16)


BAND_SALT = mix(np.arange(1, BANDS + 1, dtype=np.uint64) * PRIME).view(np.int64)


def packed(coordinates: np.ndarray) -> np.ndarray:
    """The buckets of a sketch: ROWS coordinates in one 64-bit key, mixed with the band's number."""
    return coordinates.view(np.int64) ^ BAND_SALT


def coordinates(buckets: np.ndarray) -> np.ndarray:
    """The sketches (rows of WIDTH) that these rows of buckets came from."""
    return (buckets ^ BAND_SALT).view(np.uint16)


def _sketched(batches):
    make, known = Shingles(), set()
    for batch in batches:
        digests, sizes, keys = [], [], []
        for text in batch.column(1).to_pylist():
            node, x = make(plain(text))
            digests.append(node)
            sizes.append(len(x))
            if len(known) > KEPT:
                known.clear()
            # a text that this task has met lately is sketched once
            keys.append(None if node is None or node in known else packed(sketch(x)))
            known.add(node)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "h", "digest", "n_shingles", "keys"])


def _sets(batches):
    """id and set of the rows whose text is that of the node `id`; a doc_id may stand for several texts."""
    make = Shingles()
    for batch in batches:
        ids, sets = [], []
        for text, node, digest in zip(*(batch.column(k).to_pylist() for k in ("text", "id", "digest")), strict=True):
            own, x = make(plain(text))
            if own == digest:
                ids.append(node)
                sets.append(x.astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["id", "x"])


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have 100 * intersection >= 75 * union."""
    if 100 * min(len(a), len(b)) < 75 * max(len(a), len(b)):
        return False
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return 100 * both >= 75 * (len(a) + len(b) - both)


def _verified(batches):
    for batch in batches:
        left, right = (batch.column(k) for k in ("x_a", "x_b"))
        (va, oa), (vb, ob) = ((x.values.to_numpy().view(np.uint64), x.offsets.to_numpy()) for x in (left, right))
        keep = [similar(va[oa[i] : oa[i + 1]], vb[ob[i] : ob[i + 1]]) for i in range(batch.num_rows)]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _linked_parts(batches):
    """Links that join different components within a block, or between two blocks, of one bucket: a forest of them.

    Looked at are pairs that were not compared with the bucket's hubs and whose sketches may agree, each in the first bucket that it shares.
    """
    for table, starts in whole_groups(batches, ["bucket", "i", "j"]):
        ids, parts, blk, i, j, lo, hi, bucket = (table.column(k).to_numpy() for k in ("id", "part", "blk", "i", "j", "lo", "hi", "bucket"))
        keys = table.column("keys").combine_chunks()
        keys = keys.values.to_numpy()[keys.offsets.to_numpy()[0] :][: len(ids) * BANDS].reshape(-1, BANDS)
        sketches, sets = coordinates(keys), table.column("x").combine_chunks()
        values, ends = sets.values.to_numpy().view(np.uint64), sets.offsets.to_numpy()
        sizes = np.diff(ends)
        out = []
        for at, end in zip(starts, np.append(starts[1:], len(ids)), strict=True):
            own = np.arange(at, end)
            left = own[blk[own] == i[at]]
            right = left if i[at] == j[at] else own[blk[own] == j[at]]
            root = {p: p for p in parts[at:end].tolist()}

            def find(p):
                while root[p] != p:
                    root[p] = root[root[p]]
                    p = root[p]
                return p

            for x in left:
                other = right[(parts[right] != parts[x]) & ((ids[right] > ids[x]) if i[at] == j[at] else True)]
                if ids[x] in (lo[x], hi[x]) or not len(other):
                    continue
                other = other[(ids[other] != lo[x]) & (ids[other] != hi[x]) & (100 * np.minimum(sizes[other], sizes[x]) >= 75 * np.maximum(sizes[other], sizes[x]))]
                other = other[(sketches[other] == sketches[x]).sum(1) >= AGREE]
                same = keys[other] == keys[x]
                other = other[keys[x][same.argmax(1)] == bucket[x]]
                for y in other.tolist():
                    a, b = find(parts[x]), find(parts[y])
                    if a != b and similar(values[ends[x] : ends[x + 1]], values[ends[y] : ends[y + 1]]):
                        root[a] = b
                        out.append((ids[x], ids[y]))
        pairs = np.array(out, np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, k and h: the keys KEY, digest, n_shingles), and of each digest the least doc_id and the first key of its component."""
    texts = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    texts = texts.selectExpr("doc_id", "text", *(f"{sql} {name}" for name, sql in KEY.items()))
    rows = durable(texts.select("doc_id", "text", "h").mapInArrow(lean(_sketched), "doc_id long, h long, digest binary, n_shingles long, keys array<long>"))
    first = F.min(F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("k"), "h")).alias("first")
    nodes = rows.filter("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("label"), first, F.first("keys", ignorenulls=True).alias("keys"))
    nodes = durable(nodes.withColumn("id", F.monotonically_increasing_id()))
    entries = nodes.select("id", F.explode("keys").alias("bucket"))
    full = entries.groupBy("bucket").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo != hi")
    shared = durable(entries.join(full, "bucket").select("bucket", "id", "lo", "hi"))
    wanted = durable(nodes.select("id", "first.k", "first.h", "digest").join(shared.select("id").distinct(), "id", "left_semi"))
    small = wanted.count() <= BROADCAST_ROWS
    found = texts.join(F.broadcast(wanted) if small else wanted, ["k", "h"]).select("text", "id", "digest")
    sets = durable(found.mapInArrow(lean(_sets), "id long, x array<long>").dropDuplicates(["id"]))

    def verify(pairs: DataFrame) -> DataFrame:
        # the hub's set goes to its pairs first, so that the heavy rows are dealt by the other end
        out = pairs.filter("a != b").distinct().join(sets.withColumnsRenamed({"id": "a", "x": "x_a"}), "a")
        out = out.join(sets.withColumnsRenamed({"id": "b", "x": "x_b"}), "b").select("a", "b", "x_a", "x_b")
        return out.mapInArrow(_verified, "a long, b long")

    roots = components(verify(shared.select(F.col("lo").alias("a"), F.col("id").alias("b"))))
    for last in (False, True):
        part = shared.select("bucket", "id", "lo", "hi") if roots is None else shared.join(roots.withColumnRenamed("node", "id"), "id", "left")
        part = part.withColumn("part", F.coalesce("root", "id")) if roots is not None else part.withColumn("part", F.col("id"))
        split = part.groupBy("bucket").agg(F.min("part").alias("least"), F.max("part").alias("most"), F.count("*").alias("m"))
        split = split.filter(f"least != most and m > {3 if last else 2}").select("bucket", "m")
        open_ = durable(part.join(split, "bucket").select("bucket", "id", "lo", "hi", "part", "m"))
        if open_.isEmpty():
            break
        if not last:
            found = verify(open_.select(F.col("hi").alias("a"), F.col("id").alias("b")))
        else:
            dealt = open_.selectExpr("*", f"cast(ceil(m / {BLOCK}) as int) blocks").selectExpr("*", "cast(pmod(xxhash64(id, bucket), blocks) as int) blk")
            dealt = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o")).withColumns({"i": F.least("blk", "o"), "j": F.greatest("blk", "o")})
            dealt = dealt.drop("m", "blocks", "o").join(nodes.select("id", "keys"), "id").join(sets, "id")
            dealt = dealt.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "id")
            found = dealt.mapInArrow(_linked_parts, "a long, b long")
        roots = merged(roots, found)
    names = nodes.select("digest", "id", "label", "first")
    if roots is not None:
        names = durable(names.join(roots.withColumnRenamed("node", "id"), "id", "left").select("digest", F.coalesce("root", "id").alias("root"), "label", "first"))
        names = names.select("digest", "root").join(names.groupBy("root").agg(F.min("label").alias("label"), F.min("first").alias("first")), "root")
    return rows.selectExpr("doc_id", f"coalesce(doc_id, {NO_ID}) k", "h", "digest", "n_shingles"), names.select("digest", "label", "first")


def link(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row."""
    rows, names = grouped(docs)
    out = rows.join(names, "digest", "left").select("doc_id", "n_shingles", F.coalesce("label", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, with all their columns, but of each component only the one of least doc_id (then least text hash).

    Of rows that are equal in doc_id and text one stays; texts without words all stay.
    """
    rows, names = grouped(docs)
    rows = durable(rows.filter("digest is not null").join(names, "digest").selectExpr("k", "h", "k = first.k and h = first.h own"))
    left = without(keyed(docs, **KEY), rows.filter("not own"), ["k", "h"])
    again = durable(rows.filter("own").groupBy("k", "h").count().filter("count > 1").select("k", "h"))
    if again.isEmpty():
        return left.select("doc.*")
    hint = F.broadcast if again.count() <= BROADCAST_ROWS else (lambda x: x)
    twice = left.join(hint(again), ["k", "h"], "left_semi").dropDuplicates(["k", "h"])
    return left.join(hint(again), ["k", "h"], "left_anti").unionByName(twice).select("doc.*")


def query(spark, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents"))
