"""Operator 5, embedding near-dedup by lattice hashing.

Equal vectors of a label are one node with a multiplicity. TABLES random projections to eight dimensions, scaled by SCALE and
shifted, are decoded to the nearest E8 lattice point; the cell's hash with label and table is a bucket. A node lies in its home
cell and visits the PROBES next nearest cells (the decodings of the point moved towards the lattice's 240 least vectors that
bring it nearest). Nodes meet where one is at home and the other at home or visiting, and their cosine decides, in double precision.

Large buckets are split into blocks of BLOCK entries, and pairs of blocks are dealt one by one, so no task holds a bucket. Buckets lie side
by side in a partition and are compared many at a time. What leaves a task are link counts by node and a forest of its links, never all
pairs; a pair is counted by the first table in which it meets. A null vec_id is no smallest one unless there is no other.

Defined results: vectors that are null, zero, empty, or hold null or non-finite components, and rows with a null label, link with
nothing; different lengths never link; a null vec_id is kept; each row gives one row; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomfold.llm.common import durable, table, whole_groups
from loomfold.llm.components import components

TABLES, PROBES, SCALE, COSINE, BLOCK = 10, 6, 1.1, 0.93, 2048
#: Groups up to this size are paired by shifting all rows at once.
SMALL = 64


def d8(x: np.ndarray) -> np.ndarray:
    """Nearest points with integer coordinates of even sum."""
    r = np.rint(x)
    odd = (r.sum(1) % 2) != 0
    if odd.any():
        gap = x - r
        worst = np.abs(gap).argmax(1)
        at = np.flatnonzero(odd)
        r[at, worst[at]] += np.where(gap[at, worst[at]] >= 0, 1.0, -1.0)
    return r


def e8(x: np.ndarray) -> np.ndarray:
    """Nearest points of the E8 lattice: the nearer of D8 and D8 shifted by one half."""
    a, b = d8(x), d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


def least_vectors() -> np.ndarray:
    """The 240 least vectors of the lattice, by rule: two coordinates of one, or all of one half with an even number of minus signs."""
    out = []
    for i in range(8):
        for j in range(i):
            for a in (1.0, -1.0):
                for b in (1.0, -1.0):
                    v = np.zeros(8)
                    v[i], v[j] = a, b
                    out.append(v)
    out += [np.array([0.5 if m >> k & 1 else -0.5 for k in range(8)]) for m in range(256) if bin(m).count("1") % 2 == 0]
    return np.array(out)


STEPS = least_vectors()


def cells(vectors: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Bucket hashes, rows by table by (home, probes...)."""
    n, d = vectors.shape
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    rng = np.random.default_rng([11, d])
    out = np.empty((n, TABLES, PROBES + 1), np.uint64)
    weights = rng.integers(1, 2**63, 8).astype(np.uint64) | np.uint64(1)
    for t in range(TABLES):
        p = unit @ (rng.standard_normal((d, 8)) * SCALE) + rng.random(8) * 2
        home = e8(p)
        rest = p - home
        far = (STEPS**2).sum(1)[None, :] - 2 * rest @ STEPS.T
        near = np.argpartition(far, PROBES, axis=1)[:, :PROBES]
        points = np.concatenate([home[:, None, :], home[:, None, :] + STEPS[near]], axis=1)
        keys = (np.rint(points * 2).astype(np.int64).astype(np.uint64) * weights).sum(2)
        salt = label.astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(t * 1_000_003 + d)
        keys = (keys ^ salt[:, None]) * np.uint64(0xBF58476D1CE4E5B9)
        out[:, t] = keys ^ (keys >> np.uint64(31))
    return out


def _keyed(batches):
    """Buckets of each node, and its `body`: the low halves of its buckets (ends of 64-bit hashes), then the vector as it came."""
    for batch in batches:
        vectors = batch.column("v")
        values, offsets = vectors.values.to_numpy(zero_copy_only=False), vectors.offsets.to_numpy()
        node, mult, label = (batch.column(k).to_numpy() for k in ("node", "mult", "label"))
        lengths = np.diff(offsets)
        for d in np.unique(lengths):
            at = np.flatnonzero(lengths == d)
            v = values[offsets[at][:, None] + np.arange(d)]
            keys = cells(v.astype(np.float64), label[at]).reshape(len(at), -1)
            bodies = [k.tobytes() + x.tobytes() for k, x in zip(keys.astype(np.uint32), v, strict=True)]
            flat = pa.array(keys.view(np.int64).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * keys.shape[1]), flat)
            yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(mult[at]), pa.array(label[at]), pa.array(bodies, pa.binary()), lists], names=["node", "mult", "label", "body", "keys"])


def _candidates(group: np.ndarray, starts: np.ndarray, blk: np.ndarray, cross: np.ndarray, home: np.ndarray):
    """Pairs of rows of one group with a home among them; rows of different blocks where the group is a pair of blocks."""
    sizes = np.diff(np.append(starts, len(group)))

    def fit(a, b):
        ok = (home[a] | home[b]) & (~cross[a] | (blk[a] != blk[b]))
        return a[ok], b[ok]

    small = sizes[group] <= SMALL
    for step in range(1, int(min(SMALL, sizes.max()))):
        a = np.flatnonzero((group[:-step] == group[step:]) & small[:-step])
        if len(a):
            yield fit(a, a + step)
    for at, size in zip(starts[sizes > SMALL], sizes[sizes > SMALL], strict=True):
        for lo in range(at, at + size, 256):
            a, b = np.meshgrid(np.arange(lo, min(lo + 256, at + size)), np.arange(at, at + size), indexing="ij")
            yield fit(a[a < b], b[a < b])


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least row that each of n rows reaches by the links a-b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _pairs(kind: str):
    """Links within one block, or between two blocks, of each bucket: counts by node, and a forest of them."""

    def run(batches):
        for table, _ in whole_groups(batches, ["bucket", "i", "j"], 32_768):
            lengths = pc.binary_length(table.column("body")).to_numpy()
            for size in np.unique(lengths):
                yield linked(table.filter(pa.array(lengths == size)))

    def linked(table):
        node, mult, label, bucket, tab, blk, i, j, home = (table.column(k).to_numpy() for k in ("node", "mult", "label", "bucket", "tab", "blk", "i", "j", "home"))
        body = np.frombuffer(b"".join(table.column("body").to_pylist()), np.uint8).reshape(len(node), -1)
        width = 4 * TABLES * (PROBES + 1)
        keys = np.ascontiguousarray(body[:, :width]).view(np.uint32).reshape(len(node), TABLES, PROBES + 1)
        unit = np.ascontiguousarray(body[:, width:]).view(kind).astype(np.float64)
        unit /= np.linalg.norm(unit, axis=1)[:, None]
        change = np.ones(len(node), bool)
        change[1:] = (bucket[1:] != bucket[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        found = []
        for a, b in _candidates(np.cumsum(change) - 1, np.flatnonzero(change), blk, i != j, home):
            for lo in range(0, len(a), 65_536):
                x, y = a[lo : lo + 65_536], b[lo : lo + 65_536]
                near = np.einsum("ij,ij->i", unit[x], unit[y]) >= COSINE
                found.append(np.stack([x[near], y[near]]))
        a, b = np.concatenate(found, axis=1) if found else np.empty((2, 0), np.int64)
        # the first table where they meet, and there the home of the one that the other visits or lives in
        t, key = tab[a], bucket[a].astype(np.uint64).astype(np.uint32)
        meet_a, meet_b = (keys[a, :, :1] == keys[b]).any(2), (keys[b, :, :1] == keys[a]).any(2)
        met = meet_a | meet_b
        fresh = (node[a] != node[b]) & (label[a] == label[b]) & (met.argmax(1) == t)
        at = np.arange(len(a))
        ha, hb = keys[a, t, 0], keys[b, t, 0]
        by_a = meet_a[at, t] & (~meet_b[at, t] | (ha <= hb))
        fresh &= np.where(by_a, ha == key, hb == key)
        a, b = a[fresh], b[fresh]
        ends, at = np.unique(np.concatenate([node[a], node[b]]), return_inverse=True)
        links = np.bincount(at, np.concatenate([mult[b], mult[a]]), minlength=len(ends)).astype(np.int64)
        root = ends[_forest(at[: len(a)], at[len(a) :], len(ends))] if len(ends) else ends
        return pa.RecordBatch.from_arrays([pa.array(ends, pa.int64()), pa.array(links, pa.int64()), pa.array(root, pa.int64())], names=["node", "links", "other"])

    return run


def link(rows: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row."""
    kind, item = ("<f4", "float") if dict(rows.dtypes).get("embedding") == "array<float>" else ("<f8", "double")
    rows = rows.selectExpr("cast(vec_id as long) vec_id", "cast(label as long) label", f"cast(embedding as array<{item}>) v")
    good = f"label is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < {item}('Infinity')) and exists(v, x -> x != 0)"
    # equal vectors of a label share two 64-bit hashes
    rows = rows.withColumn("copy", F.expr(f"if({good}, xxhash64(label, v), null)")).withColumn("copy2", F.expr("if(copy is not null, xxhash64(v, label, 7L), null)"))
    groups = rows.filter("copy is not null").groupBy("copy", "copy2").agg(F.min("vec_id").alias("least"), F.count("*").alias("mult"), F.first("label").alias("label"), F.first("v").alias("v"))
    groups = durable(groups.withColumn("node", F.monotonically_increasing_id()))
    keyed = durable(groups.select("node", "mult", "label", "v").mapInArrow(_keyed, "node long, mult long, label long, body binary, keys array<long>"))
    entries = keyed.select("node", F.posexplode("keys").alias("p", "bucket")).selectExpr("node", "bucket", f"cast(p div {PROBES + 1} as int) tab", f"p % {PROBES + 1} = 0 home")
    sizes = entries.groupBy("bucket").agg(F.count("*").alias("m"), F.max("home").alias("lived")).filter("m > 1 and lived").select("bucket", "m")
    near = entries.join(sizes, "bucket").selectExpr("bucket", "tab", "node", "home", f"cast(ceil(m / {BLOCK}) as int) blocks")
    near = near.withColumn("blk", F.expr("cast(pmod(xxhash64(node, bucket), blocks) as int)"))
    near = near.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o")).select("bucket", "tab", "node", "home", "blk", F.least("blk", "o").alias("i"), F.greatest("blk", "o").alias("j"))
    near = near.join(keyed.select("node", "mult", "label", "body"), "node").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "node")
    found = durable(near.mapInArrow(_pairs(kind), "node long, links long, other long"))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.filter("node != other").select(F.col("node").alias("a"), F.col("other").alias("b")))
    nodes = groups.select("copy", "copy2", "node", "least", "mult").join(counts, "node", "left")
    if roots is not None:
        nodes = durable(nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
        nodes = nodes.drop("least").join(nodes.groupBy("root").agg(F.min("least").alias("least")), "root")
    out = rows.select("vec_id", "copy", "copy2").join(nodes.select("copy", "copy2", "mult", "links", "least"), ["copy", "copy2"], "left")
    out = out.select("vec_id", F.expr("if(mult is null, 0, coalesce(links, 0) + mult - 1)").alias("n_links"), F.coalesce("least", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def query(spark, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "embeddings"))
