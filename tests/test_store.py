"""Queues, the store, state and snapshots."""

import hashlib
import json
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomfold.operators import duplicates, filters, queue, store

NOW = "2024-01-01 00:00:00"
JOB = "id long, operation string, chunk_id string, page_id string, model_version string, status string, attempts int, available_at timestamp, leased_by string, lease_expires_at timestamp, generation long, replay_required boolean"
CHUNK = "chunk_id string, page_id string, text string, content_hash string"


def job(i, status="pending", attempts=0, available="2023-01-01", by=None, expires=None, generation=1, replay=False, chunk=None, model="m"):
    return (i, "upsert", chunk or f"c{i}", f"p{i % 2}", model, status, attempts, available, by, expires, generation, replay)


def jobs(spark, *rows):
    shape = JOB.replace("timestamp", "string")
    return spark.createDataFrame(list(rows), shape).withColumns({c: F.col(c).cast("timestamp") for c in ("available_at", "lease_expires_at")})


def test_lease_retry_and_death(spark):
    table = jobs(spark, job(1), job(2, available="2025-01-01"), job(3, "leased", by="w", expires="2023-06-01"), job(4, "leased", by="w", expires="2024-06-01"), job(5, "dead"), job(6, model="other"))
    assert [r.id for r in queue.lease(table, "me", 5, NOW, model="m").orderBy("id").collect()] == [1, 3]
    leased = queue.lease(table, "me", 1, NOW).first()
    assert (leased.id, leased.status, leased.leased_by) == (1, "leased", "me")
    held = jobs(spark, *[job(i, "leased", attempts=i, by="w", expires="2024-06-01") for i in range(6)])
    failed = queue.fail(held, spark.createDataFrame([(i, "w" if i != 2 else "x", "e" * 5000) for i in range(6)], "id long, worker string, error string"), NOW).orderBy("id").collect()
    assert [r.status for r in failed] == ["pending", "pending", "leased", "pending", "dead", "dead"] and len(failed[0].last_error) == 2000
    assert [(r.available_at - failed[4].available_at).total_seconds() for r in failed if r.id in (0, 1, 3)] == [5, 10, 40]


def test_completion_and_replay(spark):
    table = jobs(spark, job(1, "leased", by="w", generation=2), job(2, "leased", by="w", generation=2, replay=True), job(3, "completed", generation=3), job(4, "leased", by="w", generation=3))
    done = spark.createDataFrame([(1, "w", 2), (2, "w", None), (3, "w", 3), (4, "w", 2)], "id long, worker string, generation long")
    assert [r.status for r in queue.complete(table, done, NOW).orderBy("id").collect()] == ["completed", "pending", "completed", "leased"]
    assert [r.current for r in queue.current(table, done).orderBy("id").collect()] == [True, False, False, False]
    after = queue.require_replay(table, spark.createDataFrame([(3, 2), (4, 2), (1, 2)], "id long, generation long"), NOW).orderBy("id").collect()
    assert [(r.status, r.replay_required) for r in after] == [("leased", False), ("leased", True), ("pending", False), ("leased", True)]


def test_enqueue_raises_the_generation(spark):
    table = jobs(spark, job(1, "completed", attempts=3, by="w", replay=True))
    asked = spark.createDataFrame([(1, "upsert", "c1", "p", "m"), (2, "delete", "c1", "p", "m"), (1, "upsert", "new", "p", "m")], "seq int, operation string, chunk_id string, page_id string, model_version string")
    got = {r.chunk_id: r for r in queue.enqueue(table, asked, NOW).collect()}
    assert (got["c1"].operation, got["c1"].generation, got["c1"].status, got["c1"].attempts, got["c1"].leased_by, got["c1"].replay_required) == ("delete", 3, "pending", 0, None, False)
    assert got["new"].generation == 1 and got["new"].id is None


def test_events_of_a_page_keep_their_order(spark):
    table = jobs(spark, job(1, "leased", by="w", expires="2024-06-01"), job(3), job(2), job(4), job(6, "completed"))
    assert [r.id for r in queue.lease_events(table, "me", 9, NOW).collect()] == [2]
    assert queue.status_counts(table.limit(0), NOW).first().asDict() == {"pending": 0, "leased": 0, "completed": 0, "dead": 0, "due": 0}
    assert queue.event_metrics(table.withColumn("created_at", F.lit("2025-01-01").cast("timestamp")), NOW).first().oldest_age_seconds == 0


def test_replace_and_tombstone(spark):
    pages = spark.createDataFrame([("p", "S", "t", "u", "", 1, None, "", "")], store.PAGE).withColumn("deleted_at", queue.at(NOW))
    chunks = spark.createDataFrame([("a", "p", "x", "h"), ("b", "p", "y", "h"), ("z", "q", "z", "h")], CHUNK)
    new = spark.createDataFrame([("b", "p", "new", "wrong"), ("c", "p", "c", "wrong")], CHUNK)
    p, c, j = store.replace_pages(pages, chunks, jobs(spark, job(9)), pages, new, "m", NOW)
    assert p.first().deleted_at is None and {r.chunk_id for r in c.collect()} == {"b", "c", "z"}
    import hashlib

    assert c.filter("chunk_id = 'b'").first().content_hash == hashlib.sha256(b"new").hexdigest()
    assert {(r.chunk_id, r.operation) for r in j.collect()} == {("c9", "upsert"), ("a", "delete"), ("b", "upsert"), ("c", "upsert")}
    with pytest.raises(Exception, match="twice"):
        store.replace_pages(pages, chunks, jobs(spark, job(9)), pages, new.union(new), "m", NOW)[1].collect()
    p, c, j = store.tombstone_pages(pages.withColumn("deleted_at", F.lit(None).cast("timestamp")), chunks, jobs(spark, job(9)), pages.select("page_id"), "m", NOW)
    assert p.first().deleted_at is not None and c.count() == 1 and j.filter("operation = 'delete'").count() == 2


def test_sync_moves_the_watermark_only_on_success(spark):
    state = spark.createDataFrame([("S", None, {"1": 3, "2": 1, "9": 1}, [], False)], "section string, last_sync timestamp, page_versions map<string,int>, inventory array<string>, ownership_known boolean")
    source = spark.createDataFrame([("1", 3, "2024-01-01"), ("2", 2, "2024-01-02"), ("3", 1, "2024-01-03")], "page_id string, version int, modified_at string").withColumn("modified_at", F.col("modified_at").cast("timestamp"))
    changed, stale, after = store.sync(state, source, "S", "2024-02-01 00:00:00", reconcile=True)
    assert {r.page_id for r in changed.collect()} == {"2", "3"} and stale.count() == 0  # the first inventory deletes nothing
    row = after.first()
    assert row.ownership_known and row.inventory == ["1", "2", "3"] and row.page_versions == {"1": 3, "2": 2, "3": 1, "9": 1} and row.last_sync is not None
    _, stale, last = store.sync(after, source, "S", "2024-03-01 00:00:00", reconcile=True)
    assert [r.page_id for r in stale.collect()] == ["9"] and "9" not in last.first().page_versions
    changed, _, same = store.sync(after, source, "S", "2024-03-01 00:00:00", succeeded=False)
    assert changed.count() == 0 and same.first().last_sync == row.last_sync


def test_state_migration(spark):
    shape = "section string, last_sync timestamp, page_versions map<string,int>, inventory array<string>, ownership_known boolean, split_from_global boolean"
    raw = spark.createDataFrame([("A", None, {"1": 1}, ["1"], None, True)], shape)
    got = {r.section: r for r in store.migrated(raw, ["A", "B"]).collect()}
    assert got["A"].inventory == [] and got["A"].page_versions == {} and not got["B"].ownership_known
    kept = store.migrated(raw.withColumn("split_from_global", F.lit(False)), ["A"]).first()
    assert kept.inventory == ["1"] and kept.ownership_known is False


def test_snapshots_swap_all_at_once(spark, tmp_path):
    snap = store.Snapshots(spark, str(tmp_path))
    first = snap.commit({"t": spark.range(3).toDF("x")}, None)
    second = snap.commit({"t": snap.read("t").filter("x > 0")}, first)
    assert snap.read("t").count() == 2 and snap.read("t", first).count() == 3 and snap.current() == second
    with pytest.raises(RuntimeError):
        snap.commit({"t": spark.range(1).toDF("x")}, first)
    aliases = spark.createDataFrame([("live", "c1")], "alias string, collection string")
    moved, before = store.promote(aliases, "live", "c2", ["c1", "c2"])
    assert before == "c1" and moved.first().collection == "c2"
    with pytest.raises(ValueError):
        store.promote(moved, "live", "c1", ["c1"], expected="c3")
    with pytest.raises(ValueError):
        store.promote(moved, "live", "c9", ["c1"])
    targets = spark.createDataFrame([("m", "r", 8, "reg")], "model_version string, provider_runtime string, dimensions int, collection_name string")
    assert store.active_collection(aliases, targets, "live", "m").first().collection == "c1" and store.active_collection(aliases, targets, "none", "m").first().collection == "reg"
    with pytest.raises(Exception, match="no collection"):
        store.active_collection(aliases, targets, "none", "x").collect()
    assert store.register_target(targets, "m", "r2", 4, "c").collect()[0].dimensions == 4


def test_local_lock(tmp_path):
    path = str(tmp_path / "lock")
    assert store.local_lock(path, 60, 0, "a") and not store.local_lock(path, 60, 10, "b") and store.local_lock(path, 60, 10, "a") and store.local_lock(path, 60, 100, "b")
    assert json.load(open(path))["owner"] == "b"


def test_index_step_embeds_each_text_once(spark):
    chunks = spark.createDataFrame([("a", "h1", "t"), ("b", "h1", "t"), ("c", "h2", "u")], "chunk_id string, content_hash string, text string")
    cache = spark.createDataFrame([("h2", "m", [9.0], "")], "content_hash string, model_version string, vector array<double>, provider_runtime string")
    old = spark.createDataFrame([("a", "old", "m", [0.0]), ("gone", "x", "m", [0.0]), ("keep", "x", "m", [0.0])], "chunk_id string, content_hash string, model_version string, vector array<double>")
    leased = spark.createDataFrame([("upsert", "a", "m"), ("upsert", "b", "m"), ("upsert", "c", "m"), ("upsert", "missing", "m"), ("delete", "gone", "m")], "operation string, chunk_id string, model_version string")
    seen = []

    def embed(rows):
        seen.append(rows.count())
        return rows.select("content_hash", F.array(F.lit(1.0)).alias("vector"))

    after, held = store.index_step(leased, chunks, cache, old, embed)
    assert {r.chunk_id: r.vector[0] for r in after.collect()} == {"a": 1.0, "b": 1.0, "c": 9.0, "keep": 0.0} and seen == [1] and held.count() == 2


def test_near_signatures_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(-(2**63), 2**63, 60)
    rows = set(base.tolist())
    for x in base.tolist():
        for _ in range(4):
            y = x
            for bit in rng.choice(64, int(rng.integers(1, 8)), replace=False):
                y ^= 1 << int(bit)
            rows.add(y - (1 << 64) if y >= 1 << 63 else y)
    rows = [((x + (1 << 63)) % (1 << 64)) - (1 << 63) for x in rows]
    df = spark.createDataFrame([(x,) for x in sorted(set(rows))], "signature long")
    every = sorted(set(rows))
    for most in (0, 1, 3, 6, 12):
        want = {(a, b) for i, a in enumerate(every) for b in every[i + 1 :] if bin((a ^ b) & (2**64 - 1)).count("1") <= most}
        got = [(r.a, r.b) for r in duplicates.near_signatures(df, most).collect()]
        assert len(got) == len(set(got)) and set(got) == want, most
    with pytest.raises(ValueError):
        duplicates.near_signatures(df, 65)


def test_tables_of_near_signatures_are_not_broadcast(spark):
    """Their 20 rows for each signature look like one to the planner; as a broadcast they filled the driver."""
    near = duplicates.near_signatures(spark.range(2000).selectExpr("id * 1048583 signature").distinct())
    assert all(0 < r.distance <= 3 for r in near.collect())
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan and "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


def test_near_links_broadcast_no_tables(spark):
    rows = spark.range(600).selectExpr("cast(id as string) chunk_id", "'p' page_id", "concat('one two three four five six ', id div 2, ' seven eight nine ten ', id % 2) text")
    links = duplicates.near_links(rows)
    assert len(links.collect()) == 600
    plan = links._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "SortMergeJoin [t#" in plan and "BroadcastHashJoin [t#" not in plan


def test_report_meets_once_and_broadcasts_no_tables(spark):
    rows = spark.range(600).selectExpr("cast(id as string) chunk_id", "'p' page_id", "concat('one two three four five six ', id div 4, ' seven eight nine ten ', repeat(' ', id % 3), id % 2) text").unionByName(spark.createDataFrame([("x", "p", None), ("y", "q", "")], "chunk_id string, page_id string, text string"))
    report = duplicates.report(rows)
    found = [(r.fingerprint, r.bytes, r.signature) for r in duplicates.simhash(rows).collect()]
    pairs = [min(a[1], b[1]) for i, a in enumerate(found) for b in found[:i] if a[0] != b[0] and ((a[2] ^ b[2]) & (2**64 - 1)).bit_count() <= 3]
    got = report.collect()
    assert [(r.chunks, r.near_pairs, r.near_savings) for r in got] == [(602, len(pairs), sum(pairs))] and pairs
    assert [(r.exact_groups, r.exact_savings) for r in got] == [tuple(duplicates.exact_groups(rows).agg(F.count("*"), F.sum("savings")).first())]
    plan = report._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("SortMergeJoin [t#") == 1 and "BroadcastHashJoin [t#" not in plan


def test_filters(spark):
    rows = spark.createDataFrame([("1", "A", "x"), ("2", "B", None)], "chunk_id string, section string, title string")
    assert [r.chunk_id for r in filters.metadata_filter(rows, {"title": "x"}, ["A"]).collect()] == ["1"]
    with pytest.raises(ValueError):
        filters.metadata_filter(rows, {"chunk_id": "1"})
    ips = spark.createDataFrame([("10.1.2.3",), ("11.0.0.1",), ("10.1.2",), ("10.1.2.999",), (None,), ("010.1.2.3",)], "ip string")
    assert [r.x for r in ips.select(filters.in_networks(F.col("ip"), ["10.0.0.0/8"]).alias("x")).collect()] == [True, False, False, False, False, False]
    assert filters.point_ids(F.lit("abc"), "x:") is not None
    import uuid

    assert rows.select(filters.point_ids(F.col("chunk_id"), "x:").alias("p")).first().p == str(uuid.uuid5(uuid.NAMESPACE_URL, "x:1"))
    assert rows.select(filters.event_kind(F.lit(" PAGE_Trashed ")).alias("k")).first().k == "delete"


def test_renumbering_is_gapless_at_size(spark):
    """Range bounds come from samples, which two runs of one plan draw anew: the numbers must not rest on them."""
    index = spark.range(0, 400_000, 1, 8).selectExpr("(id * 7919) % 400000 n", "cast(id % 100 as string) page_id", "id chunk_id")
    pages = spark.createDataFrame([("3",), ("5",), ("absent",)], "page_id string")
    out = store.keep_and_append(index, index, pages).toPandas().sort_values("n")
    assert out.n.tolist() == list(range(400_000))
    old = (out.chunk_id * 7919 % 400_000).tolist()
    assert all(a < b for a, b in zip(old[:391_999], old[1:392_000], strict=True)) and set(out.page_id[392_000:]) == {"3", "5"} and old[392_000:] == sorted(old[392_000:])


def test_long_errors_are_cut_and_not_broadcast(spark):
    """Texts that compress well look small to the planner; as a broadcast they filled the driver."""
    jobs = spark.range(2000).selectExpr("id", "'leased' status", "0 attempts", "cast(null as timestamp) available_at", "'w' leased_by", "cast(null as timestamp) lease_expires_at")
    failed = spark.range(2000).selectExpr("id", "'w' worker", "repeat('failed ', 1000) error")
    out = queue.fail(jobs, failed, "2024-01-01 00:00:00")
    assert {(r.status, r.attempts, len(r.last_error)) for r in out.collect()} == {("pending", 1, 2000)}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan and "BroadcastHashJoin" not in plan


def test_all_near_members_are_counted_without_pairs(spark, monkeypatch):
    monkeypatch.setattr(duplicates, "ROWS", 16)
    rng = np.random.default_rng(3)
    signatures = np.unique(np.concatenate([rng.integers(-(1 << 63), (1 << 63) - 1, 30), rng.integers(0, 1 << 14, 60), [-1]]))
    sizes = {int(x): 1 + i % 3 for i, x in enumerate(signatures)}
    classes = spark.createDataFrame(list(sizes.items()), "signature long, members long")
    want = {a: sum(n for b, n in sizes.items() if a != b and ((a ^ b) & (2**64 - 1)).bit_count() <= 14) for a in sizes}
    for most in (14, 3):
        got = {r.signature: r.near for r in duplicates.near_members(classes, most).collect()}
        assert most == 3 or got == {a: n for a, n in want.items() if n}
        assert most == 14 or got == {a: m for a in sizes if (m := sum(n for b, n in sizes.items() if a != b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3))}


def test_votes_hold_no_string_for_each_token():
    rng = np.random.default_rng(3)
    words = np.array([f"word{i}" for i in range(60_000)])
    texts = pa.array([words[rng.integers(0, 60_000, n)].tolist() for n in [0, 1, 2, *[200] * 5000]], pa.list_(pa.string()))
    tracemalloc.start()
    got = duplicates._votes(texts).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20
    for at in (0, 1, 2, 1500, 5002):
        sums = np.zeros(64, int)
        for t in texts[at].as_py():
            sums += np.unpackbits(np.frombuffer(hashlib.sha256(t.encode()).digest()[:8], np.uint8)).astype(int) * 2 - 1
        assert got[at] == int.from_bytes(np.packbits(sums >= 0).tobytes(), "big", signed=True)
