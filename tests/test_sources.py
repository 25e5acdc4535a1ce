"""Sources, sinks, the webhook and the event stream."""

import hashlib
import hmac
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomfold.sources import index_files, jsonl, pages
from loomfold.streaming import events, webhook


def test_jsonl_round_trip(spark, tmp_path):
    (tmp_path / "in.jsonl").write_text('{"a": 1, "b": "x"}\n\n   \n{"a": 2, "b": null}\n')
    df = jsonl.read(spark, str(tmp_path / "in.jsonl"), "a long, b string")
    jsonl.write(df, str(tmp_path / "out"))
    assert sorted(map(tuple, jsonl.read(spark, str(tmp_path / "out"), "a long, b string").collect())) == [(1, "x"), (2, None)]
    # a folder may be replaced by what was read from it
    jsonl.write(jsonl.read(spark, str(tmp_path / "out"), "a long, b string").filter("a = 2"), str(tmp_path / "out"))
    assert [r.a for r in jsonl.read(spark, str(tmp_path / "out"), "a long").collect()] == [2]
    assert [p.name for p in tmp_path.iterdir() if "out" in p.name] == ["out"]


def test_jsonl_broken_line_fails(spark, tmp_path):
    (tmp_path / "in.jsonl").write_text('{"a": 1}\n{"a": \n')
    with pytest.raises(Exception, match="(?i)malformed"):
        jsonl.read(spark, str(tmp_path / "in.jsonl"), "a long").collect()


def test_small_files(tmp_path):
    path = tmp_path / "d" / "x.json"
    jsonl.write_file(str(path), {"a": "é"})
    assert json.loads(path.read_text()) == {"a": "é"}
    with pytest.raises(TypeError):
        jsonl.write_file(str(path), {"a": object()})
    jsonl.write_file(str(path), b"b")
    assert path.read_bytes() == b"b" and len(list(path.parent.iterdir())) == 1


def test_paginated_source(spark, tmp_path, monkeypatch):
    (tmp_path / "fake_wiki.py").write_text(
        "class Wiki:\n    def __init__(self, **o): pass\n"
        "    def make(self, i): return {'id': i, 'title': f't{i}', 'version': {'number': i, 'when': '2024-01-%02dT00:00:00Z' % (1 + i % 28)}, 'ancestors': [{'id': 's', 'title': 'S'}], 'body': {'storage': {'value': '<p>x</p>'}}}\n"
        "    def search(self, section, since, start, limit): return [self.make(i) for i in range(start, min(start + limit, 120))] + ([self.make(0)] if start + limit > 120 else [])\n"
        "    def page(self, page_id): return self.make(999) if page_id == 'S' else self.make(int(page_id)) if page_id != 'none' else None\n"
    )
    spark.sparkContext.addPyFile(str(tmp_path / "fake_wiki.py"))
    monkeypatch.syspath_prepend(str(tmp_path))
    got = pages.read(spark, ["S"], transport="fake_wiki:Wiki")
    assert got.count() == 121 and got.filter("page_id = '999'").first().title == "t999"
    assert pages.read(spark, ["S"], "2024-12-01 00:00", transport="fake_wiki:Wiki").filter("page_id = '999'").count() == 0
    assert [r.page_id for r in pages.read_pages(spark, ["7", "none"], transport="fake_wiki:Wiki").collect()] == ["7"]
    assert pages.dates(got).filter("modified_at is null").count() == 0


def test_matrix_and_its_checks(spark, tmp_path):
    np.save(tmp_path / "m.npy", np.arange(12, dtype=np.float32).reshape(4, 3))
    vectors = index_files.read_matrix(spark, str(tmp_path / "m.npy"))
    assert {r.n: r.vector for r in vectors.collect()}[3] == [9.0, 10.0, 11.0]
    chunks = spark.createDataFrame([(i, "S", "p", f"t{i % 3}", None, None, None, None, None) for i in range(4)], "n long, section string, page_id string, text string, chunk_id string, chunk_index int, duplicate_ordinal int, chunker_version string, schema_version string")
    problem = lambda index, model, d: index_files.matrix_problems(index, chunks, vectors, model, "m", d).first().problem
    assert problem(chunks, "m", 3) is None and "model" in problem(chunks, "x", 3) and "row count" in problem(chunks.limit(2), "m", 3) and "dimension" in problem(chunks, None, 4)
    assert "metadata" in problem(chunks.withColumn("text", F.lit("t")), "m", 3)
    legacy = index_files.legacy_chunks(chunks)
    assert legacy.select("chunk_id").distinct().count() == 4 and {r.chunker_version for r in legacy.collect()} == {"legacy"}
    cache = index_files.legacy_cache(chunks.withColumn("content_hash", F.sha2("text", 256)), vectors, "m")
    assert cache.count() == 3
    index_files.write_index(legacy, cache.join(legacy.select("chunk_id", "content_hash"), "content_hash").select("chunk_id", "vector"), str(tmp_path / "ix"), "m")
    assert spark.read.parquet(str(tmp_path / "ix/meta")).first().total_chunks == 4
    assert index_files.snapshot(spark, cache, str(tmp_path), "one") and spark.read.parquet(str(tmp_path / "snapshots/one")).count() == 3
    with pytest.raises(Exception, match="(?i)exists"):
        index_files.snapshot(spark, cache, str(tmp_path), "one")


def test_webhook(spark):
    body = json.dumps({"eventType": "page_updated", "page": {"id": 7}, "deliveryId": "d"}).encode()
    sign = lambda b: "sha256=" + hmac.new(b"k", b, hashlib.sha256).hexdigest()
    none, big, odd = b'{"eventType": "page_updated", "page": {"id": 7}}', b"x" * 300_000, json.dumps({"eventType": "x", "page": {"id": 7}, "deliveryId": "d"}).encode()
    rows = [
        (1, body, {"X-Hub-Signature-256": sign(body)}, "10.0.0.1", None), (2, body, {"x-hub-signature": sign(body).upper()}, "10.0.0.1", None), (3, body, {"X-Hub-Signature-256": "bad"}, "10.0.0.1", "invalid_signature"),
        (4, body, None, "10.0.0.1", "invalid_signature"), (5, body, {"X-Hub-Signature-256": sign(body)}, "11.0.0.1", "source_not_allowed"), (6, big, {}, "10.0.0.1", "payload_too_large"),
        (7, b"[1]", {"X-Webhook-Signature": sign(b"[1]")}, "10.0.0.1", "invalid_payload"), (8, b"{", {"X-Webhook-Signature": sign(b"{")}, "10.0.0.1", "invalid_payload"), (9, odd, {"X-Webhook-Signature": sign(odd)}, "10.0.0.1", "unsupported_event_type"),
        (10, none, {"X-Webhook-Signature": sign(none)}, "10.0.0.1", "missing_event_identity"), (11, none, {"X-Webhook-Signature": sign(none), "X-Request-ID": "r", "X-Event-Key": "page_trashed"}, "10.0.0.1", None),
        (12, b"\xff{}", {"X-Webhook-Signature": sign(b"\xff{}")}, "10.0.0.1", "invalid_payload"),
    ]
    df = spark.createDataFrame([r[:4] for r in rows], "id int, body binary, headers map<string,string>, source string")
    got = {r.id: r for r in webhook.validated(df, "k", ["10.0.0.0/8"]).collect()}
    assert {i: r.error for i, r in got.items()} == {r[0]: r[4] for r in rows}
    assert (got[1].page_id, got[1].delivery_id, got[1].event_type, got[1]["class"]) == ("7", "d", "update", "FETCH") and (got[11].delivery_id, got[11].event_type) == ("r", "delete")
    assert {r.error for r in webhook.validated(df, "", None).filter("id = 1").collect()} == {"webhook_not_configured"}


def test_events_once_and_newest_wins(spark, tmp_path):
    schema = "delivery_id string, page_id long, version long, kind string, at timestamp"
    batches = [
        [("d1", 1, 1, "FETCH", "12:30"), ("d2", 1, 3, "FETCH", "12:30"), ("d2", 1, 3, "FETCH", "12:30"), ("d3", 2, 1, "FETCH", "12:30")], [("d1", 1, 1, "FETCH", "12:31"), ("d4", 1, 2, "FETCH", "12:32"), ("d5", 2, 2, "DELETE", "12:33")],
        [("d6", 3, 7, "FETCH", "09:00"), ("d7", 1, 9, "DELETE", "09:00")], [("d7", 1, 9, "DELETE", "23:00"), ("d3", 2, 1, "FETCH", "23:00")],
    ]
    import loomfold.streaming.events as module

    module.COMPACT = 2
    for rows in batches:
        spark.createDataFrame([(*r[:4], f"2024-01-01 {r[4]}:00") for r in rows], schema.replace("timestamp", "string")).withColumn("at", F.col("at").cast("timestamp")).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        events.ingest(spark.readStream.schema(schema).json(str(tmp_path / "in")), str(tmp_path / "store"), str(tmp_path / "ck")).awaitTermination(60)
    # late events count: page 3 is there, page 1 is deleted
    assert [tuple(r) for r in events.pages(spark, str(tmp_path / "store")).select("delivery_id", "page_id", "version").collect()] == [("d6", 3, 7)]
    assert spark.read.parquet(*[str(p) for p in (tmp_path / "store/deliveries").iterdir()]).count() == 7 and (tmp_path / "store/base").exists()
    module.COMPACT = 20


def test_events_applied_to_pages(spark):
    pages_ = spark.createDataFrame([(1, "S", 5, False), (2, "S", 1, False)], "page_id long, section string, version long, deleted boolean")
    new = spark.createDataFrame([(1, 4, "FETCH", "S"), (2, 9, "DELETE", None), (3, 1, "FETCH", "T"), (4, 1, "FETCH", None), (5, 1, "DELETE", None)], "page_id long, version long, kind string, section string")
    got = {r.page_id: (r.section, r.version, r.deleted, r.reconcile) for r in events.applied(pages_, new).collect()}
    assert got[1] == ("S", 5, False, False) and got[2][2] and got[3] == ("T", 1, False, False) and got[4][3] and got[5][3]
