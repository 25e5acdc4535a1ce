"""Evaluation of retrieval (B12, C11, C12, D12-D16, E6, F8, H12, H13) and promotion gates."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomfold.functions.text import text_or_empty

#: Sides that meet at once when a query set is compared with a corpus.
ROWS, QUERIES = 4096, 512


def checked_golden(golden: DataFrame) -> DataFrame:
    """Golden queries (id, query, section?, page_ids, title_contains, answer_contains), or an error when the job runs: no id twice, each
    with at least one assertion, none of them blank or a placeholder."""
    lists = ("page_ids", "title_contains", "answer_contains")
    every = F.concat(*[F.coalesce(c, F.array().cast("array<string>")) for c in lists])
    bad = F.exists(every, lambda x: (F.trim(x) == "") | F.lower(x).contains("placeholder") | x.startswith("<") & x.endswith(">"))
    twice = F.count("*").over(Window.partitionBy("id")) > 1
    why = F.when(twice | (F.coalesce("id", F.lit("")) == ""), "ids must be unique and not empty").when(F.size(every) == 0, "a query has no assertion").when(bad, "an assertion is blank or a placeholder")
    return golden.withColumn("why", why).filter(F.when(F.col("why").isNull(), True).otherwise(F.raise_error(F.col("why")).cast("boolean"))).drop("why")


def relevance(chunks: DataFrame, golden: DataFrame) -> DataFrame:
    """query_id, chunk_id of the records that match a golden query (B12): page in page_ids, or title or text holding one of the texts,
    whatever the case. A query with a section meets only that section (C11). The golden set is compared with every record, in one pass."""
    def any_in(texts, c):
        return F.exists(F.coalesce(texts, F.array().cast("array<string>")), lambda x: F.lower(text_or_empty(F.col(c))).contains(F.lower(x)))

    g = golden.select(F.col("id").alias("query_id"), F.col("section").alias("only") if "section" in golden.columns else F.lit(None).cast("string").alias("only"), "page_ids", "title_contains", "answer_contains")
    match = F.coalesce(F.array_contains("page_ids", F.col("page_id")), F.lit(False)) | any_in(F.col("title_contains"), "title") | any_in(F.col("answer_contains"), "text")
    return chunks.join(g, F.coalesce(F.col("only") == F.col("section"), F.lit(True)) & match).select("query_id", "chunk_id")


def metrics(rankings: DataFrame, relevant: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """One row (D12, E6): recall_at_k, mrr, overlap_at_k, queries_evaluated, queries_total.

    `rankings`: query_id, chunk_id, rank (from 1); `relevant`: query_id, chunk_id; `queries`: query_id. The first relevant rank counts within k
    only. Queries without relevant records count in queries_total only.
    """
    top = rankings.filter(F.col("rank") <= k)
    wanted = relevant.distinct().groupBy("query_id").agg(F.count("*").alias("n"))
    shown = top.groupBy("query_id").agg(F.countDistinct("chunk_id").alias("shown"))
    hits = top.join(relevant.distinct(), ["query_id", "chunk_id"]).groupBy("query_id").agg(F.countDistinct("chunk_id").alias("hits"), F.min("rank").alias("first"))
    by = queries.select("query_id").distinct().join(wanted, "query_id", "left").join(shown, "query_id", "left").join(hits, "query_id", "left").fillna(0, ["n", "shown", "hits"])
    use = F.col("n") > 0
    mean = {"recall_at_k": F.col("hits") / F.col("n"), "mrr": F.coalesce(1 / F.col("first"), F.lit(0.0)), "overlap_at_k": F.col("hits") / (F.col("n") + F.col("shown") - F.col("hits"))}
    return by.agg(*[F.round(F.coalesce(F.avg(F.when(use, x)), F.lit(0.0)), 6).alias(c) for c, x in mean.items()], F.count_if(use).alias("queries_evaluated"), F.count("*").alias("queries_total"))


def dot_rankings(corpus: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, chunk_id, rank by dot product, ties by chunk_id descending (F8, H12). Both: id, section, vector; a query's section (null:
    all) limits its corpus. Blocks of both meet, and each pair of blocks gives k rows for a query."""
    def pack(name, size, column):
        def run(frames):
            for f in frames:
                for at in range(0, len(f), size):
                    part = f.iloc[at : at + size]
                    yield pd.DataFrame({f"{name}_ids": [part[column].tolist()], f"{name}_sections": [part.section.tolist()], name: [np.array(part.vector.tolist(), np.float64).tobytes()]})

        return run

    shape = "{0}_ids array<string>, {0}_sections array<string>, {0} binary"
    c = corpus.filter("vector is not null").select("chunk_id", "section", "vector").mapInPandas(pack("c", ROWS, "chunk_id"), shape.format("c"))
    q = queries.filter("vector is not null").select("query_id", "section", "vector").mapInPandas(pack("q", QUERIES, "query_id"), shape.format("q"))

    def best(frames):
        for f in frames:
            for r in f.itertuples():
                ids, sections = np.array(r.c_ids, object), np.array(r.c_sections, object)
                order = np.argsort(ids)[::-1]
                ids, sections = ids[order], sections[order]
                scores = np.frombuffer(r.q).reshape(len(r.q_ids), -1) @ np.frombuffer(r.c).reshape(len(ids), -1)[order].T
                for query_id, only, row in zip(r.q_ids, r.q_sections, np.round(scores, 9), strict=True):
                    at = np.arange(len(ids)) if only is None else np.flatnonzero(sections == only)
                    at = at[np.argsort(-row[at], kind="stable")][:k]
                    yield pd.DataFrame({"query_id": query_id, "chunk_id": ids[at], "score": row[at]})

    found = c.crossJoin(q).mapInPandas(best, "query_id string, chunk_id string, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("chunk_id"))
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def gate(report: DataFrame, floors: dict[str, float] | None = None, baseline: dict[str, float] | None = None, most_degradation: float = 0.0, most_latency: float | None = None) -> DataFrame:
    """passed and failures (array) of a metrics row (D16): no query evaluated, some not evaluated, a metric below its floor or too far
    below the baseline, p95 latency (column latency_p95_ms) too high."""
    some, all_ = F.col("queries_evaluated"), F.col("queries_total")
    tests = [F.when(some == 0, F.lit("no golden query was evaluated")).when(some != all_, F.concat(some.cast("string"), F.lit(" of "), all_.cast("string"), F.lit(" golden queries have relevant records")))]
    for c in ("recall_at_k", "mrr", "overlap_at_k"):
        tests.append(F.when(F.col(c) < (floors or {}).get(c, 0.0), F.lit(f"{c} is below its floor")))
        if baseline is not None:
            tests.append(F.when(F.coalesce(F.lit(baseline.get(c)).cast("double"), F.col(c)) - F.col(c) > most_degradation, F.lit(f"{c} is too far below the baseline")))
    if most_latency is not None:
        tests.append(F.when(F.col("latency_p95_ms") > most_latency, F.lit("latency_p95_ms is too high")))
    failures = F.filter(F.array(*tests), lambda x: x.isNotNull())
    return report.select("*", (F.size(failures) == 0).alias("passed"), failures.alias("failures"))


def percentiles(rows: DataFrame, column: str, by: list[str], shares=(0.5, 0.95)) -> DataFrame:
    """Percentiles with linear interpolation (D13), p50, p95 and so on; 0 where a group holds no value."""
    return rows.groupBy(*by).agg(*[F.round(F.coalesce(F.percentile(column, p), F.lit(0.0)), 6).alias(f"p{round(p * 100)}") for p in shares])


def batch_stats(batches: DataFrame) -> DataFrame:
    """One row (D14) of timed batches (size, seconds): documents, duration_seconds, throughput, p50_ms and p95_ms of the seconds that a
    document took, each document of a batch an equal share."""
    each = batches.withColumn("each", F.col("seconds") / F.greatest("size", F.lit(1)))
    p = [F.round(F.coalesce(F.percentile("each", q, F.col("size")), F.lit(0.0)) * 1000, 6).alias(a) for q, a in ((0.5, "p50_ms"), (0.95, "p95_ms"))]
    total = F.coalesce(F.sum("seconds"), F.lit(0.0))
    docs = F.coalesce(F.sum("size"), F.lit(0)).cast("long")
    return each.agg(docs.alias("documents"), F.round(total, 6).alias("duration_seconds"), F.round(F.when(total > 0, docs / total).otherwise(0.0), 6).alias("throughput"), *p)


def identity(rows: DataFrame) -> Column:
    """The first of page_id, chunk_id, url and title that is not empty."""
    return F.coalesce(*[F.when(F.col(c).cast("string") != "", F.col(c).cast("string")) for c in ("page_id", "chunk_id", "url", "title") if c in rows.columns], F.lit(""))


def shadow(old: DataFrame, new: DataFrame, relevant: DataFrame, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Two backends side by side (C12, D15). `old`, `new`: query_id, id, rank (from 1); `relevant`: query_id, id. Returns one row for each
    query (overlap_at_k: common ids over k, rank_shift: sum of the rank differences of the common ids, old_quality and new_quality: 1 where
    a relevant id is shown), and the means of all queries."""
    a = old.filter(F.col("rank") <= k).groupBy("query_id", "id").agg(F.max("rank").alias("old_rank"))
    b = new.filter(F.col("rank") <= k).groupBy("query_id", "id").agg(F.max("rank").alias("new_rank"))
    both = a.join(b, ["query_id", "id"]).groupBy("query_id").agg(F.count("*").alias("common"), F.sum(F.col("new_rank") - F.col("old_rank")).alias("rank_shift"))
    out = queries.select("query_id").distinct().join(both, "query_id", "left")
    for side, name in ((old, "old_quality"), (new, "new_quality")):
        hit = side.join(relevant.distinct(), ["query_id", "id"], "left_semi").select("query_id").distinct().withColumn(name, F.lit(1.0))
        out = out.join(hit, "query_id", "left")
    each = out.select("query_id", (F.coalesce("common", F.lit(0)) / max(k, 1)).alias("overlap_at_k"), F.coalesce("rank_shift", F.lit(0)).alias("rank_shift"), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("old_quality", "new_quality")])
    means = each.agg(*[F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias(c) for c in ("overlap_at_k", "old_quality", "new_quality")])
    return each, means


def fake_vectors(rows: DataFrame, key: str, text: Column, dimensions: int = 8) -> DataFrame:
    """key, vector: unit vectors drawn from a generator that the text's digest seeds (H13). For tests: no model is loaded."""

    @F.pandas_udf("array<double>")
    def draw(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            rng = random.Random(int.from_bytes(hashlib.sha256(t.encode()).digest()[:8], "big"))
            v = [rng.uniform(-1, 1) for _ in range(dimensions)]
            length = sum(x * x for x in v) ** 0.5 or 1.0
            out.append([x / length for x in v])
        return pd.Series(out)

    return rows.select(key, draw(text).alias("vector"))


def manifest_diff(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """One row (C13): expected, actual, missing, extra and twice (rows of `actual` beyond the first of a kind). Same columns on both sides."""
    sides = expected.distinct().withColumns({"e": F.lit(1), "a": F.lit(0)}).unionByName(actual.withColumns({"e": F.lit(0), "a": F.lit(1)}))
    by = sides.groupBy(*expected.columns).agg(F.sum("e").alias("e"), F.sum("a").alias("a"))
    return by.agg(*[F.coalesce(x, F.lit(0)).cast("long").alias(c) for c, x in (("expected", F.sum("e")), ("actual", F.sum("a")), ("missing", F.sum(F.expr("if(e > 0 and a = 0, 1, 0)"))), ("extra", F.sum(F.expr("if(e = 0, 1, 0)"))), ("twice", F.sum(F.expr("greatest(a - 1, 0)"))))])


def promotion_failures(diff: DataFrame, unsettled: DataFrame, registered: str | None, collection: str, chunker_versions: DataFrame, chunker: str, dimensions: DataFrame, expected_dimensions: int | None) -> DataFrame:
    """One row (S21): failures (array) that keep a collection from being promoted. `dimensions`: dimensions of the points, distinct."""
    u = unsettled.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("open"))
    v = chunker_versions.agg(F.count_if(~F.col("chunker_version").eqNullSafe(F.lit(chunker))).alias("others"))
    d = dimensions.agg(F.count_if(~F.col("dimensions").eqNullSafe(F.lit(expected_dimensions))).alias("wrong"))
    tests = F.array(
        F.when(F.col("open") > 0, "the target's queue is not settled"),
        F.when(F.lit(registered != collection), "the target is not registered to the collection"),
        F.when(F.col("others") > 0, "the chunker's version is not the one asked for"),
        F.when(F.col("actual") != F.col("expected"), "the collection's count differs"),
        F.when(F.col("twice") > 0, "the collection holds an identity twice"),
        F.when((F.col("missing") > 0) | (F.col("extra") > 0), "the collection's identities differ"),
        F.when(F.lit(expected_dimensions is not None) & (F.col("wrong") > 0), "the vectors' dimensions differ"),
    )
    return diff.crossJoin(u).crossJoin(v).crossJoin(d).select(F.filter(tests, lambda x: x.isNotNull()).alias("failures"))


def promotion_allowed(report: DataFrame, floors: dict[str, float]) -> DataFrame:
    """allowed: the gate passed, at least one floor is above 0, and all queries were evaluated (S21). `report`: a row of gate()."""
    meaningful = any((floors or {}).get(c, 0) > 0 for c in ("recall_at_k", "mrr", "overlap_at_k"))
    return report.select((F.col("passed") & F.lit(meaningful) & (F.col("queries_evaluated") > 0) & (F.col("queries_evaluated") == F.col("queries_total"))).alias("allowed"))
