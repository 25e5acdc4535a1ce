"""Hybrid search, ranks and evaluation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomfold.operators import evaluate, ranking, search, sparse, toolkits

CHUNK = "chunk_id string, page_id string, section string, title string, breadcrumbs string, text string, chunk_index int, duplicate_ordinal int, content_type string"
PAGE = "page_id string, section string, title string, url string, breadcrumbs string, deleted_at timestamp, parent_text string, source_text string"
CODE = "ПР_UDO_01.01.01"


@pytest.fixture(scope="module")
def tables(spark):
    chunks = [
        ("a1", "p1", "A", "One", "A > One", "architecture first", 0, 0, "prose"), ("a2", "p1", "A", "One", "A > One", "architecture second", 1, 0, "prose"),
        ("b1", "p2", "B", "Two", "", "architecture elsewhere", 0, 0, "table"), ("c1", "12365330", "A", f"{CODE} Управление договорной документацией", "", "contract docs", 0, 0, "prose"),
        ("c2", "28361577", "A", f'Этап 6_РЗ_{CODE} "Управление договорной документацией"', "", "review remarks", 0, 0, "prose"), ("d1", "99999999", "B", "Gone", "", "architecture gone", 0, 0, "prose"),
        ("e1", "p5", "B", "Five", "", "Путь: x\nЗаголовок: Five\n\nshared tail of this text, twenty and more", 0, 0, "prose"), ("e2", "p5", "B", "Five", "", "shared tail of this text, twenty and more, then new", 1, 0, "prose"),
    ]
    pages = [("p1", "A", "One", "u", "A > One", None, "canonical architecture document", ""), ("p2", "B", "Two", "u", "", None, "", "source body"), ("12365330", "A", chunks[3][3], "u", "", None, "", ""), ("28361577", "A", chunks[4][3], "u", "", None, "", ""), ("99999999", "B", "Gone", "u", "", "2024", "x", ""), ("p5", "B", "Five", "u", "", None, "", "")]
    c = spark.createDataFrame(chunks, CHUNK)
    p = spark.createDataFrame([(*r[:5], None, *r[6:]) for r in pages], PAGE).withColumn("deleted_at", F.when(F.col("page_id") == "99999999", F.lit("2024-01-01").cast("timestamp")))
    v = spark.createDataFrame([("a1", [1.0, 0.0]), ("a2", [0.9, 0.1]), ("b1", [0.0, 1.0]), ("c1", [-1.0, 0.0]), ("d1", [0.0, 0.0])], "chunk_id string, vector array<double>")
    return c, p, v


def ask(spark, *texts, vector=(1.0, 0.0)):
    return spark.createDataFrame([(i, t, list(vector)) for i, t in enumerate(texts)], "query_id long, query string, vector array<double>")


def test_hybrid_sections_and_parents(spark, tables):
    got = search.hybrid(*tables, ask(spark, "architecture"), 5, ["A"]).orderBy("rank").collect()
    assert [r.page_id for r in got if "architecture" in r.text] == ["p1"] and {r.section for r in got} == {"A"}
    assert got[0].text == "Путь: A > One\nЗаголовок: One\n\ncanonical architecture document"
    bare = search.hybrid(*tables, ask(spark, "architecture"), 1, use_parents=False).collect()
    assert [(r.page_id, r.chunk_id, r.text) for r in bare] == [("p1", "a1", "architecture first")]


def test_codes_and_page_ids_come_first(spark, tables):
    got = search.hybrid(*tables, ask(spark, f"{CODE} Управление договорной документацией роли", "pageId 28361577 architecture", "99999999"), 3, use_parents=False).orderBy("query_id", "rank").collect()
    by = {q: [(r.page_id, r.match) for r in got if r.query_id == q] for q in (0, 1, 2)}
    assert by[0][:2] == [("12365330", "title_identifier"), ("28361577", "title_identifier")] and by[1][0] == ("28361577", "page_id")
    assert not any(m == "page_id" for _, m in by[2])


def test_hybrid_checks_its_request(spark, tables):
    for k, filters in ((0, None), (101, None), (5, {"text": "x"}), (5, {"title": ""}), (5, {"title": "x" * 501})):
        with pytest.raises(ValueError):
            search.hybrid(*tables, ask(spark, "x"), k, None, filters)
    with pytest.raises(Exception, match="empty"):
        search.hybrid(*tables, ask(spark, " "), 5).collect()
    assert {r.chunk_id for r in search.full_text(tables[0], ask(spark, "architecture"), 5, None, {"content_type": "table"}).collect()} == {"b1"}


def test_phrases_and_conjunctions(spark):
    rows = [("1", "x b"), ("2", "b c x"), ("3", "a-b"), ("4", "b a"), ("5", "utr 01 utr"), ("6", "nothing")]
    chunks = spark.createDataFrame([(i, i, "S", "", "", t, 0, 0, "prose") for i, t in rows], CHUNK)

    def hits(query):
        return {r.chunk_id for r in search.full_text(chunks, spark.createDataFrame([(1, query)], "query_id int, query string"), 30).collect()}

    assert hits("a-b") == {"3"} and hits("a-b zzz") == {"1", "2", "3", "4"} and hits("UTR_01") == {"5"} and hits("b") == {"1", "2", "3", "4"} and hits("01 07") == set()
    parts = lambda q: spark.createDataFrame([(q,)], "q string").select(search.fts_parts(F.col("q")).alias("p")).first().p
    assert [(p.value, p.all) for p in parts("UTR_01.01.07.01")] == [("UTR_01.01.07.01", False)]
    assert [(p.value, p.all) for p in parts("SND-INT_197_DIP")] == [("SND-INT_197_DIP", False), ("SND", True), ("INT_197_DIP", True)]
    assert [p.value for p in parts("Report report 12 A_1.2 of")] == ["A_1.2", "Report", "A_1", "of"]


def test_bm25_by_hand(spark):
    from math import log

    chunks = spark.createDataFrame([(str(i), str(i), "S", "", "", t, 0, 0, "") for i, t in enumerate(["cat cat dog", "dog", "bird fish", "bird"])], CHUNK)
    got = {r.chunk_id: r.score for r in search.full_text(chunks, spark.createDataFrame([(1, "cat dog")], "query_id int, query string"), 9).collect()}
    mean = 7 / 4
    one = lambda f, n, length: max(log((4 - n + 0.5) / (n + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * length / mean))
    assert abs(got["0"] + one(2, 1, 3) + one(1, 2, 3)) < 1e-8 and abs(got["1"] + one(1, 2, 1)) < 1e-8


def test_parent_bodies(spark, tables):
    got = {r.page_id: r.text for r in search.parents(tables[1], tables[0]).collect()}
    assert got["p2"] == "Заголовок: Two\n\nsource body" and "99999999" not in got
    assert got["p5"] == "Заголовок: Five\n\nshared tail of this text, twenty and more\n, then new"


def test_fusion(spark):
    hits = spark.createDataFrame([(1, "x", "A", 1.0)], "query_id int, chunk_id string, section string, score double")
    sizes = spark.createDataFrame([("A", 3)], "section string, n long")
    assert abs(ranking.fuse(hits, hits, sizes, 1).first().score - 0.6 / 61) < 1e-12
    assert ranking.fuse(hits, hits.limit(0), sizes.limit(0), 1).count() in (0, 1)
    with pytest.raises(ValueError):
        ranking.fuse(hits, hits, sizes, 1, 0.0, 0.0)
    two = spark.createDataFrame([(1, "a", "A", 2.0), (1, "b", "A", 1.0), (1, "c", "B", 1.0)], "query_id int, id string, section string, score double")
    got = {r.id: r.section_rank for r in ranking.section_rank(two, spark.createDataFrame([("A", 2), ("B", 8)], "section string, n long")).collect()}
    assert got["a"] == 0 and abs(got["b"] - 3) < 1e-9 and got["c"] == 0


def test_retrieval_metrics(spark):
    ranks = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "x", 1), (2, "c", 2), (3, "q", 1), (4, "z", 1), (4, "y", 2), (4, "d", 3)], "query_id int, chunk_id string, rank int")
    relevant = spark.createDataFrame([(1, "a"), (1, "z"), (2, "c"), (4, "d")], "query_id int, chunk_id string")
    queries = spark.createDataFrame([(1,), (2,), (3,)], "query_id int")
    got = evaluate.metrics(ranks, relevant, queries, 2).first()
    assert (got.recall_at_k, got.mrr, got.queries_evaluated, got.queries_total) == (0.75, 0.75, 2, 3) and abs(got.overlap_at_k - (1 / 3 + 1 / 2) / 2) < 1e-6
    # a relevant record beyond k does not count
    assert evaluate.metrics(ranks, relevant, spark.createDataFrame([(4,)], "query_id int"), 2).first().mrr == 0
    gate = evaluate.gate(evaluate.metrics(ranks, relevant, queries, 2), {"recall_at_k": 0.8}).first()
    assert not gate.passed and len(gate.failures) == 2
    assert evaluate.metrics(ranks.limit(0), relevant, queries, 2).first().recall_at_k == 0


def test_golden_queries_are_checked(spark):
    shape = "id string, query string, page_ids array<string>, title_contains array<string>, answer_contains array<string>"
    good = ("1", "q", ["p"], None, None)
    assert evaluate.checked_golden(spark.createDataFrame([good], shape)).count() == 1
    for bad in [[good, good], [("2", "q", [], [], None)], [("2", "q", None, ["<x>"], None)], [("2", "q", None, None, ["a Placeholder"])], [("", "q", ["p"], None, None)]]:
        with pytest.raises(Exception, match="ids must|no assertion|blank or"):
            evaluate.checked_golden(spark.createDataFrame(bad, shape)).collect()


def test_shadow_and_promotion(spark):
    ranks = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "query_id int, id string, rank int")
    swapped = spark.createDataFrame([(1, "b", 1), (1, "a", 2)], "query_id int, id string, rank int")
    queries = spark.createDataFrame([(1,)], "query_id int")
    each, means = evaluate.shadow(ranks, swapped, ranks.select("query_id", "id").limit(1), queries, 2)
    assert each.first().overlap_at_k == 1.0 and each.first().rank_shift == 0 and means.first().new_quality == 1.0
    rows = spark.createDataFrame([("a", "h"), ("b", "h")], "chunk_id string, content_hash string")
    diff = evaluate.manifest_diff(rows, rows.union(rows.limit(1)))
    assert tuple(diff.first()) == (2, 3, 0, 0, 1)
    none = spark.createDataFrame([], "status string, n long")
    chunker, dims = spark.createDataFrame([("4",)], "chunker_version string"), spark.createDataFrame([(8,)], "dimensions int")
    ok = evaluate.promotion_failures(evaluate.manifest_diff(rows, rows), none, "c", "c", chunker, "4", dims, 8).first().failures
    bad = evaluate.promotion_failures(diff, spark.createDataFrame([("dead", 1)], "status string, n long"), "d", "c", chunker, "5", dims, 9).first().failures
    assert ok == [] and len(bad) == 6
    report = spark.createDataFrame([(True, 2, 2)], "passed boolean, queries_evaluated long, queries_total long")
    assert evaluate.promotion_allowed(report, {"mrr": 0.5}).first().allowed and not evaluate.promotion_allowed(report, {}).first().allowed


def test_evidence_pack(spark):
    topics = spark.createDataFrame([(1, " UDO ", ["UDO_01.01", " "])], "topic_id int, topic string, codes array<string>")
    asked = toolkits.evidence_queries(topics).collect()
    assert [r.bucket for r in asked] == ["decisions", "requirements", "process", "meetings", "template", "codes"] and asked[0].query.startswith("UDO UDO_01.01") and asked[5].query == "UDO_01.01"

    def find(queries, section):
        return queries.select("query_id", F.lit("p").alias("page_id"), F.lit("c").alias("chunk_id"), (F.length("query") / 100).alias("score"), F.lit(1).alias("rank"))

    got = toolkits.evidence_pack(topics, find).orderBy("merged_rank").collect()
    assert len(got) == 6 and got[0].score == max(r.score for r in got)


def test_scenario_score(spark):
    text = "# Сценарий\n## Шаги сценария\n| # | Действие | Ожидание | Источник |\n|---|---|---|---|\n| 1 | a | b | page_id: 123456 |\n| 2 | c | d | НЕ НАЙДЕНО |\n| 3 | e | f | - |\n| 4 | - | — | |\n\n## Прочее\n| 1 | x | y | 999999 |\n"
    got = toolkits.scenario_scores(spark.createDataFrame([(1, text), (2, None)], "scenario_id int, text string")).orderBy("scenario_id").collect()
    assert tuple(got[0][c] for c in ("total_steps", "with_page_id", "with_page_id_pct", "explicit_gaps", "ungrounded_candidates", "unique_page_ids")) == (3, 1, 33.3, 1, 1, ["123456"])
    assert got[1].total_steps == 0 and got[1].with_page_id_pct == 0 and got[1].unique_page_ids == []


def test_sparse_blocks_against_brute_force(spark, monkeypatch):
    """Many blocks on both sides, ties, terms that count only together; no pair of a query and a row is shuffled."""
    import numpy as np

    rng = np.random.default_rng(5)
    for name, value in (("ROWS", 7), ("QUERIES", 3), ("EXPANDED", 40), ("DEARER", 3)):
        monkeypatch.setattr(sparse, name, value)
    bags = [(("A", "B")[i % 2], i, 1, [int(t) for t in rng.integers(0, 12, 6)]) for i in range(60)]
    asked = [(q, t, float(1 + t % 3), q % 2 == 1) for q in range(8) for t in {int(t) for t in rng.integers(0, 14, 3)}]
    packed = sparse.blocks(spark.createDataFrame(bags, "grp string, id long, dl int, terms array<long>"), True)
    queries = sparse.query_blocks(spark.createDataFrame(asked, "query_id long, term long, weight double, together boolean"))
    found = sparse.top_k(packed, queries, 4, 6, lambda row, dl, vocab, ptr, at, n: n.astype(float)).toPandas()
    for q in range(8):
        own = [(t, w, x) for a, t, w, x in asked if a == q]
        for grp in "AB":
            scores = [(-sum(w * terms.count(t) for t, w, _ in own), i) for g, i, _, terms in bags if g == grp and (q % 2 == 0 or all(t in terms for t, _, _ in own))]
            want = sorted(x for x in scores if x[0] < 0)[:4]
            got = found[(found.query_id == str(q)) & (found.grp == grp)]
            assert sorted(zip(-got.score, got.id.astype(int), strict=True))[:4] == want


@pytest.mark.parametrize("name", ["h4_okapi", "h1_bm25_search_all", "h3_tfidf_search_all"])
def test_searches_shuffle_no_pairs(spark, name):
    import re

    from loomfold.plans import catalogue

    plan = catalogue.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Aggregate \[query_id#\d+L?, (section#\d+, )?(doc_id|chunk_id)", plan)


def test_full_text_shuffles_no_pairs(spark):
    import re

    from loomfold.plans import catalogue

    plan = catalogue.queries()["h1_codes"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Aggregate \[query_id#\d+L?, chunk_id", plan)


def test_few_terms_against_blocks_of_queries(spark, monkeypatch):
    """Queries at hand in every task find what blocks of queries find; ties, groups and terms that count only together."""
    import numpy as np

    rng = np.random.default_rng(7)
    for name, value in (("ROWS", 7), ("QUERIES", 3), ("SHARED", 3)):
        monkeypatch.setattr(sparse, name, value)
    bags = spark.createDataFrame([(("A", "B")[i % 2], i, 1, [int(t) for t in rng.integers(0, 12, 6)]) for i in range(60)], "grp string, id long, dl int, terms array<long>")
    asked = spark.createDataFrame([(q, t, float(1 + t % 3), q % 2 == 1) for q in range(8) for t in {int(t) for t in rng.integers(0, 14, 3)}], "query_id long, term long, weight double, together boolean")
    plain = lambda row, dl, vocab, ptr, at, n: n.astype(float)
    few = sparse.top_k_of_few_terms(bags, True, asked, 4, 6, lambda *block: plain(None, *block)).toPandas()
    all_ = sparse.top_k(sparse.blocks(bags, True), sparse.query_blocks(asked), 4, 6, plain).toPandas()
    assert len(few) and sorted(map(tuple, few.to_numpy())) == sorted(map(tuple, all_.to_numpy()))


def test_full_text_copies_no_block_for_blocks_of_queries(spark, tables):
    plan = search.full_text(tables[0], ask(spark, "architecture"), 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan and "q_terms" not in plan


def test_hits_are_normalised_in_one_reading(spark):
    hits = spark.createDataFrame([(1, "a", -2.0), (1, "b", 1.0), (2, "a", 0.0), (None, "a", 3.0)], "query_id long, chunk_id string, score double")
    got = ranking.max_normalised(hits)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.query_id, r.chunk_id, r.score) for r in got.collect()) == [(1, "a", 1.0), (1, "b", 0.5), (2, "a", 0.0)]


def test_nearest_of_a_row_with_ties():
    import numpy as np

    scores = np.array([[0.1, 0.5, 0.5, np.nan, 0.9], [np.nan, np.nan, 0.0, 0.0, 0.0]])
    for k in (1, 2, 3, 5, 9):
        q, i = search._best_of(scores, k, 10)
        want = [(r, 10 + int(c)) for r in range(2) for c in np.argsort(-scores[r], kind="stable")[:k]]
        assert list(zip(q.tolist(), i.tolist(), strict=True)) == want


def test_needles_in_one_pass(spark):
    """Every needle that a text or title holds, of any length, across Arrow batches; no pair of a query and a chunk is compared by a join."""
    import random

    draw = random.Random(3)
    text = lambda n: "".join(draw.choice("abAB éß") for _ in range(n))
    rows = [(str(i), text(draw.randint(0, 40)) if i % 9 else None, text(draw.randint(0, 12)) if i % 7 else None) for i in range(80)]
    asked = [(q, text(draw.randint(0, 4)) if q % 3 else (rows[q][1] or "x")[2:30]) for q in range(30)] + [(97, ""), (98, None), (99, "")]
    low = lambda x: "".join(c.lower() if c.isascii() else c for c in x)
    want = sorted((q, c) for q, n in asked if n is not None for c, t, h in rows if any(x is not None and low(n) in low(x) for x in (t, h)))
    got = search.like_search(spark.createDataFrame(rows, "chunk_id string, text string, title string").repartition(3), spark.createDataFrame(asked, "query_id long, query string"))
    assert sorted((r.query_id, r.chunk_id) for r in got.collect()) == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "contains" not in plan.lower()


@pytest.mark.parametrize("name", ["h7_rrf", "h10_hybrid_parents"])
def test_searches_over_the_full_text_copy_no_blocks(spark, name):
    from loomfold.plans import catalogue

    plan = catalogue.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "q_terms" not in plan and plan.count("together") == 0


def test_dense_reads_vectors_once(spark, monkeypatch):
    monkeypatch.setattr(search, "ROWS", 8)
    rng = np.random.default_rng(3)
    vectors = rng.integers(-2, 3, (60, 4)).astype(float)
    vectors[7] = 0
    own = [f"s{i % 3}" for i in range(60)]
    chunks = spark.createDataFrame([(f"c{i:02}", own[i]) for i in range(60)], "chunk_id string, section string").repartition(5)
    held = spark.createDataFrame([(f"c{i:02}", v.tolist()) for i, v in enumerate(vectors)], "chunk_id string, vector array<double>").repartition(5)
    asked = spark.createDataFrame([(i, vectors[i].tolist()) for i in range(0, 60, 7)] + [(99, None)], "query_id long, vector array<double>").repartition(5)
    found = search.dense(chunks, held, asked, 4)
    assert "CartesianProduct" not in found._jdf.queryExecution().toString() and "NestedLoop" not in found._jdf.queryExecution().toString()
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1), 1e-9)[:, None]
    expected = set()
    for q in range(0, 60, 7):
        if q == 7:
            continue
        for s in ("s0", "s1", "s2"):
            best = sorted((-round(float(unit[q] @ unit[i]), 9), f"c{i:02}") for i in range(60) if own[i] == s and i != 7)[:4]
            expected |= {(q, c, s, round(max(-x, 0), 6), r + 1) for r, (x, c) in enumerate(best)}
    assert {(r.query_id, r.chunk_id, r.section, round(r.score, 6), r["rank"]) for r in found.collect()} == expected


@pytest.mark.parametrize("name", ["h7_rrf", "h10_hybrid_parents"])
def test_searches_pair_no_blocks_of_vectors(spark, name):
    from loomfold.plans import catalogue

    plan = catalogue.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "q_ids" not in plan and "c_ids" not in plan
