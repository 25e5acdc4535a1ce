"""Queries over search, fusion and evaluation, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomfold.functions import text as T
from loomfold.operators import evaluate, filters, ranking, search, toolkits
from loomfold.plans import adapters as A
from loomfold.plans.sql import CHUNKS, PAGES

EACH = search.EACH


def titles(s, d):
    """query_id, query, vector: the titles of all chunks whose id is divisible by 50, with the vectors that there are."""
    rows = A.chunks(s, d).filter(F.col("doc_id") % EACH == 0).select(F.col("doc_id").alias("query_id"), F.col("title").alias("query"), "chunk_id")
    return rows.join(A.vectors(s, d), "chunk_id", "left").drop("chunk_id")


def codes(s, d):
    """query_id, query: the document codes of those titles alone, which are phrases or conjunctions."""
    return titles(s, d).select("query_id", F.substring_index("query", " ", 1).alias("query"))


def named_pages(s, d):
    return titles(s, d).select("query_id", F.expr("concat('see pageId: ', 100000 + (query_id div 80) * 20 + query_id % 20, ', pageId=', 100001 + query_id, ' and pageId 12')").alias("query"))


def _hits(s, d, by, score="value"):
    return A.table(s, d, "events").selectExpr(by, "event_id id", f"{score} score")


SECTION, QUERY, LEXICAL = "event_type section", "user_id query", "cast(get_json_object(props, '$.k') as double)"


def _sizes(s, d):
    """Sizes of the sections of the corpus, which are not those of the hits."""
    return A.table(s, d, "events").groupBy(F.col("event_type").alias("section")).agg((F.count("*") * F.length(F.first("event_type")) - 3000).alias("n"))


def _two_lists(s, d):
    """Dense and lexical hits: each user's events by value and by another number, sections being event types."""
    rows = A.table(s, d, "events")
    dense = rows.selectExpr("user_id query_id", "cast(event_id as string) chunk_id", "event_type section", "value score")
    return dense, rows.selectExpr("user_id query_id", "cast(event_id as string) chunk_id", "event_type section", f"{LEXICAL} score").filter("cast(chunk_id as long) % 3 != 0")


def f1_fused(s, d):
    dense, lexical = _two_lists(s, d)
    return ranking.fuse(dense, ranking.max_normalised(lexical), _sizes(s, d), 20).select("query_id", "section", "chunk_id", F.round("score", 6).alias("score"))


def _page_hits(s, d):
    return A.chunks(s, d).selectExpr("content_type query_id", "if(doc_id % 11 = 0, '', page_id) page_id", "chunk_id", "cast(length(text) as double) score", "if(contains(text, 'License'), 0, 1) tier", "doc_id place")


def _rankings(s, d):
    """The users' events by value as rankings, purchases being relevant; only users with an even number have any."""
    rows = A.table(s, d, "events").selectExpr("user_id query_id", "cast(event_id as string) chunk_id", "value", "event_type")
    ranked = ranking.ranked(rows.selectExpr("query_id query", "chunk_id id", "value score"), "query").selectExpr("query query_id", "id chunk_id", "r + 1 rank")
    relevant = rows.filter("event_type = 'purchase' and query_id % 2 = 0").select("query_id", "chunk_id")
    return ranked, relevant, rows.select("query_id").distinct()


def d12_metrics(s, d):
    return evaluate.metrics(*_rankings(s, d), 10)


def d16_gate(s, d):
    out = evaluate.gate(d12_metrics(s, d), {"recall_at_k": 0.9, "mrr": 0.01}, {"mrr": 2.0, "overlap_at_k": 0.0}, 0.1)
    return out.select("passed", F.size("failures").cast("long").alias("failures"))


def _shadow(s, d):
    old, relevant, queries = _rankings(s, d)
    rows = A.table(s, d, "events").selectExpr("user_id query", "cast(event_id as string) id", f"{LEXICAL} score")
    new = ranking.ranked(rows, "query").selectExpr("query query_id", "id", "r + 1 rank")
    return evaluate.shadow(old.withColumnRenamed("chunk_id", "id"), new, relevant.withColumnRenamed("chunk_id", "id"), queries, 10)


def c12_shadow(s, d):
    each, _ = _shadow(s, d)
    return each.withColumns({"overlap_at_k": F.round("overlap_at_k", 6), "rank_shift": F.col("rank_shift").cast("long")})


def h12_evaluation(s, d):
    """Every vector whose id is divisible by 50 as a query over its section; relevant are the chunks of its own page."""
    corpus = A.chunks(s, d).select("chunk_id", "section", "page_id", "doc_id").join(A.vectors(s, d), "chunk_id")
    queries = corpus.filter(F.col("doc_id") % EACH == 0).select(F.col("chunk_id").alias("query_id"), F.expr("if(doc_id % 100 = 0, section, null)").alias("section"), "vector", "page_id")
    ranked = evaluate.dot_rankings(corpus, queries, 10)
    relevant = corpus.select("chunk_id", "page_id").join(queries.select("query_id", "page_id"), "page_id").select("query_id", "chunk_id")
    return evaluate.metrics(ranked, relevant, queries.select("query_id"), 10)


def h11_pack(s, d):
    """Evidence for a topic of each language over the full text."""
    topics = A.chunks(s, d).groupBy(F.col("content_type").alias("topic_id")).agg(F.min("title").alias("topic"), F.array(F.min(F.substring_index("title", " ", 1)), F.lit(" ")).alias("codes"))
    chunks = A.chunks(s, d)

    def find(queries, section):
        hits = search.full_text(chunks, queries, 5).join(chunks.select("chunk_id", "page_id"), "chunk_id")
        return hits.select("query_id", "page_id", "chunk_id", (-F.col("score")).alias("score"), "rank")

    return toolkits.evidence_pack(topics, find).withColumn("score", F.round("score", 6))


QUERIES = {
    "b12_relevance": lambda s, d: evaluate.relevance(A.chunks(s, d), evaluate.checked_golden(A.golden(s, d))),
    "c1_page_lookup": lambda s, d: search.exact_pages(A.chunks(s, d), A.pages(A.chunks(s, d)), named_pages(s, d)).select("query_id", "page_id", "chunk_id", "score"),
    "c2_title_codes": lambda s, d: search.title_codes(A.chunks(s, d), A.pages(A.chunks(s, d)), titles(s, d), 30).select("query_id", "page_id", "chunk_id", "title", "score"),
    "c5_parents": lambda s, d: search.parents(A.pages(A.chunks(s, d)), A.chunks(s, d)).select("page_id", F.sha2("text", 256).alias("text_sha256")),
    "c12_shadow_queries": c12_shadow,
    "d12_retrieval_metrics": d12_metrics,
    "d13_percentiles": lambda s, d: evaluate.percentiles(A.table(s, d, "events"), "value", ["event_type"]),
    "d14_batch_stats": lambda s, d: evaluate.batch_stats(A.table(s, d, "events").selectExpr("cast(event_id % 32 as int) size", "value seconds")),
    "d15_shadow_summary": lambda s, d: _shadow(s, d)[1],
    "d16_quality_gate": d16_gate,
    "d20_max_per_page": lambda s, d: search.best_of_pages(_page_hits(s, d)).select("query_id", "tier", "page_id", "chunk_id"),
    "d21_max_normalised": lambda s, d: ranking.max_normalised(_hits(s, d, "user_id query_id", "value - 40")).select("query_id", "id", F.round("score", 6).alias("score")),
    "d22_section_normalised": lambda s, d: ranking.section_normalised(_hits(s, d, SECTION, "value - 40")).select("section", "id", F.round("score", 6).alias("score")),
    "e1_section_rank": lambda s, d: ranking.section_rank(_hits(s, d, SECTION), _sizes(s, d), 30).select("section", "id", F.round("section_rank", 6).alias("section_rank")),
    "e1b_legacy_rank": lambda s, d: ranking.section_rank(_hits(s, d, SECTION), A.table(s, d, "events").filter("event_type != 'view'").groupBy(F.col("event_type").alias("section")).agg(F.expr("if(event_type = 'click', 1, count(*))").alias("n")), 30, 1).select("section", "id", F.round("section_rank", 6).alias("section_rank")),
    "e4_first_chunks": lambda s, d: search.first_chunks(A.chunks(s, d)).select("page_id", "chunk_id"),
    "f1_fused": f1_fused,
    "f2_page_results": lambda s, d: search.page_results(_page_hits(s, d), 10).select("query_id", F.col("rank").cast("long").alias("rank"), "page_id", "chunk_id"),
    "g18_query_parts": lambda s, d: titles(s, d).unionByName(codes(s, d).withColumn("vector", F.lit(None).cast("array<double>"))).select("query_id", "query", F.array_join(F.transform(search.fts_parts(F.col("query")), lambda p: F.concat(F.when(p.all, "&").otherwise("|"), p.value)), " ").alias("parts")),
    "h1_full_text": lambda s, d: search.full_text(A.chunks(s, d), titles(s, d), 30).select("query_id", "section", "chunk_id", F.round("score", 6).alias("score")),
    "h1_codes": lambda s, d: search.full_text(A.chunks(s, d), codes(s, d), 30, None, {"content_type": "en"}).select("query_id", "section", "chunk_id", F.round("score", 6).alias("score")),
    "h1_bm25_search": lambda s, d: search.bm25(A.table(s, d, "documents"), s.createDataFrame(search.sample_queries(), "query_id int, query string"), 30),
    "h1_bm25_search_all": lambda s, d: search.bm25(A.table(s, d, "documents"), search.all_queries(A.table(s, d, "documents")), 30, few=False),
    "h2_like_fallback": lambda s, d: search.like_search(A.chunks(s, d), titles(s, d).select("query_id", F.lower(F.substring_index("query", " ", 2)).alias("query"))).select("query_id", "chunk_id", "score"),
    "h3_tfidf_search": lambda s, d: ranking.tfidf(A.table(s, d, "documents"), s.createDataFrame(search.sample_queries(), "query_id int, query string"), 30),
    "h3_tfidf_search_all": lambda s, d: ranking.tfidf(A.table(s, d, "documents"), search.all_queries(A.table(s, d, "documents")), 30),
    "h4_okapi": lambda s, d: search.okapi(A.chunks(s, d), titles(s, d)).select("query_id", "chunk_id", "score"),
    "h5_dense_top_k": lambda s, d: search.dense_top_k_blocks(A.table(s, d, "embeddings"), A.table(s, d, "embeddings").filter(F.col("vec_id") % EACH == 0), 10),
    "h6_dense_sections": lambda s, d: search.dense(A.chunks(s, d), A.vectors(s, d), titles(s, d), 5, None, {"content_type": "en"}).select("query_id", "section", "chunk_id", F.round("score", 6).alias("score")),
    "h7_rrf": lambda s, d: ranking.fuse(search.dense(A.chunks(s, d), A.vectors(s, d), titles(s, d), 30), ranking.max_normalised(search.full_text(A.chunks(s, d), titles(s, d), 30)), A.chunks(s, d).groupBy("section").agg(F.count("*").alias("n")), 30).select("query_id", "section", "chunk_id", F.round("score", 6).alias("score")),
    "h8_rank_sum": lambda s, d: ranking.rank_sum([(_hits(s, d, QUERY), 0.7), (_hits(s, d, QUERY, LEXICAL), 0.3)]),
    "h9_hybrid_search": lambda s, d: search.hybrid(A.chunks(s, d), A.pages(A.chunks(s, d)), A.vectors(s, d), titles(s, d), 10, use_parents=False).select("query_id", F.col("rank").cast("long").alias("rank"), "page_id", "chunk_id", "match", F.round("score", 4).alias("score")),
    "h10_hybrid_parents": lambda s, d: search.hybrid(A.chunks(s, d), A.pages(A.chunks(s, d)), A.vectors(s, d), titles(s, d), 10).select("query_id", F.col("rank").cast("long").alias("rank"), "page_id", F.sha2("text", 256).alias("text_sha256")),
    "a13_context": lambda s, d: search.context(search.hybrid(A.chunks(s, d), A.pages(A.chunks(s, d)), A.vectors(s, d), titles(s, d), 3)).select("query_id", F.length("context").alias("chars")),
    "h11_evidence_pack": h11_pack,
    "h12_evaluation": h12_evaluation,
    "h13_fake_vectors": lambda s, d: evaluate.fake_vectors(A.chunks(s, d), "chunk_id", T.prefixed(F.col("text"), T.PASSAGE)).select("chunk_id", F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x), 6).alias("length")),
}

_Q = f"q as (select doc_id as query_id, title as query, chunk_id as own from ch where doc_id % {EACH} = 0)"
_CODES = "q as (select doc_id as query_id, split_part(title, ' ', 1) as query from ch where doc_id % 50 = 0)"
_IDS = "(^|[^A-Za-zА-Яа-яЁё0-9])([A-Za-zА-Яа-яЁё][A-Za-zА-Яа-яЁё0-9]*([_.-][A-Za-zА-Яа-яЁё0-9]+)+)"
#: Identifiers of queries q, in order of length; words; parts (query_id, all_, value, i).
_PARTS = rf"""ids0 as (select query_id, query, unnest(f) as x, generate_subscripts(f, 1) as i from (select query_id, query, regexp_extract_all(query, '{_IDS}', 2) as f from q)),
    ids as (select query_id, query, x, row_number() over (partition by query_id, query order by length(x) desc, min(i)) as k from ids0 group by query_id, query, x),
    w0 as (select query_id, query, unnest(f) as x, generate_subscripts(f, 1) as i from (select query_id, query, list_filter(regexp_extract_all(query, '[\p{{L}}\p{{N}}_]+'), lambda t: not regexp_full_match(t, '[0-9]{{1,2}}')) as f from q)),
    ev as (select query_id, query, x, k as i from ids union all select query_id, query, x, 1000 + i from w0),
    onep as (select query_id, query, arg_min(x, i) as value, min(i) as i, false as all_ from ev group by query_id, query, replace(lower(x), 'ß', 'ss')),
    lon as (select query_id, query, x as value, i, true as all_ from w0 where not regexp_full_match(x, '[0-9]+') and length(x) >= 3),
    cod as (select query_id, query, x from ids where k = 1 and x = trim(query)), nl as (select query_id, query, count(*) as n from lon group by all),
    parts as (select o.query_id, o.query, o.value, o.i, o.all_ from onep o left join cod c using (query_id, query) where c.x is null or o.i = 1
        union all select l.query_id, l.query, l.value, 2000 + l.i, l.all_ from lon l join cod using (query_id, query) join nl using (query_id, query) where nl.n >= 2)"""
#: BM25 of the parts over three columns: fts (query_id, chunk_id, score), rounded to 9 digits.
_FTS = r"""cols as (select chunk_id, 0 as c, title as t from ch union all select chunk_id, 1, breadcrumbs from ch union all select chunk_id, 2, text from ch),
    toks as (select chunk_id, c, regexp_extract_all(lower(strip_accents(lower(t))), '[\p{L}\p{N}]+') as t from cols), len_ as (select chunk_id, sum(len(t)) as l from toks group by chunk_id),
    tot as (select count(*) as n_docs, avg(l) as avg_l from len_),
    pt as (select query_id, all_, i, regexp_extract_all(lower(strip_accents(lower(value))), '[\p{L}\p{N}]+') as p from parts), pk as (select *, array_to_string(p, ' ') as phrase from pt where len(p) > 0),
    ph as (select distinct phrase, p from pk), pw as (select phrase, len(p) as n, unnest(p) as token, generate_subscripts(p, 1) as place from ph),
    pos as (select chunk_id, c, unnest(t) as token, generate_subscripts(t, 1) as position from toks),
    occ as (select phrase, chunk_id, c, position - place as start from pos join pw using (token) group by phrase, n, chunk_id, c, position - place having count(*) = n),
    f as (select phrase, chunk_id, count(*) as f from occ group by all), df as (select phrase, count(*) as df from f group by phrase),
    sc as (select phrase, chunk_id, -case when n_docs > 2 * df then ln((n_docs - df + 0.5) / (df + 0.5)) else 1e-6 end * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * l / avg_l)) as x from f join df using (phrase) join len_ using (chunk_id), tot),
    need as (select query_id, count(*) as need from pk where all_ group by query_id),
    agg as (select query_id, chunk_id, sum(x) filter (not all_) as a, sum(x) filter (all_) as b, count(*) filter (all_) as met from sc join pk using (phrase) group by all),
    fts as (select query_id, chunk_id, round(coalesce(a, 0) + case when met = need then b else 0 end, 9) as score from agg left join need using (query_id) where a is not null or met = need)"""
_TOP_FTS = "lex as (select query_id, section, chunk_id, score from fts join ch using (chunk_id) {where} qualify row_number() over (partition by query_id, section order by score, chunk_id) <= 30)"
_DENSE = """vec as (select chunk_id, section, content_type, list_transform(cast(embedding as double[]), lambda x: x) as v from ch join embeddings on vec_id = doc_id),
    nrm as (select chunk_id, section, content_type, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) as l from vec),
    qv as (select query_id, v, l from q join nrm on nrm.chunk_id = q.own),
    den0 as (select query_id, c.chunk_id, section, content_type, round(list_dot_product(c.v, qv.v) / (c.l * qv.l), 9) as raw from nrm c, qv),
    den as (select query_id, section, chunk_id, greatest(raw, 0) as score from den0 {where} qualify row_number() over (partition by query_id, section order by raw desc, chunk_id) <= {k})"""
_FUSE = """nl_ as (select query_id, section, chunk_id, abs(score) / case when max(abs(score)) over (partition by query_id) = 0 then 1 else max(abs(score)) over (partition by query_id) end as score from lex),
    sz as (select section, count(*) as n from ch group by section), wt as (select section, greatest(ln(greatest(n, 2)) / ln(greatest((select max(n) from sz), 2)), 0.01) as w from sz),
    src as (select query_id, section, chunk_id, score, 0.6 as weight from den union all select query_id, section, chunk_id, score, 0.4 from nl_),
    rk as (select *, (row_number() over (partition by query_id, weight, section order by score desc, chunk_id) - 1) / w as r from src join wt using (section)),
    fu0 as (select query_id, section, chunk_id, max(weight * score / (60 + r + 1)) as s from rk group by all),
    fu as (select query_id, section, chunk_id, s as score, row_number() over (partition by query_id order by s desc, section, chunk_id) - 1 as place from fu0 qualify row_number() over (partition by query_id order by s desc, section, chunk_id) <= 30)"""
_TITLES = r"""tc as (select q.query_id, q.query, ids.x as code, ids.k, c.chunk_id, c.page_id, c.section, p.title, c.chunk_index from q join ids on ids.query_id = q.query_id and ids.query = q.query, ch c join pv p using (page_id) where not p.deleted and (contains(lower(c.title), lower(ids.x)) or contains(lower(p.title), lower(ids.x)))),
    tf as (select * from tc qualify row_number() over (partition by query_id, page_id order by k, chunk_index, chunk_id) = 1),
    tk as (select *, replace(lower(title), 'ß', 'ss') as low, replace(lower(code), 'ß', 'ss') as cf, list_filter(list_transform(list_filter(regexp_extract_all(query, '[\p{L}\p{N}_]{3,}'), lambda t: not regexp_full_match(t, '[0-9]+')), lambda t: replace(lower(t), 'ß', 'ss')), lambda t: t <> replace(lower(code), 'ß', 'ss')) as terms from tf),
    ti as (select query_id, page_id, chunk_id, section, title, row_number() over (partition by query_id order by len(list_filter(terms, lambda t: contains(low, t))) desc, case when starts_with(low, cf) then 0 else 1 end, case when position(cf in low) = 0 then 10000 else position(cf in low) - 1 end, length(title), k, chunk_index, chunk_id) - 1 as place from tk)"""

SQL = {
    "b12_relevance": f"with {CHUNKS} select cast(item_id as varchar) as query_id, chunk_id from ch, benchmark b where contains(lower(ch.text), lower(substr(b.text, 1, 80)))",
    "c1_page_lookup": f"""with {PAGES}, a as (select doc_id as query_id, cast(100000 + (doc_id // 80) * 20 + doc_id % 20 as varchar) as page_id from ch where doc_id % {EACH} = 0 union select doc_id, cast(100001 + doc_id as varchar) from ch where doc_id % {EACH} = 0)
        select query_id, page_id, arg_min(ch.chunk_id, ch.chunk_index) as chunk_id, 1.0 as score from a join pv using (page_id) join ch using (page_id) where not deleted group by query_id, page_id""",
    "c2_title_codes": f"with {PAGES}, {_Q}, {_PARTS}, {_TITLES} select query_id, page_id, chunk_id, title, round(0.99 - place * 0.001, 4) as score from ti where place < 30",
    "c12_shadow_queries": """with e as (select user_id as query_id, event_id, event_type = 'purchase' and user_id % 2 = 0 as rel, row_number() over (partition by user_id order by value desc, cast(event_id as varchar)) as a,
        row_number() over (partition by user_id order by cast(regexp_extract(props, '([0-9]+)', 1) as double) desc, cast(event_id as varchar)) as b from events)
        select query_id, round(count(*) filter (a <= 10 and b <= 10) / 10, 6) as overlap_at_k, cast(coalesce(sum(b - a) filter (a <= 10 and b <= 10), 0) as bigint) as rank_shift, cast(coalesce(bool_or(rel), false) as integer)::double as old_quality, cast(coalesce(bool_or(rel), false) as integer)::double as new_quality from e group by query_id""",
    "d12_retrieval_metrics": """with e as (select user_id, event_type = 'purchase' and user_id % 2 = 0 as rel, row_number() over (partition by user_id order by value desc, cast(event_id as varchar)) as r from events),
        q as (select user_id, count(*) filter (rel) as n, least(10, count(*)) as shown, count(*) filter (rel and r <= 10) as hits, min(r) filter (rel and r <= 10) as first from e group by user_id)
        select round(coalesce(avg(hits / n) filter (n > 0), 0), 6) as recall_at_k, round(coalesce(avg(coalesce(1 / first, 0)) filter (n > 0), 0), 6) as mrr, round(coalesce(avg(hits / (n + shown - hits)) filter (n > 0), 0), 6) as overlap_at_k, count(*) filter (n > 0) as queries_evaluated, count(*) as queries_total from q""",
    "d13_percentiles": "select event_type, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95 from events group by event_type",
    "d14_batch_stats": """with e as (select event_id % 32 as size, value as seconds, value / greatest(event_id % 32, 1) as each_ from events), x as (select each_ from e, range(0, 32) r(i) where i < size)
        select cast(sum(size) as bigint) as documents, round(sum(seconds), 6) as duration_seconds, round(sum(size) / sum(seconds), 6) as throughput, (select round(quantile_cont(each_, 0.5) * 1000, 6) from x) as p50_ms, (select round(quantile_cont(each_, 0.95) * 1000, 6) from x) as p95_ms from e""",
    "d15_shadow_summary": """with e as (select user_id as query_id, event_type = 'purchase' and user_id % 2 = 0 as rel, row_number() over (partition by user_id order by value desc, cast(event_id as varchar)) as a,
        row_number() over (partition by user_id order by cast(regexp_extract(props, '([0-9]+)', 1) as double) desc, cast(event_id as varchar)) as b from events),
        q as (select query_id, count(*) filter (a <= 10 and b <= 10) / 10 as o, cast(bool_or(rel) as integer) as x from e group by query_id) select round(avg(o), 6) as overlap_at_k, round(avg(x), 6) as old_quality, round(avg(x), 6) as new_quality from q""",
    "d16_quality_gate": """with e as (select user_id, event_type = 'purchase' and user_id % 2 = 0 as rel, row_number() over (partition by user_id order by value desc, cast(event_id as varchar)) as r from events),
        q as (select user_id, count(*) filter (rel) as n, count(*) filter (rel and r <= 10) as hits from e group by user_id), m as (select round(coalesce(avg(hits / n) filter (n > 0), 0), 6) as recall from q)
        select false as passed, cast(2 + case when recall < 0.9 then 1 else 0 end as bigint) as failures from m""",
    "d20_max_per_page": f"""with {CHUNKS}, x as (select content_type as query_id, case when doc_id % 11 = 0 then '' else page_id end as page_id, chunk_id, length(text) as score, case when contains(text, 'License') then 0 else 1 end as tier, doc_id from ch)
        select query_id, tier, page_id, chunk_id from x qualify row_number() over (partition by query_id, tier, case when page_id = '' then 'c' || chunk_id else 'p' || page_id end order by score desc, doc_id) = 1""",
    "d21_max_normalised": "with m as (select user_id, max(abs(value - 40)) as m from events group by user_id) select user_id as query_id, event_id as id, round(abs(value - 40) / case when m = 0 then 1 else m end, 6) as score from events join m using (user_id)",
    "d22_section_normalised": "select event_type as section, event_id as id, round((value - 40) / max(value - 40) over (partition by event_type), 6) as score from events where value - 40 > 0",
    "e1_section_rank": """with n as (select event_type as section, count(*) * length(event_type) - 3000 as n from events group by event_type), r as (select event_id as id, event_type as section, row_number() over (partition by event_type order by value desc, event_id) - 1 as r from events)
        select section, id, round(r / greatest(ln(greatest(n, 2)) / ln(greatest((select max(n) from n), 2)), 0.01), 6) as section_rank from r join n using (section) where r < 30""",
    "e1b_legacy_rank": """with n as (select event_type as section, case when event_type = 'click' then 1 else count(*) end as n from events where event_type <> 'view' group by event_type), r as (select event_id as id, event_type as section, row_number() over (partition by event_type order by value desc, event_id) - 1 as r from events)
        select section, id, round(r / greatest(ln(coalesce(n, 1)) / ln((select max(n) from n)), 0.01), 6) as section_rank from r left join n using (section) where r < 30""",
    "e4_first_chunks": f"with {CHUNKS} select page_id, arg_min(chunk_id, chunk_index) as chunk_id from ch group by page_id",
    "f1_fused": """with n as (select event_type as section, count(*) * length(event_type) - 3000 as n from events group by event_type), w as (select section, greatest(ln(greatest(n, 2)) / ln(greatest((select max(n) from n), 2)), 0.01) as w from n),
        k as (select user_id as query_id, event_type as section, event_id, cast(event_id as varchar) as chunk_id, value, cast(regexp_extract(props, '([0-9]+)', 1) as double) as k from events), m as (select query_id, max(abs(k)) as m from k where event_id % 3 <> 0 group by query_id),
        h as (select query_id, section, chunk_id, value as score, 0.6 as weight from k union all select query_id, section, chunk_id, abs(k) / case when m = 0 then 1 else m end, 0.4 from k join m using (query_id) where event_id % 3 <> 0),
        r as (select *, row_number() over (partition by query_id, section, weight order by score desc, chunk_id) - 1 as r from h), s as (select query_id, section, chunk_id, max(weight * score / (60 + r / w + 1)) as s from r join w using (section) group by all)
        select query_id, section, chunk_id, round(s, 6) as score from s qualify row_number() over (partition by query_id order by s desc, section, chunk_id) <= 20""",
    "f2_page_results": f"""with {CHUNKS}, x as (select content_type as query_id, case when doc_id % 11 = 0 then '' else page_id end as page_id, chunk_id, length(text) as score, case when contains(text, 'License') then 0 else 1 end as tier, doc_id from ch),
        f as (select *, case when page_id = '' then 'c' || chunk_id else 'p' || page_id end as key from x qualify row_number() over (partition by query_id, case when page_id = '' then 'c' || chunk_id else 'p' || page_id end order by tier, score desc, doc_id) = 1)
        select query_id, row_number() over (partition by query_id order by tier, score desc, doc_id) as rank, page_id, chunk_id from f qualify rank <= 10""",
    "g18_query_parts": f"""with {CHUNKS}, q as (select doc_id as query_id, title as query from ch where doc_id % {EACH} = 0 union all select doc_id, split_part(title, ' ', 1) from ch where doc_id % {EACH} = 0), {_PARTS}
        select query_id, query, string_agg(case when all_ then '&' else '|' end || value, ' ' order by i) as parts from parts group by query_id, query""",
    "h1_full_text": f"with {CHUNKS}, {_Q}, {_PARTS}, {_FTS}, {_TOP_FTS.format(where='')} select query_id, section, chunk_id, round(score, 6) + 0 as score from lex",
    "h1_codes": f"""with {CHUNKS}, {_CODES}, {_PARTS}, {_FTS}, {_TOP_FTS.format(where="where content_type = 'en'")} select query_id, section, chunk_id, round(score, 6) + 0 as score from lex""",
    "h2_like_fallback": f"with {CHUNKS}, {_Q}, p as (select query_id, lower(case when split_part(query, ' ', 2) = '' then query else split_part(query, ' ', 1) || ' ' || split_part(query, ' ', 2) end) as query from q) select query_id, chunk_id, 0.0 as score from ch, p where contains(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), query) or contains(translate(title, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), query)",
    "h4_okapi": rf"""with {CHUNKS}, {_Q}, t as (select chunk_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') as t from ch), tot as (select count(*) as n_docs, avg(len(t)) as avg_dl from t),
        tf as (select chunk_id, dl, term, count(*) as tf from (select chunk_id, len(t) as dl, unnest(t) as term from t) group by all), df as (select term, ln((n_docs - count(*) + 0.5) / (count(*) + 0.5)) as raw from tf, tot group by term, n_docs), mean as (select avg(raw) as mean from df),
        qt as (select query_id, term, count(*) as times from (select query_id, unnest(list_filter(regexp_split_to_array(lower(query), '\s+'), lambda x: x <> '')) as term from q) group by all),
        s as (select query_id, chunk_id, round(sum(times * case when raw < 0 then 0.25 * mean else raw end * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg_dl))), 9) as raw from tf join df using (term) join qt using (term), tot, mean group by query_id, chunk_id),
        r as (select *, max(raw) over (partition by query_id) as best from s where raw > 0 qualify row_number() over (partition by query_id order by raw desc, chunk_id) <= 30) select query_id, chunk_id, round(raw / best, 6) as score from r""",
    "h6_dense_sections": f"""with {CHUNKS}, {_Q}, {_DENSE.format(where="where content_type = 'en'", k=5)} select query_id, section, chunk_id, round(score, 6) as score from den""",
    "h7_rrf": f"with {CHUNKS}, {_Q}, {_PARTS}, {_FTS}, {_TOP_FTS.format(where='')}, {_DENSE.format(where='', k=30)}, {_FUSE} select query_id, section, chunk_id, round(score, 6) as score from fu",
    "h8_rank_sum": """with k as (select user_id as query, event_id as id, value as a, cast(regexp_extract(props, '([0-9]+)', 1) as double) as b from events),
        r as (select query, id, 0.7 / row_number() over (partition by query order by a desc, id) + 0.3 / row_number() over (partition by query order by b desc, id) as s from k) select query, id, cast(round(cast(cast(s as varchar) as decimal(38, 18)), 4) as double) as score from r""",
    "h9_hybrid_search": f"""with {PAGES}, {_Q}, {_PARTS}, {_FTS}, {_TOP_FTS.format(where='')}, {_DENSE.format(where='', k=30)}, {_FUSE}, {_TITLES},
        hits as (select query_id, page_id, chunk_id, round(0.99 - place * 0.001, 4) as score, place, 'title_identifier' as match, 0 as tier from ti where place < 30 union all select query_id, page_id, chunk_id, score, place, null, 1 from fu join ch using (chunk_id)),
        one as (select * from hits qualify row_number() over (partition by query_id, page_id order by tier, score desc, place, chunk_id) = 1)
        select query_id, row_number() over (partition by query_id order by tier, score desc, place, chunk_id) as rank, page_id, chunk_id, match, round(score, 4) as score from one qualify rank <= 10""",
    "h12_evaluation": f"""with {CHUNKS}, v as (select chunk_id, section, page_id, doc_id, cast(embedding as double[]) as v from ch join embeddings on vec_id = doc_id),
        q as (select chunk_id as query_id, case when doc_id % 100 = 0 then section end as only_, v, page_id from v where doc_id % {EACH} = 0),
        r as (select query_id, c.chunk_id, c.page_id = q.page_id as rel, row_number() over (partition by query_id order by round(list_dot_product(c.v, q.v), 9) desc, c.chunk_id desc) as r from q, v c where only_ is null or only_ = c.section),
        n as (select query_id, count(*) as n from q join v c on c.page_id = q.page_id group by query_id), s as (select query_id, count(*) filter (r <= 10) as shown, count(*) filter (rel and r <= 10) as hits, min(r) filter (rel and r <= 10) as first from r group by query_id)
        select round(avg(hits / n), 6) as recall_at_k, round(avg(coalesce(1 / first, 0)), 6) as mrr, round(avg(hits / (n + shown - hits)), 6) as overlap_at_k, count(*) as queries_evaluated, count(*) as queries_total from s join n using (query_id)""",
    "h1_bm25_search": r"""with t as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as t from documents),
        n as (select count(*) as n_docs, avg(len(t)) as avg_dl from t),
        q(query_id, query) as (values (1, 'released under the mit license'), (2, 'password secret token'), (3, 'erinst de la')),
        terms as (select distinct query_id, unnest(regexp_extract_all(query, '[\p{L}\p{N}]+')) as term from q),
        words as (select doc_id, len(t) as dl, unnest(t) as term from t),
        p as (select term, doc_id, dl, count(*) as tf from words where term in (select term from terms) group by all),
        d as (select term, count(*) as df from p group by term),
        s as (select query_id, doc_id, round(-sum(case when n_docs > 2 * df then ln((n_docs - df + 0.5) / (df + 0.5)) else 1e-6 end * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avg_dl))), 6) as score from p join d using (term) join terms using (term), n group by query_id, doc_id)
        select query_id, doc_id, score, row_number() over (partition by query_id order by score, doc_id) as rank from s qualify rank <= 30""",
    "h1_bm25_search_all": r"""with t as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as t from documents),
        n as (select count(*) as n_docs, avg(len(t)) as avg_dl from t),
        q as (select doc_id as query_id, lower(text) as query from documents where doc_id % 50 = 0),
        terms as (select distinct query_id, unnest(regexp_extract_all(query, '[\p{L}\p{N}]+')) as term from q),
        words as (select doc_id, len(t) as dl, unnest(t) as term from t),
        p as (select term, doc_id, dl, count(*) as tf from words where term in (select term from terms) group by all),
        d as (select term, count(*) as df from p group by term),
        s as (select query_id, doc_id, round(-sum(case when n_docs > 2 * df then ln((n_docs - df + 0.5) / (df + 0.5)) else 1e-6 end * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avg_dl))), 6) as score from p join d using (term) join terms using (term), n group by query_id, doc_id)
        select query_id, doc_id, score, row_number() over (partition by query_id order by score, doc_id) as rank from s qualify rank <= 30""",
    "h3_tfidf_search": r"""with words as (select source as section, doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) as term from documents),
        tf as (select section, doc_id, term, count(*) as tf from words group by all), sizes as (select source as section, count(*) as n from documents group by all),
        ranked as (select section, term, count(*) as df, row_number() over (partition by section order by sum(tf) desc, term) as place from tf group by section, term),
        terms as (select section, term, ln((1 + n) / (1 + df)) + 1 as idf from ranked join sizes using (section) where place <= 10000),
        w as (select section, doc_id, term, tf * idf as x from tf join terms using (section, term)), norms as (select section, doc_id, sqrt(sum(x * x)) as norm from w group by all),
        q(query_id, query) as (values (1, 'released under the mit license'), (2, 'password secret token'), (3, 'erinst de la')),
        qt as (select query_id, unnest(regexp_extract_all(query, '[\p{L}\p{N}_]{2,}')) as term from q), qc as (select query_id, term, count(*) as q_tf from qt group by all),
        asked as (select query_id, section, term, q_tf * idf as y from qc join terms using (term)), q_norms as (select query_id, section, sqrt(sum(y * y)) as q_norm from asked group by all),
        dots as (select query_id, section, doc_id, sum(x * y) as dot from w join asked using (section, term) group by all),
        s as (select query_id, section, doc_id, round(dot / (norm * q_norm), 6) as score from dots join norms using (section, doc_id) join q_norms using (query_id, section))
        select query_id, section, doc_id, score from s qualify row_number() over (partition by query_id, section order by score desc, doc_id) <= 30""",
    "h3_tfidf_search_all": r"""with words as (select source as section, doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) as term from documents),
        tf as (select section, doc_id, term, count(*) as tf from words group by all), sizes as (select source as section, count(*) as n from documents group by all),
        ranked as (select section, term, count(*) as df, row_number() over (partition by section order by sum(tf) desc, term) as place from tf group by section, term),
        terms as (select section, term, ln((1 + n) / (1 + df)) + 1 as idf from ranked join sizes using (section) where place <= 10000),
        w as (select section, doc_id, term, tf * idf as x from tf join terms using (section, term)), norms as (select section, doc_id, sqrt(sum(x * x)) as norm from w group by all),
        q as (select doc_id as query_id, lower(text) as query from documents where doc_id % 50 = 0),
        qt as (select query_id, unnest(regexp_extract_all(query, '[\p{L}\p{N}_]{2,}')) as term from q), qc as (select query_id, term, count(*) as q_tf from qt group by all),
        asked as (select query_id, section, term, q_tf * idf as y from qc join terms using (term)), q_norms as (select query_id, section, sqrt(sum(y * y)) as q_norm from asked group by all),
        dots as (select query_id, section, doc_id, sum(x * y) as dot from w join asked using (section, term) group by all),
        s as (select query_id, section, doc_id, round(dot / (norm * q_norm), 6) as score from dots join norms using (section, doc_id) join q_norms using (query_id, section))
        select query_id, section, doc_id, score from s qualify row_number() over (partition by query_id, section order by score desc, doc_id) <= 30""",
    "h5_dense_top_k": r"""with e as (select vec_id, cast(embedding as double[]) as v from embeddings),
        s as (select q.vec_id as query_id, c.vec_id, round(list_cosine_similarity(c.v, q.v), 6) as score from e q join e c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0)
        select query_id, vec_id, score, row_number() over (partition by query_id order by score desc, vec_id) as rank from s qualify rank <= 10""",
}
