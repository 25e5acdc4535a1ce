"""Queries over texts, pages, chunks and duplicates, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomfold.functions import content
from loomfold.functions import text as T
from loomfold.operators import duplicates, filters, store, toolkits
from loomfold.plans import adapters as A
from loomfold.plans.sql import CHUNKS, PAGES, PLAIN, SIMHASH
from loomfold.sources import index_files


def _docs(s, d):
    return A.table(s, d, "documents")


def _html(s, d):
    return A.table(s, d, "pages").selectExpr("cast(page_id as string) page_id", "concat('host', page_id % 9) section", "concat('page ', page_id) title", "array('root', concat('part ', page_id % 3)) ancestors", "html", "if(page_id % 7 = 0, timestamp'2024-01-01 00:00:00', null) deleted_at")


def g24_dates(s, d):
    """Each event's time in four spellings, read back as seconds."""
    forms = {"zulu": "yyyy-MM-dd'T'HH:mm:ss'Z'", "short": "yyyy-MM-dd'T'HH:mm:ss.SSS'+0300'", "colon": "yyyy-MM-dd HH:mm'-05:30'", "broken": "dd.MM.yyyy"}
    rows = A.table(s, d, "events").select("event_id", *[F.date_format("ts", f).alias(k) for k, f in forms.items()])
    return rows.select("event_id", *[F.coalesce(F.unix_timestamp(T.parsed_date(F.col(k))), F.lit(-1)).alias(k) for k in forms], T.minute_format(F.col("short")).alias("minute"))


def g28_lists(s, d):
    payload = F.expr("if(event_id % 3 = 0, concat('[{\"id\":\"', event_id, '\",\"value\":\"a\"}]'), if(event_id % 3 = 1, concat('{\"', event_id, '\":{\"id\":\"x\",\"value\":\"b\"},\"k\":\"c\",\"n\":null}'), '7'))")
    items = filters.listed(payload, "struct<id:string,value:string>")
    return A.table(s, d, "events").select("event_id", F.array_join(F.transform(items, lambda x: F.concat(x.id, F.lit("="), x.value)), ",").alias("items"))


def a14_legacy(s, d):
    rows = A.chunks(s, d).selectExpr("doc_id n", "section", "page_id", "text", "if(doc_id % 3 = 0, chunk_id, null) chunk_id", "if(doc_id % 2 = 0, chunk_index, null) chunk_index", "cast(null as int) duplicate_ordinal", "if(doc_id % 5 = 0, '4', null) chunker_version", "cast(null as string) schema_version")
    return index_files.legacy_chunks(rows).drop("text")


def a16_metric_lines(s, d):
    row = A.table(s, d, "events").agg(F.count("*").alias("events"), F.round(F.avg("event_id"), 3).alias("mean_id"))
    return index_files.metric_lines(row)


def b14_titles(s, d):
    """Pages of a section whose plain title is that of one wanted text, or holds it; picked where one only is best."""
    pages = A.pages(A.chunks(s, d)).select("page_id", "section", T.plain_title(F.col("title")).alias("plain"))
    wanted = A.pages(A.chunks(s, d)).groupBy("section").agg(F.min(T.plain_title(F.substring("title", 1, 12))).alias("wanted"))
    return filters.title_scores(pages.join(wanted, "section"), F.col("plain"), F.col("wanted")).select("page_id", "section", "match")


def e3_ordinals(s, d):
    return toolkits.duplicate_ordinals(A.chunks(s, d).withColumn("page_id", F.col("section")).withColumn("chunk_index", F.col("doc_id")))


def g9_chunks(s, d):
    out = content.page_chunks(_html(s, d))
    return out.select("page_id", "chunk_index", "chunk_id", "content_type", "duplicate_ordinal", F.length("text").alias("chars"), "content_hash")


def g5_packed(s, d):
    pack = F.pandas_udf(lambda x: x.map(lambda t: content.packed_lines(t or "")), "array<string>")
    return _docs(s, d).select("doc_id", F.posexplode(pack(F.col("text"))).alias("chunk_index", "chunk")).select("doc_id", "chunk_index", F.sha2("chunk", 256).alias("chunk_sha256"), F.length("chunk").alias("chars"))


def s20_experiment(s, d):
    return store.experiment(_html(s, d), "legacy")[1]


QUERIES = {
    "a4_corpus_scan": lambda s, d: filters.corpus(A.chunks(s, d), 500).select("chunk_id", "page_id", "section", "title", F.sha2("text", 256).alias("text_sha256")),
    "a11_manifest": lambda s, d: index_files.manifest(A.chunks(s, d).withColumns({"model_version": F.lit("m0"), "chunker_version": F.lit(None).cast("string")})),
    "a12_point_upsert": lambda s, d: index_files.upsert_points(A.chunks(s, d).select("chunk_id", "section"), A.chunks(s, d).filter("doc_id % 3 = 0").select("chunk_id", F.lit("new").alias("section")), A.chunks(s, d).filter("doc_id % 4 = 0").select("chunk_id")),
    "a14_legacy_chunks": a14_legacy,
    "a16_metric_lines": a16_metric_lines,
    "b1_metadata_filter": lambda s, d: filters.metadata_filter(A.chunks(s, d), {"content_type": "fr", "breadcrumbs": "src1 > fr"}).select("chunk_id"),
    "b3_sections": lambda s, d: filters.metadata_filter(A.chunks(s, d), None, ["src1", "src2", "none"]).select("chunk_id", "section"),
    "b4_live_pages": lambda s, d: filters.live(A.pages(A.chunks(s, d))).select("page_id"),
    "b5_like_ascii_fold": lambda s, d: _docs(s, d).filter(T.contains_ascii_fold(F.col("text"), "MIT License")).select("doc_id"),
    "b6_json_path": lambda s, d: A.table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k")),
    "b7_metadata_fold": lambda s, d: filters.unfold_metadata(filters.fold_metadata(A.chunks(s, d).select("chunk_id", "title", "content_type", "doc_id")).withColumn("same", F.col("metadata_json")), "content_type string, doc_id long").withColumnRenamed("same", "metadata_json").drop("title"),
    "b8_payload": lambda s, d: filters.payload(A.chunks(s, d).withColumn("content_type", F.when(F.col("doc_id") % 4 != 0, F.col("content_type"))), "m0", "cpu").select("chunk_id", "page_id", "section", "content_type", "chunker_version", "model_version", "provider_runtime"),
    "b9_first_of": lambda s, d: A.table(s, d, "events").select("event_id", filters.first_of(F.expr("if(event_id % 2 = 0, '', null)"), F.expr("if(event_id % 3 = 0, cast(user_id as string), null)"), F.expr("if(event_id % 5 = 0, event_type, '')")).alias("value")),
    "b14_title_match": b14_titles,
    "b14_title_pick": lambda s, d: filters.pick_unique(b14_titles(s, d), "section"),
    "b16_marked_pages": lambda s, d: filters.table_pages(A.chunks(s, d), A.pages(A.chunks(s, d)), 25, ["100003"], "License"),
    "d1_section_counts": lambda s, d: _docs(s, d).groupBy(F.col("source").alias("section")).agg(F.count("*").alias("n")),
    "d2_exact_duplicates": lambda s, d: duplicates.exact_groups(A.chunks(s, d)),
    "d2_duplicate_members": lambda s, d: duplicates.members(A.chunks(s, d)),
    "d3_simhash": lambda s, d: duplicates.simhash(A.chunks(s, d)).select("chunk_id", "signature"),
    "d5_near_links": lambda s, d: duplicates.near_links(A.chunks(s, d)),
    "d5_near_classes": lambda s, d: duplicates.near_classes(A.chunks(s, d)),
    "d6_duplicate_report": lambda s, d: duplicates.report(A.chunks(s, d)),
    "c10_all_pairs": lambda s, d: duplicates.near_links(A.chunks(s, d), 14).select("chunk_id", "n_links"),
    "d24_marker_counts": lambda s, d: filters.marker_counts(A.chunks(s, d).withColumn("content_type", F.when(F.col("doc_id") % 9 == 0, "table"))),
    "e3_duplicate_ordinal": e3_ordinals,
    "f3_unique_in_order": lambda s, d: filters.unique_in_order(A.chunks(s, d).select("page_id", "doc_id", "chunk_id"), "page_id", "doc_id").select("page_id", "chunk_id"),
    "g1_html_to_text": lambda s, d: _html(s, d).select("page_id", F.sha2(content.html_to_text(F.col("html")), 256).alias("text_sha256")),
    "g4_strip_tags": lambda s, d: _html(s, d).select("page_id", F.sha2(T.strip_tags(F.col("html")), 256).alias("text_sha256")),
    "g5_line_packing": g5_packed,
    "g5_long_line_windows": lambda s, d: _docs(s, d).select("doc_id", content.long_line_windows(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")).alias("w")).select("doc_id", F.size("w").cast("long").alias("n"), F.sha2(F.array_join("w", "\n"), 256).alias("windows_sha256")),
    "g9_page_chunks": g9_chunks,
    "g10_breadcrumbs": lambda s, d: A.table(s, d, "events").select("event_id", T.breadcrumbs(F.expr("array(event_type, if(event_id % 3 = 0, ' ', cast(user_id as string)), null, if(event_id % 4 = 0, 'last', ''))"), F.expr("if(event_id % 2 = 0, 'last ', event_type)")).alias("path")),
    "g11_content_hash": lambda s, d: _docs(s, d).select("doc_id", F.sha2("text", 256).alias("content_hash")),
    "g12_stable_chunk_id": lambda s, d: _docs(s, d).select("doc_id", T.stable_chunk_id(F.col("source"), F.col("doc_id").cast("string"), F.col("text")).alias("chunk_id")),
    "g14_normalized_text": lambda s, d: _docs(s, d).select("doc_id", F.sha2(T.normalized(F.col("text")), 256).alias("normalized_sha256")),
    "g15_page_ids": lambda s, d: _docs(s, d).select("doc_id", F.array_join(T.page_ids(F.expr("case doc_id % 4 when 0 then concat(' ', 100000 + doc_id, ' ') when 1 then concat('pageId=', 200000 + doc_id, ', PAGEID: ', 300000 + doc_id, ' pageId ', 200000 + doc_id, ' pageId 12345') when 2 then concat('xpageId=', 100000 + doc_id, ' ', doc_id) else cast(doc_id as string) end")), ",").alias("page_ids")),
    "g16_identifiers": lambda s, d: A.chunks(s, d).select("doc_id", F.array_join(T.identifiers(F.concat(F.col("title"), F.lit(" ПР_UDO_01.01 "), F.substring("text", 1, 300), F.lit(" a.b"))), ",").alias("identifiers")),
    "g17_query_terms": lambda s, d: _docs(s, d).select("doc_id", F.sha2(F.array_join(T.query_terms(F.col("text")), " "), 256).alias("terms_sha256")),
    "g20_bare_chunks": lambda s, d: _docs(s, d).select("doc_id", F.sha2(T.without_header(F.concat(F.expr("if(doc_id % 2 = 0, 'Путь: a > b\n', '')"), F.expr("if(doc_id % 3 = 0, 'Заголовок: x\n\n', '')"), F.col("text"))), 256).alias("text_sha256")),
    "g21_collection_names": lambda s, d: A.table(s, d, "events").select("event_id", T.collection_name("base", F.concat(F.lit("/Org "), F.col("event_type"), F.lit("@"), F.col("event_id"), F.expr("repeat('.x', event_id % 60)"))).alias("name")),
    "g23_plain_titles": lambda s, d: A.chunks(s, d).select("doc_id", T.plain_title(F.concat(F.lit("УДО 01🙆 ☀📑 "), F.col("title"))).alias("title")),
    "g24_dates": g24_dates,
    "g26_prefixes": lambda s, d: _docs(s, d).select("doc_id", F.sha2(T.prefixed(F.col("text"), T.PASSAGE), 256).alias("passage_sha256"), T.prefixed(F.expr("if(doc_id % 2 = 0, lang, null)"), T.QUERY).alias("query")),
    "g28_listed": g28_lists,
    "g29_truncated": lambda s, d: _docs(s, d).select("doc_id", F.sha2(T.truncated(F.col("text"), 8000), 256).alias("page_sha256"), F.sha2(T.truncated(F.col("text"), 3000), 256).alias("chunk_sha256")),
    "s20_experiment": s20_experiment,
}

SQL = {
    "a4_corpus_scan": f"with {CHUNKS} select chunk_id, page_id, section, title, content_hash as text_sha256 from ch order by chunk_id limit 500",
    "a11_manifest": f"with {CHUNKS} select chunk_id, content_hash, 'm0' as model_version, '' as chunker_version from ch",
    "a12_point_upsert": f"with {CHUNKS} select chunk_id, case when doc_id % 3 = 0 then 'new' else section end as section from ch where doc_id % 4 <> 0",
    "a14_legacy_chunks": f"""with {CHUNKS} select case when doc_id % 3 = 0 then chunk_id else substr(sha256(section || chr(31) || page_id || chr(31) || content_hash || chr(31) || cast(doc_id as varchar)), 1, 24) end as chunk_id, page_id, section, content_hash,
        cast(case when doc_id % 2 = 0 then chunk_index else doc_id end as integer) as chunk_index, 0 as duplicate_ordinal, case when doc_id % 5 = 0 then '4' else 'legacy' end as chunker_version, 'legacy' as schema_version from ch""",
    "a16_metric_lines": "with x as (select count(*) as events, round(avg(event_id), 3) as mean_id from events) select 'loomfold_events ' || events as line from x union all select 'loomfold_mean_id ' || case when mean_id = floor(mean_id) then cast(cast(mean_id as bigint) as varchar) else cast(mean_id as varchar) end from x",
    "b1_metadata_filter": f"with {CHUNKS} select chunk_id from ch where content_type = 'fr' and breadcrumbs = 'src1 > fr'",
    "b3_sections": f"with {CHUNKS} select chunk_id, section from ch where section in ('src1', 'src2', 'none')",
    "b4_live_pages": f"with {PAGES} select page_id from pv where not deleted",
    "b5_like_ascii_fold": "select doc_id from documents where contains(lower(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')), 'mit license')",
    "b6_json_path": r"""select event_id, regexp_extract(props, '"k":\s*([0-9]+)', 1) as k from events""",
    "b7_metadata_fold": f"with {CHUNKS} select chunk_id, content_type, doc_id, '{{\"content_type\":\"' || content_type || '\",\"doc_id\":' || cast(doc_id as varchar) || '}}' as metadata_json from ch",
    "b8_payload": f"with {CHUNKS} select chunk_id, page_id, section, case when doc_id % 4 = 0 then 'prose' else content_type end as content_type, '' as chunker_version, 'm0' as model_version, 'cpu' as provider_runtime from ch",
    "b9_first_of": "select event_id, case when event_id % 3 = 0 then cast(user_id as varchar) when event_id % 5 = 0 then event_type else '' end as value from events",
    "b14_title_match": rf"""with {PAGES}, t as (select page_id, section, trim(regexp_replace(replace(lower(regexp_replace(title, '[^\p{{L}}\p{{N}}_\s\-./]+', ' ', 'g')), 'ß', 'ss'), '\s+', ' ', 'g')) as plain, trim(regexp_replace(replace(lower(regexp_replace(substr(title, 1, 12), '[^\p{{L}}\p{{N}}_\s\-./]+', ' ', 'g')), 'ß', 'ss'), '\s+', ' ', 'g')) as part from pv),
        w as (select section, min(part) as wanted from t group by section) select page_id, section, case when plain = wanted then 0 when contains(plain, wanted) or contains(wanted, plain) then 1 else 2 end as match from t join w using (section)""",
    "b14_title_pick": rf"""with {PAGES}, t as (select page_id, section, trim(regexp_replace(replace(lower(regexp_replace(title, '[^\p{{L}}\p{{N}}_\s\-./]+', ' ', 'g')), 'ß', 'ss'), '\s+', ' ', 'g')) as plain, trim(regexp_replace(replace(lower(regexp_replace(substr(title, 1, 12), '[^\p{{L}}\p{{N}}_\s\-./]+', ' ', 'g')), 'ß', 'ss'), '\s+', ' ', 'g')) as part from pv),
        w as (select section, min(part) as wanted from t group by section), m as (select page_id, section, case when plain = wanted then 0 when contains(plain, wanted) or contains(wanted, plain) then 1 else 2 end as match from t join w using (section)),
        n as (select section, count(*) filter (match = 0) as n0, count(*) filter (match = 1) as n1, count(*) as n from m group by section)
        select page_id, section, match from m join n using (section) where match = case when n0 = 1 then 0 when n0 = 0 and n1 = 1 then 1 when n0 = 0 and n1 = 0 and n = 1 then 2 end""",
    "b16_marked_pages": f"with {PAGES} select page_id, n, title from (select page_id, count(*) as n from ch where contains(text, 'License') group by page_id) join pv using (page_id) where not deleted and page_id <> '100003' order by n desc, page_id limit 25",
    "d1_section_counts": "select source as section, count(*) as n from documents group by source",
    "d2_exact_duplicates": f"""with {CHUNKS}, x as (select chunk_id, page_id, sha256({PLAIN}) as fingerprint, strlen(text) as bytes from ch)
        select fingerprint, count(*) as members, min(chunk_id) as first_chunk, cast(sum(bytes) - max(bytes) as bigint) as savings, count(distinct page_id) as pages from x group by fingerprint having count(*) >= 2""",
    "d2_duplicate_members": f"with {CHUNKS}, x as (select chunk_id, page_id, sha256({PLAIN}) as fingerprint from ch) select fingerprint, chunk_id, page_id from x qualify count(*) over (partition by fingerprint) >= 2",
    "d3_simhash": f"with {SIMHASH} select chunk_id, signature from sig",
    "d5_near_links": f"""with {SIMHASH}, cls as (select signature, count(*) as members from sig group by signature), near as (select a.signature, sum(b.members) as n from cls a join cls b on a.signature <> b.signature and bit_count(xor(a.signature, b.signature)) <= 3 group by a.signature),
        eq as (select fingerprint, count(*) as equal from sig group by fingerprint) select chunk_id, signature, cast(coalesce(n, 0) + members - equal as bigint) as n_links from sig join cls using (signature) left join near using (signature) join eq using (fingerprint)""",
    "d5_near_classes": f"""with {SIMHASH}, cls as (select signature, count(*) as members, min(chunk_id) as chunk from sig group by signature), eq as (select signature, sum(n * n) as squares from (select signature, fingerprint, count(*) as n from sig group by all) group by signature)
        select least(a.chunk, b.chunk) as a, greatest(a.chunk, b.chunk) as b, cast(bit_count(xor(a.signature, b.signature)) as integer) as distance, a.members * b.members as pairs from cls a join cls b on a.signature < b.signature and bit_count(xor(a.signature, b.signature)) <= 3
        union all select chunk, chunk, 0, cast((members * members - squares) // 2 as bigint) from cls join eq using (signature) where members * members > squares""",
    "d6_duplicate_report": f"""with {SIMHASH}, p as (select a.bytes as x, b.bytes as y from sig a join sig b on a.chunk_id < b.chunk_id and a.fingerprint <> b.fingerprint and bit_count(xor(a.signature, b.signature)) <= 3),
        e as (select sum(bytes) - max(bytes) as s from sig group by fingerprint having count(*) >= 2)
        select (select count(*) from sig) as chunks, (select count(*) from e) as exact_groups, cast(coalesce((select sum(s) from e), 0) as bigint) as exact_savings, (select count(*) from p) as near_pairs, cast(coalesce((select sum(least(x, y)) from p), 0) as bigint) as near_savings""",
    "c10_all_pairs": f"""with {SIMHASH}, n as (select a.chunk_id, count(*) as n from sig a join sig b on a.chunk_id <> b.chunk_id and a.fingerprint <> b.fingerprint and bit_count(xor(a.signature, b.signature)) <= 14 group by a.chunk_id)
        select chunk_id, coalesce(n, 0) as n_links from sig left join n using (chunk_id)""",
    "d24_marker_counts": f"with {CHUNKS} select page_id, count(*) as chunks, count(*) filter (contains(text, '| строка ') and contains(text, ': ')) as labelled, count(*) filter (doc_id % 9 = 0 or contains(text, '[Таблица ')) as tables from ch group by page_id",
    "e3_duplicate_ordinal": f"with {CHUNKS} select chunk_id, row_number() over (partition by section, content_hash order by doc_id) - 1 as ordinal from ch",
    "f3_unique_in_order": f"with {CHUNKS} select page_id, arg_min(chunk_id, doc_id) as chunk_id from ch group by page_id",
    "g4_strip_tags": r"""select cast(page_id as varchar) as page_id, sha256(trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&apos;', ''''), '&#39;', ''''), '&amp;', '&'), '[ \t]+', ' ', 'g'))) as text_sha256 from pages""",
    "g5_long_line_windows": r"""with x as (select doc_id, regexp_replace(coalesce(text, ''), '\s+', ' ', 'g') as t from documents), w as (select doc_id, list_filter(list_transform(range(0, length(t), 650), lambda i: trim(substr(t, i + 1, 800))), lambda p: length(p) >= 100) as w from x)
        select doc_id, len(w) as n, sha256(array_to_string(w, chr(10))) as windows_sha256 from w""",
    "g10_breadcrumbs": """with x as (select event_id, list_filter([event_type, case when event_id % 3 = 0 then '' else cast(user_id as varchar) end, case when event_id % 4 = 0 then 'last' else '' end], lambda p: p <> '') as p, case when event_id % 2 = 0 then 'last' else event_type end as t from events)
        select event_id, array_to_string(case when p[-1] = t then p else list_append(p, t) end, ' > ') as path from x""",
    "g11_content_hash": "select doc_id, sha256(text) as content_hash from documents",
    "g12_stable_chunk_id": "select doc_id, substr(sha256(concat_ws(chr(31), source, cast(doc_id as varchar), text)), 1, 24) as chunk_id from documents",
    "g14_normalized_text": f"select doc_id, sha256({PLAIN}) as normalized_sha256 from documents",
    "g15_page_ids": "select doc_id, case doc_id % 4 when 0 then cast(100000 + doc_id as varchar) when 1 then cast(200000 + doc_id as varchar) || ',' || cast(300000 + doc_id as varchar) else case when doc_id % 4 = 3 and length(cast(doc_id as varchar)) between 6 and 12 then cast(doc_id as varchar) else '' end end as page_ids from documents",
    "g16_identifiers": f"""with {CHUNKS}, q as (select doc_id, title || ' ПР_UDO_01.01 ' || substr(text, 1, 300) || ' a.b' as q from ch), f as (select doc_id, regexp_extract_all(q, '(^|[^A-Za-zА-Яа-яЁё0-9])([A-Za-zА-Яа-яЁё][A-Za-zА-Яа-яЁё0-9]*([_.-][A-Za-zА-Яа-яЁё0-9]+)+)', 2) as f from q),
        u as (select doc_id, unnest(f) as x, generate_subscripts(f, 1) as i from f), m as (select doc_id, x, min(i) as i from u group by all) select doc_id, string_agg(x, ',' order by length(x) desc, i) as identifiers from m group by doc_id""",
    "g17_query_terms": r"select doc_id, sha256(array_to_string(list_transform(list_filter(regexp_extract_all(text, '[\p{L}\p{N}_]{3,}'), lambda x: not regexp_full_match(x, '[0-9]+')), lambda x: replace(lower(x), 'ß', 'ss')), ' ')) as terms_sha256 from documents",
    "g20_bare_chunks": r"select doc_id, sha256(case when doc_id % 3 = 0 then text when doc_id % 2 = 0 then 'Путь: a > b' || chr(10) || text else text end) as text_sha256 from documents",
    "g21_collection_names": r"with x as (select event_id, '/Org ' || event_type || '@' || event_id || repeat('.x', cast(event_id % 60 as bigint)) as m from events) select event_id, 'base__' || substr(lower(regexp_replace(regexp_replace(m, '[^a-zA-Z0-9_-]+', '-', 'g'), '^-+|-+$', '', 'g')), 1, 68) || '-' || substr(sha256(m), 1, 10) as name from x",
    "g23_plain_titles": rf"with {CHUNKS} select doc_id, trim(regexp_replace(replace(lower(regexp_replace('УДО 01   ' || title, '[^\p{{L}}\p{{N}}_\s\-./]+', ' ', 'g')), 'ß', 'ss'), '\s+', ' ', 'g')) as title from ch",
    "g24_dates": "select event_id, cast(floor(epoch(ts)) as bigint) as zulu, cast(floor(epoch(ts)) as bigint) - 10800 as short, cast(floor(epoch(date_trunc('minute', ts))) as bigint) + 19800 as colon, cast(-1 as bigint) as broken, strftime(ts, '%Y-%m-%d %H:%M') as minute from events",
    "g26_prefixes": "select doc_id, sha256('passage: ' || text) as passage_sha256, 'query: ' || case when doc_id % 2 = 0 then lang else '' end as query from documents",
    "g28_listed": "select event_id, case event_id % 3 when 0 then cast(event_id as varchar) || '=a' when 1 then 'x=b,k=c' else '' end as items from events",
    "g29_truncated": "select doc_id, sha256(case when length(text) > 8000 then substr(text, 1, 8000) || '... [текст обрезан]' else text end) as page_sha256, sha256(case when length(text) > 3000 then substr(text, 1, 3000) || '... [текст обрезан]' else text end) as chunk_sha256 from documents",
}
