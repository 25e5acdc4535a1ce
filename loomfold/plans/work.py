"""Queries over queues, the store and the roll-ups, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomfold.operators import filters, queue, store, toolkits
from loomfold.plans import adapters as A
from loomfold.plans.sql import CHUNKS, DUE, JOBS, NOW, PAGES


def _requests(s, d):
    """Requests of workers, some of which hold their job: id, worker, generation, error."""
    return A.jobs(s, d).selectExpr("id", "concat('w', id % 3) worker", "1 + id % 3 generation", "repeat(concat('failed ', id, ' '), 300) error")


REQUESTS = "rq as (select id, 'w' || cast(id % 3 as varchar) as worker, 1 + id % 3 as generation, repeat('failed ' || cast(id as varchar) || ' ', 300) as error from jb)"


def _incoming(s, d):
    return A.jobs(s, d).selectExpr("id seq", "operation", "if(id % 5 = 0, concat('n', id), cast(id - id % 3 as string)) chunk_id", "page_id", "'m0' model_version")


def _cache(s, d):
    """Vectors of two thirds of the texts that have one, under two models."""
    rows = A.vectors(s, d).join(A.chunks(s, d).select("chunk_id", "content_hash", "doc_id"), "chunk_id").filter("doc_id % 3 != 0")
    rows = rows.selectExpr("content_hash", "concat('m', doc_id % 2) model_version", "vector", "'' provider_runtime", "doc_id")
    return rows.groupBy("content_hash", "model_version", "provider_runtime").agg(F.min_by("vector", "doc_id").alias("vector"))


CACHE = CHUNKS + ", ca as (select content_hash, 'm' || cast(doc_id % 2 as varchar) as model_version, arg_min(embedding, doc_id) as vector from ch join embeddings on vec_id = doc_id where doc_id % 3 <> 0 group by all)"


def _pages(s, d):
    return A.pages(A.chunks(s, d))


def _replaced(s, d):
    """A batch that replaces each fifth page by its chunks of even index, renamed where the id is a multiple of 8."""
    chunks = A.chunks(s, d).select("chunk_id", "page_id", "text", "content_hash")
    pages = _pages(s, d).select("page_id", "section", "title", "url", "breadcrumbs", "version", "deleted_at", "parent_text", "source_text")
    new_pages = pages.filter("cast(page_id as long) % 5 = 0").withColumn("version", F.col("version") + 1)
    new = A.chunks(s, d).filter("cast(page_id as long) % 5 = 0 and chunk_index % 2 = 0").selectExpr("if(doc_id % 8 = 0, concat(chunk_id, 'x'), chunk_id) chunk_id", "page_id", "text", "'' content_hash")
    return pages, chunks, new_pages, new


def s1_jobs(s, d):
    pages, chunks, new_pages, new = _replaced(s, d)
    out = store.replace_pages(pages, chunks, A.jobs(s, d).filter("model_version = 'm0'"), new_pages, new, "m0", A.NOW)[2]
    return out.select("chunk_id", "model_version", "operation", "status", F.col("generation").cast("long").alias("generation"))


def s1_chunks(s, d):
    pages, chunks, new_pages, new = _replaced(s, d)
    return store.replace_pages(pages, chunks, A.jobs(s, d).limit(0), new_pages, new, "m0", A.NOW)[1].select("chunk_id", "page_id", "content_hash")


def s2_pages(s, d):
    chunks = A.chunks(s, d)
    out = store.tombstone_pages(_pages(s, d), chunks, A.jobs(s, d).limit(0), chunks.filter("doc_id % 160 = 1").select("page_id"), "m0", A.NOW)
    return out[0].select("page_id", F.col("deleted_at").isNotNull().alias("deleted")).join(out[1].groupBy("page_id").agg(F.count("*").alias("chunks")), "page_id", "left").fillna(0, ["chunks"])


def s11_collection(s, d):
    chunks = A.chunks(s, d).select("chunk_id", "content_hash", "text")
    jobs = queue.due(A.jobs(s, d), A.NOW).select("operation", F.expr("cast(id % 2000 as string)").alias("chunk_id"), "model_version").dropDuplicates(["chunk_id", "model_version"])
    old = chunks.selectExpr("chunk_id", "content_hash", "'m0' model_version", "array(0.0D) vector")
    made = lambda rows: rows.select("content_hash", F.array(F.length("text").cast("double")).alias("vector"))
    after, _ = store.index_step(jobs.withColumn("operation", F.lit("upsert")), chunks, _cache(s, d), old, made)
    return after.select("chunk_id", "model_version", F.round(F.col("vector")[0], 6).alias("first"))


def s13_sync(s, d):
    """The pages that a run for one section takes in, where each second page was known at a version one lower, equal or higher."""
    pages = _pages(s, d)
    known = pages.filter("cast(page_id as long) % 2 = 0").select("page_id", (F.col("version") + F.expr("cast(cast(page_id as long) % 3 - 1 as int)")).alias("version"))
    return store.changed_pages(pages.select("page_id", "version"), known)


def s14_stale(s, d):
    pages = _pages(s, d)
    return filters.stale_pages(pages.filter("section != 'src3'"), pages.filter("version = 4"), pages.filter("cast(page_id as long) % 4 != 0"))


def s17_ledger(s, d):
    pages = _pages(s, d).selectExpr("section", "page_id", "cast(page_id as long) % 10 p")
    return store.pending_ledger(pages.filter("p < 4").drop("p"), pages.filter("p between 3 and 6").drop("p"), pages.filter("p in (1, 5)").drop("p"))


def e8_renumbered(s, d):
    index = A.chunks(s, d).selectExpr("doc_id n", "page_id", "chunk_id")
    fresh = index.filter("n % 2 = 0").selectExpr("n", "page_id", "concat(chunk_id, 'x') chunk_id")
    return store.keep_and_append(index, fresh, index.filter("cast(page_id as long) % 5 = 0").select("page_id"))


def c13_diff(s, d):
    rows = A.chunks(s, d).select("chunk_id", "content_hash", "doc_id")
    from loomfold.operators.evaluate import manifest_diff

    expected = rows.filter("doc_id % 7 != 0").select("chunk_id", "content_hash")
    actual = rows.filter("doc_id % 5 != 0").select("chunk_id", "content_hash")
    return manifest_diff(expected, actual.unionAll(actual.filter("chunk_id like '1%'")))


def d19_evidence(s, d):
    rows = s.read.parquet(f"{d}/events.parquet").selectExpr("event_id seq", "event_type bucket", "cast(user_id % 50 as string) page_id", "if(event_id % 3 = 0, null, cast(event_id % 11 as string)) chunk_id", "concat('t', event_id % 2) title", "value score")
    return toolkits.merge_evidence(rows).select("seq", "bucket", "page_id")


SCENARIO = "concat('## Шаги сценария ', doc_id, '\n| # | Действие | Ожидание | Источник |\n|---|:---:|---|---|\n| 1 | ', {0}, ' | ok | page_id: ', 100000 + doc_id, ' |\n| 2 | b | | НЕ НАЙДЕНО |\n| 3 | - | | |\n| 4 | c | d | - |\n\n# Другое\n| 5 | e | f | 123456 |\n')"


def d18_scenarios(s, d):
    rows = A.table(s, d, "documents").selectExpr("doc_id scenario_id", SCENARIO.format("regexp_replace(substring(text, 1, 20), '[|\\n]', ' ')") + " text")
    out = toolkits.scenario_scores(rows)
    return out.select("scenario_id", "total_steps", "with_page_id", "with_page_id_pct", "explicit_gaps", "ungrounded_candidates", F.array_join("unique_page_ids", ",").alias("unique_page_ids"))


def a10_webhooks(s, d):
    from loomfold.streaming.webhook import signed, validated

    rows = A.deliveries(s, d).select(F.to_json(F.struct(F.col("raw_type").alias("eventType"), F.struct(F.col("page_id").alias("id")).alias("page"), F.col("delivery_id").alias("deliveryId"))).cast("binary").alias("body"), "id")
    rows = rows.withColumn("signature", F.when(F.col("id") % 13 == 0, "sha256=00").otherwise(F.concat(F.lit("sha256="), signed(F.col("body"), "key"))))
    rows = rows.select("id", "body", F.create_map(F.lit("X-Hub-Signature-256"), "signature").alias("headers"), F.concat(F.lit("10.0."), (F.col("id") % 300).cast("string"), F.lit(".1")).alias("source"))
    return validated(rows, "key", ["10.0.0.0/16"]).select("id", "error", "event_type", "class")


QUERIES = {
    "a10_webhook_checks": a10_webhooks,
    "b10_event_kind": lambda s, d: A.deliveries(s, d).select("id", filters.event_kind(F.col("raw_type")).alias("kind"), filters.event_class(filters.event_kind(F.col("raw_type"))).alias("class")),
    "b11_newer_versions": s13_sync,
    "b15_networks": lambda s, d: A.table(s, d, "events").select("event_id", filters.in_networks(F.concat_ws(".", F.expr("event_id % 256"), F.expr("user_id % 300"), F.expr("event_id % 7"), F.lit(1)), ["10.0.0.0/8", "8.8.0.0/14", "200.1.2.1/32"]).alias("allowed")),
    "c6_uncached": lambda s, d: filters.uncached(A.chunks(s, d).select("chunk_id", "content_hash"), _cache(s, d)).select("chunk_id"),
    "c7_first_open": lambda s, d: queue.first_open(A.jobs(s, d)).select("id"),
    "c8_cached_vectors": lambda s, d: filters.cached(A.chunks(s, d).select("chunk_id", "content_hash"), _cache(s, d), "m1").select("chunk_id", F.round(F.col("vector")[0], 6).alias("first")),
    "c13_manifest_diff": c13_diff,
    "c14_names": lambda s, d: filters.named(A.time_entries(s, d).select("user_id").distinct(), A.time_entries(s, d).select("user_id").distinct().filter("cast(user_id as int) % 3 != 0").selectExpr("user_id id", "if(cast(user_id as int) % 2 = 0, concat('N', user_id), ' ') name", "if(cast(user_id as int) % 5 = 0, 'L', '') last_name", "concat('login', user_id) login")),
    "c15_page_sections": lambda s, d: filters.page_sections(A.table(s, d, "events").selectExpr("cast(event_id as string) page_id", "array(cast(event_id % 10 as string), cast(user_id % 7 as string)) ancestors"), [("first", "3"), ("second", "5"), ("third", "8")]),
    "d7_queue_metrics": lambda s, d: queue.status_counts(A.jobs(s, d), A.NOW),
    "d8_event_metrics": lambda s, d: queue.event_metrics(A.jobs(s, d).filter("id % 2 = 0"), A.NOW).withColumn("oldest_age_seconds", F.round("oldest_age_seconds", 3)),
    "d9_drift": lambda s, d: store.drift(_pages(s, d), A.chunks(s, d), A.jobs(s, d), _cache(s, d), A.vectors(s, d)),
    "d10_coverage": lambda s, d: toolkits.coverage(A.chunks(s, d), A.vectors(s, d), _pages(s, d).filter("version = 3").select("section", "page_id")),
    "d11_parents": lambda s, d: toolkits.parents(A.chunks(s, d)).select("page_id", "title", "url", "breadcrumbs", F.array_join("chunk_ids", ",").alias("chunk_ids"), F.sha2("full_text", 256).alias("text_sha256")),
    "d17_task_time": lambda s, d: toolkits.task_time(A.time_entries(s, d)).withColumn("rank", F.col("rank").cast("long")),
    "d18_scenario_scores": d18_scenarios,
    "d19_evidence_merge": d19_evidence,
    "d23_unsettled": lambda s, d: queue.unsettled(A.jobs(s, d), "m1"),
    "e8_keep_and_append": e8_renumbered,
    "f5_removed_chunks": lambda s, d: filters.removed(A.chunks(s, d).filter("doc_id % 3 < 2"), A.chunks(s, d).filter("doc_id % 4 < 2")),
    "f6_stale_pages": s14_stale,
    "f7_multiset_equal": lambda s, d: toolkits.multiset_equal(A.chunks(s, d), A.chunks(s, d).repartition(4)).withColumn("pair", F.lit("same")).unionByName(toolkits.multiset_equal(A.chunks(s, d), A.chunks(s, d).withColumn("text", F.when(F.col("doc_id") != 7, F.col("text")))).withColumn("pair", F.lit("null"))).unionByName(toolkits.multiset_equal(A.chunks(s, d), A.chunks(s, d).union(A.chunks(s, d).filter("doc_id = 3"))).withColumn("pair", F.lit("repeated"))),
    "g27_backoff": lambda s, d: A.jobs(s, d).selectExpr("id", "cast(id % 7 as int) + 1 attempts").select("id", queue.backoff_seconds(F.col("attempts")).alias("delay_s"), F.when(F.col("attempts") >= 5, "dead").otherwise("pending").alias("status")),
    "g30_dialog_ids": lambda s, d: A.table(s, d, "events").select("event_id", filters.dialog_id(F.expr("if(event_id % 4 = 0, concat('chat', event_id), if(event_id % 4 = 1, concat('sg', event_id), cast(event_id as string)))"), F.expr("if(event_id % 3 = 0, 'project', null)"), F.expr("if(event_id % 5 = 0, 'sonet_group', null)")).alias("dialog")),
    "a15_chat_window": lambda s, d: toolkits.chat_window(A.messages(s, d), 4).select("dialog", F.col("place").cast("long").alias("place"), "author", F.sha2("text", 256).alias("text_sha256")),
    "s1_replaced_chunks": s1_chunks,
    "s1_replaced_jobs": s1_jobs,
    "s2_tombstones": s2_pages,
    "s3_enqueue": lambda s, d: queue.enqueue(A.jobs(s, d), _incoming(s, d), A.NOW).select("chunk_id", "model_version", "operation", "status", F.col("generation").cast("long").alias("generation"), "attempts", "replay_required"),
    "s4_lease": lambda s, d: queue.lease(A.jobs(s, d), "w9", 100, A.NOW, model="m1").select("id", "status", "leased_by"),
    "s5_complete": lambda s, d: queue.complete(A.jobs(s, d), _requests(s, d), A.NOW).select("id", "status", "leased_by", "replay_required"),
    "s5_fail": lambda s, d: queue.fail(A.jobs(s, d), _requests(s, d), A.NOW).select("id", "status", "attempts", "leased_by", F.expr(f"if(last_error is null, -1, unix_timestamp(available_at) - unix_timestamp(timestamp'{A.NOW}'))").alias("delay"), F.coalesce(F.length("last_error"), F.lit(0)).alias("error_chars")),
    "s5_heartbeat": lambda s, d: queue.heartbeat(A.jobs(s, d), _requests(s, d), A.NOW).select("id", F.expr(f"coalesce(lease_expires_at > timestamp'{A.NOW}', false)").alias("extended")),
    "s5_current": lambda s, d: queue.current(A.jobs(s, d), _requests(s, d)),
    "s5_replay": lambda s, d: queue.require_replay(A.jobs(s, d), _requests(s, d), A.NOW).select("id", "status", "attempts", "replay_required"),
    "s7_event_lease": lambda s, d: queue.lease_events(A.jobs(s, d), "w9", 50, A.NOW).select("id", "leased_by"),
    "s9_cache_put": lambda s, d: store.put_vectors(_cache(s, d), A.chunks(s, d).filter("doc_id % 4 = 0").selectExpr("content_hash", "'m0' model_version", "array(1.0D) vector", "'r' provider_runtime")).select("content_hash", "model_version", "dimensions", "provider_runtime"),
    "s10_requeue": lambda s, d: queue.requeue_model(A.jobs(s, d), A.chunks(s, d), "m0", A.NOW).select("chunk_id", "model_version", "operation", "status", F.col("generation").cast("long").alias("generation")),
    "s11_index_step": s11_collection,
    "s17_pending_ledger": s17_ledger,
    "s18_batches": lambda s, d: queue.batches(A.chunks(s, d).select("section", F.lpad("chunk_id", 12, "0").alias("page_id")), 1),
}

_OWNED = "jb.status = 'leased' and jb.leased_by = rq.worker"

SQL = {
    "b10_event_kind": "select event_id as id, case event_type when 'signup' then 'create' when 'view' then 'update' when 'click' then 'move' when 'purchase' then 'archive' else 'delete' end as kind, case when event_type in ('signup', 'view', 'click') then 'FETCH' else 'DELETE' end as class from events",
    "a10_webhook_checks": """select event_id as id, case when event_id % 300 > 255 then 'source_not_allowed' when event_id % 13 = 0 then 'invalid_signature' end as error,
        case event_type when 'signup' then 'create' when 'view' then 'update' when 'click' then 'move' when 'purchase' then 'archive' else 'delete' end as event_type, case when event_type in ('signup', 'view', 'click') then 'FETCH' else 'DELETE' end as class from events""",
    "b11_newer_versions": f"with {PAGES} select page_id, version from pv where not (p % 2 = 0 and version <= version + (cast(page_id as bigint) % 3 - 1))",
    "b15_networks": "select event_id, user_id % 300 <= 255 and (event_id % 256 = 10 or event_id % 256 = 8 and user_id % 300 between 8 and 11 or event_id % 256 = 200 and user_id % 300 = 1 and event_id % 7 = 2) as allowed from events",
    "c6_uncached": f"with {CACHE} select chunk_id from ch where content_hash not in (select content_hash from ca)",
    "c7_first_open": f"with {JOBS} select id from jb e where not exists (select 1 from jb p where p.page_id = e.page_id and p.id < e.id and p.status in ('pending', 'leased'))",
    "c8_cached_vectors": f"with {CACHE} select chunk_id, round(cast(vector[1] as double), 6) as first from ch left join (select * from ca where model_version = 'm1') c using (content_hash)",
    "c13_manifest_diff": f"""with {CHUNKS}, a as (select chunk_id, content_hash, doc_id from ch where doc_id % 5 <> 0)
        select (select count(*) from ch where doc_id % 7 <> 0) as expected, (select count(*) + count(*) filter (chunk_id like '1%') from a) as actual,
        (select count(*) from ch where doc_id % 7 <> 0 and doc_id % 5 = 0) as missing, (select count(*) from a where doc_id % 7 = 0) as extra, (select count(*) from a where chunk_id like '1%') as twice""",
    "c14_names": """with u as (select distinct user_id from events) select cast(user_id as varchar) as user_id, case when user_id % 3 = 0 then cast(user_id as varchar) when user_id % 2 = 0 then 'N' || user_id || case when user_id % 5 = 0 then ' L' else '' end
        when user_id % 5 = 0 then 'L' else 'login' || user_id end as "user" from u""",
    "c15_page_sections": "with e as (select cast(event_id as varchar) as page_id, [cast(event_id as varchar), cast(event_id % 10 as varchar), cast(user_id % 7 as varchar)] as ids from events) select page_id, case when list_contains(ids, '3') then 'first' when list_contains(ids, '5') then 'second' when list_contains(ids, '8') then 'third' end as section from e",
    "d7_queue_metrics": f"with {JOBS} select count(*) filter (status = 'pending') as pending, count(*) filter (status = 'leased') as leased, count(*) filter (status = 'completed') as completed, count(*) filter (status = 'dead') as dead, count(*) filter (status = 'pending' and available_at <= {NOW}) as due from jb",
    "d8_event_metrics": f"with {JOBS} select count(*) filter (status = 'pending') as pending, count(*) filter (status = 'leased') as leased, count(*) filter (status = 'completed') as completed, count(*) filter (status = 'dead') as dead, count(*) filter (status in ('pending', 'leased')) as depth, round(greatest(0, epoch_us({NOW}) - epoch_us(min(created_at) filter (status in ('pending', 'leased')))) / 1e6, 3) as oldest_age_seconds from jb where id % 2 = 0",
    "d9_drift": f"""with {PAGES}, ca as (select distinct content_hash from ch join embeddings on vec_id = doc_id where doc_id % 3 <> 0), {JOBS}
        select (select count(*) from pv where not deleted) as pages, (select count(*) from ch) as chunks, (select count(*) from ch where content_hash not in (select content_hash from ca)) as uncached_chunks,
        (select count(*) from jb where status <> 'completed') as unsettled_jobs, (select count(*) from embeddings) as vectors, (select count(*) from embeddings) - (select count(*) from ch) as vector_delta""",
    "d10_coverage": f"""with {PAGES}, late as (select section, count(*) as n from pv where version = 3 group by section), v as (select distinct vec_id from embeddings),
        by_ as (select section, count(*) as corpus_chunks, count(distinct page_id) as corpus_pages, count(vec_id) as indexed_chunks from ch left join v on vec_id = doc_id group by section),
        x as (select section, corpus_chunks, corpus_pages, indexed_chunks, coalesce(n, 0) as pending_pages from by_ left join late using (section))
        select section, cast(sum(corpus_chunks) as bigint) as corpus_chunks, cast(sum(corpus_pages) as bigint) as corpus_pages, cast(sum(indexed_chunks) as bigint) as indexed_chunks, cast(sum(pending_pages) as bigint) as pending_pages,
        round(sum(indexed_chunks) / sum(corpus_chunks), 6) as coverage from x group by grouping sets ((section), ())""",
    "d11_parents": f"""with {CHUNKS} select page_id, arg_min(title, chunk_index) as title, arg_min(url, chunk_index) as url, arg_min(breadcrumbs, chunk_index) as breadcrumbs, string_agg(chunk_id, ',' order by chunk_index, chunk_id) as chunk_ids,
        sha256(string_agg(text, chr(10) || chr(10) order by chunk_index, chunk_id)) as text_sha256 from ch group by page_id""",
    "d17_task_time": """with x as (select event_type as task, cast(user_id as varchar) as user_id, cast(sum(cast(floor(value) as bigint)) as bigint) as seconds, count(*) as entries from events group by all),
        y as (select task, user_id, seconds, entries, row_number() over (partition by task order by seconds desc, user_id) as rank from x union all select task, null, cast(sum(seconds) as bigint), cast(sum(entries) as bigint), 0 from x group by task)
        select task, user_id, seconds, entries, rank, round(seconds / 3600, 2) as hours from y""",
    "d18_scenario_scores": r"""with x as (select doc_id, regexp_replace(substr(text, 1, 20), '[|\n]', ' ', 'g') as a from documents), y as (select doc_id, trim(a) as a, regexp_extract_all(a, '\d{6,}') as ids from x)
        select doc_id as scenario_id, cast(3 as bigint) as total_steps, cast(1 as bigint) as with_page_id, 33.3 as with_page_id_pct, cast(1 as bigint) as explicit_gaps, cast(1 as bigint) as ungrounded_candidates,
        array_to_string(list_sort(list_distinct(list_append(ids, cast(100000 + doc_id as varchar)))), ',') as unique_page_ids from y""",
    "d19_evidence_merge": "select event_id as seq, event_type as bucket, cast(user_id % 50 as varchar) as page_id from events qualify row_number() over (partition by user_id % 50, event_type, case when event_id % 3 = 0 then 't' || cast(event_id % 2 as varchar) else cast(event_id % 11 as varchar) end order by value desc, event_id) = 1",
    "d23_unsettled": f"with {JOBS} select status, count(*) as n from jb where model_version = 'm1' and status <> 'completed' group by status",
    "e8_keep_and_append": f"""with {CHUNKS}, x as (select 0 as side, doc_id as o, page_id, chunk_id from ch where cast(page_id as bigint) % 5 <> 0 union all select 1, doc_id, page_id, chunk_id || 'x' from ch where cast(page_id as bigint) % 5 = 0 and doc_id % 2 = 0)
        select row_number() over (order by side, o) - 1 as n, page_id, chunk_id from x""",
    "f5_removed_chunks": f"with {CHUNKS} select chunk_id from ch where doc_id % 3 < 2 and doc_id % 4 >= 2",
    "f6_stale_pages": f"with {PAGES} select page_id from pv where (section <> 'src3' or version = 4) and cast(page_id as bigint) % 4 = 0",
    "f7_multiset_equal": """with c as (select source, cast(100000 + (doc_id // 80) * 20 + doc_id % 20 as varchar) as page_id, text, doc_id from documents),
        n as (select count(*) filter (n <> 0) = 0 as eq from (select page_id, t, sum(k) as n from (select page_id, coalesce(text, chr(0)) as t, 1 as k from c union all select page_id, coalesce(case when doc_id <> 7 then text end, chr(0)), -1 from c) group by all)),
        r as (select count(*) filter (n <> 0) = 0 as eq from (select page_id, text, sum(k) as n from (select page_id, text, 1 as k from c union all select page_id, text, -1 from c union all select page_id, text, -1 from c where doc_id = 3) group by all))
        select eq as equal, 'null' as pair from n union all select eq, 'repeated' from r union all select true, 'same'""",
    "g27_backoff": "select event_id as id, case when event_id % 7 + 1 >= 5 then 0.0 else 5 * pow(2, event_id % 7) end::double as delay_s, case when event_id % 7 + 1 >= 5 then 'dead' else 'pending' end as status from events",
    "g30_dialog_ids": "select event_id, case when event_id % 4 = 0 then 'chat' || event_id when event_id % 4 = 1 then 'sg' || event_id when event_id % 3 = 0 or event_id % 5 = 0 then 'sg' || event_id else 'chat' || event_id end as dialog from events",
    "a15_chat_window": r"""with x as (select conv_id, turn, role, regexp_replace(coalesce(text, ''), '^ +| +$', '', 'g') as text from conversations qualify row_number() over (partition by conv_id order by turn desc) <= 4)
        select conv_id as dialog, row_number() over (partition by conv_id order by turn) - 1 as place, role as author, sha256(text) as text_sha256 from x""",
    "s1_replaced_chunks": f"""with {CHUNKS} select chunk_id, page_id, content_hash from ch where cast(page_id as bigint) % 5 <> 0 union all
        select case when doc_id % 8 = 0 then chunk_id || 'x' else chunk_id end, page_id, content_hash from ch where cast(page_id as bigint) % 5 = 0 and chunk_index % 2 = 0""",
    "s1_replaced_jobs": f"""with {CHUNKS}, new as (select case when doc_id % 8 = 0 then chunk_id || 'x' else chunk_id end as chunk_id from ch where cast(page_id as bigint) % 5 = 0 and chunk_index % 2 = 0),
        asked as (select chunk_id, 'upsert' as op from new union all select chunk_id, 'delete' from ch where cast(page_id as bigint) % 5 = 0 and chunk_id not in (select chunk_id from new)), {JOBS}
        select coalesce(j.chunk_id, a.chunk_id) as chunk_id, 'm0' as model_version, coalesce(op, operation) as operation, case when op is not null then 'pending' else status end as status, coalesce(generation, 0) + case when op is not null then 1 else 0 end as generation
        from (select * from jb where model_version = 'm0') j full join asked a using (chunk_id)""",
    "s2_tombstones": f"""with {PAGES}, gone as (select distinct page_id from ch where doc_id % 160 = 1), c as (select page_id, count(*) as n from ch group by page_id)
        select page_id, deleted or page_id in (select page_id from gone) as deleted, case when page_id in (select page_id from gone) then 0 else n end as chunks from pv join c using (page_id)""",
    "s3_enqueue": f"""with {JOBS}, inc as (select id as seq, operation, case when id % 5 = 0 then 'n' || cast(id as varchar) else cast(id - id % 3 as varchar) end as chunk_id, 'm0' as model_version from jb),
        a as (select chunk_id, model_version, count(*) as times, arg_max(operation, seq) as op from inc group by all)
        select coalesce(j.chunk_id, a.chunk_id) as chunk_id, coalesce(j.model_version, a.model_version) as model_version, coalesce(op, operation) as operation, case when op is not null then 'pending' else status end as status,
        coalesce(generation, 0) + coalesce(times, 0) as generation, case when op is not null then 0 else attempts end as attempts, case when op is not null then false else replay_required end as replay_required
        from jb j full join a on a.chunk_id = j.chunk_id and a.model_version = j.model_version""",
    "s4_lease": f"with {JOBS} select id, 'leased' as status, 'w9' as leased_by from jb where {DUE} and model_version = 'm1' order by id limit 100",
    "s5_complete": f"""with {JOBS}, {REQUESTS}, h as (select jb.*, {_OWNED} and jb.generation = rq.generation as hit from jb join rq using (id))
        select id, case when hit then case when replay_required then 'pending' else 'completed' end else status end as status, case when not coalesce(hit, false) then leased_by end as leased_by, case when hit then false else replay_required end as replay_required from h""",
    "s5_fail": f"""with {JOBS}, {REQUESTS}, h as (select jb.*, error, coalesce({_OWNED}, false) as hit from jb join rq using (id))
        select id, case when not hit then status when attempts + 1 >= 5 then 'dead' else 'pending' end as status, case when hit then attempts + 1 else attempts end as attempts, case when not hit then leased_by end as leased_by,
        case when hit then case when attempts + 1 >= 5 then 0 else cast(5 * pow(2, attempts) as bigint) end else -1 end as delay, case when hit then least(2000, length(error)) else 0 end as error_chars from h""",
    "s5_heartbeat": f"with {JOBS}, {REQUESTS} select id, case when {_OWNED} then true else coalesce(lease_expires_at > {NOW}, false) end as extended from jb join rq using (id)",
    "s5_current": f"with {JOBS}, {REQUESTS} select id, coalesce({_OWNED} and jb.generation = rq.generation, false) as current from jb join rq using (id)",
    "s5_replay": f"""with {JOBS}, {REQUESTS}, h as (select jb.*, jb.generation <> rq.generation as hit from jb join rq using (id))
        select id, case when hit and status = 'completed' then 'pending' else status end as status, case when hit and status = 'completed' then 0 else attempts end as attempts, case when hit then status <> 'completed' else replay_required end as replay_required from h""",
    "s7_event_lease": f"with {JOBS} select id, 'w9' as leased_by from jb e where {DUE} and not exists (select 1 from jb p where p.page_id = e.page_id and p.id < e.id and p.status in ('pending', 'leased')) order by id limit 50",
    "s9_cache_put": f"""with {CACHE}, new as (select distinct content_hash from ch where doc_id % 4 = 0)
        select content_hash, model_version, cast(len(vector) as integer) as dimensions, '' as provider_runtime from ca where not (model_version = 'm0' and content_hash in (select content_hash from new)) union all select content_hash, 'm0', 1, 'r' from new""",
    "s10_requeue": f"""with {CHUNKS}, {JOBS} select coalesce(j.chunk_id, c.chunk_id) as chunk_id, coalesce(model_version, 'm0') as model_version, case when c.chunk_id is not null then 'upsert' else operation end as operation, case when c.chunk_id is not null then 'pending' else status end as status,
        coalesce(generation, 0) + case when c.chunk_id is not null then 1 else 0 end as generation from jb j full join ch c on c.chunk_id = j.chunk_id and j.model_version = 'm0'""",
    "s11_index_step": f"""with {CACHE}, {JOBS}, t as (select distinct cast(id % 2000 as varchar) as chunk_id, model_version from jb where {DUE})
        select chunk_id, model_version, round(coalesce(cast(vector[1] as double), length(text)), 6) as first from t join ch using (chunk_id) left join ca using (content_hash, model_version)
        union all select chunk_id, 'm0', 0.0 from ch where (chunk_id, 'm0') not in (select (chunk_id, model_version) from t)""",
    "s17_pending_ledger": f"with {PAGES} select section, page_id from pv where cast(page_id as bigint) % 10 <= 6 and cast(page_id as bigint) % 10 not in (1, 5)",
    "s18_batches": "with x as (select source as section, lpad(cast(doc_id as varchar), 12, '0') as page_id, cast(floor((row_number() over (partition by source order by doc_id) - 1) / 75) as bigint) as batch from documents) select section, page_id, batch, batch >= 1 as pending from x",
}
