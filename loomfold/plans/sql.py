"""The adapters' tables in SQL for DuckDB, as common table expressions that the oracles begin with."""

CHUNKS = """ch as (select cast(doc_id as varchar) as chunk_id, source as section, cast(100000 + (doc_id // 80) * 20 + doc_id % 20 as varchar) as page_id,
    cast((doc_id // 20) % 4 as integer) as chunk_index, 0 as duplicate_ordinal, lang as content_type, text, doc_id,
    'DOC-' || upper(lang) || '_' || cast(doc_id // 80 as varchar) || ' ' || substr(split_part(text, chr(10), 1), 1, 60) as title,
    source || ' > ' || lang as breadcrumbs, sha256(text) as content_hash, 'https://example.org/pages/' || cast(100000 + (doc_id // 80) * 20 + doc_id % 20 as varchar) as url from documents)"""

PAGES = (
    CHUNKS
    + """, pg as (select page_id, min(section) as section, arg_min(title, chunk_index) as title, min(url) as url, cast(page_id as bigint) - 100000 as p from ch group by page_id),
    pv as (select page_id, section, title, url, section || ' > ' || title as breadcrumbs, cast(p % 9 + 1 as integer) as version, p % 7 = 6 as deleted, p,
    case when p % 3 = 0 then '' else 'parent of ' || title end as parent_text, case when p % 6 = 0 then 'source of ' || title else '' end as source_text from pg)"""
)

NOW = "timestamp '2024-01-20 00:00:00'"

JOBS = """jb as (select event_id as id, cast(event_id as varchar) as chunk_id, cast(user_id as varchar) as page_id, 'm' || cast(event_id % 3 as varchar) as model_version,
    case when event_id % 4 = 0 then 'delete' else 'upsert' end as operation, case event_type when 'click' then 'leased' when 'purchase' then 'completed' when 'error' then 'dead' else 'pending' end as status,
    cast(event_id % 6 as integer) as attempts, ts + to_seconds(event_id % 600) as available_at, 1 + event_id % 4 as generation, event_id % 5 = 0 as replay_required,
    case when event_type = 'click' then 'w' || cast(user_id % 3 as varchar) end as leased_by, case when event_type = 'click' then ts + to_seconds(300) end as lease_expires_at, ts as created_at from events)"""

DUE = f"(status = 'pending' and available_at <= {NOW} or status = 'leased' and lease_expires_at <= {NOW})"

#: A normalized text (lower case, words only) of column `text`.
PLAIN = r"trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"

SIMHASH = (
    f"plain as (select cast(doc_id as varchar) as chunk_id, {PLAIN} as plain, strlen(text) as bytes from documents), "
    r"""tok as (select chunk_id, unnest(regexp_extract_all(plain, '[\p{L}\p{N}_]+')) as token from plain),
    cnt as (select chunk_id, token, count(*) as c from tok group by all),
    hashed as (select token, cast('0x' || substr(sha256(token), 1, 16) as ubigint) as h from (select distinct token from cnt)),
    bits as (select chunk_id, i, sum(case when (h >> i) & 1 = 1 then c else -c end) as w from cnt join hashed using (token), range(0, 64) r(i) group by chunk_id, i),
    sums as (select chunk_id, sum(case when w >= 0 then (1::hugeint) << i else 0 end) as u from bits group by chunk_id),
    sig as (select chunk_id, bytes, sha256(plain) as fingerprint, cast(case when coalesce(u, 18446744073709551615) >= 9223372036854775808 then coalesce(u, 18446744073709551615) - 18446744073709551616 else u end as bigint) as signature from plain left join sums using (chunk_id))"""
)
