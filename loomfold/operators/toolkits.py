"""Roll-ups of chats, time entries, evidence and scenarios."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomfold.functions.text import text_or_empty
from loomfold.operators.filters import first_of

#: Headings under which a scenario's steps stand, what marks a gap, words of a header row, page ids in a step (fixed values).
STEPS, GAP = "(?iu)шаги сценария|негативн|граничн", "(?iu)НЕ НАЙДЕНО"
ACTION, CONDITION, SOURCE = "действие", "предусловие", "источник"
STEP_PAGE = r"(?i)(?:page[_ ]?id\s*[=:]\s*)?(\d{6,})"
#: Queries of an evidence pack: bucket, words after topic and codes, section (fixed values).
BUCKETS = {
    "decisions": ("проектное решение ПР", "Стадии проекта"), "requirements": ("требование ФТ FTT доработка", "Стадии проекта"),
    "process": ("BPMN Шторм бизнес-процесс шаг", "Стадии проекта"), "meetings": ("протокол встречи решение совета", "Управление проектом"),
}
TEMPLATE = "шаблон сценария приёмки функционала"


def coverage(chunks: DataFrame, vectors: DataFrame, pending: DataFrame) -> DataFrame:
    """section, corpus_chunks, corpus_pages, indexed_chunks, pending_pages, coverage (0 for no chunks), and a row of totals without section
    (D10). `vectors`: chunk_id; `pending`: section, page_id."""
    have = vectors.select("chunk_id", F.lit(1).alias("has")).distinct()
    rows = chunks.select("chunk_id", "section", "page_id").join(have, "chunk_id", "left")
    by = rows.groupBy("section").agg(F.count("*").alias("corpus_chunks"), F.count("has").alias("indexed_chunks"))
    pages = rows.select("section", "page_id").distinct().groupBy("section").agg(F.count("*").alias("corpus_pages"))
    late = pending.distinct().groupBy("section").agg(F.count("*").alias("pending_pages"))
    by = by.join(pages, "section", "left").join(late, "section", "left").fillna(0, ["pending_pages"])
    counts = ["corpus_chunks", "corpus_pages", "indexed_chunks", "pending_pages"]
    whole = by.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts]).withColumn("section", F.lit(None).cast("string"))
    ratio = F.coalesce(F.try_divide("indexed_chunks", "corpus_chunks"), F.lit(0.0))
    return by.select("section", *counts).unionByName(whole).withColumn("coverage", F.round(ratio, 6))


def parents(chunks: DataFrame) -> DataFrame:
    """page_id, title and url of the first chunk, the first breadcrumbs that are not empty, chunk ids in order, texts joined by a blank line
    (D11). A page is the unit that is held whole."""
    part = F.struct("chunk_index", "chunk_id", "title", "url", F.when(F.col("breadcrumbs") != "", F.col("breadcrumbs")).alias("crumbs"), "text")
    rows = chunks.groupBy("page_id").agg(F.array_sort(F.collect_list(part)).alias("p"))
    crumbs = F.get(F.filter(F.transform("p", lambda x: x.crumbs), lambda x: x.isNotNull()), 0)
    return rows.select("page_id", F.col("p")[0].title.alias("title"), F.col("p")[0].url.alias("url"), F.coalesce(crumbs, F.lit("")).alias("breadcrumbs"), F.transform("p", lambda x: x.chunk_id).alias("chunk_ids"), F.array_join(F.transform("p", lambda x: text_or_empty(x.text)), "\n\n").alias("full_text"))


def duplicate_ordinals(chunks: DataFrame) -> DataFrame:
    """chunk_id and the place of its text among the equal texts of its page."""
    w = Window.partitionBy("page_id", "content_hash").orderBy("chunk_index", "chunk_id")
    return chunks.select("chunk_id", (F.row_number().over(w) - 1).cast("long").alias("ordinal"))


def multiset_equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """Whether both hold the same (page_id, text) rows equally often (F7): signed counts by row, nulls being values of their own."""
    signed = a.select("page_id", "text", F.lit(1).alias("n")).unionAll(b.select("page_id", "text", F.lit(-1).alias("n")))
    key = F.sha2(F.to_json(F.struct("page_id", "text"), {"ignoreNullFields": "false"}), 256)
    return signed.groupBy(key.alias("k")).agg(F.sum("n").alias("n")).agg((F.count_if(F.col("n") != 0) == 0).alias("equal"))


def task_time(entries: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """task, user_id, seconds, entries, hours (two digits), rank by seconds, and for each task a row of totals without user."""
    by = entries.groupBy("task", "user_id").agg(F.sum("seconds").alias("seconds"), F.count("*").alias("entries"))
    by = by.withColumn("rank", F.row_number().over(Window.partitionBy("task").orderBy(F.desc("seconds"), "user_id")))
    whole = by.groupBy("task").agg(F.sum("seconds").alias("seconds"), F.sum("entries").alias("entries")).select("task", F.lit(None).cast("string").alias("user_id"), "seconds", "entries", F.lit(0).alias("rank"))
    # rounded by the binary value, as floats are elsewhere: 522 seconds are 0.14 hours
    out = by.unionByName(whole).withColumn("hours", F.floor(F.col("seconds") / 3600 * 100 + 0.5) / 100)
    if names is not None:
        out = out.join(names.select(F.col("id").alias("user_id"), F.col("name").alias("user")), "user_id", "left").withColumn("user", F.coalesce("user", "user_id"))
    return out


def chat_window(messages: DataFrame, most: int, since: str | None = None, names: DataFrame | None = None) -> DataFrame:
    """dialog, place, author, text of the last `most` messages of each dialog, oldest first (A15): by date and id, the text's first useful
    field trimmed, the author's name, `system` for 0, or the id. Messages: dialog, id, author_id, text, and date and message if there are any."""
    have = messages.columns
    date = F.col("date") if "date" in have else F.lit("")
    rows = messages if since is None else messages.filter(date >= since)
    text = F.trim(first_of(*[F.col(c) for c in ("text", "message") if c in have]))
    author = first_of(F.col("author_id"), F.lit("0"))
    rows = rows.select("dialog", "id", date.alias("date"), author.alias("author_id"), text.alias("text"))
    back = Window.partitionBy("dialog").orderBy(F.desc("date"), F.desc("id"))
    rows = rows.withColumn("back", F.row_number().over(back)).filter(F.col("back") <= most)
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("dialog").orderBy(F.desc("back"))) - 1)
    if names is not None:
        rows = rows.join(names.select(F.col("id").alias("author_id"), F.col("name").alias("named")), "author_id", "left")
    known = F.col("named") if names is not None else F.lit(None).cast("string")
    return rows.select("dialog", "place", F.coalesce(known, F.when(F.col("author_id") == "0", "system"), F.col("author_id")).alias("author"), "text")


def merge_evidence(hits: DataFrame) -> DataFrame:
    """The best hit of each page, chunk (or title) and bucket, the first of equal ones (D19). Hits: seq, bucket, page_id,
    chunk_id, title, score."""
    key = F.when(F.coalesce("chunk_id", F.lit("")) != "", F.col("chunk_id")).otherwise(F.coalesce("title", F.lit("")))
    score = F.coalesce(F.col("score"), F.lit(0.0))
    w = Window.partitionBy(F.coalesce("page_id", F.lit("")), "key", "bucket").orderBy(F.desc(score), "seq")
    best = hits.withColumn("key", key).withColumn("n_", F.row_number().over(w)).filter("n_ = 1").drop("n_", "key")
    return best


def evidence_queries(topics: DataFrame) -> DataFrame:
    """query_id, topic_id, bucket, section, query of an evidence pack (H11): four buckets, the template, and each code alone. `topics`: topic_id,
    topic, codes array<string>."""
    blob = F.trim(F.concat_ws(" ", F.trim("topic"), F.array_join("codes", " ")))
    own = [F.struct(F.lit(b).alias("bucket"), F.lit(section).alias("section"), F.concat_ws(" ", blob, F.lit(words)).alias("query")) for b, (words, section) in BUCKETS.items()]
    own.append(F.struct(F.lit("template").alias("bucket"), F.lit(None).cast("string").alias("section"), F.lit(TEMPLATE).alias("query")))
    codes = F.transform(F.filter("codes", lambda c: F.trim(c) != ""), lambda c: F.struct(F.lit("codes").alias("bucket"), F.lit(None).cast("string").alias("section"), F.trim(c).alias("query")))
    rows = topics.select("topic_id", F.posexplode(F.concat(F.array(*own), codes)).alias("place", "q"))
    return rows.select(F.concat_ws("/", F.col("topic_id").cast("string"), F.col("place").cast("string")).alias("query_id"), "topic_id", "place", "q.*")


def evidence_pack(topics: DataFrame, search, k: int = 5) -> DataFrame:
    """Evidence for each topic (H11): the queries of evidence_queries through `search` (queries and a section -> query_id, page_id, chunk_id,
    score, rank), merged within the topic (D19). Codes get half as many results, three at least."""
    asked = evidence_queries(topics)
    parts = []
    for section in sorted({s for _, s in BUCKETS.values()}) + [None]:
        own = asked.filter(F.col("section").eqNullSafe(F.lit(section)))
        parts.append(search(own.select("query_id", "query"), section))
    hits = parts[0]
    for p in parts[1:]:
        hits = hits.unionByName(p)
    hits = hits.join(asked.select("query_id", "topic_id", "place", "bucket"), "query_id").filter(F.col("rank") <= F.when(F.col("bucket") == "codes", max(3, k // 2)).otherwise(k))
    key = F.coalesce("chunk_id", F.lit(""))
    w = Window.partitionBy("topic_id", "page_id", key, "bucket").orderBy(F.desc("score"), "place", "rank")
    best = hits.withColumn("n_", F.row_number().over(w)).filter("n_ = 1")
    order = Window.partitionBy("topic_id").orderBy(F.desc("score"), "place", "rank")
    return best.withColumn("merged_rank", F.row_number().over(order)).select("topic_id", "bucket", "page_id", "chunk_id", "score", "merged_rank")


def scenario_steps(scenarios: DataFrame) -> DataFrame:
    """scenario_id, line, section, action, expected, source, page_ids, gap, ungrounded of every step of a scenario in markdown.

    Rows of the tables under headings that name steps; separator, header and empty rows are none. A scenario is one text; its lines are numbered
    and the heading above each is the last one before it. `scenarios`: scenario_id, text.
    """
    lines = scenarios.select("scenario_id", F.posexplode(F.split(text_or_empty(F.col("text")), r"\r\n|[\n\r]")).alias("line", "raw"))
    heading = F.when(F.col("raw").rlike(r"^#{1,6}\s+"), F.trim(F.regexp_replace("raw", r"^#{1,6}\s+", "")))
    above = Window.partitionBy("scenario_id").orderBy("line")
    lines = lines.withColumn("heading", heading).withColumn("section", F.last("heading", ignorenulls=True).over(above))
    rows = lines.filter(F.col("heading").isNull() & F.coalesce(F.col("section").rlike(STEPS), F.lit(False)) & F.col("raw").rlike(r"^\s*\|"))
    cells = F.transform(F.split(F.regexp_replace(F.trim("raw"), r"^\|+|\|+$", ""), r"\|"), lambda c: F.trim(c))
    rows = rows.withColumn("cells", cells).filter(~F.forall("cells", lambda c: F.replace(c, F.lit(" "), F.lit("")).rlike("^:?-{3,}:?$")))
    low = F.transform("cells", F.lower)
    first, labels, joined = F.replace(low[0], F.lit("№"), F.lit("#")), F.array_join(F.slice(low, 2, 2), " "), F.array_join(low, " ")
    number = F.coalesce(F.get(F.col("cells"), 0).rlike(r"^\d+$"), F.lit(False))
    header = F.when(first.isin("#", "n") & (labels.contains(ACTION) | labels.contains(CONDITION)), True).when(first.isin("#", "n"), False).otherwise(joined.startswith(ACTION) | joined.contains(ACTION) & joined.contains(SOURCE) & ~number)
    body = F.when(number, F.slice("cells", 2, 10_000)).otherwise(F.col("cells"))
    empty = ~F.exists(body, lambda c: ~c.isin("", "-", "—"))
    rows = rows.filter(~header & ~empty)
    every = F.array_join("cells", " ")
    ids = F.array_distinct(F.regexp_extract_all(every, F.lit(STEP_PAGE)))
    cell = lambda i: F.coalesce(F.get(F.col("cells"), i), F.lit(""))
    gap = every.rlike(GAP)
    return rows.select("scenario_id", "line", "section", cell(1).alias("action"), cell(2).alias("expected"), F.element_at("cells", -1).alias("source"), ids.alias("page_ids"), gap.alias("gap"), (((cell(1) != "") | (cell(2) != "")) & (F.size(ids) == 0) & ~gap).alias("ungrounded"))


def scenario_scores(scenarios: DataFrame) -> DataFrame:
    """scenario_id, total_steps, with_page_id, with_page_id_pct (one digit), explicit_gaps, ungrounded_candidates, unique_page_ids."""
    steps = scenario_steps(scenarios)
    by = steps.groupBy("scenario_id").agg(F.count("*").alias("total_steps"), F.count_if(F.size("page_ids") > 0).alias("with_page_id"), F.count_if("gap").alias("explicit_gaps"), F.count_if("ungrounded").alias("ungrounded_candidates"))
    ids = steps.select("scenario_id", F.explode("page_ids").alias("id")).distinct().groupBy("scenario_id").agg(F.array_sort(F.collect_list("id")).alias("unique_page_ids"))
    out = scenarios.select("scenario_id").join(by, "scenario_id", "left").join(ids, "scenario_id", "left").fillna(0)
    pct = F.round(F.coalesce(F.try_divide(100.0 * F.col("with_page_id"), F.col("total_steps")), F.lit(0.0)), 1)
    return out.withColumns({"with_page_id_pct": pct, "unique_page_ids": F.coalesce("unique_page_ids", F.array().cast("array<string>"))})
