"""Work queues as pure transitions of a job table.

A job: id, operation, chunk_id, page_id, model_version, status, attempts, available_at, lease_expires_at, leased_by, generation,
replay_required. Every transition takes the table and a table of requests and returns the new table (or the rows asked for); `now` is given.
Requests are joined by key, so they may be as many as the jobs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATUSES = ("pending", "leased", "completed", "dead")
OPEN = ("pending", "leased")
#: Longest error text that is kept.
ERROR = 2000


def at(now: str) -> Column:
    return F.lit(now).cast("timestamp")


def after(now: str, seconds: Column | int) -> Column:
    seconds = F.lit(seconds) if isinstance(seconds, int) else seconds
    return at(now) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18, 6)"))


def status_counts(jobs: DataFrame, now: str) -> DataFrame:
    """Rows by status, zero-filled, and those pending ones that are due, in one row."""
    due = (F.col("status") == "pending") & (F.col("available_at") <= at(now))
    return jobs.agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES], F.count_if(due).alias("due"))


def event_metrics(events: DataFrame, now: str) -> DataFrame:
    """Counts by status, open events, and the age in seconds of the oldest open one, at least 0."""
    is_open = F.col("status").isin(*OPEN)
    age = F.unix_micros(at(now)) - F.unix_micros(F.min(F.when(is_open, F.col("created_at"))))
    return events.agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES], F.count_if(is_open).alias("depth"), F.coalesce(F.greatest(age / 1e6, F.lit(0.0)), F.lit(0.0)).alias("oldest_age_seconds"))


def unsettled(jobs: DataFrame, model: str) -> DataFrame:
    """Jobs of one model that are not completed, by status."""
    return jobs.filter((F.col("model_version") == model) & (F.col("status") != "completed")).groupBy("status").agg(F.count("*").alias("n"))


def enqueue(jobs: DataFrame, incoming: DataFrame, now: str) -> DataFrame:
    """Upsert by chunk_id and model_version (S3). `incoming`: seq, operation, chunk_id, page_id, model_version.

    A known job takes the last request's operation and page, goes up one generation for each request and back to pending, free of
    attempts, lease and replay; a new one starts at generation 1. New rows carry a null id.
    """
    key = ["chunk_id", "model_version"]
    asked = incoming.groupBy(*key).agg(F.count("*").alias("times"), F.max(F.struct("seq", "operation", "page_id")).alias("last"))
    out = jobs.join(asked, key, "full")
    again = F.col("times").isNotNull()
    fresh = {
        "operation": F.col("last.operation"), "page_id": F.col("last.page_id"), "status": F.lit("pending"), "attempts": F.lit(0), "available_at": at(now),
        "leased_by": F.lit(None).cast("string"), "lease_expires_at": F.lit(None).cast("timestamp"), "replay_required": F.lit(False),
        "generation": F.coalesce("generation", F.lit(0)) + F.col("times"),
    }
    return out.select(*[(F.when(again, fresh[c]).otherwise(F.col(c)).cast(t) if c in fresh else F.col(c)).alias(c) for c, t in jobs.dtypes])


def requeue_model(jobs: DataFrame, chunks: DataFrame, model: str, now: str) -> DataFrame:
    """One upsert job for each present chunk, for one model."""
    asked = chunks.selectExpr("0 seq", "'upsert' operation", "chunk_id", "page_id").withColumn("model_version", F.lit(model))
    return enqueue(jobs, asked, now)


def due(jobs: DataFrame, now: str, model: str | None = None) -> DataFrame:
    """Pending jobs whose time has come, and leased ones whose lease has ended."""
    when = (F.col("status") == "pending") & (F.col("available_at") <= at(now)) | (F.col("status") == "leased") & (F.col("lease_expires_at") <= at(now))
    return jobs.filter(when if model is None else when & (F.col("model_version") == model))


def _leased(rows: DataFrame, worker: str, n: int, now: str, seconds: int) -> DataFrame:
    rows = rows.orderBy("id").limit(max(1, n))
    return rows.withColumns({"status": F.lit("leased"), "leased_by": F.lit(worker), "lease_expires_at": after(now, seconds)})


def lease(jobs: DataFrame, worker: str, n: int, now: str, seconds: int = 300, model: str | None = None) -> DataFrame:
    """The first n due jobs by id, as leased by `worker` (S4); the limit is the operator's own."""
    return _leased(due(jobs, now, model), worker, n, now, seconds)


def first_open(events: DataFrame) -> DataFrame:
    """Events without an earlier open event of the same page (C7): open ones that are their page's first, and closed ones before it."""
    first = events.filter(F.col("status").isin(*OPEN)).groupBy("page_id").agg(F.min("id").alias("first"))
    return events.join(first, "page_id", "left").filter(F.col("first").isNull() | (F.col("id") <= F.col("first"))).drop("first")


def lease_events(events: DataFrame, worker: str, n: int, now: str, seconds: int = 300) -> DataFrame:
    """The first n due events by id, of each page only the earliest open one."""
    return _leased(due(first_open(events), now), worker, n, now, seconds)


def _changed(jobs: DataFrame, requests: DataFrame, holds: Column, values: dict[str, Column]) -> DataFrame:
    """Jobs with `values` where a request of the same id meets them and `holds`. Of requests: columns other than id are named r_*."""
    asked = requests.select("id", *[F.col(c).alias(f"r_{c}") for c in requests.columns if c != "id"], F.lit(True).alias("r_"))
    # merged, not broadcast: requests may be as many as the jobs, and their texts larger than they look compressed
    out = jobs.join(asked.dropDuplicates(["id"]).hint("merge"), "id", "left")
    hit = F.coalesce(F.col("r_") & holds, F.lit(False))
    return out.select(*[(F.when(hit, values[c]).otherwise(F.col(c)).cast(t) if c in values else F.col(c)).alias(c) for c, t in jobs.dtypes])


def _owned() -> Column:
    return (F.col("status") == "leased") & F.col("leased_by").eqNullSafe(F.col("r_worker"))


def heartbeat(jobs: DataFrame, beats: DataFrame, now: str, seconds: int = 300) -> DataFrame:
    """Leases that their worker holds end later (S5, S8). `beats`: id, worker."""
    return _changed(jobs, beats, _owned(), {"lease_expires_at": after(now, seconds)})


def current(jobs: DataFrame, checks: DataFrame) -> DataFrame:
    """id, current: whether the worker still holds the job at that generation (S5). `checks`: id, worker, generation."""
    own = jobs.select("id", "status", "leased_by", F.col("generation").alias("own"))
    holds = (F.col("status") == "leased") & (F.col("leased_by") == F.col("worker")) & (F.col("own") == F.col("generation"))
    return checks.join(own, "id", "left").select("id", F.coalesce(holds, F.lit(False)).alias("current"))


def require_replay(jobs: DataFrame, stale: DataFrame, now: str) -> DataFrame:
    """After work on an old generation: a completed newer one is open again, another is marked for replay (S5). `stale`: id, generation."""
    done = F.col("status") == "completed"
    null = F.lit(None)
    values = {
        "status": F.when(done, "pending").otherwise(F.col("status")), "attempts": F.when(done, 0).otherwise(F.col("attempts")), "available_at": F.when(done, at(now)).otherwise(F.col("available_at")),
        "leased_by": F.when(done, null).otherwise(F.col("leased_by")), "lease_expires_at": F.when(done, null).otherwise(F.col("lease_expires_at")), "replay_required": ~done,
    }
    return _changed(jobs, stale, F.col("generation") != F.col("r_generation"), values)


def complete(jobs: DataFrame, done: DataFrame, now: str) -> DataFrame:
    """Jobs that their worker holds are completed, or pending again where a replay is required (S5, S8). `done`: id, worker, generation
    (null: any)."""
    holds = _owned() & F.coalesce(F.col("r_generation") == F.col("generation"), F.lit(True))
    values = {
        "status": F.when(F.col("replay_required"), "pending").otherwise("completed"), "available_at": at(now), "leased_by": F.lit(None),
        "lease_expires_at": F.lit(None), "replay_required": F.lit(False),
    }
    return _changed(jobs, done, holds, values)


def fail(jobs: DataFrame, failed: DataFrame, now: str, most: int = 5, base: float = 5.0) -> DataFrame:
    """Jobs that their worker holds are tried again after a delay that doubles, or are dead at `most` attempts.
    `failed`: id, worker, error. Adds last_error where the table has none."""
    if "last_error" not in jobs.columns:
        jobs = jobs.withColumn("last_error", F.lit(None).cast("string"))
    attempts = F.col("attempts") + 1
    values = {
        "attempts": attempts, "status": F.when(attempts >= most, "dead").otherwise("pending"), "available_at": after(now, backoff_seconds(attempts, most, base)),
        "leased_by": F.lit(None), "lease_expires_at": F.lit(None), "last_error": F.col("r_error"),
    }
    return _changed(jobs, failed.withColumn("error", F.substring("error", 1, ERROR)), _owned(), values)


def backoff_seconds(attempts: Column, most: int = 5, base: float = 5.0) -> Column:
    """base * 2^(attempts - 1); a dead job waits for nothing."""
    return F.when(attempts >= most, F.lit(0.0)).otherwise(F.lit(base) * F.pow(F.lit(2.0), attempts - 1))


def batches(pages: DataFrame, failed_from: int | None = None, size: int = 75) -> DataFrame:
    """Batch number of each page within its section, and whether it stays pending: from the batch that failed on.

    `pages`: section, page_id (distinct). A section is ordered in one task: ids only, spilled by the sort.
    """
    w = Window.partitionBy("section").orderBy("page_id")
    out = pages.select("section", "page_id", F.floor((F.row_number().over(w) - 1) / size).cast("long").alias("batch"))
    return out.withColumn("pending", F.lit(False) if failed_from is None else F.col("batch") >= failed_from)
