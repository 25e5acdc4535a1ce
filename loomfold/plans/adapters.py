"""The standard tables as the engine's own ones: chunks, pages, vectors, jobs, events, golden queries, messages, time entries.

Each is a projection or one aggregation by key; `NOW` is passed to the queue operators, never taken from a clock.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "2024-01-20 00:00:00"
MODELS = ("m0", "m1", "m2")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four chunks make a page; a title is a document code and the first line's first 60 characters."""
    rows = table(spark, sf_dir, "documents").selectExpr(
        "cast(doc_id as string) chunk_id", "source section", "cast(100000 + (doc_id div 80) * 20 + doc_id % 20 as string) page_id",
        "cast((doc_id div 20) % 4 as int) chunk_index", "0 duplicate_ordinal", "lang content_type", "text", "doc_id",
        "concat('DOC-', upper(lang), '_', doc_id div 80, ' ', substring(substring_index(text, '\n', 1), 1, 60)) title",
    )
    return rows.withColumns({"breadcrumbs": F.concat_ws(" > ", "section", "content_type"), "content_hash": F.sha2("text", 256), "url": F.concat(F.lit("https://example.org/pages/"), "page_id")})


def pages(chunks: DataFrame) -> DataFrame:
    """Page number p = page_id - 100000: each seventh is deleted, each third has no parent text, each sixth of those a source text."""
    out = chunks.groupBy("page_id").agg(F.min("section").alias("section"), F.min_by("title", "chunk_index").alias("title"), F.min("url").alias("url"))
    p = F.col("page_id").cast("long") - 100000
    return out.withColumns({
        "breadcrumbs": F.concat_ws(" > ", "section", "title"),
        "version": (p % 9 + 1).cast("int"),
        "deleted_at": F.when(p % 7 == 6, F.lit(NOW).cast("timestamp")),
        "parent_text": F.when(p % 3 == 0, "").otherwise(F.concat(F.lit("parent of "), "title")),
        "source_text": F.when(p % 6 == 0, F.concat(F.lit("source of "), "title")).otherwise(""),
    })


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("chunk_id"), F.col("embedding").cast("array<double>").alias("vector"))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index jobs: signup and view are pending, click leased, purchase completed, error dead."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id id", "cast(event_id as string) chunk_id", "cast(user_id as string) page_id", "concat('m', event_id % 3) model_version",
        "if(event_id % 4 = 0, 'delete', 'upsert') operation", "case event_type when 'click' then 'leased' when 'purchase' then 'completed' when 'error' then 'dead' else 'pending' end status",
        "cast(event_id % 6 as int) attempts", "cast(ts as timestamp) + make_dt_interval(0, 0, 0, event_id % 600) available_at", "1 + event_id % 4 generation",
        "event_id % 5 = 0 replay_required", "if(event_type = 'click', concat('w', user_id % 3), null) leased_by",
        "if(event_type = 'click', cast(ts as timestamp) + interval 300 seconds, null) lease_expires_at", "cast(ts as timestamp) created_at",
    )


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Webhook deliveries; each tenth repeats the delivery before it."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id id", "concat('d', event_id - if(event_id % 10 = 9, 1, 0)) delivery_id", "cast(user_id as string) page_id", "event_id version",
        "case event_type when 'signup' then 'page_created' when 'view' then 'Page_Edited ' when 'click' then 'moved' when 'purchase' then 'page_archived' else 'page_removed' end raw_type",
        "cast(ts as timestamp) created_at",
    )


def golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Golden queries: the first six words of a benchmark passage, whose first 80 characters the answer must hold."""
    return table(spark, sf_dir, "benchmark").selectExpr(
        "cast(item_id as string) id", "array_join(slice(split(text, ' '), 1, 6), ' ') query", "cast(array() as array<string>) page_ids",
        "cast(array() as array<string>) title_contains", "array(substring(text, 1, 80)) answer_contains",
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").selectExpr("conv_id dialog", "turn id", "role author_id", "text")


def time_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("event_type task", "cast(user_id as string) user_id", "cast(floor(value) as bigint) seconds")
