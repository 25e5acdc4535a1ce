"""Event intake as a stream (S6, S12, S16): each delivery once, for good, then the newest version of each page.

Deliveries are remembered by id in a table of their own, however late they come; lateness is the version's business (B11). A batch is written to
folders named by the batch's number, so a batch that is run again replaces itself, and reads only what earlier batches wrote. Versions are
compacted: each COMPACT batches the newest event of each page goes to one base, and reads begin there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

COMPACT = 20
EVENT = "delivery_id string, page_id long, version long, kind string, at timestamp"


def latest(events: DataFrame) -> DataFrame:
    """The newest event of each page: highest version, then delivery id; an older version never wins."""
    w = Window.partitionBy("page_id").orderBy(F.desc("version"), F.desc("delivery_id"))
    return events.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


def _numbers(spark: SparkSession, path: str) -> list[int]:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(n.partition("=")[2]) for n in names if n.startswith("batch="))


def _before(spark: SparkSession, path: str, number: int, schema: str) -> DataFrame:
    folders = [f"{path}/batch={n}" for n in _numbers(spark, path) if n < number]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def once(batch: DataFrame, seen: DataFrame) -> DataFrame:
    """The first row of each delivery of a batch that was not seen before."""
    w = Window.partitionBy("delivery_id").orderBy("version", "page_id")
    return batch.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n").join(seen.select("delivery_id"), "delivery_id", "left_anti")


def ingest(stream: DataFrame, path: str, checkpoint: str):
    """Starts a query that takes in all that is there and ends (S16: the checkpoint is where the next one begins)."""

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = once(batch.select("delivery_id", "page_id", "version", "kind", "at"), _before(spark, f"{path}/deliveries", number, "delivery_id string"))
        new.write.mode("overwrite").parquet(f"{path}/events/batch={number}")
        written = spark.read.parquet(f"{path}/events/batch={number}")
        written.select("delivery_id").write.mode("overwrite").parquet(f"{path}/deliveries/batch={number}")
        if number % COMPACT == COMPACT - 1:
            versions(spark, path, number + 1).write.mode("overwrite").parquet(f"{path}/base/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def versions(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """The newest event of each page: the last base, and the batches after it."""
    limit = before if before is not None else 1 << 62
    bases = [n for n in _numbers(spark, f"{path}/base") if n < limit - 1 or before is None]
    start = bases[-1] if bases else -1
    folders = [f"{path}/base/batch={start}"] if bases else []
    folders += [f"{path}/events/batch={n}" for n in _numbers(spark, f"{path}/events") if start < n < limit]
    return latest(spark.read.schema(EVENT).parquet(*folders) if folders else spark.createDataFrame([], EVENT))


def pages(spark: SparkSession, path: str) -> DataFrame:
    """Live pages: the newest event of each page, deleted pages left out."""
    return versions(spark, path).filter("kind != 'DELETE'")


def applied(pages: DataFrame, events: DataFrame) -> DataFrame:
    """page_id, section, version, deleted after a batch of events (S12): a delete marks its page, an older version changes nothing, a page whose
    section is not known goes to `reconcile`. `pages`: page_id, section, version, deleted; `events`: page_id, version, kind, section."""
    new = latest(events.withColumn("delivery_id", F.lit("")))
    out = pages.join(new.select("page_id", F.col("version").alias("v"), "kind", F.col("section").alias("s")), "page_id", "full")
    gone = F.coalesce(F.col("kind") == "DELETE", F.lit(False))
    newer = F.coalesce((F.col("kind") == "FETCH") & F.col("s").isNotNull() & (F.col("v") >= F.coalesce("version", F.lit(-1))), F.lit(False))
    unknown = gone & F.col("section").isNull() | F.coalesce((F.col("kind") == "FETCH") & F.col("s").isNull(), F.lit(False))
    return out.select(
        "page_id", F.when(newer, F.col("s")).otherwise(F.col("section")).alias("section"), F.when(newer, F.col("v")).otherwise(F.col("version")).alias("version"),
        F.when(gone, True).when(newer, False).otherwise(F.coalesce("deleted", F.lit(False))).alias("deleted"), unknown.alias("reconcile"),
    )
