"""The store as tables and transitions.

Each transition takes the present tables and the changes of one batch, joined by key, and returns the new tables; Snapshots writes them beside
the old ones and then moves one pointer, so readers see all of a batch or nothing.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomfold.functions.content import page_chunks
from loomfold.operators import queue
from loomfold.operators.filters import newer, stale_pages

PAGE = "page_id string, section string, title string, url string, breadcrumbs string, version int, deleted_at timestamp, parent_text string, source_text string"
#: Old numbers that are counted together when an index is numbered anew.
TOGETHER = 65_536


def replace_pages(pages: DataFrame, chunks: DataFrame, jobs: DataFrame, new_pages: DataFrame, new_chunks: DataFrame, model: str, now: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pages, chunks and jobs after all chunks of the new pages are replaced (S1). A replaced page is live again; its new chunks are queued for
    upsert, and its old ones that no new chunk names (F5) for delete. A chunk id twice within the batch fails the job. Content hashes are
    made anew from the texts."""
    ids = new_pages.select("page_id").distinct()
    twice = new_chunks.groupBy("chunk_id").agg(F.count("*").alias("times")).filter("times > 1").agg(F.count("*").alias("twice"))
    new_chunks = new_chunks.crossJoin(F.broadcast(twice)).filter(F.when(F.col("twice") == 0, True).otherwise(F.raise_error(F.lit("a chunk id occurs twice")).cast("boolean"))).drop("twice")
    new_chunks = new_chunks.withColumn("content_hash", F.sha2("text", 256))
    out_pages = pages.join(ids, "page_id", "left_anti").unionByName(new_pages.withColumn("deleted_at", F.lit(None).cast("timestamp")).select(pages.columns))
    out_chunks = chunks.join(ids, "page_id", "left_anti").unionByName(new_chunks.select(chunks.columns))
    gone = chunks.join(ids, "page_id", "left_semi").select("chunk_id", "page_id").join(new_chunks.select("chunk_id"), "chunk_id", "left_anti")
    asked = new_chunks.select(F.lit(0).alias("seq"), F.lit("upsert").alias("operation"), "chunk_id", "page_id").unionByName(gone.select(F.lit(1).alias("seq"), F.lit("delete").alias("operation"), "chunk_id", "page_id"))
    return out_pages, out_chunks, queue.enqueue(jobs, asked.withColumn("model_version", F.lit(model)), now)


def tombstone_pages(pages: DataFrame, chunks: DataFrame, jobs: DataFrame, gone: DataFrame, model: str, now: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pages, chunks and jobs after pages are deleted (S2): marked, without chunks, deletes queued for the chunks they had. `gone`: page_id."""
    ids = gone.select("page_id").distinct()
    marked = pages.join(ids.withColumn("gone_", F.lit(True)), "page_id", "left").withColumn("deleted_at", F.when(F.col("gone_"), queue.at(now)).otherwise(F.col("deleted_at"))).select(pages.columns)
    asked = chunks.join(ids, "page_id", "left_semi").select(F.lit(0).alias("seq"), F.lit("delete").alias("operation"), "chunk_id", "page_id").withColumn("model_version", F.lit(model))
    return marked, chunks.join(ids, "page_id", "left_anti"), queue.enqueue(jobs, asked, now)


def tombstones(gone: DataFrame, section: str, now: str) -> DataFrame:
    """The record of each deleted page."""
    return gone.select(F.lit(section).alias("section"), "page_id", queue.at(now).alias("deleted_at"), F.lit("missing from the inventory").alias("reason"), F.lit("1").alias("schema_version")).distinct()


def put_vectors(cache: DataFrame, new: DataFrame) -> DataFrame:
    """The cache with the new vectors in place of the old ones of the same text and model (S9). Both: content_hash, model_version, vector,
    provider_runtime; dimensions are counted anew."""
    new = new.dropDuplicates(["content_hash", "model_version"])
    out = cache.select("content_hash", "model_version", "vector", "provider_runtime").join(new.select("content_hash", "model_version"), ["content_hash", "model_version"], "left_anti")
    return out.unionByName(new.select("content_hash", "model_version", "vector", "provider_runtime")).withColumn("dimensions", F.size("vector"))


def register_target(targets: DataFrame, model: str, runtime: str, dimensions: int, collection: str) -> DataFrame:
    """Targets with one model's row put in or replaced."""
    row = targets.sparkSession.createDataFrame([(model, runtime, dimensions, collection)], "model_version string, provider_runtime string, dimensions int, collection_name string")
    return targets.filter(F.col("model_version") != model).unionByName(row)


def drift(pages: DataFrame, chunks: DataFrame, jobs: DataFrame, cache: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """One row (D9): live pages, chunks, uncached_chunks (whatever the model), unsettled_jobs, and with `vectors` their count and how far it is
    from the chunks'."""
    out = pages.filter("deleted_at is null").agg(F.count("*").alias("pages")).crossJoin(chunks.agg(F.count("*").alias("chunks")))
    out = out.crossJoin(chunks.join(cache.select("content_hash"), "content_hash", "left_anti").agg(F.count("*").alias("uncached_chunks")))
    out = out.crossJoin(jobs.filter("status != 'completed'").agg(F.count("*").alias("unsettled_jobs")))
    if vectors is not None:
        out = out.crossJoin(vectors.agg(F.count("*").alias("vectors"))).withColumn("vector_delta", F.col("vectors") - F.col("chunks"))
    return out


def index_step(leased: DataFrame, chunks: DataFrame, cache: DataFrame, collection: DataFrame, embed) -> tuple[DataFrame, DataFrame]:
    """One step of the indexer over leased jobs (S11): the collection and the cache after it.

    A delete, and an upsert whose chunk is gone, removes the vector. Each text without a cached vector is embedded once: `embed` takes
    (content_hash, text) and returns (content_hash, vector). Collection: chunk_id, content_hash, model_version, vector.
    """
    wanted = leased.filter("operation = 'upsert'").select("chunk_id", "model_version").distinct().join(chunks.select("chunk_id", "content_hash", "text"), "chunk_id")
    known = cache.select("content_hash", "model_version", "vector", "provider_runtime")
    fresh = wanted.join(known, ["content_hash", "model_version"], "left_anti")
    made = embed(fresh.select("content_hash", "text").dropDuplicates(["content_hash"]))
    made = fresh.select("content_hash", "model_version").distinct().join(made, "content_hash").withColumn("provider_runtime", F.lit(""))
    after = known.unionByName(made.select(known.columns))
    touched = leased.select("chunk_id", "model_version").distinct()
    rows = wanted.join(after, ["content_hash", "model_version"]).select("chunk_id", "content_hash", "model_version", "vector")
    return collection.join(touched, ["chunk_id", "model_version"], "left_anti").unionByName(rows.select(collection.columns)), after


def changed_pages(source: DataFrame, known: DataFrame, since: str | None = None) -> DataFrame:
    """Pages modified at `since` or later, of which those with a version above the known one (S13, B11). `source`: page_id, version, modified_at."""
    rows = source if since is None else source.filter(F.col("modified_at") >= queue.at(since))
    return newer(rows, known)


def sync(state: DataFrame, source: DataFrame, section: str, started: str, reconcile: bool = False, succeeded: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One run for one section (S13, S14): changed pages, stale pages, and the new state.

    State: section, last_sync, page_versions map, inventory array, ownership_known. The next run begins where this one started, and only if it
    succeeded. A reconciling run reads the whole section; it finds stale pages only if an inventory was taken before.
    """
    own = state.filter(F.col("section") == section)
    since = None if reconcile else (own.select(F.date_format("last_sync", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("s")).first() or {"s": None})["s"]
    known = own.select(F.explode("page_versions").alias("page_id", "version"))
    changed = changed_pages(source, known, since)
    owned = own.filter("ownership_known")
    before = owned.select(F.explode(F.array_union("inventory", F.map_keys("page_versions"))).alias("page_id"))
    stale = stale_pages(before, before, source) if reconcile else before.limit(0)
    versions = known.join(changed.select("page_id"), "page_id", "left_anti").unionByName(changed.select("page_id", F.col("version").cast("int").alias("version"))).join(stale, "page_id", "left_anti")
    if not succeeded:
        return changed, stale, state
    new = versions.agg(F.map_from_entries(F.collect_list(F.struct("page_id", "version"))).alias("page_versions"))
    if reconcile:
        new = new.crossJoin(source.agg(F.array_sort(F.collect_set("page_id")).alias("inventory"))).withColumn("ownership_known", F.lit(True))
    else:
        new = new.crossJoin(own.select("inventory", "ownership_known"))
    new = new.withColumns({"section": F.lit(section), "last_sync": queue.at(started)})
    return changed, stale, state.filter(F.col("section") != section).unionByName(new.select(state.columns))


def migrated(raw: DataFrame, sections: list[str]) -> DataFrame:
    """State rows of the present form for every section (S15). `raw`: section, last_sync, page_versions, inventory, ownership_known, and
    split_from_global: rows made from one global list, which begin anew unless their ownership is known; null fields take their defaults."""
    spark = raw.sparkSession
    rows = spark.createDataFrame([(s,) for s in sections], "section string").join(raw, "section", "left")
    unsafe = F.max(F.coalesce("split_from_global", F.lit(False)) & F.col("ownership_known").isNull()).over(_whole())
    empty = {"last_sync": F.lit(None).cast("timestamp"), "page_versions": F.create_map().cast("map<string,int>"), "inventory": F.array().cast("array<string>"), "ownership_known": F.lit(False)}
    rows = rows.withColumn("unsafe_", unsafe)
    return rows.select("section", *[(F.when(F.col("unsafe_"), d).otherwise(F.coalesce(F.col(c), d))).alias(c) for c, d in empty.items()])


def _whole():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(1))


def pending_ledger(pending: DataFrame, added: DataFrame, done: DataFrame) -> DataFrame:
    """section, page_id of the pages whose index is behind (S17): those before and those added, without those done."""
    return pending.union(added.select(pending.columns)).distinct().join(done.select("section", "page_id"), ["section", "page_id"], "left_anti")


def keep_and_append(index: DataFrame, fresh: DataFrame, pages: DataFrame) -> DataFrame:
    """The index without rows of the given pages, then the fresh rows of these pages, numbered anew from 0 (E8, F9). Rows: n, page_id, and
    others. Rows are counted by runs of TOGETHER old numbers, so no task holds the table, and the new numbers depend on the rows alone."""
    kept = index.join(pages.select("page_id"), "page_id", "left_anti").withColumn("side_", F.lit(0))
    new = fresh.join(pages.select("page_id").distinct(), "page_id", "left_semi").withColumn("side_", F.lit(1))
    rows = kept.unionByName(new).withColumn("run_", F.coalesce(F.floor(F.col("n") / TOGETHER), F.lit(-(1 << 62))))
    sizes = rows.groupBy("side_", "run_").agg(F.count("*").alias("size_"))
    w = Window.orderBy("side_", "run_").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("side_", "run_", F.coalesce(F.sum("size_").over(w), F.lit(0)).alias("before_"))
    place = F.row_number().over(Window.partitionBy("side_", "run_").orderBy("n")) - 1
    return rows.withColumn("in_", place).join(F.broadcast(before), ["side_", "run_"]).withColumn("n", F.col("before_") + F.col("in_")).select(index.columns)


def experiment(pages: DataFrame, strategy: str, **sizes) -> tuple[DataFrame, DataFrame]:
    """All live pages chunked by another strategy (S20): the chunks, and one row of counts. Pages (page_id, section, title, ancestors, html,
    deleted_at) without html are skipped."""
    alive = pages.filter("deleted_at is null")
    with_body = alive.filter("html is not null and html != ''")
    chunks = page_chunks(with_body, strategy, **sizes)
    counts = alive.agg(F.count("*").alias("source_pages"), F.count_if(F.coalesce(F.col("html"), F.lit("")) != "").alias("pages_rechunked"), F.count_if(F.coalesce(F.col("html"), F.lit("")) == "").alias("pages_skipped"))
    return chunks, counts.crossJoin(chunks.agg(F.count("*").alias("chunks_generated")))


def active_collection(aliases: DataFrame, targets: DataFrame, alias: str, model: str) -> DataFrame:
    """collection (S22): what the alias points to, else what the model is registered to; an error where neither is there."""
    row = aliases.filter(F.col("alias") == alias).agg(F.first("collection").alias("a")).crossJoin(targets.filter(F.col("model_version") == model).agg(F.first("collection_name").alias("t")))
    return row.select(F.coalesce("a", "t", F.raise_error(F.lit("no collection is active")).cast("string")).alias("collection"))


def promote(aliases: DataFrame, alias: str, collection: str, collections: list[str], expected: str | None = None) -> tuple[DataFrame, str | None]:
    """Aliases with one pointing elsewhere, and where it pointed (S19). Fails where the collection does not exist, or where `expected` is given
    and the alias does not point there (a guarded rollback)."""
    if collection not in collections:
        raise ValueError(f"there is no collection {collection!r}")
    row = aliases.filter(F.col("alias") == alias).select("collection").first()
    before = row["collection"] if row else None
    if expected is not None and before != expected:
        raise ValueError(f"the alias points to {before!r}, not to {expected!r}")
    new = aliases.sparkSession.createDataFrame([(alias, collection)], "alias string, collection string")
    return aliases.filter(F.col("alias") != alias).unionByName(new), before


class Snapshots:
    """Named tables of which all change at once: written to a new folder, then a pointer file moves.

    One writer at a time: commit() fails if the pointer has moved since the tables were read. `path` may be any file system that Spark knows.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._at = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self._at(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        at = self._at(f"{self.path}/pointers")
        return sorted(int(f.getPath().getName()) for f in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def current(self) -> int | None:
        numbers = self._numbers()
        return numbers[-1] if numbers else None

    def read(self, name: str, number: int | None = None) -> DataFrame:
        number = self.current() if number is None else number
        stream = self.fs.open(self._at(f"{self.path}/pointers/{number}"))
        try:
            folders = json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()
        return self.spark.read.parquet(f"{self.path}/{folders[name]}")

    def commit(self, tables: dict[str, DataFrame], seen: int | None) -> int:
        """Writes the tables and moves the pointer from `seen` on; an error where another writer has moved it."""
        folder = f"data/{uuid.uuid4().hex}"
        for name, df in tables.items():
            df.write.parquet(f"{self.path}/{folder}/{name}")
        number = 0 if seen is None else seen + 1
        if self.current() != seen:
            raise RuntimeError("another writer was first")
        out = self.fs.create(self._at(f"{self.path}/pointers/{number}"), False)  # fails where the file is there
        try:
            out.write(json.dumps({name: f"{folder}/{name}" for name in tables}).encode())
        finally:
            out.close()
        return number


def local_lock(path: str, stale_after: float, now: float, owner: str) -> bool:
    """Takes a lock file on one machine (S23): True if it is ours now. A lock older than `stale_after` seconds is taken over."""
    try:
        with open(path, encoding="utf-8") as held:
            taken = json.load(held)
        if now - taken["at"] < stale_after:
            return taken["owner"] == owner
        os.remove(path)
    except FileNotFoundError:
        pass
    try:
        handle = os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
    except FileExistsError:
        return False
    with os.fdopen(handle, "w", encoding="utf-8") as out:
        json.dump({"owner": owner, "at": now}, out)
    return True
