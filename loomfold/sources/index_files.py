"""Index artefacts and collections (A5, A6, A11-A14, A16, A17): matrices with their checks, legacy chunks, sinks for results and metrics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfold.functions.text import stable_chunk_id, text_or_empty

ROWS = 65_536


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """n, vector of a dense .npy matrix in a shared folder (A5): the file is mapped, and a task reads its own rows only."""
    shape = np.load(path, mmap_mode="r").shape
    if len(shape) != 2:
        raise ValueError(f"{path} holds no matrix")

    def rows(frames):
        matrix = np.load(path, mmap_mode="r")
        for f in frames:
            for start in f.id:
                part = np.asarray(matrix[start : start + ROWS], np.float64)
                for at in range(0, len(part), 4096):
                    yield pd.DataFrame({"n": np.arange(start + at, start + min(at + 4096, len(part))), "vector": list(part[at : at + 4096])})

    parts = max(1, -(-shape[0] // ROWS))
    return spark.range(0, shape[0], ROWS, parts).mapInPandas(rows, "n long, vector array<double>")


def matrix_problems(index: DataFrame, chunks: DataFrame, vectors: DataFrame, meta_model: str | None, model: str, dimensions: int) -> DataFrame:
    """One row, `problem`: the first of: another model, row counts that differ, other dimensions, index rows that are not the chunks' (page_id,
    text) rows; null where the matrix may be used (A5)."""
    from loomfold.operators.toolkits import multiset_equal

    counts = vectors.agg(F.count("*").alias("v"), F.count_if(F.size("vector") != dimensions).alias("wrong")).crossJoin(index.agg(F.count("*").alias("i"))).crossJoin(multiset_equal(index, chunks))
    tests = F.when(F.lit(bool(meta_model) and meta_model != model), F.lit(f"model mismatch: {meta_model}")).when(F.col("v") != F.col("i"), "embedding row count mismatch")
    return counts.select(tests.when(F.col("wrong") > 0, "embedding dimension mismatch").when(~F.col("equal"), "chunks_index metadata mismatch").alias("problem"))


def legacy_chunks(rows: DataFrame) -> DataFrame:
    """Chunks of the old form in the present one (A14). `rows`: n (place in its section's file), section, page_id, text, and chunk_id (text or
    null), chunk_index, duplicate_ordinal, chunker_version, schema_version, each null where it was not given."""
    text, page = text_or_empty(F.col("text")), text_or_empty(F.col("page_id"))
    digest = F.sha2(text, 256)
    made = stable_chunk_id(F.col("section"), page, digest, F.col("n").cast("string"))
    return rows.select(
        F.coalesce("chunk_id", made).alias("chunk_id"), page.alias("page_id"), "section", text.alias("text"), digest.alias("content_hash"), F.coalesce("chunk_index", F.col("n")).cast("int").alias("chunk_index"),
        F.coalesce("duplicate_ordinal", F.lit(0)).cast("int").alias("duplicate_ordinal"), *[F.coalesce(c, F.lit("legacy")).alias(c) for c in ("chunker_version", "schema_version")],
    )


def legacy_cache(chunks: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    """content_hash, model_version, vector of legacy chunks by their place n (A14); equal texts share one vector, that of the first place."""
    rows = chunks.join(vectors, "n").groupBy("content_hash").agg(F.min_by("vector", "n").alias("vector"))
    return rows.select("content_hash", F.lit(model).alias("model_version"), "vector")


def write_index(chunks: DataFrame, vectors: DataFrame, path: str, model: str) -> None:
    """An index's tables by section, and one row about it."""
    rows = chunks.join(vectors, "chunk_id")
    rows.write.mode("overwrite").partitionBy("section").parquet(f"{path}/index")
    rows.agg(F.count("*").alias("total_chunks"), F.max(F.size("vector")).alias("dimensions")).withColumn("embedding_model", F.lit(model)).write.mode("overwrite").parquet(f"{path}/meta")


def upsert_points(collection: DataFrame, new: DataFrame, gone: DataFrame) -> DataFrame:
    """The collection with points put in, replaced and removed by chunk_id (A12); a point that is put in and removed is removed."""
    ids = new.select("chunk_id").union(gone.select("chunk_id")).distinct()
    return collection.join(ids, "chunk_id", "left_anti").unionByName(new.select(collection.columns).dropDuplicates(["chunk_id"]).join(gone.select("chunk_id"), "chunk_id", "left_anti"))


def manifest(collection: DataFrame) -> DataFrame:
    """Identities of all points (A11): chunk_id, content_hash, model_version, chunker_version, empty where null."""
    return collection.select(*[text_or_empty(F.col(c)).alias(c) for c in ("chunk_id", "content_hash", "model_version", "chunker_version")])


def snapshot(spark: SparkSession, collection: DataFrame, path: str, name: str) -> str:
    """A copy of a collection under a name that must be new."""
    target = f"{path}/snapshots/{name}"
    collection.write.mode("error").parquet(target)
    return target


def metric_lines(metrics: DataFrame, prefix: str = "loomfold") -> DataFrame:
    """`line` for each number of a one-row table, in the text form of a metrics endpoint."""
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in metrics.columns])
    return metrics.select(F.explode(pairs).alias("m")).select(F.concat(F.lit(f"{prefix}_"), F.col("m.name"), F.lit(" "), F.format_string("%s", F.when(F.col("m.value") == F.floor("m.value"), F.col("m.value").cast("long").cast("string")).otherwise(F.col("m.value").cast("string")))).alias("line"))
