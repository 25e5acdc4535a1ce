"""The corpus pipeline: quality classifier, quality rules, MinHash near-dedup, secret scans, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet in the shared folder and read again
as the next stage's documents. All but the last return the columns of their input, whatever further columns there are.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from loomfold.llm import classifier, minhash, ngrams, packing, secrets
from loomfold.llm.common import keyed, shared_folder, table, without


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows that score below the threshold. Null texts count as empty; equal texts share a verdict; without labels of both
    classes every row scores 0.5 and is dropped; an empty table stays empty."""
    return classifier.accepted(docs, classifier.train(docs, table(spark, sf_dir, "labels")))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows that fail the base rules or whose perplexity lies outside the band of their language. Null, empty and blank texts fail;
    rows that are equal in doc_id, lang and text share a verdict; an empty table stays empty."""
    rejected = ngrams.judge(docs, table(spark, sf_dir, "labels")).filter("not kept").withColumnRenamed("row", "row_key")
    return without(keyed(docs, row_key=ngrams.ROW), rejected, ["row_key"]).select("doc.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near-duplicates: least doc_id (null last), then least hash of the text; of equal rows one.
    Texts without words are in no group and stay; a doc_id may stand for several texts; an empty table stays empty."""
    return minhash.one_of_each(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks every span that the scan finds with as many `*`. Null texts stay null; each row stays."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows, packed. Null and empty texts are one id; repeated rows are packed once per row."""
    return packing.pack(docs)


STAGES = [("quality_classifier", quality), ("quality_rules", rules), ("near_dedup", near_dedup), ("secret_scan", secret_scan), ("packing", pack)]
#: SQL cannot express the classifier or the tokenizer.
ORACLE_SQL = None


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's files go when the next stage is written; those of the last one stay for the caller."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            _delete(spark, before)
        before = path
    return docs
