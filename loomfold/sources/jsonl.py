"""JSON lines and small files (A1-A3): blank lines are skipped, a broken line fails the read, a replaced folder is never seen half written."""

from __future__ import annotations

import json
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    lines = spark.read.text(path).filter(F.length(F.trim("value")) > 0)
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("row")).select("row.*")


def write(df: DataFrame, path: str) -> None:
    """Replaces the folder `path`: written beside it, then moved into its place; the old one goes last, and comes back if the move fails."""
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    new, old = f"{path.rstrip('/')}.new-{uuid.uuid4().hex}", f"{path.rstrip('/')}.old-{uuid.uuid4().hex}"
    df.write.json(new)
    there = fs.exists(at(path))
    if there and not fs.rename(at(path), at(old)):
        raise OSError(f"cannot move {path}")
    if not fs.rename(at(new), at(path)):
        if there:
            fs.rename(at(old), at(path))
        raise OSError(f"cannot move {new}")
    if there:
        fs.delete(at(old), True)


def write_file(path: str, content: bytes | str | dict | list) -> None:
    """A small file on the driver's machine, whole or not at all (A3): bytes, text, or anything else as JSON."""
    if not isinstance(content, bytes | str):
        content = json.dumps(content, ensure_ascii=False, indent=2) + "\n"
    data = content.encode() if isinstance(content, str) else content
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=folder)
    try:
        with os.fdopen(handle, "wb") as out:
            out.write(data)
            out.flush()
            os.fsync(out.fileno())
        os.replace(name, path)
    except BaseException:
        if os.path.exists(name):
            os.remove(name)
        raise
