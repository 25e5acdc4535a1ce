"""Helpers shared by the operators: table access, checkpoints in the shared folder, tokenizer files, safe text cuts."""

from __future__ import annotations

import base64
import contextlib
import ctypes
import functools
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: The marker that the byte-level tokenizer takes for one token, and that token's id (fixed values of the vocabulary file).
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of our own only on a local master where none is set."""
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="loomfold-checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the shared folder."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def cut(text: str, limit: int = 1_000_000):
    """Pieces of about `limit` characters, cut only where a visible character meets white space.

    No pre-token of the byte-level pattern holds a visible character before white space and none looks behind,
    so the pre-tokens of the pieces, one after another, are those of the text.
    """
    at, n = 0, len(text)
    gap = re.compile(r"(?<=\S)(?=\s)")
    while n - at > limit:
        found = gap.search(text, at + limit)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    if at < n or not n:
        yield text[at:]


#: Rows of a batch that a task turns into Python's objects at once.
SLICE = 512


def lean(run):
    """`run` over slices of its Arrow batches, so that no large batch's objects or results are held at once; what a task has freed goes back to the system
    at its end, as its worker and those that wait share the executor's memory."""

    @functools.wraps(run)
    def sliced(batches):
        import pyarrow as pa

        try:
            yield from run(batch.slice(at, SLICE) for batch in batches for at in range(0, batch.num_rows, SLICE))
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # other C libraries than glibc
                ctypes.CDLL(None).malloc_trim(0)

    return sliced


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}


_ENCODERS: dict = {}


def encoder(path: str | None = None):
    """The byte-level vocabulary in its quickest public library; one per Python worker."""
    import public_tokenizers
    import tiktoken

    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    if path not in _ENCODERS:
        _ENCODERS[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(path), special_tokens={})
    return _ENCODERS[path]


def whole_groups(batches, keys: list[str], rows: int = 16_384, size: int = 64 << 20):
    """Tables of at least `rows` rows or `size` bytes (but the last) that hold whole groups, and the row where each group begins.

    The batches come sorted by `keys`, or at least with equal keys side by side. Memory is that and one group.
    """
    import numpy as np
    import pyarrow as pa

    def starts(table):
        change = np.zeros(table.num_rows, bool)
        change[:1] = True
        for k in keys:
            x = table.column(k).to_numpy()
            change[1:] |= x[1:] != x[:-1]
        return np.flatnonzero(change)

    held, n, weight = [], 0, 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        weight += batch.nbytes
        if n >= rows or weight >= size:
            table = pa.Table.from_batches(held).combine_chunks()
            at = starts(table)
            if len(at) > 1:
                yield table.slice(0, at[-1]), at[:-1]
            rest = table.slice(at[-1])
            # a group larger than the bounds is waited for
            held, n, weight = rest.to_batches(), rest.num_rows if len(at) > 1 else 0, rest.nbytes if len(at) > 1 else 0
    if sum(batch.num_rows for batch in held):
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, starts(table)


def plain(text: str | None) -> str:
    """Null texts count as empty; lone surrogates cannot occur in Spark strings."""
    return text or ""


#: Rows of a key table that may be broadcast; above it the join shuffles.
BROADCAST_ROWS = 500_000


def keyed(docs: DataFrame, **keys: str) -> DataFrame:
    """`doc`, a struct of all columns, beside keys given as SQL over them; `doc.*` gives the columns back, whatever their names."""
    from pyspark.sql import functions as F

    whole = F.struct(*[docs[f"`{c.replace('`', '``')}`"] for c in docs.columns]).alias("doc")
    return docs.select(whole, *[F.expr(sql).alias(name) for name, sql in keys.items()])


def without(docs: DataFrame, rejected: DataFrame, on) -> DataFrame:
    """Rows of `docs` that no row of `rejected` matches on its columns `on`; `rejected` is broadcast only if it is counted as small."""
    from pyspark.sql import functions as F

    rejected = durable(rejected.select(*on).distinct())
    return docs.join(F.broadcast(rejected) if rejected.count() <= BROADCAST_ROWS else rejected, on, "left_anti")
