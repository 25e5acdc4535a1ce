"""Filters, projections and predicates over chunks, pages and events."""

from __future__ import annotations

import ipaddress
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Columns that a search may filter on, longest value, columns of a chunk that are no metadata, columns of a vector's payload (fixed values).
FIELDS = ("section", "page_id", "title", "content_type", "breadcrumbs")
LONGEST = 500
CORE = ("chunk_id", "page_id", "section", "title", "url", "breadcrumbs", "text", "chunk_index", "duplicate_ordinal", "content_hash", "chunker_version", "schema_version")
PAYLOAD = ("chunk_id", "page_id", "section", "title", "url", "breadcrumbs", "content_type", "text", "content_hash", "chunker_version", "schema_version")
#: What senders call their events, and what each means (fixed values).
EVENTS = {
    "page_created": "create", "page_created_event": "create", "created": "create", "page_updated": "update", "page_edited": "update", "updated": "update", "page_moved": "move",
    "moved": "move", "page_archived": "archive", "page_trashed": "delete", "page_removed": "delete", "page_deleted": "delete", "deleted": "delete", "page_restored": "update",
}
FETCH, DELETE = ("create", "update", "move"), ("archive", "delete")


def checked(filters: dict | None) -> dict:
    """The filters, or ValueError for a key that is not allowed or a value that is no text of 1 to 500 characters (B1)."""
    for key, value in (filters or {}).items():
        if key not in FIELDS:
            raise ValueError(f"filter on {key!r} is not allowed")
        if not isinstance(value, str) or not 0 < len(value) <= LONGEST:
            raise ValueError(f"filter {key!r} wants a text of 1 to {LONGEST} characters")
    return dict(filters or {})


def metadata_filter(rows: DataFrame, filters: dict | None = None, sections=None) -> DataFrame:
    """Rows that equal all filters and lie in one of the sections, where any are given (B1, B2, B3); a null equals nothing."""
    for key, value in checked(filters).items():
        rows = rows.filter(F.col(key) == value)
    return rows.filter(F.col("section").isin(*sections)) if sections else rows


def live(pages: DataFrame) -> DataFrame:
    """Pages that are not deleted."""
    return pages.filter("deleted_at is null")


def corpus(chunks: DataFrame, limit: int) -> DataFrame:
    """The first chunks by id, the columns that an evaluation reads (A4); the limit is the operator's own."""
    return chunks.select("chunk_id", "page_id", "section", "title", "text").orderBy("chunk_id").limit(limit)


def fold_metadata(chunks: DataFrame) -> DataFrame:
    """Core columns, and all others as JSON in metadata_json, nulls left out."""
    core = [c for c in chunks.columns if c in CORE]
    rest = [c for c in chunks.columns if c not in CORE]
    return chunks.select(*core, (F.to_json(F.struct(*rest)) if rest else F.lit("{}")).alias("metadata_json"))


def unfold_metadata(chunks: DataFrame, schema: str) -> DataFrame:
    """The columns of `schema` out of metadata_json, beside the others."""
    return chunks.withColumn("m", F.from_json("metadata_json", schema)).select(*[c for c in chunks.columns if c != "metadata_json"], "m.*")


def payload(chunks: DataFrame, model_version: str, runtime: str = "") -> DataFrame:
    """The 13 texts that go with a vector; no content type means prose, any other null is empty."""
    def text(c):
        return F.coalesce(F.col(c).cast("string") if c in chunks.columns else F.lit(None).cast("string"), F.lit("prose" if c == "content_type" else "")).alias(c)

    return chunks.select(*[text(c) for c in PAYLOAD], F.lit(model_version).alias("model_version"), F.lit(runtime).alias("provider_runtime"))


def first_of(*columns: Column) -> Column:
    """The first column that is neither null nor empty, else empty."""
    return F.coalesce(*[F.when(c.cast("string") != "", c.cast("string")) for c in columns], F.lit(""))


def event_kind(raw: Column) -> Column:
    """create, update, move, archive or delete; null for a name that is not known."""
    known = F.create_map(*[F.lit(x) for pair in EVENTS.items() for x in pair])
    return F.element_at(known, F.lower(F.trim(raw)))


def event_class(kind: Column) -> Column:
    return F.when(kind.isin(*FETCH), "FETCH").when(kind.isin(*DELETE), "DELETE")


def newer(incoming: DataFrame, known: DataFrame) -> DataFrame:
    """Incoming pages whose version is above the known one; an unknown page has version 0 (B11). Both: page_id, version."""
    old = known.groupBy("page_id").agg(F.max("version").alias("old"))
    return incoming.join(old, "page_id", "left").filter(F.col("version") > F.coalesce("old", F.lit(0))).drop("old")


def title_scores(rows: DataFrame, title: Column, wanted: Column) -> DataFrame:
    """`match`: 0 where the plain titles are equal, 1 where one holds the other, else 2."""
    match = F.when(title == wanted, 0).when(title.contains(wanted) | wanted.contains(title), 1).otherwise(2)
    return rows.withColumn("match", match)


def pick_unique(rows: DataFrame, by: str) -> DataFrame:
    """Of each query the only row with match 0, else (if there is none) the only one with match 1, else its only row (B14); queries that
    stay ambiguous give no row. Partial counts by query and match, so no query's rows meet in one task."""
    counts = rows.groupBy(by).agg(F.count_if(F.col("match") == 0).alias("n0"), F.count_if(F.col("match") == 1).alias("n1"), F.count("*").alias("n"))
    level = F.when(F.col("n0") == 1, 0).when((F.col("n0") == 0) & (F.col("n1") == 1), 1).when((F.col("n0") == 0) & (F.col("n1") == 0) & (F.col("n") == 1), 2)
    return rows.join(counts.select(by, level.alias("level")), by).filter(F.col("match") == F.col("level")).drop("level")


def in_networks(address: Column, networks: list[str]) -> Column:
    """Whether an IPv4 address lies in one of the networks (B15); without networks every address does, a broken one lies in none."""
    if not networks:
        return F.lit(True)
    parts = F.transform(F.split(address, r"\."), lambda x: F.when(x.rlike(r"^(0|[1-9]\d{0,2})$"), x.cast("bigint")))
    good = (F.size(parts) == 4) & F.forall(parts, lambda x: x.isNotNull() & (x <= 255))
    number = F.aggregate(parts, F.lit(0).cast("bigint"), lambda s, x: s * 256 + x)
    ranges = [ipaddress.ip_network(n, strict=False) for n in networks]
    inside = [number.between(int(n.network_address), int(n.broadcast_address)) for n in ranges if n.version == 4]
    return F.coalesce(good & F.greatest(*inside, F.lit(False), F.lit(False)), F.lit(False))


def table_pages(chunks: DataFrame, pages: DataFrame, n: int, exclude=(), marker: str = "[Таблица ") -> DataFrame:
    """Live pages with the most chunks that hold the marker (B16); ties go by page_id, the limit is the operator's own."""
    counts = chunks.filter(F.col("text").contains(marker)).groupBy("page_id").agg(F.count("*").alias("n"))
    counts = counts.join(live(pages).select("page_id", "title"), "page_id")
    return (counts.filter(~F.col("page_id").isin(*exclude)) if exclude else counts).orderBy(F.desc("n"), "page_id").limit(n)


def marker_counts(chunks: DataFrame) -> DataFrame:
    """page_id, labelled rows, table-like chunks."""
    text = F.col("text")
    labelled = text.contains("| строка ") & text.contains(": ")
    tables = [F.col(c) == "table" for c in ("content_type", "structural_content_type") if c in chunks.columns] + [text.contains("[Таблица ")]
    either = F.lit(False)
    for t in tables:
        either = either | F.coalesce(t, F.lit(False))
    return chunks.groupBy("page_id").agg(F.count("*").alias("chunks"), F.count_if(labelled).alias("labelled"), F.count_if(either).alias("tables"))


def uncached(chunks: DataFrame, cache: DataFrame) -> DataFrame:
    """Chunks whose text has no vector of any model."""
    return chunks.join(cache.select("content_hash"), "content_hash", "left_anti")


def cached(chunks: DataFrame, cache: DataFrame, model_version: str) -> DataFrame:
    """Chunks with the vector of their text under one model, null where there is none."""
    own = cache.filter(F.col("model_version") == model_version).select("content_hash", "vector")
    return chunks.join(own, "content_hash", "left")


def named(rows: DataFrame, names: DataFrame, key: str = "user_id") -> DataFrame:
    """Rows with the name of their user; the id where there is none (C14). `names`: id, name, last_name, login."""
    full = F.trim(F.concat_ws(" ", F.nullif(F.trim("name"), F.lit("")), F.nullif(F.trim("last_name"), F.lit(""))))
    known = names.select(F.col("id").cast("string").alias(key), first_of(full, F.col("login"), F.col("id")).alias("user"))
    return rows.join(known.dropDuplicates([key]), key, "left").withColumn("user", F.coalesce("user", F.col(key)))


def page_sections(pages: DataFrame, roots: list[tuple[str, str]]) -> DataFrame:
    """page_id and the first section, in the order given, whose root is the page or one of its ancestors (C15); null where none is.
    `pages`: page_id, ancestors array<string>."""
    ids = F.concat(F.array("page_id"), F.coalesce("ancestors", F.array().cast("array<string>")))
    return pages.select("page_id", F.coalesce(*[F.when(F.array_contains(ids, root), section) for section, root in roots], F.lit(None).cast("string")).alias("section"))


def removed(old: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Keys of the old rows that no new row has."""
    return old.select(key).distinct().join(new.select(key), key, "left_anti")


def stale_pages(existing: DataFrame, known: DataFrame, inventory: DataFrame) -> DataFrame:
    """Pages that exist or are known, and are not in the inventory."""
    return existing.select("page_id").union(known.select("page_id")).distinct().join(inventory.select("page_id"), "page_id", "left_anti")


def unique_in_order(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("n_", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter("n_ = 1").drop("n_")


def point_ids(chunk_id: Column, prefix: str) -> Column:
    """The name-based UUID (version 5, URL namespace) of prefix and chunk id."""
    @F.pandas_udf("string")
    def make(ids: pd.Series) -> pd.Series:
        return ids.map(lambda x: None if x is None else str(uuid.uuid5(uuid.NAMESPACE_URL, prefix + x)))

    return make(chunk_id)


def listed(payload: Column, item: str) -> Column:
    """The items of a JSON array, or of an object keyed by id (G28): objects as they are, other values as {id, value}. `item`: their schema."""
    as_array = F.from_json(payload, f"array<{item}>")
    entries = F.map_entries(F.from_json(payload, "map<string, string>"))
    items = F.transform(entries, lambda e: F.when(e.value.startswith("{"), F.from_json(e.value, item)).otherwise(F.from_json(F.to_json(F.struct(e.key.alias("id"), e.value.alias("value"))), item)))
    kept = F.filter(F.zip_with(items, entries, lambda i, e: F.struct(i.alias("i"), e.value.alias("v"))), lambda x: x.v.isNotNull() & (x.v != "null"))
    return F.when(payload.startswith("["), as_array).when(payload.startswith("{"), F.transform(kept, lambda x: x.i)).otherwise(F.from_json(F.lit("[]"), f"array<{item}>"))


def dialog_id(chat_id: Column, entity: Column, source: Column) -> Column:
    """`chat…` and `sg…` as they are; the id of a group or project after `sg`, any other after `chat`."""
    group = F.coalesce(entity.isin("sonet_group", "workgroup", "group", "project"), F.lit(False)) | F.coalesce(source == "sonet_group", F.lit(False))
    return F.when(chat_id.startswith("chat") | chat_id.startswith("sg"), chat_id).when(group, F.concat(F.lit("sg"), chat_id)).otherwise(F.concat(F.lit("chat"), chat_id))
