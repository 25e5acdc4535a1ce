"""Webhook deliveries (A10, B9, B10, B15): size, secret, sender's network, signature, JSON, event type and identity, in that order."""

from __future__ import annotations

import hashlib
import hmac

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomfold.operators.filters import event_class, event_kind, first_of, in_networks

LARGEST, PAGE_ID, DELIVERY_ID = 262_144, 128, 255
#: Headers that carry each value, in the order in which they are looked for (fixed values).
SIGNATURE = ("x-hub-signature-256", "x-hub-signature", "x-webhook-signature")
TYPE = ("x-event-type", "x-event-key")
DELIVERY = ("x-atlassian-webhook-delivery", "x-atlassian-webhook-identifier", "x-webhook-delivery", "x-request-id")


def signed(body: Column, secret: str) -> Column:
    """The body's HMAC with SHA-256, in hex."""

    @F.pandas_udf("string")
    def digest(bodies: pd.Series) -> pd.Series:
        return bodies.map(lambda b: hmac.new(secret.encode(), bytes(b or b""), hashlib.sha256).hexdigest())

    return digest(body)


def validated(rows: DataFrame, secret: str, networks: list[str] | None = None, largest: int = LARGEST) -> DataFrame:
    """Each request with `error` (null where it is good) and delivery_id, page_id, event_type, class. `rows`: body binary, headers
    map<string,string>, source. Works on a batch and on a stream."""
    lower = F.transform_keys(F.coalesce("headers", F.create_map().cast("map<string,string>")), lambda k, v: F.lower(k))
    rows = rows.withColumn("h_", lower)

    def header(names):
        return first_of(*[F.try_element_at("h_", F.lit(n)) for n in names])

    text = F.when(F.is_valid_utf8(F.col("body").cast("string")), F.col("body").cast("string"))
    kind = F.schema_of_variant(F.try_parse_json(text))
    get = lambda *paths: first_of(*[F.get_json_object(text, p) for p in paths])
    supplied = F.regexp_replace(F.lower(header(SIGNATURE)), "^sha256=", "")
    event = event_kind(first_of(header(TYPE), get("$.eventType", "$.event", "$.type")))
    page = get("$.page.id", "$.content.id", "$.pageId", "$.contentId", "$.id")
    delivery = first_of(header(DELIVERY), get("$.deliveryId", "$.webhookEventId"))
    rows = rows.withColumns({"page_id": page, "event_type": event, "delivery_id": delivery, "own_": signed(F.col("body"), secret)})
    error = (
        F.when(F.octet_length("body") > largest, "payload_too_large")
        .when(F.lit(not secret), "webhook_not_configured")
        .when(~in_networks(F.col("source"), networks or []), "source_not_allowed")
        .when((supplied == "") | (supplied != F.col("own_")), "invalid_signature")
        .when(kind.isNull() | ~kind.startswith("OBJECT"), "invalid_payload")
        .when(F.col("event_type").isNull(), "unsupported_event_type")
        .when((F.col("page_id") == "") | (F.col("delivery_id") == "") | (F.length("page_id") > PAGE_ID) | (F.length("delivery_id") > DELIVERY_ID), "missing_event_identity")
    )
    return rows.withColumn("error", error).drop("h_", "own_").withColumn("class", event_class(F.col("event_type")))
