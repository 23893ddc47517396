"""What could not be processed: one table for failures of every kind, which rows leave once a replay succeeds.

A row names its source (envelope, event, typed or subscription), the key to retry it by, the reason, and the text that failed. The table is
published like the mirror, by (source, retry_key), so recording a failure again renews its row instead of adding one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import QUARANTINE
from ..sources.tables import RANGE_ROWS, read_current, rows_of, upsert_rows
from .ingest import parse_envelope, resolve_event
from .mirror import explode_items, typed_view

KEYS = ["source", "retry_key"]


def _rows(failed: DataFrame, source: str, key: Column, reason: Column, text: Column, as_of: Column) -> DataFrame:
    rows = failed.select(key.alias("retry_key"), reason.alias("reason"), text.alias("text"))
    # One row a key, however often it failed in a batch.
    one = rows.groupBy("retry_key").agg(F.max(F.struct("reason", "text")).alias("r"))
    none = F.lit(None).cast("timestamp")
    return one.select(F.lit(source).alias("source"), "retry_key", "r.reason", "r.text", as_of.cast("timestamp").alias("failed_at"), none.alias("resolved_at"))


def failed_envelopes(deliveries: DataFrame, as_of: Column) -> DataFrame:
    """Deliveries (body, received_at) that hold no event; the key is the body's SHA-256. Of one that is too large no text is kept."""
    rows = parse_envelope(deliveries.withColumn("_key", F.sha2(F.col("body").cast("binary"), 256))).where("parse_status <> 'ok'")
    return _rows(rows, "envelope", F.col("_key"), F.col("parse_status"), F.col("payload"), as_of)


def failed_events(events: DataFrame, as_of: Column) -> DataFrame:
    """Events of a known type that name no object, by event_id. Events of unknown types fail nothing."""
    return _rows(resolve_event(events).where("resolve_status = 'malformed'"), "event", F.col("event_id"), F.lit("malformed"), F.col("payload"), as_of)


def failed_objects(mirror: DataFrame, object_type: str, as_of: Column) -> DataFrame:
    """Objects of a type with values that do not fit their columns, which the reason lists; the key is type/id."""
    bad = typed_view(mirror, object_type, "data").where(F.size("typed_errors") > 0)
    return _rows(bad, "typed", F.concat(F.lit(f"{object_type}/"), F.col("id")), F.array_join(F.array_sort("typed_errors"), ","), F.col("data"), as_of)


def failed_subscriptions(subscriptions: DataFrame, as_of: Column, listing: DataFrame | None = None) -> DataFrame:
    """Subscriptions (id, data) that are unreadable or whose items are incomplete or lack an id, by id."""
    bad = explode_items(subscriptions, listing).where("status <> 'ok'").groupBy(F.col("subscription").alias("id")).agg(F.max("status").alias("status"))
    return _rows(subscriptions.join(bad, "id"), "subscription", F.col("id"), F.col("status"), F.col("data"), as_of)


def record(path: str, failed: DataFrame, range_rows: int = RANGE_ROWS) -> int:
    """Publish failures; a key that is there already gets the new reason and is open again. Returns the version."""
    return upsert_rows(failed.select(*QUARANTINE.names), path, KEYS, range_rows)


def open_rows(spark: SparkSession, path: str, source: str | None = None) -> DataFrame:
    """The failures that no replay has resolved, of one source if given."""
    rows = read_current(spark, path, QUARANTINE).where("resolved_at IS NULL")
    return rows if source is None else rows.where(F.col("source") == source)


def corrected(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Failures with the texts that replace theirs (source, retry_key, text), where there are any."""
    new = texts.select(*KEYS, F.col("text").alias("_new"))
    return rows.join(new, KEYS, "left").withColumn("text", F.coalesce("_new", "text")).drop("_new")


def replay_envelopes(rows: DataFrame, received_at: Column) -> DataFrame:
    """retry_key and the columns of the log for the envelopes that can be read now."""
    again = rows.where("source = 'envelope'").select("retry_key", F.col("text").alias("body"), received_at.cast("timestamp").alias("received_at"))
    return parse_envelope(again).where("parse_status = 'ok'").drop("parse_status")


def replay_events(rows: DataFrame) -> DataFrame:
    """retry_key, payload and the object (object_type, object_id) of the events that name one now; `rows` has their type too."""
    again = rows.where("source = 'event'").select("retry_key", "type", F.col("text").alias("payload"))
    return resolve_event(again).where("resolve_status = 'mapped'").drop("resolve_status")


def replay_objects(rows: DataFrame, object_type: str) -> DataFrame:
    """retry_key, object_type, id and data of the objects whose values fit now."""
    prefix = f"{object_type}/"
    own = rows.where((F.col("source") == "typed") & F.col("retry_key").startswith(prefix))
    again = own.select("retry_key", F.lit(object_type).alias("object_type"), F.substring("retry_key", len(prefix) + 1, 1 << 20).alias("id"), F.col("text").alias("data"))
    none = F.lit(None)
    shown = typed_view(again.select("*", none.cast("string").alias("account_id"), F.lit(False).alias("is_deleted"), none.cast("timestamp").alias("deleted_at"), none.cast("timestamp").alias("updated_at")), object_type)
    return again.join(shown.where(F.size("typed_errors") > 0).select("id"), "id", "left_anti").select("retry_key", "object_type", "id", "data")


def replay_subscriptions(rows: DataFrame, listing: DataFrame | None = None) -> DataFrame:
    """retry_key, id and data of the subscriptions whose items are all there now; mirror.subscription_writes() takes them."""
    again = rows.where("source = 'subscription'").select(F.col("retry_key").alias("id"), F.col("text").alias("data"))
    bad = explode_items(again, listing).where("status <> 'ok'").select(F.col("subscription").alias("id"))
    return again.join(bad, "id", "left_anti").select(F.col("id").alias("retry_key"), "id", "data")


def resolve(path: str, done: DataFrame, as_of: Column) -> int:
    """Mark the failures (source, retry_key) as resolved; they leave open_rows(). Opens the ranges that the keys fall into. To be
    called once what the replay gave is published: a crash between leaves the row open, and a replay writes the same again."""
    keys = done.select(*KEYS)
    rows = rows_of(done.sparkSession, path, QUARANTINE, keys).where("resolved_at IS NULL")
    return upsert_rows(rows.withColumn("resolved_at", as_of.cast("timestamp")), path, KEYS)


def dead_rows(rows: DataFrame, limit: int = 50) -> DataFrame:
    """The first failures, oldest first."""
    return rows.orderBy("failed_at", *KEYS).limit(limit)
