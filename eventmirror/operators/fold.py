"""Folding events into current state, in the strict order (created, event_id)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.payload import after, data_object, data_object_id, event_newer, is_stub, marks_deleted
from .ingest import resolve_event
from .mirror import KEY, write_objects

OBJECT = ["object_type", "object_id"]


def mapped(events: DataFrame) -> DataFrame:
    """The events that are about an object; those already resolved stay as they are."""
    rows = events if "resolve_status" in events.columns else resolve_event(events)
    return rows.where(F.col("resolve_status") == "mapped")


def coalesce_work(events: DataFrame) -> DataFrame:
    """One row per object with its newest event. Partial maxima are taken before the shuffle, so a hot object is cheap."""
    newest = mapped(events).groupBy(*OBJECT).agg(F.max(F.struct("created", "event_id")).alias("w"))
    return newest.select(*OBJECT, F.col("w.created").alias("latest_event_created"), F.col("w.event_id").alias("latest_event_id"))


def fold_latest(events: DataFrame) -> DataFrame:
    """One row per object: its newest event, whether that deletes, and the newest event with data.

    object_type, object_id, last_event_created, last_event_id, is_deleted, data, data_event_created, data_event_id; data is
    null if all events delete. Copies of an event change nothing.
    """
    rows = mapped(events).select(*OBJECT, "created", "event_id", data_object(F.col("payload")).alias("data"), marks_deleted(F.col("payload")).alias("deletes"))
    last = F.max(F.struct("created", "event_id", "deletes"))
    live = F.max(F.when(~F.col("deletes"), F.struct("created", "event_id", "data")))
    return rows.groupBy(*OBJECT).agg(last.alias("l"), live.alias("d")).select(
        *OBJECT, F.col("l.created").alias("last_event_created"), F.col("l.event_id").alias("last_event_id"), F.col("l.deletes").alias("is_deleted"),
        F.col("d.data").alias("data"), F.col("d.created").alias("data_event_created"), F.col("d.event_id").alias("data_event_id"),
    )


def apply_events(events: DataFrame, mirror: DataFrame, state: DataFrame, as_of: Column) -> DataFrame:
    """One row per object of the batch, the mirror or the state, with all their columns after the batch and `changed`.

    An event that is older than what was applied is skipped. A live event newer than the data but older than
    the last delete updates the data and leaves the object deleted. So batches of any cut and order, with
    copies, end as one fold of all events. Split the result with mirror_of() and state_of().
    """
    new = fold_latest(events).select(*OBJECT, *[F.col(c).alias(f"_{c}") for c in ("last_event_created", "last_event_id", "is_deleted", "data", "data_event_created", "data_event_id")])
    old = mirror.withColumnRenamed("id", "object_id").withColumn("_in_mirror", F.lit(True))
    rows = new.withColumn("_in_batch", F.lit(True)).join(state.withColumn("_in_state", F.lit(True)), OBJECT, "full_outer").join(old, OBJECT, "full_outer")
    batch = F.col("_in_batch").isNotNull()
    # State rows of an import or backfill have a mirror row; without any event of their own every event is newer.
    newer = batch & event_newer(F.col("_last_event_created"), F.col("_last_event_id"), F.col("last_event_created"), F.col("last_event_id"))
    newer = newer | (batch & F.col("_in_state").isNull() & F.col("_last_event_created").isNull())
    data_newer = batch & F.col("_data").isNotNull() & (
        event_newer(F.col("_data_event_created"), F.col("_data_event_id"), F.col("data_event_created"), F.col("data_event_id"))
        | (F.col("_in_state").isNull() & F.col("_data_event_created").isNull())
    )
    return _after(rows, newer, data_newer, as_of)


def _after(rows: DataFrame, newer: Column, data_newer: Column, as_of: Column) -> DataFrame:
    rows = rows.withColumns({"_newer": F.coalesce(newer, F.lit(False)), "_data_newer": F.coalesce(data_newer, F.lit(False))})
    has_row = F.col("_in_mirror").isNotNull() | F.col("_data_newer")
    deleted = F.when(F.col("_newer"), F.col("_is_deleted")).when(
        F.col("_in_mirror").isNull(), F.coalesce(after(F.col("last_event_created"), F.col("last_event_id"), F.col("data_event_created"), F.col("data_event_id")), F.lit(False)) & F.col("_in_state").isNotNull()
    ).otherwise(F.coalesce("is_deleted", F.lit(False)))
    # With no live data in this batch a deleted object stays; with data behind a delete in the state it lands deleted.
    rows = rows.withColumn("_deleted", deleted)
    flips = F.col("_deleted") != F.coalesce("is_deleted", F.lit(False))
    changed = has_row & (F.col("_data_newer") | (F.col("_newer") & flips) | F.col("_in_mirror").isNull())
    touched = F.col("_newer") | F.col("_data_newer")
    pick = lambda when, new, old: F.when(when, F.col(new)).otherwise(F.col(old)).alias(old)
    return rows.select(
        *OBJECT,
        pick(F.col("_data_newer"), "_data", "data"), "account_id", F.when(has_row, F.col("_deleted")).alias("is_deleted"),
        F.when(has_row & F.col("_deleted"), F.when(flips, as_of).otherwise(F.coalesce("deleted_at", as_of))).alias("deleted_at"),
        F.when(changed, as_of).otherwise(F.col("updated_at")).alias("updated_at"),
        F.when(touched, as_of).otherwise(F.col("last_synced_at")).alias("last_synced_at"),
        pick(F.col("_newer"), "_last_event_created", "last_event_created"), pick(F.col("_newer"), "_last_event_id", "last_event_id"),
        F.when(touched, F.lit("payload")).otherwise(F.col("sync_source")).alias("sync_source"),
        F.when(touched, F.lit(0)).otherwise(F.col("fetch_failures")).cast("int").alias("fetch_failures"),
        pick(F.col("_data_newer"), "_data_event_created", "data_event_created"), pick(F.col("_data_newer"), "_data_event_id", "data_event_id"),
        has_row.alias("in_mirror"), (F.col("_in_state").isNotNull() | touched).alias("in_state"), F.coalesce(changed, F.lit(False)).alias("changed"),
    )


def mirror_of(applied: DataFrame) -> DataFrame:
    return applied.where("in_mirror").select("object_type", F.col("object_id").alias("id"), "data", "account_id", "is_deleted", "deleted_at", "updated_at")


def state_of(applied: DataFrame) -> DataFrame:
    return applied.where("in_state").select(*OBJECT, "last_synced_at", "last_event_created", "last_event_id", "sync_source", "fetch_failures", "data_event_created", "data_event_id")


def changes_of(applied: DataFrame) -> DataFrame:
    """(object_type, object_id) of what changed; ids only."""
    return applied.where("changed").select(*OBJECT)


def apply_snapshot(work: DataFrame, snapshot: DataFrame, mirror: DataFrame, as_of: Column, item_listing: DataFrame | None = None) -> DataFrame:
    """The mirror after the pending objects of `work` take their current upstream data; what upstream lacks or
    shows as a stub is deleted."""
    todo = work.select("object_type", F.col("object_id").alias("id")).distinct()
    seen = todo.join(snapshot.select(*KEY, "data"), KEY, "left")
    gone = F.col("data").isNull() | is_stub(F.col("data"))
    return write_objects(mirror, seen.where(~gone), as_of, deletes=seen.where(gone), listing=item_listing)


def merge_state(state: DataFrame, applied: DataFrame, as_of: Column) -> DataFrame:
    """The state after applied (object_type, object_id, created, event_id, sync_source): last_event_* only move
    forward, source and time are overwritten, failures start anew; what was written is what the data now stands for."""
    new = applied.groupBy(*OBJECT).agg(F.max(F.struct("created", "event_id", "sync_source")).alias("_n"))
    hit = F.col("_n").isNotNull()
    created, event_id = F.col("_n.created"), F.col("_n.event_id")
    ahead = hit & after(created, event_id, F.col("last_event_created"), F.col("last_event_id"))
    last_created = F.greatest("last_event_created", created)
    last_id = F.when(ahead, event_id).otherwise(F.col("last_event_id"))
    return state.join(new, OBJECT, "full_outer").select(
        *OBJECT, F.when(hit, as_of).otherwise(F.col("last_synced_at")).alias("last_synced_at"),
        last_created.alias("last_event_created"), last_id.alias("last_event_id"),
        F.coalesce("_n.sync_source", "sync_source").alias("sync_source"), F.when(hit, 0).otherwise(F.col("fetch_failures")).cast("int").alias("fetch_failures"),
        F.when(hit, last_created).otherwise(F.col("data_event_created")).alias("data_event_created"),
        F.when(hit, last_id).otherwise(F.col("data_event_id")).alias("data_event_id"),
    )


def mark_processed(log: DataFrame, applied: DataFrame, as_of: Column) -> DataFrame:
    """The log with processed_at set on open events whose object id was applied at their time or later.

    By id alone, whatever the type. Applied is first reduced to one row per id, so this is an equal join. Only open
    events with an object take part in it: all others pass through as they are, without a shuffle.
    """
    done = applied.where(F.col("created").isNotNull()).groupBy(F.col("object_id").alias("_id")).agg(F.max("created").alias("_upto"))
    keyed = log.withColumn("_id", F.when(F.col("processed_at").isNull(), data_object_id(F.col("payload"))))
    hit = F.coalesce(F.col("created") <= F.col("_upto"), F.lit(False))
    fresh = keyed.where("_id IS NOT NULL").join(done, "_id", "left").withColumn("processed_at", F.when(hit, as_of))
    return fresh.select(*log.columns).unionByName(keyed.where("_id IS NULL").select(*log.columns))


def pending_work(work: DataFrame, state: DataFrame) -> DataFrame:
    """The rows of work whose newest event comes after the last one applied."""
    rows = work.join(state.select(*OBJECT, "last_event_created", "last_event_id", F.lit(True).alias("_known")), OBJECT, "left")
    late = after(F.col("latest_event_created"), F.col("latest_event_id"), F.col("last_event_created"), F.col("last_event_id"))
    return rows.where(F.col("_known").isNull() | late).select(*work.columns)
