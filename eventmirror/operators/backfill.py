"""Loading history without overwriting what is fresher."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.payload import is_stub
from ..sources.scratch import stored_in_parts
from .fold import OBJECT, merge_state
from .mirror import KEY, write_objects

PAGE = 100
LIVE = ("active", "trialing", "past_due")


def writable(snapshot: DataFrame, state: DataFrame, horizon: Column) -> DataFrame:
    """The snapshot rows whose object has no event after the horizon."""
    fresh = state.where(F.col("last_event_created") > horizon).select("object_type", F.col("object_id").alias("id"))
    return snapshot.join(fresh, ["object_type", "id"], "left_anti")


def backfill(snapshot: DataFrame, mirror: DataFrame, state: DataFrame, horizon: Column, as_of: Column, item_listing: DataFrame | None = None, parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(mirror, state) after loading the snapshot. Every written object counts as known up to the horizon, so
    events from before it lose. Runs a job that stores the rows to write, which are read six times. With `parts`, for which the
    snapshot is to be a stored table, this and the joins with items and mirror are made part by part, and the mirror is stored."""
    upstream = snapshot.where(~is_stub(F.col("data")))
    rows = stored_in_parts(snapshot.sparkSession, lambda cut: writable(cut(upstream, *KEY), cut(state, *OBJECT), horizon), "writable", parts or 1)
    out = write_objects(mirror, rows, as_of, listing=item_listing, parts=parts)
    applied = rows.select("object_type", F.col("id").alias("object_id"), horizon.alias("created"), F.lit(None).cast("string").alias("event_id"), F.lit("backfill").alias("sync_source"))
    return out, merge_state(state, applied, as_of)


def live_subscription_payment_methods(methods: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """The payment methods (id, data) of customers with a live subscription (data, is_deleted)."""
    live = subscriptions.where(~F.col("is_deleted") & F.get_json_object("data", "$.status").isin(*LIVE)).select(F.get_json_object("data", "$.customer").alias("_c")).distinct()
    return methods.withColumn("_c", F.get_json_object("data", "$.customer")).join(live, "_c", "left_semi").drop("_c")


def backfill_progress(snapshot: DataFrame, written: DataFrame, page: int = PAGE) -> DataFrame:
    """object_type, pages_done (of all listed rows; payment methods have at least one page per customer) and objects_done (rows written)."""
    listed = snapshot.withColumn("_c", F.when(F.col("object_type") == "payment_method", F.get_json_object("data", "$.customer")))
    pages = (
        listed.groupBy("object_type", "_c").agg(F.greatest(F.ceil(F.count(F.lit(1)) / page), F.lit(1)).alias("pages"))
        .groupBy("object_type").agg(F.sum("pages").cast("long").alias("pages_done"))
    )
    done = written.groupBy("object_type").agg(F.count(F.lit(1)).alias("objects_done"))
    return pages.join(done, "object_type", "left").select("object_type", "pages_done", F.coalesce("objects_done", F.lit(0)).cast("long").alias("objects_done"))


def resume_after(listing: DataFrame, cursor_created: Column | None = None, cursor_id: Column | None = None, cursor_customer: Column | None = None) -> DataFrame:
    """The rows after a cursor in listing order: newest (created, id) first; payment methods by customer, ascending."""
    if cursor_customer is not None:
        return listing.where(F.get_json_object("data", "$.customer") > cursor_customer)
    created = F.get_json_object("data", "$.created").try_cast("bigint")
    return listing.where((created < cursor_created) | ((created == cursor_created) & (F.col("id") < cursor_id)))


__all__ = ["OBJECT", "backfill", "backfill_progress", "live_subscription_payment_methods", "resume_after", "writable"]
