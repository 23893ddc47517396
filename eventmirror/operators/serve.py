"""What applications read from the mirror."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def entitlements(mirror: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """customer, subscription, status, access: each customer's newest live subscription (created, then id) and
    whether it gives access; with users (user_id, customer) a row per user, access false without a subscription."""
    live = mirror.where((F.col("object_type") == "subscription") & ~F.col("is_deleted")).select(
        F.get_json_object("data", "$.customer").alias("customer"), F.get_json_object("data", "$.created").try_cast("bigint").alias("created"), "id", F.get_json_object("data", "$.status").alias("status")
    )
    last = live.where(F.col("customer").isNotNull()).groupBy("customer").agg(F.max(F.struct("created", "id", "status")).alias("s")).select("customer", F.col("s.id").alias("subscription"), F.col("s.status").alias("status"))
    access = F.coalesce(F.col("status").isin("active", "trialing"), F.lit(False)).alias("access")
    if users is None:
        return last.select("customer", "subscription", "status", access)
    return users.select("user_id", "customer").join(last, "customer", "left").select("user_id", "customer", "subscription", "status", access)


def changes_since(mirror: DataFrame, cursor: Column) -> DataFrame:
    """(object_type, id) of all rows written after the cursor, deleted ones too."""
    return mirror.where(F.col("updated_at") > cursor).select("object_type", "id")


def dead_rows(quarantine: DataFrame, limit: int = 50) -> DataFrame:
    """The first rows of a quarantine table by id."""
    return quarantine.orderBy("id").limit(limit)


def list_work(work: DataFrame, status: str | None = None, limit: int = 50) -> DataFrame:
    """The first rows of monitor.work_status() by object, of one status if given."""
    rows = work if status is None else work.where(F.col("status") == status)
    return rows.orderBy("object_type", "object_id").limit(limit)


def show_event(log: DataFrame, event_id: str) -> DataFrame:
    """The event of one id. See indented() for its payload."""
    return log.where(F.col("event_id") == event_id)


def indented(payload: str) -> str:
    """A payload for reading; what is no JSON stays as it is."""
    try:
        return json.dumps(json.loads(payload), indent=2, ensure_ascii=False)
    except ValueError:
        return payload
