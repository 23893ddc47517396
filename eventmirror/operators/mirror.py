"""The mirror: upserts, soft deletes, subscription items, typed views."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.json_equal import parsed, take_last_keys
from ..schemas import MIRROR
from ..sources.scratch import discard, stored, stored_in_parts

KEY = ["object_type", "id"]
# The columns of each object type; t: epoch seconds, n: whole number, b: boolean, else text. `name=path`
# reads another path. Every type also has created and livemode.
TYPED = {
    "customer": "email name currency b:delinquent",
    "product": "name b:active type",
    "price": "product b:active currency n:unit_amount recurring_interval=recurring.interval type",
    "subscription": "customer status b:cancel_at_period_end t:current_period_start t:current_period_end t:canceled_at t:trial_end",
    "subscription_item": "subscription price=price.id n:quantity",
    "invoice": "customer subscription status n:total n:amount_paid n:amount_due currency t:period_start t:period_end number",
    "charge": "customer invoice payment_intent status n:amount n:amount_refunded currency b:paid b:refunded",
    "payment_intent": "customer status n:amount currency latest_charge",
    "payment_method": "customer type card_brand=card.brand card_last4=card.last4",
    "setup_intent": "customer status payment_method",
    "refund": "charge payment_intent status n:amount currency reason",
    "dispute": "charge payment_intent status n:amount currency reason t:evidence_due_by=evidence_details.due_by",
    "checkout_session": "customer subscription payment_intent status mode n:amount_total currency",
}
_CASTS = {"n": "bigint", "b": "boolean", "t": "bigint"}


def typed_view(mirror: DataFrame, object_type: str, *others: str) -> DataFrame:
    """The typed columns of one object type with the bookkeeping columns and `others` of the mirror.

    A value that does not fit its type is null, and its column is named in `typed_errors`: rows with errors
    belong to quarantine, and none fails the batch.
    """
    columns, errors, tops, nested = [], [], [], {}
    for spec in (TYPED[object_type] + " t:created b:livemode").split():
        kind, _, rest = spec.rpartition(":")
        name, _, path = rest.partition("=")
        top, _, inner = (path or name).partition(".")
        if inner:
            nested.setdefault(top, []).append(inner)
        elif top not in tops:
            tops.append(top)
        text = F.col(f"_o.{path or name}")
        value = text
        if kind:
            value = text.try_cast(_CASTS[kind])
            errors.append(F.when(text.isNotNull() & value.isNull(), F.lit(name)))
        columns.append((F.timestamp_seconds(value) if kind == "t" else value).alias(name))
    # One pass over the text for all columns; every field is read as text first.
    shape = ", ".join([f"`{t}` string" for t in tops] + [f"`{t}` struct<{', '.join(f'`{i}`: string' for i in names)}>" for t, names in nested.items()])
    rows = mirror.where(F.col("object_type") == object_type).withColumn("_o", F.from_json("data", shape))
    return rows.select("id", *columns, "account_id", "is_deleted", "deleted_at", "updated_at", F.array_compact(F.array(*errors)).alias("typed_errors"), *others)


def live_items(mirror: DataFrame) -> DataFrame:
    """object_type, id and _parent (the subscription) of the live items that name one."""
    rows = mirror.where((F.col("object_type") == "subscription_item") & ~F.col("is_deleted"))
    return rows.select(*KEY, F.get_json_object("data", "$.subscription").alias("_parent")).where("_parent IS NOT NULL")


def merge_objects(
    mirror: DataFrame, as_of: Column, upserts: DataFrame | None = None, deletes: DataFrame | None = None, refreshed: DataFrame | None = None, parts: int | None = None
) -> DataFrame:
    """The mirror after one pass of writes: upserts (object_type, id, data, optionally account_id), deletes (object_type,
    id), and the subscriptions (id) whose items are all among the upserts, so that their other live items go.

    The last write wins and clears delete flags; of upserts with one key the greatest (data, account_id) is written. A delete flags
    a live row and keeps its data; ids that the mirror lacks or holds deleted change nothing. A subscription's
    live items go with it. With `parts` the mirror is stored, in a job for each part, so that only a part's texts lie in shuffle files.
    """
    changes, parents = [], []
    none = F.lit(None).cast("string")
    no_data = F.lit(None).cast("struct<data: string, account_id: string>").alias("_n")
    if upserts is not None:
        account = F.col("account_id") if "account_id" in upserts.columns else none
        changes.append(upserts.select(*KEY, F.struct(F.col("data").alias("data"), account.alias("account_id")).alias("_n"), F.lit(False).alias("_gone"), F.lit(False).alias("_orphan")))
    if deletes is not None:
        changes.append(deletes.select(*KEY, no_data, F.lit(True).alias("_gone"), F.lit(False).alias("_orphan")))
        live = mirror.where(~F.col("is_deleted") & (F.col("object_type") == "subscription")).select(F.col("id").alias("_parent"))
        parents.append(live.join(deletes.where(F.col("object_type") == "subscription").select(F.col("id").alias("_parent")), "_parent", "left_semi"))
    if refreshed is not None:
        parents.append(refreshed.select(F.col("id").alias("_parent")))
    if parents:
        # Live items of these subscriptions, by their ids: only rows that have a parent are joined on it.
        gone = parents[0] if len(parents) == 1 else parents[0].unionByName(parents[1])
        orphans = live_items(mirror).join(gone, "_parent", "left_semi").select(*KEY)
        orphans = orphans if parts is None else stored(orphans, "orphans")
        changes.append(orphans.select(*KEY, no_data, F.lit(False).alias("_gone"), F.lit(True).alias("_orphan")))
    merged = lambda cut: _merged(cut(mirror, *KEY), cut(functools.reduce(DataFrame.unionByName, changes), *KEY), as_of)
    if parts is None:
        return merged(lambda rows, *_: rows)
    out = stored_in_parts(mirror.sparkSession, merged, "mirror", parts)
    if parents:
        discard(orphans)
    return out


def _merged(mirror: DataFrame, changes: DataFrame, as_of: Column) -> DataFrame:
    """The mirror after the changes (object_type, id, _n, _gone, _orphan) of the same keys."""
    changes = changes.groupBy(*KEY).agg(F.max("_n").alias("_n"), F.max("_gone").alias("_gone"), F.max("_orphan").alias("_orphan"))
    out = mirror.withColumn("_old", F.lit(True)).join(changes, KEY, "full_outer")
    written = F.col("_n").isNotNull()
    live = F.coalesce(~F.col("is_deleted"), F.lit(False))
    goes = (F.coalesce("_gone", F.lit(False)) & (live | written)) | (F.coalesce("_orphan", F.lit(False)) & ~written)
    pick = lambda new, kept, old: F.when(goes, new).when(written, kept).otherwise(F.col(old)).alias(old)
    return out.where(F.col("_old").isNotNull() | written).select(
        *KEY, F.when(written, F.col("_n.data")).otherwise(F.col("data")).alias("data"), F.coalesce("_n.account_id", "account_id").alias("account_id"),
        pick(F.lit(True), F.lit(False), "is_deleted"), pick(as_of, F.lit(None).cast("timestamp"), "deleted_at"), pick(as_of, as_of, "updated_at"),
    )


def upsert_objects(mirror: DataFrame, rows: DataFrame, as_of: Column) -> DataFrame:
    """The mirror after writing rows; see merge_objects()."""
    return merge_objects(mirror, as_of, upserts=rows)


def soft_delete(mirror: DataFrame, ids: DataFrame, as_of: Column) -> DataFrame:
    """The mirror after deleting the objects of ids; see merge_objects()."""
    return merge_objects(mirror, as_of, deletes=ids)


def explode_items(subscriptions: DataFrame, listing: DataFrame | None = None) -> DataFrame:
    """One row per item of each subscription (id, data): subscription, item_id, item, status.

    Where the embedded list has more, the complete listing (subscription, data) counts instead. status is ok,
    no_id, incomplete (more than is embedded and no listing) or unreadable (the subscription is no JSON object, or its
    items or one of them are of another shape): a subscription of the latter two gets a single row without item, for
    quarantine, and is never cut short or taken to have no items. One without items gives no row.
    """
    take_last_keys(subscriptions.sparkSession)
    # Parsed once: each item stays the text it is. A cut list is one row without item, until the listing gives its items.
    rows = subscriptions.select(F.col("id").alias("subscription"), "data", F.from_json("data", "items struct<data: array<string>, has_more: boolean>")["items"].alias("_i"))
    # A text that gives no list of items in this shape is looked at more closely: only an object without items may have none.
    v = parsed(F.col("data"))
    own, items = F.try_variant_get(v, "$", "struct<items:variant>"), F.try_variant_get(v, "$.items", "struct<data:variant>")
    absent = lambda c: c.isNull() | F.is_variant_null(c)
    none_there = own.isNotNull() & (absent(own["items"]) | (items.isNotNull() & absent(items["data"])))
    rows = rows.withColumn("_broken", F.when(F.col("_i.data").isNull(), F.coalesce(~none_there, F.lit(True))).otherwise(False))
    more = F.coalesce(F.col("_i.has_more"), F.lit(False)) & ~F.col("_broken")
    none = F.array(F.lit(None).cast("string"))
    out = rows.select("subscription", "_broken", more.alias("_cut"), F.explode(F.when(more | F.col("_broken"), none).otherwise(F.col("_i.data"))).alias("item"))
    if listing is not None:
        own = listing.select("subscription", F.col("data").alias("_listed"), F.lit(True).alias("_cut"))
        out = out.join(own, ["subscription", "_cut"], "left").withColumn("item", F.coalesce("_listed", "item"))
    item_id = F.nullif(F.get_json_object("item", "$.id"), F.lit(""))
    status = F.when(F.col("_broken"), "unreadable").when(F.col("_cut") & F.col("item").isNull(), "incomplete").when(F.col("item_id").isNull(), "no_id").otherwise("ok")
    return out.withColumn("item_id", item_id).select("subscription", "item_id", "item", status.alias("status"))


def prune_items(mirror: DataFrame, kept: DataFrame, refreshed: DataFrame, as_of: Column) -> DataFrame:
    """The mirror after deleting live items of the refreshed subscriptions (id) that are not kept (subscription, item_id)."""
    keep = kept.select(F.col("subscription").alias("_parent"), F.col("item_id").alias("id"))
    victims = live_items(mirror).join(refreshed.select(F.col("id").alias("_parent")), "_parent", "left_semi").join(keep, ["_parent", "id"], "left_anti")
    out = mirror.join(victims.select(*KEY).distinct().withColumn("_hit", F.lit(True)), KEY, "left")
    hit = ~F.col("is_deleted") & F.col("_hit").isNotNull()
    return out.select(
        *KEY, "data", "account_id", F.when(hit, True).otherwise(F.col("is_deleted")).alias("is_deleted"),
        F.when(hit, as_of).otherwise(F.col("deleted_at")).alias("deleted_at"), F.when(hit, as_of).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def subscription_writes(subscriptions: DataFrame, listing: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows to upsert, refreshed ids) for subscriptions (id, data) with all their items. Those that are unreadable or whose
    items are incomplete or lack an id are left out, and so stay as they were with all their items."""
    items = explode_items(subscriptions, listing)
    return _writes(subscriptions, items, _unfit(items))


def _unfit(items: DataFrame) -> DataFrame:
    return items.where(F.col("status") != "ok").select(F.col("subscription").alias("id")).distinct()


def _writes(subscriptions: DataFrame, items: DataFrame, bad: DataFrame) -> tuple[DataFrame, DataFrame]:
    good = subscriptions.select("id", "data").join(bad, "id", "left_anti")
    own = items.join(bad.withColumnRenamed("id", "subscription"), "subscription", "left_anti")
    rows = good.select(F.lit("subscription").alias("object_type"), "id", "data").unionByName(
        own.select(F.lit("subscription_item").alias("object_type"), F.col("item_id").alias("id"), F.col("item").alias("data"))
    )
    return rows, good.select("id")


def write_objects(mirror: DataFrame, rows: DataFrame, as_of: Column, deletes: DataFrame | None = None, listing: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """The mirror after upserting rows of any types, subscriptions with their items, and deleting others.

    With `parts` it is stored, and so are the items meanwhile, in a job for each part of the keys; then rows and deletes are to be
    stored tables, as every part reads them.
    """
    subscriptions = rows.where(F.col("object_type") == "subscription")
    others = rows.where(F.col("object_type") != "subscription").select(*KEY, "data")
    if parts is None:
        items, refreshed = subscription_writes(subscriptions, listing)
        return merge_objects(mirror, as_of, upserts=others.unionByName(items), deletes=deletes, refreshed=refreshed)
    exploded = stored_in_parts(rows.sparkSession, lambda cut: explode_items(cut(subscriptions, "id"), None if listing is None else cut(listing, "subscription")), "items", parts)
    unfit = stored(_unfit(exploded), "unfit")
    items, refreshed = _writes(subscriptions, exploded, unfit)
    out = merge_objects(mirror, as_of, upserts=others.unionByName(items), deletes=deletes, refreshed=refreshed, parts=parts)
    discard(exploded, unfit)
    return out


def refresh_subscriptions(mirror: DataFrame, subscriptions: DataFrame, as_of: Column, listing: DataFrame | None = None) -> DataFrame:
    """The mirror after writing subscriptions (id, data) with all their items."""
    rows, refreshed = subscription_writes(subscriptions, listing)
    return merge_objects(mirror, as_of, upserts=rows, refreshed=refreshed)


def empty_mirror(spark) -> DataFrame:
    return spark.createDataFrame([], MIRROR)
