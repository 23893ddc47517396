"""Importing the tables of a legacy mirror."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.json_equal import canonical_json
from .fold import OBJECT
from .mirror import KEY

#: Bookkeeping columns of legacy tables.
BOOKKEEPING = ("updated_at", "last_synced_at")


def reconstruct_objects(legacy: DataFrame, object_type: str, json_columns: tuple[str, ...] = ()) -> DataFrame:
    """object_type, id, data, deleted: each row as the object's JSON.

    Bookkeeping columns go, null fields go at every depth, times become whole epoch seconds (rounded; a null time stays as an
    explicit null), `object` is set, JSON columns are embedded as JSON.
    """
    fields, times = [], []
    for field in legacy.schema.fields:
        if field.name in BOOKKEEPING or field.name == "object":
            continue
        column = F.col(field.name)
        if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            micros = F.unix_micros(column.cast("timestamp")) if not isinstance(field.dataType, T.TimestampNTZType) else F.timestamp_diff("MICROSECOND", F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")), column)
            times.append(F.concat(F.lit(f'"{field.name}":'), F.coalesce(F.round(micros / 1_000_000).cast("bigint").cast("string"), F.lit("null"))))
        elif field.name in json_columns:
            fields.append(F.try_parse_json(column).alias(field.name))
        else:
            fields.append(column)
    fields.append(F.lit(object_type).alias("object"))
    # to_json leaves SQL nulls out; the helper drops the nulls inside embedded JSON, then the times are put in.
    body = canonical_json(F.to_json(F.struct(*fields)), F.lit(""), strict_ints=True, nulls=False)
    if times:
        body = F.concat(F.substring(body, F.lit(1), F.length(body) - 1), F.lit(","), F.concat_ws(",", *times), F.lit("}"))
    deleted = F.coalesce(F.col("deleted"), F.lit(False)) if "deleted" in legacy.columns else F.lit(False)
    return legacy.select(F.lit(object_type).alias("object_type"), F.col("id"), body.alias("data"), deleted.alias("deleted"))


def import_objects(objects: DataFrame, mirror: DataFrame, as_of: Column) -> DataFrame:
    """objects with `outcome` imported (absent from the mirror) or skipped; a repeated id is imported once."""
    first = objects.groupBy(*KEY).agg(F.max(F.struct("data", "deleted")).alias("o"), F.count(F.lit(1)).alias("copies"))
    known = mirror.select(*KEY, F.lit(True).alias("_known"))
    return first.join(known, KEY, "left").select(
        *KEY, "o.data", "o.deleted", "copies", F.when(F.col("_known"), "skipped").otherwise("imported").alias("outcome")
    )


def mirror_with(mirror: DataFrame, imported: DataFrame, as_of: Column) -> DataFrame:
    rows = imported.where(F.col("outcome") == "imported")
    return mirror.unionByName(
        rows.select(*KEY, "data", F.lit(None).cast("string").alias("account_id"), F.col("deleted").alias("is_deleted"), F.when(F.col("deleted"), as_of).alias("deleted_at"), as_of.alias("updated_at"))
    )


def import_counts(imported: DataFrame) -> DataFrame:
    """object_type, imported, skipped."""
    return imported.groupBy("object_type").agg(F.count_if(F.col("outcome") == "imported").alias("imported"), F.count_if(F.col("outcome") == "skipped").alias("skipped"))


def import_state(objects: DataFrame, state: DataFrame, as_of: Column) -> DataFrame:
    """The state with an `import` row for every source object that has none, skipped or not."""
    ids = objects.select("object_type", F.col("id").alias("object_id")).distinct().join(state, OBJECT, "left_anti")
    none = lambda kind: F.lit(None).cast(kind)
    return state.unionByName(
        ids.select(
            *OBJECT, as_of.alias("last_synced_at"), none("timestamp").alias("last_event_created"), none("string").alias("last_event_id"), F.lit("import").alias("sync_source"),
            F.lit(0).cast("int").alias("fetch_failures"), none("timestamp").alias("data_event_created"), none("string").alias("data_event_id"),
        )
    )
