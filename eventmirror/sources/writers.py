"""Sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.json_equal import digest
from ..schemas import DRIFTS, LOG, MIRROR, PUBLISHED, VERIFICATIONS
from .tables import RANGE_ROWS, changes_between, exists, rows_of, upsert_rows, write_table

DAY = 86_400


MIRROR_KEYS = ["object_type", "id"]


def _published(mirror: DataFrame) -> DataFrame:
    """The mirror's rows with the digests that verification compares in place of their texts."""
    return mirror.withColumn("digest", digest(F.col("data"), F.col("object_type"))).select(*PUBLISHED.names)


def write_mirror(mirror: DataFrame, path: str, range_rows: int = RANGE_ROWS, expected_rows: int | None = None, parts: int = 1) -> int:
    """Publish the whole mirror, in `parts` jobs if it is stored and large; returns its version."""
    return write_table(_published(mirror), path, MIRROR_KEYS, range_rows, expected_rows, parts=parts)


def update_mirror(path: str, changes: DataFrame, change: Callable[[DataFrame], DataFrame], range_rows: int = RANGE_ROWS) -> int:
    """Publish the rows that the keys of `changes` (object_type, id) have after the change: `change` gets the mirror's rows of
    these keys and returns their new rows. Reads the ranges that the keys fall into, writes the returned rows; returns the version."""
    own = rows_of(changes.sparkSession, path, MIRROR, changes.select(*MIRROR_KEYS))
    return upsert_rows(_published(change(own)), path, MIRROR_KEYS, range_rows)


def mirror_changes(spark: SparkSession, path: str, after: int, upto: int | None = None) -> DataFrame:
    """(object_type, object_id) of what was written after a version; ids only, read from the runs of later versions."""
    return changes_between(spark, path, MIRROR, after, upto).select("object_type", F.col("id").alias("object_id"))


def created_day(created: Column) -> Column:
    """Days from the epoch to created, whatever the session's time zone."""
    return F.floor(F.unix_seconds(created) / DAY).cast("int")


def write_log(rows: DataFrame, path: str) -> None:
    """Append inserted events, in folders by day of created, which ingest, sweeps and retention prune by."""
    rows.withColumn("created_day", created_day(F.col("created"))).write.mode("append").partitionBy("created_day").parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The log with created_day; an empty one if nothing was ever appended."""
    return spark.read.schema(LOG).parquet(path) if exists(spark, path) else spark.createDataFrame([], LOG)


def append_verification(report: DataFrame, drifts: DataFrame, path: str, verification_id: int, mode: str, started_at, finished_at) -> None:
    """One history row with the totals of a run and one row per drifted object: two flat tables.

    Both lie in a folder of the run's id that a repeated call overwrites; the history row comes last, so what it names is there.
    """
    total = report.where(F.col("object_type") == "total")
    history = total.select(
        F.lit(started_at).cast("timestamp").alias("started_at"), F.lit(finished_at).cast("timestamp").alias("finished_at"),
        F.lit(mode).alias("mode"), F.lit(None).cast("string").alias("object_type"), "checked", "drifted", "repaired",
    )
    rows = drifts.select("object_type", "object_id", "kind", F.lit(False).alias("repaired") if "repaired" not in drifts.columns else F.col("repaired"))
    rows.write.mode("overwrite").parquet(f"{path}/drifts/verification_id={verification_id}")
    history.write.mode("overwrite").parquet(f"{path}/verifications/id={verification_id}")


def read_verifications(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(history, drifts) of all runs; a run has its number as a folder."""
    return tuple(spark.read.schema(schema).parquet(f"{path}/{name}").select(*schema.names) for name, schema in (("verifications", VERIFICATIONS), ("drifts", DRIFTS)))


def change_feed(changes: DataFrame, path: str, batch: int) -> None:
    """(object_type, object_id) of what a batch changed; ids only. A repeated batch overwrites its own folder."""
    changes.write.mode("overwrite").json(f"{path}/batch={batch}")
