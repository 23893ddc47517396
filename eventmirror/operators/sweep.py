"""Finding events that never arrived."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.event_types import subscribed_types
from ..sources.writers import DAY
from .fold import coalesce_work
from .ingest import known_ids, resolve_event

OVERLAP, LOOKBACK, GRACE = 600, 86_400, 60
RETENTION_ALARM = 25 * 86_400


def sweep_window(sweeps: DataFrame, as_of: dt.datetime, overlap: int = OVERLAP, lookback: int = LOOKBACK, grace: int = GRACE) -> DataFrame:
    """One row (window_from, window_to): from the newest successful window's end less the overlap (the first time:
    less the lookback from as_of) to as_of less the grace; never backwards."""
    now = F.lit(as_of).cast("timestamp")
    seconds = lambda n: F.make_dt_interval(secs=F.lit(n).cast("decimal(18,6)"))
    last = sweeps.where(F.col("status") == "done").agg(F.max(F.struct("window_to", "id")).alias("l"))
    upto = now - seconds(grace)
    start = F.coalesce(F.col("l.window_to") - seconds(overlap), now - seconds(lookback))
    return last.select(F.least(start, upto).alias("window_from"), upto.alias("window_to"))


def collect_window(window: DataFrame) -> tuple[dt.datetime, dt.datetime]:
    """The one row as values, so that scans can prune by them. Runs a job over the small table of sweeps."""
    row = window.first()
    return row["window_from"], row["window_to"]


def within(log: DataFrame, window: tuple[dt.datetime, dt.datetime] | None) -> DataFrame:
    """The log's events created within the window, both ends included. A log in folders by created_day is pruned to its days."""
    if window is None:
        return log
    start, end = (int(w.replace(tzinfo=w.tzinfo or dt.UTC).timestamp() // 1) for w in window)
    if "created_day" in log.columns:
        log = log.where(F.col("created_day").between(start // DAY, end // DAY))
    return log.where((F.col("created") >= F.timestamp_seconds(F.lit(start))) & (F.col("created") < F.timestamp_seconds(F.lit(end + 1))))


def find_gaps(listed: DataFrame, log: DataFrame, as_of: Column, sweep_id: int, window: tuple[dt.datetime, dt.datetime] | None = None) -> DataFrame:
    """The events of upstream's list that the log lacks, as rows for the log (source sweep) with gap columns
    detected_at, sweep_id, lag_seconds and their object.

    The listed side is short; the log is the large side. With the sweep's `window`, only listed events and log
    rows created within it count (an id's created never changes), and a log in folders by created_day is read for those days
    alone. The listed ids are sent to the log's files, so that the log is not shuffled while they are few.
    """
    types = subscribed_types()
    listed = within(listed, window)
    seen = listed.where(F.col("type").isin(types)).groupBy("event_id").agg(F.min(F.struct("created", "type", "api_version", "payload", "livemode")).alias("e"))
    rows = seen.select("event_id", "e.*").join(known_ids(seen, within(log, window)), "event_id", "left_anti")
    out = rows.select(
        "event_id", "type", "api_version", F.lit(None).cast("string").alias("account_id"), "created", as_of.alias("received_at"), F.lit("sweep").alias("source"),
        "payload", F.lit(None).cast("timestamp").alias("processed_at"), "livemode",
        as_of.alias("detected_at"), F.lit(sweep_id).cast("long").alias("sweep_id"), (F.unix_seconds(as_of) - F.unix_seconds("created")).alias("lag_seconds"),
    )
    return resolve_event(out)


def gap_rows(found: DataFrame) -> DataFrame:
    return found.select("event_id", "detected_at", "sweep_id", F.col("created").alias("event_created"), "lag_seconds")


def gap_work(found: DataFrame) -> DataFrame:
    """The objects to apply again."""
    return coalesce_work(found)


def failed_sweep(spark: SparkSession, sweep_id: int, window: tuple[dt.datetime, dt.datetime], as_of: Column) -> DataFrame:
    """The row of a pass that did not end: it has status failed, so the next window starts where this one did."""
    zero = F.lit(0).cast("long")
    return spark.range(1).select(
        F.lit(sweep_id).cast("long").alias("id"), as_of.alias("started_at"), as_of.alias("finished_at"), F.lit(window[0]).cast("timestamp").alias("window_from"),
        F.lit(window[1]).cast("timestamp").alias("window_to"), zero.alias("events_seen"), zero.alias("gaps_found"), F.lit("failed").alias("status"),
    )


def sweep_summary(listed: DataFrame, found: DataFrame, sweep_id: int, window: tuple[dt.datetime, dt.datetime], as_of: Column) -> DataFrame:
    """The finished sweep's row: events_seen counts all listed events. See failed_sweep() for a pass that fails."""
    seen = listed.where(F.col("type").isin(subscribed_types())).agg(F.count(F.lit(1)).alias("events_seen"))
    gaps = found.agg(F.count(F.lit(1)).alias("gaps_found"))
    # One row each: a join of two totals.
    return seen.join(gaps, F.lit(True)).select(
        F.lit(sweep_id).cast("long").alias("id"), as_of.alias("started_at"), as_of.alias("finished_at"),
        F.lit(window[0]).cast("timestamp").alias("window_from"), F.lit(window[1]).cast("timestamp").alias("window_to"), "events_seen", "gaps_found", F.lit("done").alias("status"),
    )


def delivery_outage(gaps: DataFrame, log: DataFrame, window: tuple[Column, Column]) -> DataFrame:
    """One row (gaps_found, arrived, outage): gaps although not one webhook came in the window."""
    arrived = log.where((F.col("source") == "webhook") & F.col("received_at").between(*window)).agg(F.count(F.lit(1)).alias("arrived"))
    total = gaps.agg(F.count(F.lit(1)).alias("gaps_found"))
    return total.join(arrived, F.lit(True)).withColumn("outage", (F.col("gaps_found") > 0) & (F.col("arrived") == 0))


def retention_risk(window_from: Column, as_of: Column, seconds: int = RETENTION_ALARM) -> Column:
    """Whether upstream may drop events before the sweep reaches them."""
    return F.unix_micros(as_of) - F.unix_micros(window_from) > seconds * 1_000_000
