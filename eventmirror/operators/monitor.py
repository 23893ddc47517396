"""Status and alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.event_types import resolve_type
from .fold import OBJECT, pending_work
from .sweep import retention_risk

SWEEP_INTERVAL = 300
EPOCH = F.timestamp_seconds


def events_summary(log: DataFrame) -> DataFrame:
    """total, unprocessed, last_received (the epoch if there are no events)."""
    return log.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("processed_at").isNull()).alias("unprocessed"),
        F.coalesce(F.max("received_at"), F.timestamp_seconds(F.lit(0))).alias("last_received"),
    )


def unhandled_types(log: DataFrame) -> DataFrame:
    """Types of open events that resolve to no object, most frequent first."""
    counts = log.where(F.col("processed_at").isNull()).groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(resolve_type(F.col("type")).isNull()).orderBy(F.desc("n"), "type")


def work_status(work: DataFrame, state: DataFrame, dead: DataFrame) -> DataFrame:
    """work with status: dead if quarantined (object_type, object_id), pending if newer than what was applied, else done."""
    late = pending_work(work, state).select(*OBJECT, F.lit(True).alias("_late"))
    bad = dead.select(*OBJECT).distinct().withColumn("_dead", F.lit(True))
    status = F.when(F.col("_dead"), "dead").when(F.col("_late"), "pending").otherwise("done")
    return work.join(late, OBJECT, "left").join(bad, OBJECT, "left").withColumn("status", status).drop("_late", "_dead")


def work_by_status(status: DataFrame) -> DataFrame:
    return status.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def oldest_live(status: DataFrame) -> DataFrame:
    """The created time of the oldest pending work, the epoch if none is pending."""
    return status.agg(F.coalesce(F.min(F.when(F.col("status") == "pending", F.col("latest_event_created"))), F.timestamp_seconds(F.lit(0))).alias("oldest"))


def source_counts(log: DataFrame) -> DataFrame:
    """webhook, sweep, and warn: the sweep finds events, yet no webhook ever came."""
    counts = log.agg(F.count_if(F.col("source") == "webhook").alias("webhook"), F.count_if(F.col("source") == "sweep").alias("sweep"))
    return counts.withColumn("warn", (F.col("webhook") == 0) & (F.col("sweep") > 0))


def gaps_last_day(gaps: DataFrame, as_of: Column) -> DataFrame:
    return gaps.where(F.unix_micros("detected_at") > F.unix_micros(as_of) - 86_400_000_000).agg(F.count(F.lit(1)).alias("n"))


def latest_backfill(runs: DataFrame, tasks: DataFrame) -> DataFrame:
    """The newest run with tasks_done, tasks_total and objects_done."""
    sums = tasks.groupBy(F.col("run_id").alias("id")).agg(F.count_if(F.col("status") == "done").alias("tasks_done"), F.count(F.lit(1)).alias("tasks_total"), F.sum("objects_done").alias("objects_done"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    last = runs.orderBy(F.desc("id")).limit(1)
    return last.join(sums, "id", "left").select("id", "status", "started_at", "finished_at", zero("tasks_done"), zero("tasks_total"), zero("objects_done"))


def latest_sweep(sweeps: DataFrame) -> DataFrame:
    return sweeps.where(F.col("status") == "done").orderBy(F.desc("id")).limit(1).select("window_from", "window_to", "finished_at", "events_seen", "gaps_found")


def latest_verification(verifications: DataFrame) -> DataFrame:
    return verifications.orderBy(F.desc("id")).limit(1).select("mode", "started_at", "finished_at", "checked", "drifted", "repaired")


def drift_by_type(drifts: DataFrame, types: DataFrame, verification_id: Column) -> DataFrame:
    """Drifted objects of one run for every type of `types` (object_type), 0 where clean."""
    counts = drifts.where(F.col("verification_id") == verification_id).groupBy("object_type").agg(F.count(F.lit(1)).alias("n"))
    return types.join(counts, "object_type", "left").select("object_type", F.coalesce("n", F.lit(0)).cast("long").alias("drifted"))


def delivery_lag_histogram(log: DataFrame) -> DataFrame:
    """le (1, 2, 4 ... 2**17 seconds, then null for all) and n, the webhook events that arrived within le; cumulative."""
    lag = F.unix_micros("received_at") - F.unix_micros("created")
    rows = log.where(F.col("source") == "webhook").select(lag.alias("lag"))
    exponent = F.when(F.col("lag") <= 1_000_000, 0).when(F.col("lag") <= 131_072_000_000, F.ceil(F.round(F.log2(F.col("lag") / 1_000_000), 9)).cast("int")).otherwise(18)
    counts = rows.where(F.col("lag").isNotNull()).groupBy(exponent.alias("e")).agg(F.count(F.lit(1)).alias("n"))
    steps = log.sparkSession.range(19).select(F.col("id").cast("int").alias("e"))
    running = Window.orderBy("e").rowsBetween(Window.unboundedPreceding, 0)  # 19 rows
    return steps.join(counts, "e", "left").select(
        F.when(F.col("e") < 18, F.pow(F.lit(2), F.col("e")).cast("long")).alias("le"), F.sum(F.coalesce("n", F.lit(0))).over(running).alias("n")
    )


def alerts(log: DataFrame, gaps: DataFrame, sweeps: DataFrame, dead: DataFrame, drifts: DataFrame, as_of: Column) -> DataFrame:
    """alert, firing: retention_cliff, sweep_stalled (no successful sweep for over three intervals), dead_rows_rising (a
    dead row in the last 15 minutes), webhooks_silent (gaps in the last hour but no new webhook), drift_found.

    `dead` has failed_at. Each condition is reduced to one row before the five are put together.
    """
    now = F.unix_micros(as_of)
    within = lambda c, s: F.unix_micros(c) > now - s * 1_000_000
    done = sweeps.where(F.col("status") == "done")
    parts = [
        done.agg(F.coalesce(retention_risk(F.max("window_to"), as_of), F.lit(False)).alias("firing")).withColumn("alert", F.lit("retention_cliff")),
        done.agg((F.coalesce(F.unix_micros(F.max("finished_at")), F.lit(0)) < now - 3 * SWEEP_INTERVAL * 1_000_000).alias("firing")).withColumn("alert", F.lit("sweep_stalled")),
        dead.agg((F.count_if(within("failed_at", 900)) > 0).alias("firing")).withColumn("alert", F.lit("dead_rows_rising")),
        log.agg((F.count_if((F.col("source") == "webhook") & within("received_at", 3600)) == 0).alias("_silent"))
        .join(gaps.agg((F.count_if(within("detected_at", 3600)) > 0).alias("_gaps")), F.lit(True))
        .select((F.col("_silent") & F.col("_gaps")).alias("firing"), F.lit("webhooks_silent").alias("alert")),
        drifts.agg((F.count(F.lit(1)) > 0).alias("firing")).withColumn("alert", F.lit("drift_found")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("alert", "firing")
