"""Continuous ingest, apply, monitoring and gap detection.

Each micro-batch is handled by the tested batch operators inside foreachBatch. A batch that runs again after a crash finds
its own work done: ids already in the log are duplicates, and an applied batch is published with its number.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from ..operators import fold, ingest
from ..schemas import MIRROR, STATE
from ..sources.tables import RANGE_ROWS, current_manifest, read_current, rows_of, upsert_rows
from ..sources.writers import change_feed, read_log, write_log


def stream_ingest(deliveries: DataFrame, log_path: str, secrets: Sequence[str], tolerance_seconds: int = 300, on_batch: Callable[[DataFrame, int], None] | None = None) -> DataStreamWriter:
    """Authenticate, parse and append events to the log: every event once, over the whole log.

    A batch is judged once and kept; its ids are looked up in the log's folders of the days that its events were created on.
    `on_batch` gets each batch's outcome rows before they are appended.
    """

    def batch(rows: DataFrame, number: int) -> None:
        judged = ingest.judge(rows, secrets, tolerance_seconds).persist()
        outcome = ingest.settle(judged, read_log(rows.sparkSession, log_path), ingest.created_days(judged)).persist()
        try:
            # Appending to the log drops what is cached of rows that were joined with it, so it comes last.
            if on_batch:
                on_batch(outcome, number)
            write_log(ingest.log_rows(outcome), log_path)
        finally:
            outcome.unpersist()
            judged.unpersist()

    return deliveries.writeStream.foreachBatch(batch)


def stream_dedupe_bounded(events: DataFrame, delay: str = "3 days") -> DataFrame:
    """Alternative to the log join: state bounded by the watermark, exact for copies that arrive within the delay."""
    return events.withWatermark("received_at", delay).dropDuplicatesWithinWatermark(["event_id"])


APPLIED = T.StructType([
    *[T.StructField(c, T.StringType()) for c in fold.OBJECT], *[f for f in MIRROR.fields if f.name not in ("object_type", "id")],
    *[f for f in STATE.fields if f.name not in fold.OBJECT], T.StructField("in_mirror", T.BooleanType()), T.StructField("in_state", T.BooleanType()),
])


def stream_apply(
    events: DataFrame, table_path: str, as_of: Callable[[], Column] = F.current_timestamp, feed_path: str | None = None, stream: str = "apply", range_rows: int = RANGE_ROWS
) -> DataStreamWriter:
    """Fold log events into mirror and state; no watermark, since a late event only loses to newer ones.

    Mirror and state are one table, so they never disagree. A batch reads the rows of its objects from the ranges that
    they fall into, writes their new rows, and publishes these at once with its number. With `feed_path` the ids of changed objects are written there
    first, in a folder of the batch, so a batch that runs again neither loses nor doubles them. `stream` names the
    checkpoint: give a stream that starts anew from an empty checkpoint another name.
    """

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        done = (current_manifest(spark, table_path) or {}).get("batches", {})
        if done.get(stream, -1) >= number:
            return  # published before a crash
        work = fold.mapped(rows).persist()
        table = rows_of(spark, table_path, APPLIED, work.select(*fold.OBJECT))
        applied = fold.apply_events(work, fold.mirror_of(table), fold.state_of(table), as_of()).persist()
        try:
            if feed_path:
                change_feed(fold.changes_of(applied), feed_path, number)
            upsert_rows(applied.select(*APPLIED.names), table_path, fold.OBJECT, range_rows, {"batches": done | {stream: number}})
        finally:
            applied.unpersist()
            work.unpersist()

    return events.writeStream.foreachBatch(batch)


def read_applied(spark, table_path: str) -> tuple[DataFrame, DataFrame]:
    """(mirror, state) as stream_apply() last published them."""
    table = read_current(spark, table_path, APPLIED)
    return fold.mirror_of(table), fold.state_of(table)


def stream_silent_webhooks(events: DataFrame, gaps: DataFrame, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Windows in which gaps were found and no webhook came: window_start, webhooks, gaps, silent."""
    both = events.where(F.col("source") == "webhook").select(F.col("received_at").alias("at"), F.lit(1).alias("w"), F.lit(0).alias("g")).unionByName(
        gaps.select(F.col("detected_at").alias("at"), F.lit(0).alias("w"), F.lit(1).alias("g"))
    )
    if both.isStreaming:
        both = both.withWatermark("at", delay)
    out = both.groupBy(F.window("at", window).alias("win")).agg(F.sum("w").alias("webhooks"), F.sum("g").alias("gaps"))
    return out.select(F.col("win.start").alias("window_start"), "webhooks", "gaps", ((F.col("webhooks") == 0) & (F.col("gaps") > 0)).alias("silent"))


def stream_gap_detect(listed: DataFrame, arrived: DataFrame, grace: str = "60 seconds", delay: str = "10 minutes") -> DataFrame:
    """Listed events without a webhook copy within the grace, as a stream-stream left join with bounded state.

    sweep.find_gaps() on a schedule is the exact form: it looks through the whole log.
    """
    left = listed.select("event_id", "created").withWatermark("created", delay)
    right = arrived.where(F.col("source") == "webhook").select(F.col("event_id").alias("_id"), "received_at").withWatermark("received_at", delay)
    near = (F.col("event_id") == F.col("_id")) & (F.col("received_at") >= F.col("created") - F.expr("INTERVAL 1 HOUR")) & (F.col("received_at") <= F.col("created") + F.expr(f"INTERVAL {grace}"))
    return left.join(right, near, "left_outer").where(F.col("_id").isNull()).select("event_id", "created")


__all__ = ["read_applied", "stream_apply", "stream_dedupe_bounded", "stream_gap_detect", "stream_ingest", "stream_silent_webhooks"]
