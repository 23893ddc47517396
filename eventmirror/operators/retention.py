"""Dropping events that are old and done."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.writers import DAY
from .ingest import known_ids

RETENTION_DAYS = 90


def _old(cutoff: Column) -> Column:
    return F.coalesce((F.col("received_at") < cutoff) & F.col("processed_at").isNotNull(), F.lit(False))


def purge_events(log: DataFrame, gaps: DataFrame, cutoff: dt.datetime | None, skew_seconds: int = DAY) -> tuple[DataFrame, DataFrame]:
    """(log, gaps) without events received before the cutoff and processed; open ones stay. Gaps of dropped
    events go too. Without a cutoff everything stays.

    An event is created before it is received, but for clocks that differ by `skew_seconds` at most; so the dropped events
    are looked for in the days up to the cutoff alone, in a log in folders by created_day. One created later stays.
    """
    if cutoff is None:
        return log, gaps
    moment = cutoff.replace(tzinfo=cutoff.tzinfo or dt.UTC)
    at, old = int(moment.timestamp() // 1), _old(F.lit(moment).cast("timestamp"))
    late = F.lit(False)
    victims = log
    if "created_day" in log.columns:
        late = F.coalesce(F.col("created_day") > (at + skew_seconds) // DAY, F.lit(False))
        victims = log.where(F.col("created_day").isNull() | (F.col("created_day") <= (at + skew_seconds) // DAY))
    lost = known_ids(gaps, victims.where(old))
    return log.where(late | ~old), gaps.join(lost, "event_id", "left_anti")
