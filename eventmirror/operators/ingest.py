"""From raw deliveries to an event log in which every event is recorded once."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.event_types import resolve_type
from ..functions.json_equal import once, parsed, take_last_keys
from ..functions.payload import data_object_id
from ..functions.signatures import signature_status
from ..schemas import EVENTS
from ..sources.writers import created_day

MAX_BODY = 1 << 20
#: The fields read here, and the only kind of value that each may have, if it has one.
ENVELOPE = {"id": "STRING", "type": "STRING", "api_version": "STRING", "created": "BIGINT", "livemode": "BOOLEAN"}


def verify_signatures(deliveries: DataFrame, secrets: Sequence[str], tolerance_seconds: int = 300) -> DataFrame:
    """deliveries with sig_status."""
    return deliveries.withColumn("sig_status", signature_status(F.col("header"), F.col("body"), F.col("received_at"), secrets, tolerance_seconds))


def _envelope(text: Column) -> Column:
    """The fields of ENVELOPE as a struct; null if the text is no envelope. One expression, so that the text is parsed once wherever it goes."""
    variants = lambda *names: "struct<" + ",".join(f"{n}:variant" for n in names) + ">"
    has = lambda c: c.isNotNull() & ~F.is_variant_null(c)
    wrong = lambda c, kind: has(c) & (F.schema_of_variant(c) != kind)

    def typed(e: Column, d: Column, o: Column) -> Column:
        shape = functools.reduce(lambda a, b: a | b, [wrong(e[n], kind) for n, kind in ENVELOPE.items()])
        shape = shape | (has(e["data"]) & d.isNull()) | (has(d["object"]) & o.isNull()) | wrong(o["id"], "STRING")
        return F.when(e.isNotNull() & ~shape, F.struct(*[F.try_variant_get(e[n], "$", kind).alias(n) for n, kind in ENVELOPE.items()]))

    inner = lambda e, d: once(F.try_variant_get(d["object"], "$", variants("id")), lambda o: typed(e, d, o))
    whole = F.try_variant_get(parsed(text), "$", variants(*ENVELOPE, "data"))
    return once(whole, lambda e: once(F.try_variant_get(e["data"], "$", variants("object")), lambda d: inner(e, d)))


def parse_envelope(deliveries: DataFrame, source: str = "webhook", account_id: str | None = None) -> DataFrame:
    """Event rows with `parse_status`: ok, too_large or bad_envelope.

    An envelope is one JSON object with an id and a type; its fields have the kinds of ENVELOPE or are null or absent, data and
    data.object are objects and the id in there a text, if they are there. Of a repeated key the last value counts. No row is
    dropped; one that is not ok has nulls for what the envelope would say. An empty api_version is null.
    """
    take_last_keys(deliveries.sparkSession)
    text = F.decode(F.col("body"), "utf-8") if dict(deliveries.dtypes)["body"] == "binary" else F.col("body")
    large = F.octet_length("body") > MAX_BODY
    rows = deliveries.withColumn("_text", F.when(~large, text)).withColumn("_e", _envelope(F.col("_text")))
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    status = F.when(F.coalesce(large, F.lit(False)), "too_large").when(empty(F.col("_e.id")) | empty(F.col("_e.type")), "bad_envelope").otherwise("ok")
    extra = [c for c in deliveries.columns if c not in EVENTS.names and c not in ("header", "body")]
    return rows.select(
        F.col("_e.id").alias("event_id"), F.col("_e.type").alias("type"), F.nullif(F.col("_e.api_version"), F.lit("")).alias("api_version"),
        F.lit(account_id).cast("string").alias("account_id"), F.timestamp_seconds(F.col("_e.created")).alias("created"), "received_at",
        F.lit(source).alias("source"), F.col("_text").alias("payload"), F.lit(None).cast("timestamp").alias("processed_at"),
        F.coalesce("_e.livemode", F.lit(False)).alias("livemode"), status.alias("parse_status"), *extra,
    )


def resolve_event(events: DataFrame) -> DataFrame:
    """events with object_type, object_id and resolve_status: mapped, unknown (type) or malformed (no object id)."""
    # As rows of their own: a filter on them is not put below and the payload not parsed again for each use.
    found = F.inline(F.array(F.struct(resolve_type(F.col("type")).alias("object_type"), data_object_id(F.col("payload")).alias("object_id"))))
    status = F.when(F.col("object_type").isNull(), "unknown").when(F.col("object_id").isNull(), "malformed").otherwise("mapped")
    return events.drop("object_type", "object_id").select("*", found).withColumn("resolve_status", status)


def known_ids(ids: DataFrame, log: DataFrame) -> DataFrame:
    """The event ids that the log holds too. Few ids are sent to the log's files, so that the log is not shuffled."""
    return log.select("event_id").join(ids.select("event_id"), "event_id", "left_semi").distinct()


def of_days(log: DataFrame, days: Sequence[int] | None) -> DataFrame:
    """The log's events of some days of created, and those of no known day. A log without created_day is not pruned."""
    if days is None or "created_day" not in log.columns:
        return log
    return log.where(F.col("created_day").isin(*days) | F.col("created_day").isNull())


def dedupe_events(new: DataFrame, log: DataFrame | None = None, days: Sequence[int] | None = None) -> DataFrame:
    """new with `outcome`: inserted for the first arrival of an event that the log lacks, else duplicate.

    First is the smallest (received_at, source, payload); rows equal in all three are interchangeable. Only the log's ids
    are read, and only those of `days` (all days of created in `new`, see created_days()) if given: an id's created never
    changes. Rows of a null event_id are none of the log's events: they stay as they are, with a null outcome.
    """
    # Rows without an id are spread by their payload, so that they are no hot key.
    key = F.coalesce("event_id", F.concat(F.lit("\0"), F.hash("payload").cast("string")))
    order = Window.partitionBy("_key").orderBy(F.col("received_at").asc_nulls_last(), "source", "payload")
    ranked = new.withColumn("_key", key).withColumn("_rank", F.row_number().over(order))
    known = F.lit(False)
    if log is not None:
        ids = known_ids(new, of_days(log, days)).withColumnRenamed("event_id", "_known")
        ranked = ranked.join(ids, F.col("_key") == F.col("_known"), "left")
        known = F.col("_known").isNotNull()
    outcome = F.when(F.col("event_id").isNull(), F.lit(None)).when((F.col("_rank") == 1) & ~known, "inserted").otherwise("duplicate")
    return ranked.withColumn("outcome", outcome).drop("_key", "_rank", "_known")


def created_days(events: DataFrame, most: int = 1000) -> list[int] | None:
    """The days of created that a batch spans, for pruning the log; None if there are over `most`. Runs a job."""
    days = events.where(F.col("event_id").isNotNull()).select(created_day(F.col("created")).alias("day")).where("day IS NOT NULL").distinct().limit(most + 1).collect()
    return None if len(days) > most else sorted(r.day for r in days)


def ingest_outcomes(rows: DataFrame, outcome: Column | str = "outcome") -> DataFrame:
    """Rows by outcome."""
    return rows.groupBy((F.col(outcome) if isinstance(outcome, str) else outcome).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def judge(deliveries: DataFrame, secrets: Sequence[str], tolerance_seconds: int = 300) -> DataFrame:
    """Every delivery as an event row with `refused`: bad_signature, error or null. A refused row has no event_id, as
    what it claims counts for nothing.

    The size is judged before the signature, the signature before the content.
    """
    rows = parse_envelope(verify_signatures(deliveries, secrets, tolerance_seconds))
    refused = F.when(F.col("parse_status") == "too_large", "error").when(F.col("sig_status") != "ok", "bad_signature").when(F.col("parse_status") != "ok", "error")
    return rows.withColumn("refused", refused).withColumn("event_id", F.when(F.col("refused").isNull(), F.col("event_id")))


def settle(judged: DataFrame, log: DataFrame | None, days: Sequence[int] | None = None) -> DataFrame:
    """judge()'s rows with their outcome: inserted, duplicate, bad_signature or error."""
    rows = dedupe_events(judged, log, days)
    return rows.withColumn("outcome", F.coalesce("refused", "outcome")).drop("refused")


def ingest(deliveries: DataFrame, log: DataFrame | None, secrets: Sequence[str], tolerance_seconds: int = 300) -> DataFrame:
    """Every delivery with its outcome: inserted, duplicate, bad_signature or error; inserted rows go into the log.

    Signatures and contents are judged once, in one pass, before the rows are dealt out by event_id. When there is a log,
    store judge()'s rows and call settle() on them, since the ids also go to the log.
    """
    return settle(judge(deliveries, secrets, tolerance_seconds), log)


def log_rows(rows: DataFrame) -> DataFrame:
    """The inserted rows with the columns of the log."""
    return rows.where(F.col("outcome") == "inserted").select(*EVENTS.names)
