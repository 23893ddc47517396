"""The tables. Times are timestamps, money is in minor units, JSON is text."""

from pyspark.sql.types import BinaryType, BooleanType, IntegerType, LongType, StringType, StructField, StructType, TimestampType

_KINDS = {"s": StringType(), "t": TimestampType(), "l": LongType(), "i": IntegerType(), "b": BooleanType(), "x": BinaryType()}


def _table(*columns: str) -> StructType:
    return StructType([StructField(name, _KINDS[kind]) for kind, name in (c.split(":") for c in columns)])


RAW_DELIVERIES = _table("s:header", "x:body", "t:received_at")
EVENTS = _table("s:event_id", "s:type", "s:api_version", "s:account_id", "t:created", "t:received_at", "s:source", "s:payload", "t:processed_at", "b:livemode")
#: The log in its files: partitioned by days from the epoch to created.
LOG = StructType([*EVENTS.fields, StructField("created_day", IntegerType())])
SNAPSHOT = _table("s:object_type", "s:id", "s:data")
MIRROR = _table("s:object_type", "s:id", "s:data", "s:account_id", "b:is_deleted", "t:deleted_at", "t:updated_at")
#: A published mirror: each row has the digest of its data.
PUBLISHED = StructType([*MIRROR.fields, StructField("digest", LongType())])
STATE = _table("s:object_type", "s:object_id", "t:last_synced_at", "t:last_event_created", "s:last_event_id", "s:sync_source", "i:fetch_failures", "t:data_event_created", "s:data_event_id")
GAPS = _table("s:event_id", "t:detected_at", "l:sweep_id", "t:event_created", "l:lag_seconds")
SWEEPS = _table("l:id", "t:started_at", "t:finished_at", "t:window_from", "t:window_to", "l:events_seen", "l:gaps_found", "s:status")
BACKFILL_RUNS = _table("l:id", "t:started_at", "t:finished_at", "s:requested_by", "t:since", "s:status")
BACKFILL_TASKS = _table("l:id", "l:run_id", "s:object_type", "s:status", "s:cursor", "l:pages_done", "l:objects_done", "s:last_error", "t:updated_at")
VERIFICATIONS = _table("l:id", "t:started_at", "t:finished_at", "s:mode", "s:object_type", "l:checked", "l:drifted", "l:repaired")
DRIFTS = _table("l:verification_id", "s:object_type", "s:object_id", "s:kind", "b:repaired")
QUARANTINE = _table("s:source", "s:retry_key", "s:reason", "s:text", "t:failed_at", "t:resolved_at")
