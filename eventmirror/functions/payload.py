"""What is inside an event's or object's JSON, and which of two events is newer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def data_object(payload: Column) -> Column:
    """The object an event carries, as JSON text."""
    return F.get_json_object(payload, "$.data.object")


def data_object_id(payload: Column) -> Column:
    """Its id; an empty one counts as none."""
    return F.nullif(F.get_json_object(payload, "$.data.object.id"), F.lit(""))


def marks_deleted(payload: Column) -> Column:
    """Whether the event's object says that it is deleted. The event's type does not."""
    return F.coalesce(F.get_json_object(payload, "$.data.object.deleted") == "true", F.lit(False))


def is_stub(data: Column) -> Column:
    """Whether an object of a snapshot is a deletion stub, which equals no object. A text without the word, written as such or escaped, is not parsed."""
    named = F.contains(data, F.lit("deleted")) | F.contains(data, F.lit("\\"))
    return F.coalesce(named & (F.get_json_object(data, "$.deleted") == "true"), F.lit(False))


def event_newer(created: Column, event_id: Column, last_created: Column, last_id: Column) -> Column:
    """Whether an event comes after the last one applied, in the strict order (created, id).

    An event without created is never newer; any other is newer than no event at all.
    """
    later = last_created.isNull() | (created > last_created)
    tie = (created == last_created) & event_id.isNotNull() & (last_id.isNull() | (event_id > last_id))
    return created.isNotNull() & F.coalesce(later | tie, F.lit(False))


def after(created: Column, event_id: Column, last_created: Column, last_id: Column) -> Column:
    """The same order for stored pairs: null created is earliest, null id is empty; equal is not after."""
    late = F.coalesce(created > last_created, created.isNotNull() & last_created.isNull())
    same = created.eqNullSafe(last_created)
    return late | (same & (F.coalesce(event_id, F.lit("")) > F.coalesce(last_id, F.lit(""))))


def epoch(ts: Column) -> Column:
    return F.unix_seconds(ts)
