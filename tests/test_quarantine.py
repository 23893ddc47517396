"""Failures of all kinds: recorded, corrected, replayed."""

import datetime as dt
import hashlib

from pyspark.sql import functions as F

from eventmirror.operators import mirror, quarantine
from eventmirror.schemas import MIRROR, QUARANTINE
from eventmirror.sources.tables import read_current

T0 = dt.datetime(2026, 1, 10)


def at():
    return F.lit(T0).cast("timestamp")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def failures(spark):
    bodies = ['{"id":"e","type":"t"}', "{bad", "{bad", '{"id":5,"type":"t"}', "x" * ((1 << 20) + 1)]
    deliveries = spark.createDataFrame([(None, bytearray(b.encode()), T0) for b in bodies], "header string, body binary, received_at timestamp")
    events = spark.createDataFrame([("e1", "customer.updated", "{}"), ("e2", "unknown.type", "{}"), ("e3", "customer.updated", '{"data":{"object":{"id":"c"}}}')], "event_id string, type string, payload string")
    objects = spark.createDataFrame([("charge", i, d, None, False, None, T0) for i, d in (("a", '{"amount":"much","created":"x"}'), ("b", '{"amount":1}'))], MIRROR)
    subs = spark.createDataFrame([("s1", '{"items":{"data":[{"id":"i1"}],"has_more":true}}'), ("s2", "nope"), ("s3", '{"items":{"data":[{"x":1}]}}'), ("s4", "{}")], "id string, data string")
    q = quarantine
    return [q.failed_envelopes(deliveries, at()), q.failed_events(events, at()), q.failed_objects(objects, "charge", at()), q.failed_subscriptions(subs, at())]


def test_failures_are_listed_corrected_and_leave_by_replay(spark, tmp_path):
    path = str(tmp_path / "quarantine")
    large = sha("x" * ((1 << 20) + 1))
    for failed in failures(spark):
        quarantine.record(path, failed)
    want = {
        ("envelope", sha("{bad")): "bad_envelope", ("envelope", sha('{"id":5,"type":"t"}')): "bad_envelope", ("envelope", large): "too_large", ("event", "e1"): "malformed",
        ("typed", "charge/a"): "amount,created", ("subscription", "s1"): "incomplete", ("subscription", "s2"): "unreadable", ("subscription", "s3"): "no_id",
    }
    assert {(r.source, r.retry_key): r.reason for r in quarantine.open_rows(spark, path).collect()} == want
    assert [r.retry_key for r in quarantine.dead_rows(quarantine.open_rows(spark, path, "subscription"), 2).collect()] == ["s1", "s2"]
    # The same failures again add nothing.
    quarantine.record(path, failures(spark)[3])
    assert quarantine.open_rows(spark, path).count() == len(want)
    texts = [("envelope", sha("{bad"), '{"id":"e9","type":"t","created":7}'), ("event", "e1", '{"data":{"object":{"id":"c1"}}}'), ("typed", "charge/a", '{"amount":5}')]
    rows = quarantine.corrected(quarantine.open_rows(spark, path), spark.createDataFrame(texts, "source string, retry_key string, text string"))
    listing = spark.createDataFrame([("s1", '{"id":"i1"}'), ("s1", '{"id":"i2"}')], "subscription string, data string")
    events = quarantine.replay_envelopes(rows, at())
    assert [(r.event_id, r.retry_key) for r in events.collect()] == [("e9", sha("{bad"))]
    named = quarantine.replay_events(rows.withColumn("type", F.lit("customer.updated")))
    assert [(r.object_type, r.object_id) for r in named.collect()] == [("customer", "c1")]
    objects = quarantine.replay_objects(rows, "charge")
    assert [(r.object_type, r.id, r.data) for r in objects.collect()] == [("charge", "a", '{"amount":5}')]
    subs = quarantine.replay_subscriptions(rows, listing)
    written = mirror.refresh_subscriptions(mirror.empty_mirror(spark), subs.select("id", "data"), at(), listing)
    assert {r.id for r in written.collect()} == {"s1", "i1", "i2"}
    for source, done in (("envelope", events), ("event", named), ("typed", objects), ("subscription", subs)):
        quarantine.resolve(path, done.select(F.lit(source).alias("source"), "retry_key"), at())
    left = {(r.source, r.retry_key) for r in quarantine.open_rows(spark, path).collect()}
    assert left == {("envelope", sha('{"id":5,"type":"t"}')), ("envelope", large), ("subscription", "s2"), ("subscription", "s3")}
    assert read_current(spark, path, QUARANTINE).count() == len(want)
    # A failure that comes back is open again.
    quarantine.record(path, failures(spark)[1])
    assert ("event", "e1") in {(r.source, r.retry_key) for r in quarantine.open_rows(spark, path).collect()}


def test_an_empty_quarantine(spark, tmp_path):
    path = str(tmp_path / "quarantine")
    assert quarantine.open_rows(spark, path).count() == 0
    quarantine.resolve(path, spark.createDataFrame([("event", "e")], "source string, retry_key string"), at())
    assert quarantine.open_rows(spark, path).count() == 0
