import datetime as dt
import hashlib
import hmac
import json
import random
import re
import shutil

import pytest
from pyspark.sql import functions as F

from eventmirror.operators import fold, ingest
from eventmirror.schemas import EVENTS, GAPS, MIRROR, RAW_DELIVERIES, STATE
from eventmirror.sources import readers, tables, writers
from eventmirror.streaming import jobs

T0 = dt.datetime(2026, 1, 1, tzinfo=dt.UTC)


def delivery(n, second, secret="s", email=None):
    at = T0 + dt.timedelta(seconds=second)
    body = json.dumps({"id": f"evt_{n}", "type": "customer.updated", "created": int(T0.timestamp()) + n // 2, "livemode": False, "data": {"object": {"id": f"cus_{n % 3}", "email": email or f"v{n}"}}}).encode()
    t = int(at.timestamp())
    mac = hmac.new(secret.encode(), f"{t}.".encode() + body, hashlib.sha256).hexdigest()
    return (f"t={t},v1={mac}", bytearray(body), at)


def run(writer, checkpoint):
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def test_ingest_and_apply_survive_restarts(spark, tmp_path):
    raw, log_path, table = (str(tmp_path / x) for x in ("raw", "log", "table"))
    first = [delivery(n, n) for n in range(8)] + [delivery(3, 40), delivery(5, 41, secret="wrong")]
    spark.createDataFrame(first, RAW_DELIVERIES).write.parquet(raw)
    seen = []

    def ingest_once():
        deliveries = readers.read_raw_deliveries(spark, raw, streaming=True)
        run(jobs.stream_ingest(deliveries, log_path, ["s"], on_batch=lambda rows, i: seen.append({r.outcome: r.n for r in ingest.ingest_outcomes(rows).collect()})), str(tmp_path / "c1"))

    def apply_once():
        events = spark.readStream.schema(EVENTS).parquet(log_path)
        run(jobs.stream_apply(events, table, lambda: F.lit(T0).cast("timestamp"), str(tmp_path / "feed"), range_rows=2), str(tmp_path / "c2"))

    ingest_once()
    apply_once()
    assert seen == [{"inserted": 8, "duplicate": 1, "bad_signature": 1}]
    # New deliveries, among them old events again; the jobs start anew from their checkpoints.
    spark.createDataFrame([delivery(n, 100 + n) for n in (1, 9, 7, 8)], RAW_DELIVERIES).write.mode("append").parquet(raw)
    ingest_once()
    apply_once()
    assert seen[1] == {"inserted": 2, "duplicate": 2}
    log = spark.read.schema(EVENTS).parquet(log_path)
    assert log.count() == log.select("event_id").distinct().count() == 10
    mirror, state = jobs.read_applied(spark, table)
    whole = fold.apply_events(log, spark.createDataFrame([], MIRROR), spark.createDataFrame([], STATE), F.lit(T0).cast("timestamp"))
    key = lambda df: sorted((r.id, r.data, r.is_deleted) for r in df.collect())
    assert key(mirror) == key(fold.mirror_of(whole)) and len(key(mirror)) == 3
    assert state.count() == 3
    assert spark.read.json(str(tmp_path / "feed")).select("object_id").distinct().count() == 3


def test_bounded_dedupe_and_silent_webhooks(spark, tmp_path):
    path = str(tmp_path / "events")
    rows = [(f"e{i % 4}", "customer.updated", None, None, T0, T0 + dt.timedelta(minutes=i), "webhook", "{}", None, False) for i in range(8)]
    spark.createDataFrame(rows, EVENTS).write.parquet(path)
    stream = jobs.stream_dedupe_bounded(spark.readStream.schema(EVENTS).parquet(path))
    run(stream.writeStream.format("memory").queryName("unique_events"), str(tmp_path / "c"))
    assert spark.table("unique_events").count() == 4
    gaps = spark.createDataFrame([("x", T0 + dt.timedelta(hours=h), 1, T0, 0) for h in (0, 2)], GAPS)
    out = {r.window_start: (r.webhooks, r.gaps, r.silent) for r in jobs.stream_silent_webhooks(spark.createDataFrame(rows, EVENTS), gaps).collect()}
    start = T0.replace(tzinfo=None)
    assert out == {start: (8, 1, False), start + dt.timedelta(hours=2): (0, 1, True)}


def test_gap_stream_plan(spark, tmp_path):
    path = str(tmp_path / "events")
    late = T0 + dt.timedelta(hours=5)
    rows = [(n, "customer.updated", None, None, at, at, "webhook", "{}", None, False) for n, at in (("a", T0), ("b", T0), ("z", late))]
    spark.createDataFrame(rows, EVENTS).write.parquet(path)
    read = lambda: spark.readStream.schema(EVENTS).parquet(path)
    stream = jobs.stream_gap_detect(read(), read().where("event_id <> 'b'"))
    run(stream.writeStream.format("memory").queryName("gap_events").outputMode("append"), str(tmp_path / "c"))
    assert {r.event_id for r in spark.table("gap_events").collect()} == {"b"}


def test_silent_webhooks_as_a_stream(spark, tmp_path):
    """Windows come out once the watermark has passed them; a much later event moves it."""
    path, gaps_path = str(tmp_path / "events"), str(tmp_path / "gaps")
    row = lambda n, at: (n, "customer.updated", None, None, at, at, "webhook", "{}", None, False)
    at = lambda h: T0 + dt.timedelta(hours=h)
    spark.createDataFrame([row("a", at(0)), row("b", at(1)), row("z", at(9))], EVENTS).coalesce(1).write.parquet(path)
    spark.createDataFrame([("x", at(h), 1, T0, 0) for h in (0, 2, 9)], GAPS).coalesce(1).write.parquet(gaps_path)
    stream = jobs.stream_silent_webhooks(spark.readStream.schema(EVENTS).parquet(path), spark.readStream.schema(GAPS).parquet(gaps_path))
    run(stream.writeStream.format("memory").queryName("silent").outputMode("append"), str(tmp_path / "c"))
    assert {(r.window_start - T0.replace(tzinfo=None)).seconds // 3600: (r.webhooks, r.gaps, r.silent) for r in spark.table("silent").collect()} == {0: (1, 1, False), 1: (1, 0, False), 2: (0, 1, True)}


def mirror_rows(*ids, data="{}"):
    return [("customer", str(n), data, None, False, None, T0) for n in ids]


def folder_bytes(path):
    return sum(f.stat().st_size for f in path.rglob("*.parquet"))


def test_publishing_whole_tables_and_batches(spark, tmp_path):
    path = str(tmp_path / "mirror")
    assert tables.read_current(spark, path, MIRROR).count() == 0
    for n in (2, 5, 0, 3):
        writers.write_mirror(spark.createDataFrame(mirror_rows(*range(n)), MIRROR), path)
        assert tables.read_current(spark, path, MIRROR).count() == n
    current = tables.read_current(spark, path, MIRROR)
    before = writers.write_mirror(current.unionByName(spark.createDataFrame(mirror_rows(9), MIRROR)), path)
    assert tables.read_current(spark, path, MIRROR).count() == 4
    one = spark.createDataFrame(mirror_rows("9"), MIRROR).select("object_type", "id")
    after = writers.update_mirror(path, one, lambda own: own.withColumn("data", F.lit("new")))
    assert {r.id: r.data for r in tables.read_current(spark, path, MIRROR).collect()} == {"0": "{}", "1": "{}", "2": "{}", "9": "new"}
    assert {r.id: r.data for r in tables.read_current(spark, path, MIRROR, before).collect()}["9"] == "{}"
    assert [tuple(r) for r in writers.mirror_changes(spark, path, before).collect()] == [("customer", "9")] and writers.mirror_changes(spark, path, after).count() == 0
    assert writers.update_mirror(path, one.limit(0), lambda own: own) > after and tables.read_current(spark, path, MIRROR).count() == 4
    assert len(tables.names_in(spark, f"{path}/_published")) == tables.KEPT


def test_batches_cost_their_size_and_ranges_halve(spark, tmp_path):
    """Twelve batches of new and known keys against a dictionary: any number of merges in between, and every change seen by a follower."""
    path, where = str(tmp_path / "mirror"), tmp_path / "mirror"
    rnd = random.Random(6)
    many = [(k, f"c{i}", "x" * 200, None, False, None, T0) for k in ("customer", "charge") for i in range(20_000)]
    writers.write_mirror(spark.createDataFrame(many, MIRROR), path, range_rows=5_000)
    (run_,) = tables.current_manifest(spark, path)["runs"]
    assert run_["bits"] == 3 and run_["rows"] == 40_000
    whole = folder_bytes(where)
    model = {(r[0], r[1]): r[2] for r in many}
    seen = dict(model)
    version = tables.current_manifest(spark, path)["version"]
    for batch in range(12):
        rows = {(rnd.choice(["customer", "charge", None]), rnd.choice([None, *(f"c{rnd.randrange(22_000)}" for _ in range(50))])): f"{batch}" for _ in range(100)}
        keys = spark.createDataFrame([(*k, v) for k, v in rows.items()], "object_type string, id string, new string")
        was = folder_bytes(where)
        if batch == 0:
            assert was < 2 * whole
        own = tables.rows_of(spark, path, MIRROR, keys)
        assert {(r.object_type, r.id): r.data for r in own.collect()} == {k: model[k] for k in rows if k in model}
        out = keys.select("object_type", "id", F.col("new").alias("data"), *[F.lit(None).cast(MIRROR[c].dataType).alias(c) for c in MIRROR.names[3:]])
        tables.upsert_rows(out, path, writers.MIRROR_KEYS)
        model |= rows
        if batch < 3:
            assert folder_bytes(where) - was < whole / 10  # a hundredth of the keys, and not yet merged
        assert {(r.object_type, r.id): r.data for r in tables.read_current(spark, path, MIRROR).collect()} == model
        if batch % 3 == 2:
            changed = tables.changes_between(spark, path, MIRROR, version)
            assert run_["folder"] not in "".join(changed.inputFiles())
            seen |= {(r.object_type, r.id): r.data for r in changed.collect()}
            version = tables.current_manifest(spark, path)["version"]
            assert seen == model
    assert len(tables.current_manifest(spark, path)["runs"]) < 8
    more = spark.createDataFrame([("customer", f"n{i}", "{}", None, False, None, T0) for i in range(40_000)], MIRROR)
    tables.upsert_rows(more, path, writers.MIRROR_KEYS, merge=False)
    assert tables.compact(spark, path, MIRROR, whole=True) and tables.compact(spark, path, MIRROR, whole=True) is None
    (run_,) = tables.current_manifest(spark, path)["runs"]
    assert run_["bits"] == 5 and tables.read_current(spark, path, MIRROR).count() == len(model) + 40_000
    opened = tables.rows_of(spark, path, MIRROR, spark.createDataFrame([("customer", "n7")], "object_type string, id string"))
    assert [r.id for r in opened.collect()] == ["n7"]
    assert re.search(r"PartitionFilters: \[[^\]]*range#\d+ = \d+", opened._jdf.queryExecution().executedPlan().toString())
    with pytest.raises(ValueError):
        tables.upsert_rows(more, path, ["id"])
    with pytest.raises(ValueError):
        tables.read_current(spark, path, MIRROR, 1)


def test_runs_are_merged_as_they_double():
    runs, written = [], 0
    for _ in range(1000):
        runs.append({"rows": 1})
        if due := tables.due_runs(runs):
            runs[-len(due) :] = [{"rows": sum(r["rows"] for r in due)}]
            written += runs[-1]["rows"]
        assert len(runs) < 16
    assert written < 1000 * 10


@pytest.mark.parametrize("stop", ["before publishing", "while publishing", "before the sweep"])
def test_a_crash_leaves_the_old_table_or_the_new(spark, tmp_path, monkeypatch, stop):
    path = str(tmp_path / "mirror")
    writers.write_mirror(spark.createDataFrame(mirror_rows(*range(5)), MIRROR), path)

    def crash(*_):
        raise RuntimeError("killed")

    def half(session, where, number, manifest):
        (tmp_path / "mirror" / "_published" / f"{number:012d}").write_text(json.dumps(manifest)[:20])
        crash()

    with monkeypatch.context() as m:
        m.setattr(tables, "_sweep" if stop == "before the sweep" else "publish", half if stop == "while publishing" else crash)
        with pytest.raises(RuntimeError):
            writers.write_mirror(spark.createDataFrame(mirror_rows(*range(7)), MIRROR), path)
    assert tables.read_current(spark, path, MIRROR).count() == (7 if stop == "before the sweep" else 5)
    writers.write_mirror(tables.read_current(spark, path, MIRROR).unionByName(spark.createDataFrame(mirror_rows("x"), MIRROR)), path)
    assert tables.read_current(spark, path, MIRROR).count() == (8 if stop == "before the sweep" else 6)


def test_data_without_publication_is_an_error(spark, tmp_path):
    path = str(tmp_path / "mirror")
    writers.write_mirror(spark.createDataFrame(mirror_rows(1), MIRROR), path)
    shutil.rmtree(f"{path}/_published")
    with pytest.raises(ValueError):
        tables.read_current(spark, path, MIRROR)


def test_a_batch_that_runs_again_keeps_its_feed(spark, tmp_path, monkeypatch):
    """Killed after the feed and before the table, then after the table: the feed names each change once."""
    log, table, feed = (str(tmp_path / x) for x in ("log", "table", "feed"))
    rows = [(f"e{i}", "customer.updated", None, None, T0, T0, "webhook", json.dumps({"data": {"object": {"id": f"c{i}"}}}), None, False) for i in range(4)]
    writers.write_log(spark.createDataFrame(rows, EVENTS), log)
    make = lambda: jobs.stream_apply(spark.readStream.schema(EVENTS).parquet(log), table, lambda: F.lit(T0).cast("timestamp"), feed)
    real = jobs.upsert_rows

    def killed(*args, after):
        if after:
            real(*args)
        raise RuntimeError("killed")

    for after in (False, True):
        with monkeypatch.context() as m:
            m.setattr(jobs, "upsert_rows", lambda *args: killed(*args, after=after))  # noqa: B023
            with pytest.raises(Exception, match="killed"):
                run(make(), str(tmp_path / "c"))
    run(make(), str(tmp_path / "c"))
    assert sorted(r.object_id for r in spark.read.json(feed).collect()) == ["c0", "c1", "c2", "c3"]
    assert jobs.read_applied(spark, table)[0].count() == 4


def test_readers_and_history(spark, tmp_path):
    snapshot = str(tmp_path / "snapshot")
    spark.createDataFrame([("charge", "a", '{"created":5,"status":"x"}'), ("charge", "b", '{"created":9}'), ("invoice", "c", '{"created":9}')], "object_type string, id string, data string").write.partitionBy("object_type").parquet(snapshot)
    assert [r.id for r in readers.read_snapshot(spark, snapshot, ["charge"], since=6).collect()] == ["b"]
    assert readers.read_snapshot(spark, snapshot, status="x").count() == 1
    dated = str(tmp_path / "dated")
    spark.read.parquet(snapshot).withColumn("created", F.get_json_object("data", "$.created").cast("bigint")).write.parquet(dated)
    late = readers.read_snapshot(spark, dated, since=6)
    assert sorted(r.id for r in late.collect()) == ["b", "c"] and late.columns == ["object_type", "id", "data"]
    assert "GreaterThanOrEqual(created,6)" in late._jdf.queryExecution().executedPlan().toString()
    events = str(tmp_path / "listed")
    spark.createDataFrame([(f"e{i}", k, None, None, T0 + dt.timedelta(seconds=i), T0, "webhook", "{}", None, False) for i, k in enumerate(("a", "b", "a"))], EVENTS).write.parquet(events)
    window = (T0, T0 + dt.timedelta(seconds=2))
    assert readers.read_listed_events(spark, events, window, ["a"]).count() == 2
    raw = tmp_path / "raw.json"
    raw.write_text('{"header":"h","body":"aGk=","received_at":"2026-01-01T00:00:00Z"}\n')
    assert bytes(readers.read_raw_deliveries(spark, str(raw)).first().body) == b"hi"
    spark.sql("CREATE DATABASE IF NOT EXISTS legacy")
    spark.range(2).selectExpr("cast(id as string) AS id").write.mode("overwrite").saveAsTable("legacy.customers")
    spark.range(1).write.mode("overwrite").saveAsTable("legacy.unrelated")
    assert list(readers.read_legacy_tables(spark, "legacy")) == ["customer"]
    report = spark.createDataFrame([("customer", 5, 1, 0), ("total", 5, 1, 0)], "object_type string, checked long, drifted long, repaired long")
    drifts = spark.createDataFrame([("customer", "c", "stale")], "object_type string, object_id string, kind string")
    for i in (1, 2, 2):  # the last one is a retry
        writers.append_verification(report, drifts, str(tmp_path / "history"), i, "full", T0, T0)
    history, found = writers.read_verifications(spark, str(tmp_path / "history"))
    assert sorted((r.id, r.checked) for r in history.collect()) == [(1, 5), (2, 5)]
    assert sorted(r.verification_id for r in found.collect()) == [1, 2]
