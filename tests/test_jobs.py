import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from eventmirror.functions.event_types import OBJECT_TYPES, VERIFY_TYPES
from eventmirror.operators import backfill, importer, ingest, monitor, retention, serve, sweep, verify
from eventmirror.schemas import DRIFTS, EVENTS, GAPS, MIRROR, STATE, SWEEPS
from eventmirror.sources import writers

T0 = dt.datetime(2026, 1, 10)


def ts(x):
    return F.lit(x).cast("timestamp")


def hours(n):
    return T0 + dt.timedelta(hours=n)


def ev(n, created=T0, received=T0, source="webhook", kind="customer.created", processed=None):
    payload = json.dumps({"id": n, "type": kind, "data": {"object": {"id": f"cus_{n}"}}})
    return (n, kind, None, None, created, received, source, payload, processed, False)


def log(spark, *rows):
    return spark.createDataFrame(list(rows), EVENTS)


def objects(spark, *rows):
    return spark.createDataFrame([(k, d["id"], json.dumps(d)) for k, d in rows], "object_type string, id string, data string")


def mirror(spark, *rows):
    return spark.createDataFrame([(k, d["id"], json.dumps(d), None, gone, None, T0) for k, d, gone in rows], MIRROR)


def sweeps(spark, *rows):
    return spark.createDataFrame([(i, T0, T0, a, b, 0, 0, s) for i, a, b, s in rows], SWEEPS)


def test_sweep_window(spark):
    now = hours(100)
    first = sweep.collect_window(sweep.sweep_window(sweeps(spark), now))
    assert first == (now - dt.timedelta(days=1), now - dt.timedelta(seconds=60))
    later = sweep.sweep_window(sweeps(spark, (1, hours(0), hours(90), "done"), (2, hours(90), hours(99), "failed"), (3, hours(0), hours(95), "done")), now)
    assert sweep.collect_window(later)[0] == hours(95) - dt.timedelta(minutes=10)
    ahead = sweep.collect_window(sweep.sweep_window(sweeps(spark, (1, hours(0), hours(200), "done")), now))
    assert ahead[0] == ahead[1] == now - dt.timedelta(seconds=60)


def test_gaps_heal_and_overlap_finds_none(spark):
    listed, have = log(spark, ev("a"), ev("b"), ev("c"), ev("c"), ev("x", kind="customer.subscription.brand_new")), log(spark, ev("a"))
    found = sweep.find_gaps(listed, have, ts(hours(2)), 4)
    assert sorted((r.event_id, r.source, r.lag_seconds, r.resolve_status) for r in found.collect()) == [("b", "sweep", 7200, "mapped"), ("c", "sweep", 7200, "mapped")]
    assert sweep.gap_work(found).count() == 2
    healed = have.unionByName(found.select(*EVENTS.names))
    assert sweep.find_gaps(listed, healed, ts(hours(3)), 5).count() == 0
    row = sweep.sweep_summary(listed, found, 4, (hours(0), hours(1)), ts(hours(2))).first()
    assert (row.events_seen, row.gaps_found, row.status) == (4, 2, "done")


def test_sweep_reads_the_days_of_its_window(spark, tmp_path):
    path = str(tmp_path / "log")
    days = [ev(f"d{i}", created=T0 + dt.timedelta(days=i), received=T0 + dt.timedelta(days=i), processed=T0) for i in range(9)]
    writers.write_log(log(spark, *days, ev("none", created=None)), path)
    stored = writers.read_log(spark, path)
    window = (T0 + dt.timedelta(days=3), T0 + dt.timedelta(days=4))
    listed = log(spark, *days[2:6], ev("x", created=T0 + dt.timedelta(days=3, seconds=5)))
    found = sweep.find_gaps(listed, stored, ts(hours(200)), 1, window)
    assert [r.event_id for r in found.collect()] == ["x"]
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    parts = lambda df: [x for x in plan(df).split("PartitionFilters: [")[1:] if "created_day" in x.split("]")[0]]
    assert parts(found)
    gaps = spark.createDataFrame([("d1", T0, 1, T0, 0), ("d8", T0, 1, T0, 0)], GAPS)
    kept, left = retention.purge_events(stored, gaps, T0 + dt.timedelta(days=4))
    assert sorted(r.event_id for r in kept.collect()) == ["d4", "d5", "d6", "d7", "d8", "none"] and [r.event_id for r in left.collect()] == ["d8"]
    assert parts(left)
    again = ingest.dedupe_events(log(spark, days[2], ev("y", created=T0)), stored, [int(T0.replace(tzinfo=dt.UTC).timestamp()) // 86_400 + i for i in (0, 2)])
    assert {r.event_id: r.outcome for r in again.collect()} == {"d2": "duplicate", "y": "inserted"} and parts(again)


def test_failed_sweep_leaves_the_checkpoint(spark):
    done = sweeps(spark, (1, hours(0), hours(90), "done"))
    bad = sweep.failed_sweep(spark, 2, (hours(89), hours(95)), ts(hours(96)))
    assert sweep.collect_window(sweep.sweep_window(done.unionByName(bad), hours(100)))[0] == hours(90) - dt.timedelta(minutes=10)


def test_outage_and_retention_risk(spark):
    gaps = spark.createDataFrame([("a", T0, 1, T0, 5)], GAPS)
    window = (ts(hours(0)), ts(hours(1)))
    assert sweep.delivery_outage(gaps, log(spark, ev("s", received=hours(0.5), source="sweep")), window).first().outage
    assert not sweep.delivery_outage(gaps, log(spark, ev("s", received=hours(1))), window).first().outage
    assert not sweep.delivery_outage(gaps.limit(0), log(spark), window).first().outage
    risk = lambda d: spark.range(1).select(sweep.retention_risk(ts(T0), ts(T0 + d))).first()[0]
    assert risk(dt.timedelta(days=26)) and not risk(dt.timedelta(days=25)) and risk(dt.timedelta(days=25, microseconds=1))


def state(spark, *rows):
    return spark.createDataFrame([(k, i, T0, c, e, "payload", 2, c, e) for k, i, c, e in rows], STATE)


def test_backfill_keeps_what_is_fresher(spark):
    snapshot = objects(spark, ("customer", {"id": "fresh", "v": 2}), ("customer", {"id": "plain", "v": 2}), ("customer", {"id": "edge", "v": 2}), ("customer", {"id": "stub", "deleted": True}), ("subscription", {"id": "s", "items": {"data": [{"id": "i", "subscription": "s"}], "has_more": False}}))
    mine = mirror(spark, ("customer", {"id": "fresh", "v": 1}, False))
    st = state(spark, ("customer", "fresh", hours(1), "e"), ("customer", "edge", T0, "e"))
    out, new = backfill.backfill(snapshot, mine, st, ts(T0), ts(hours(5)))
    got = {r.id: json.loads(r.data).get("v") for r in out.collect()}
    assert got == {"fresh": 1, "plain": 2, "edge": 2, "s": None, "i": None}
    states = {r.object_id: (r.sync_source, r.last_event_created, r.last_event_id, r.fetch_failures) for r in new.collect()}
    assert states["plain"] == ("backfill", T0, None, 0) and states["fresh"] == ("payload", hours(1), "e", 2) and states["edge"] == ("backfill", T0, "e", 0)


def test_payment_methods_progress_resume(spark):
    methods = objects(spark, *[("payment_method", {"id": f"pm{i}", "customer": f"c{i % 9}"}) for i in range(9)])
    subs = mirror(spark, *[("subscription", {"id": f"s{i}", "customer": f"c{i}", "status": ("active", "canceled", "trialing")[i % 3]}, i == 0) for i in range(9)])
    live = backfill.live_subscription_payment_methods(methods, subs)
    assert live.count() == 5
    listed = methods.unionByName(objects(spark, *[("customer", {"id": str(i)}) for i in range(201)]))
    got = {r.object_type: (r.pages_done, r.objects_done) for r in backfill.backfill_progress(listed, live).collect()}
    assert got == {"payment_method": (9, 5), "customer": (3, 0)}
    rows = objects(spark, *[("customer", {"id": i, "created": c}) for i, c in (("a", 5), ("b", 5), ("c", 4), ("d", 9))])
    assert sorted(r.id for r in backfill.resume_after(rows, F.lit(5), F.lit("b")).collect()) == ["a", "c"]
    assert {json.loads(r.data)["customer"] for r in backfill.resume_after(methods, cursor_customer=F.lit("c5")).collect()} == {"c6", "c7", "c8"}


def test_injected_drift_is_found_and_repaired(spark):
    up = [("customer", {"id": f"c{i}", "v": i, "created": 100 + i}) for i in range(20)] + [("invoice", {"id": "in", "total": 5, "invoice_pdf": "new", "created": 1}), ("charge", {"id": "ch", "x": {"receipt_url": 1}})]
    truth = objects(spark, *up, ("customer", {"id": "stub", "deleted": True}), ("subscription", {"id": "s", "items": {"data": [], "has_more": False}}))
    mine = mirror(
        spark, *[("customer", d | {"v": -1} if d["id"] in ("c1", "c2") else d, False) for k, d in up if k == "customer" and d["id"] != "c3"],
        ("invoice", {"invoice_pdf": "old", "total": 5, "id": "in", "created": 1}, False), ("charge", {"id": "ch", "x": {}}, False), ("customer", {"id": "gone"}, False),
        ("customer", {"id": "stub"}, False), ("customer", {"id": "dead"}, True), ("subscription", {"id": "s"}, True), ("subscription_item", {"id": "i", "subscription": "s"}, False),
    )
    diff = verify.full_diff(truth, mine)
    assert {(r.object_id, r.kind) for r in verify.drifts(diff).collect()} == {("c1", "stale"), ("c2", "stale"), ("c3", "missing"), ("gone", "orphaned"), ("stub", "orphaned"), ("s", "missing")}
    report = {r.object_type: (r.checked, r.drifted, r.repaired) for r in verify.verify_report(diff, True).collect()}
    assert report == {"customer": (22, 5, 5), "invoice": (1, 0, 0), "charge": (1, 0, 0), "subscription": (1, 1, 1), "total": (25, 6, 6)}
    assert verify.exit_code(verify.verify_report(diff, True)) == 3
    fixed, states = verify.repair(diff, truth, mine, state(spark, ("customer", "c1", T0, "e")), ts(hours(1)))
    fixed = fixed.checkpoint()
    assert verify.drifts(verify.full_diff(truth, fixed)).count() == 0
    assert verify.exit_code(verify.verify_report(verify.full_diff(truth, fixed))) == 0
    assert {r.object_id: (r.sync_source, r.last_event_id) for r in states.collect()}["c1"] == ("repair", "e")
    assert {r.id: r.is_deleted for r in fixed.collect()}["i"] is True
    since = {(r.object_id, r.kind) for r in verify.drifts(verify.full_diff(truth, mine, since=102)).collect()}
    assert since == {("c2", "stale"), ("c3", "missing")}


@pytest.mark.parametrize("seed", [1, 2])
def test_only_types_that_can_be_verified_are(spark, seed):
    """All 13 types live in the mirror; upstream's export lists neither payment methods nor items."""
    up = [(k, {"id": f"{k}_{i}", "created": 10 + i, "v": i}) for k in OBJECT_TYPES for i in range(3) if k not in ("payment_method", "subscription_item")]
    up = [(k, d | {"items": {"data": [], "has_more": False}} if k == "subscription" else d) for k, d in up]
    live = [(k, d, False) for k, d in up] + [(k, {"id": f"{k}_{i}", "created": 5, "subscription": "none", "customer": "c"}, False) for k in ("payment_method", "subscription_item") for i in range(3)]
    rnd = random.Random(seed)
    rnd.shuffle(live)
    truth, mine = objects(spark, *up), mirror(spark, *live)
    assert verify.drifts(verify.full_diff(truth, mine)).count() == 0
    assert verify.drifts(verify.quick_diff(truth, mine, T0, since=11)).count() == 0
    assert {r.object_type for r in verify.spot_check(mine, truth, 10**9).collect()} == set(VERIFY_TYPES)
    # An export of some types only is compared with those.
    charges = truth.where("object_type = 'charge'")
    assert verify.full_diff(charges, mine, types=["charge"]).count() == 3
    assert verify.drifts(verify.full_diff(charges, mine)).count() == 30
    with pytest.raises(ValueError):
        verify.full_diff(truth, mine, types=["payment_method"])
    worse = mirror(spark, *[(k, d | {"v": -1} if i == 0 else d, gone) for i, (k, d, gone) in enumerate(live)])
    diff, fixed, _ = verify.diff_and_repair(truth, worse, state(spark), ts(hours(1)))
    assert verify.drifts(diff).count() == (live[0][0] in VERIFY_TYPES)
    assert fixed.where("is_deleted").count() == 0 and fixed.count() == len(live)


def test_quick_finds_old_drift(spark):
    truth = objects(spark, ("customer", {"id": "old", "v": 2, "created": 10}), ("customer", {"id": "new", "created": 10**9}))
    mine = mirror(spark, ("customer", {"id": "old", "v": 1, "created": 10}, False), ("customer", {"id": "lost", "created": None}, False))
    out = {(r.object_id, r.kind) for r in verify.quick_diff(truth, mine, T0, since=10**8).collect()}
    assert out == {("old", "stale"), ("lost", "orphaned"), ("new", "missing")}
    assert verify.spot_check(mine, truth, 10**8, n=1).count() == 1


def test_import(spark):
    legacy = spark.createDataFrame(
        [("cus_1", "a", '{"k":{"n":null,"m":1}}', 1700000004, False, T0, dt.datetime(2023, 12, 14, 22, 15, 0, 600000)), ("cus_2", None, None, 1, True, T0, None), ("cus_3", "c", "{}", 1, None, T0, None)],
        "id string, email string, metadata string, created int, deleted boolean, updated_at timestamp, trial_end timestamp",
    )
    objs = importer.reconstruct_objects(legacy, "customer", ("metadata",)).checkpoint()
    data = {r.id: json.loads(r.data) for r in objs.collect()}
    assert data["cus_1"] == {"id": "cus_1", "email": "a", "metadata": {"k": {"m": 1}}, "created": 1700000004, "deleted": False, "trial_end": 1702592101, "object": "customer"}
    assert data["cus_2"] == {"id": "cus_2", "created": 1, "deleted": True, "trial_end": None, "object": "customer"}
    mine = mirror(spark, ("customer", {"id": "cus_3", "kept": 1}, False))
    done = importer.import_objects(objs, mine, ts(T0))
    assert importer.import_counts(done).first().asDict() == {"object_type": "customer", "imported": 2, "skipped": 1}
    rows = {r.id: (r.is_deleted, r.deleted_at) for r in importer.mirror_with(mine, done, ts(T0)).collect()}
    assert rows == {"cus_1": (False, None), "cus_2": (True, T0), "cus_3": (False, None)}
    st = importer.import_state(objs, state(spark, ("customer", "cus_1", T0, "e")), ts(T0))
    assert {r.object_id: r.sync_source for r in st.collect()} == {"cus_1": "payload", "cus_2": "import", "cus_3": "import"}


def test_retention(spark):
    rows = log(spark, ev("old_done", received=hours(0), processed=T0), ev("old_open", received=hours(0)), ev("new_done", received=hours(9), processed=T0))
    gaps = spark.createDataFrame([("old_done", T0, 1, T0, 0), ("old_open", T0, 1, T0, 0)], GAPS)
    kept, left = retention.purge_events(rows, gaps, hours(5))
    assert sorted(r.event_id for r in kept.collect()) == ["new_done", "old_open"] and [r.event_id for r in left.collect()] == ["old_open"]
    assert retention.purge_events(rows, gaps, None)[0].count() == 3


def test_status_on_empty_tables(spark):
    assert monitor.events_summary(log(spark)).first().asDict() == {"total": 0, "unprocessed": 0, "last_received": dt.datetime(1970, 1, 1)}
    assert [r.n for r in monitor.delivery_lag_histogram(log(spark)).collect()] == [0] * 19
    firing = monitor.alerts(log(spark), spark.createDataFrame([], GAPS), sweeps(spark), spark.createDataFrame([], "failed_at timestamp"), spark.createDataFrame([], DRIFTS), ts(T0))
    assert {r.alert for r in firing.collect() if r.firing} == {"sweep_stalled"}


def test_histogram_edges(spark):
    rows = [ev(str(i), created=T0, received=T0 + dt.timedelta(microseconds=us)) for i, us in enumerate((0, 1_000_000, 1_000_001, 2_000_000, 4_000_001, 131_072_000_000, 131_072_000_001))]
    got = {r.le: r.n for r in monitor.delivery_lag_histogram(log(spark, *rows)).collect()}
    assert (got[1], got[2], got[4], got[8], got[131072], got[None]) == (2, 4, 4, 5, 6, 7)


def test_alerts(spark):
    now = hours(10)
    gaps = spark.createDataFrame([("a", hours(9.5), 1, T0, 0)], GAPS)
    dead = spark.createDataFrame([(hours(9.9),)], "failed_at timestamp")
    drift = spark.createDataFrame([(1, "customer", "c", "stale", False)], DRIFTS)
    old = sweeps(spark, (1, T0, T0 - dt.timedelta(days=30), "done"))
    fired = lambda lg: {r.alert for r in monitor.alerts(lg, gaps, old, dead, drift, ts(now)).collect() if r.firing}
    assert fired(log(spark, ev("x", received=hours(1)))) == {"retention_cliff", "sweep_stalled", "dead_rows_rising", "webhooks_silent", "drift_found"}
    assert "webhooks_silent" not in fired(log(spark, ev("x", received=hours(9.7))))


def test_entitlements(spark):
    rows = mirror(
        spark, ("subscription", {"id": "s1", "customer": "c", "created": 1, "status": "active"}, False), ("subscription", {"id": "s2", "customer": "c", "created": 2, "status": "canceled"}, False),
        ("subscription", {"id": "s3", "customer": "d", "created": 2, "status": "trialing"}, False), ("subscription", {"id": "s4", "customer": "d", "created": 3, "status": "canceled"}, True),
    )
    users = spark.createDataFrame([(1, "c"), (2, "d"), (3, "none"), (4, None)], "user_id int, customer string")
    assert {r.user_id: (r.subscription, r.access) for r in serve.entitlements(rows, users).collect()} == {1: ("s2", False), 2: ("s3", True), 3: (None, False), 4: (None, False)}


def test_show_event_and_dead_rows(spark):
    assert serve.show_event(log(spark, ev("a"), ev("b")), "b").first().event_id == "b"
    assert serve.indented('{"a":1}') == '{\n  "a": 1\n}' and serve.indented("no json") == "no json"
    assert [r.id for r in serve.dead_rows(spark.range(100).orderBy(F.desc("id")), 3).collect()] == [0, 1, 2]
    assert serve.changes_since(mirror(spark, ("customer", {"id": "c"}, True)), ts(hours(-1))).count() == 1
    assert serve.changes_since(mirror(spark, ("customer", {"id": "c"}, True)), ts(T0)).count() == 0


@pytest.mark.parametrize("dead", [True, False])
def test_work_status(spark, dead):
    work = spark.createDataFrame([("customer", "a", hours(1), "e1"), ("customer", "b", hours(1), "e2"), ("customer", "c", T0, "e3")], "object_type string, object_id string, latest_event_created timestamp, latest_event_id string")
    st = state(spark, ("customer", "a", hours(1), "e1"), ("customer", "b", T0, "e0"))
    bad = work.where("object_id = 'c'" if dead else "false")
    status = monitor.work_status(work, st, bad)
    assert {r.object_id: r.status for r in status.collect()} == {"a": "done", "b": "pending", "c": "dead" if dead else "pending"}
    assert monitor.oldest_live(status).first().oldest == (hours(1) if dead else T0)
