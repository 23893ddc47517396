import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from eventmirror.operators import fold, ingest, mirror
from eventmirror.schemas import EVENTS, MIRROR, STATE

T0 = dt.datetime(2026, 1, 1)


def now():
    return F.lit(dt.datetime(2026, 2, 1)).cast("timestamp")


def event(n, created, obj="cus_1", deleted=False, kind="customer.updated", source="webhook", received=None, **fields):
    body = {"id": obj, "object": "customer", "email": f"v{n}@x.y", **fields} | ({"deleted": True} if deleted else {})
    payload = json.dumps({"id": f"evt_{n}", "type": kind, "data": {"object": body}})
    when = None if created is None else T0 + dt.timedelta(seconds=created)
    return (f"evt_{n}", kind, None, None, when, T0 + dt.timedelta(seconds=(n if isinstance(n, int) else 0) if received is None else received), source, payload, None, False)


def log(spark, *events):
    return spark.createDataFrame(list(events), EVENTS)


def empty(spark):
    return spark.createDataFrame([], MIRROR), spark.createDataFrame([], STATE)


def test_first_arrival_is_kept(spark):
    rows = log(spark, event(1, 0, received=3, source="sweep"), event("1", 0, received=1), event("1", 0, received=2), event("2", 0, received=1))
    out = ingest.dedupe_events(rows, log(spark, event("2", 0, received=0))).collect()
    assert sorted((r.event_id, r.outcome, r.source) for r in out) == [("evt_1", "duplicate", "sweep"), ("evt_1", "duplicate", "webhook"), ("evt_1", "inserted", "webhook"), ("evt_2", "duplicate", "webhook")]
    counts = {r.outcome: r.n for r in ingest.ingest_outcomes(ingest.dedupe_events(rows)).collect()}
    assert counts == {"inserted": 2, "duplicate": 2}


def test_coalesce(spark):
    rows = [event(i, i, "cus_1", received=i) for i in range(1, 21)] + [event(50, 1, "cus_2", received=1), event(1, 1, received=1)]
    out = {r.object_id: r.latest_event_id for r in fold.coalesce_work(log(spark, *rows)).collect()}
    assert out == {"cus_1": "evt_20", "cus_2": "evt_50"}


def fold_model(events):
    """The rule in plain Python: apply each event once, in (created, id) order."""
    out = {}
    for created, name, obj, deleted, email in sorted(set(events)):
        row = out.setdefault(obj, {"last": None, "deleted": False, "email": None, "live": False})
        row["last"], row["deleted"] = name, deleted
        if not deleted:
            row["email"], row["live"] = email, True
    return {k: (v["last"], v["deleted"] if v["live"] else None, v["email"]) for k, v in out.items()}


@pytest.mark.parametrize("seed", range(3))
def test_any_cut_and_order_converges(spark, seed):
    rnd = random.Random(seed)
    objects = [f"cus_{i}" for i in range(25)]
    facts, rows = [], []
    for n in range(160):
        created, obj, deleted = rnd.randrange(12), rnd.choice(objects), rnd.random() < 0.3
        facts.append((created, f"evt_{n}", obj, deleted, f"v{n}@x.y"))
        rows.append(event(n, created, obj, deleted))
    rows += rnd.sample(rows, 20)
    rnd.shuffle(rows)
    cuts = sorted(rnd.sample(range(len(rows)), 2))
    mine, state = empty(spark)
    for batch in (rows[: cuts[0]], rows[cuts[0] : cuts[1]], rows[cuts[1] :]):
        applied = fold.apply_events(log(spark, *batch), mine, state, now()).checkpoint()
        mine, state = fold.mirror_of(applied), fold.state_of(applied)
    want = fold_model(facts)
    got_state = {r.object_id: r.last_event_id for r in state.collect()}
    got = {r.id: (r.is_deleted, json.loads(r.data)["email"]) for r in mine.collect()}
    assert got_state == {k: v[0] for k, v in want.items()}
    assert got == {k: v[1:] for k, v in want.items() if v[2] is not None}


def test_stale_events_change_nothing(spark):
    mine, state = empty(spark)
    first = fold.apply_events(log(spark, event("9", 10)), mine, state, now()).checkpoint()
    again = fold.apply_events(log(spark, event("1", 5), event("9", 10)), fold.mirror_of(first), fold.state_of(first), F.lit(dt.datetime(2027, 1, 1)).cast("timestamp"))
    assert fold.changes_of(again).count() == 0
    assert fold.mirror_of(again).collect() == fold.mirror_of(first).collect()


def test_event_without_time(spark):
    mine, state = empty(spark)
    first = fold.apply_events(log(spark, event("a", None)), mine, state, now()).checkpoint()
    assert fold.mirror_of(first).count() == 1
    second = fold.apply_events(log(spark, event("b", None)), fold.mirror_of(first), fold.state_of(first), now())
    assert json.loads(fold.mirror_of(second).first().data)["email"] == "va@x.y"


def test_mark_processed(spark):
    rows = log(spark, event("1", 1), event("2", 5), event("3", 9), event("4", 1, "other"))
    applied = spark.createDataFrame([("customer", "cus_1", T0 + dt.timedelta(seconds=5)), ("x", "cus_1", T0)], "object_type string, object_id string, created timestamp")
    out = {r.event_id: r.processed_at is not None for r in fold.mark_processed(rows, applied, now()).collect()}
    assert out == {"evt_1": True, "evt_2": True, "evt_3": False, "evt_4": False}


def row(kind, id_, data, deleted=False):
    return (kind, id_, json.dumps(data), None, deleted, T0 if deleted else None, T0)


def table(spark, *rows):
    return spark.createDataFrame(list(rows), MIRROR)


def shown(df):
    return {(r.object_type, r.id): r.is_deleted for r in df.collect()}


def test_upsert_revives_and_delete_cascades(spark):
    mine = table(spark, row("customer", "c", {"id": "c", "v": 1}, True), row("subscription", "s", {"id": "s"}), row("subscription_item", "i1", {"id": "i1", "subscription": "s"}), row("subscription_item", "i2", {"id": "i2", "subscription": "t"}))
    new = spark.createDataFrame([("customer", "c", '{"v":2}')], "object_type string, id string, data string")
    out = mirror.upsert_objects(mine, new, now())
    assert shown(out)[("customer", "c")] is False
    ids = spark.createDataFrame([("subscription", "s"), ("customer", "nobody")], "object_type string, id string")
    gone = mirror.soft_delete(out, ids, now())
    assert shown(gone) == {("customer", "c"): False, ("subscription", "s"): True, ("subscription_item", "i1"): True, ("subscription_item", "i2"): False}
    assert mirror.soft_delete(gone, ids, F.lit(dt.datetime(2030, 1, 1)).cast("timestamp")).where("deleted_at > '2029-01-01'").count() == 0


def subscription(id_, items, more=False):
    return (id_, json.dumps({"id": id_, "items": {"data": [{"id": i, "subscription": id_} for i in items], "has_more": more}}))


def test_items(spark):
    subs = lambda *x: spark.createDataFrame(list(x), "id string, data string")
    mine = mirror.refresh_subscriptions(mirror.empty_mirror(spark), subs(subscription("s", ["a", "b", "c"])), now()).checkpoint()
    assert sum(not d for (t, _), d in shown(mine).items() if t == "subscription_item") == 3
    fewer = mirror.refresh_subscriptions(mine, subs(subscription("s", ["a", "b"])), now())
    assert shown(fewer)[("subscription_item", "c")] is True and shown(fewer)[("subscription_item", "a")] is False
    none = mirror.refresh_subscriptions(mine, subs(subscription("s", [])), now())
    assert all(d for (t, _), d in shown(none).items() if t == "subscription_item")
    listing = spark.createDataFrame([("s", json.dumps({"id": f"x{i}", "subscription": "s"})) for i in range(15)], "subscription string, data string")
    full = mirror.refresh_subscriptions(mirror.empty_mirror(spark), subs(subscription("s", [f"x{i}" for i in range(10)], True)), now(), listing)
    assert sum(t == "subscription_item" for t, _ in shown(full)) == 15
    cut = mirror.explode_items(subs(subscription("s", ["a"], True), subscription("t", [None]))).collect()
    assert sorted((r.subscription, r.status) for r in cut) == [("s", "incomplete"), ("t", "no_id")]
    untouched = mirror.refresh_subscriptions(mine, subs(subscription("s", ["a"], True)), now())
    assert shown(untouched) == shown(mine)


def test_snapshot_stub_deletes_and_keeps_data(spark):
    mine = table(spark, row("customer", "c", {"id": "c", "email": "e"}), row("customer", "d", {"id": "d"}))
    work = spark.createDataFrame([("customer", "c"), ("customer", "d"), ("customer", "new")], "object_type string, object_id string")
    snapshot = spark.createDataFrame([("customer", "c", '{"id":"c","deleted":true}'), ("customer", "new", '{"id":"new"}')], "object_type string, id string, data string")
    out = {r.id: (r.is_deleted, r.data) for r in fold.apply_snapshot(work, snapshot, mine, now()).collect()}
    assert out["c"][0] and json.loads(out["c"][1])["email"] == "e" and out["d"][0] and not out["new"][0]


@pytest.mark.parametrize("kind", sorted(mirror.TYPED))
def test_typed_views(spark, kind):
    data = {"id": "x", "created": 1735689600, "livemode": True}
    for spec in mirror.TYPED[kind].split():
        what, _, rest = spec.rpartition(":")
        name, _, path = rest.partition("=")
        *parents, at = (path or name).split(".")
        place = data
        for key in parents:
            place = place.setdefault(key, {})
        place[at] = {"t": 1735689600, "n": 9900, "b": True}.get(what, "text")
    good, bare = mirror.typed_view(table(spark, row(kind, "x", data), row(kind, "y", {"id": "y"})), kind).orderBy("id").collect()
    assert all(v is not None for k, v in good.asDict().items() if k not in ("account_id", "deleted_at"))
    assert good.created == dt.datetime(2025, 1, 1) and good.typed_errors == []
    assert all(v is None for k, v in bare.asDict().items() if k not in ("id", "is_deleted", "updated_at", "typed_errors"))


def test_typed_errors(spark):
    view = mirror.typed_view(table(spark, row("price", "p", {"unit_amount": "many", "active": True, "recurring": {"interval": "month"}})), "price").first()
    assert (view.unit_amount, view.typed_errors, view.recurring_interval) == (None, ["unit_amount"], "month")
