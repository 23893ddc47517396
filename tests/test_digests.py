"""The diff by digests, and subscriptions that cannot be read."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from eventmirror.operators import mirror, verify
from eventmirror.schemas import MIRROR, SNAPSHOT
from eventmirror.sources import writers

T0 = dt.datetime(2026, 1, 10)


def drifted(spark, rnd):
    """(snapshot, mirror) rows with every kind of drift, texts that are no JSON, numbers written in several ways and volatile fields."""
    snapshot, mine = [], []
    for i in range(400):
        kind = rnd.choice(["charge", "customer", "invoice", "payment_method"])
        text = f'{{"id":"o{i}","n":{rnd.randrange(5)},"receipt_url":"{i}"}}'
        up, own = text, rnd.choice([text, text, text, f'{{"receipt_url":"other", "n": {rnd.randrange(5)}, "id":"o{i}"}}', text.replace('"n":2', '"n":2.0'), text.replace('"n":2', '"n":20e-1')])
        case = rnd.randrange(20)
        if case == 0:
            up = own = "{bad"
        if case == 1:
            up = '{"id":"o","deleted":true}'
        if case != 2:
            snapshot += [(kind, f"o{i}", up)] * (2 if case == 3 else 1)
        if case != 4:
            mine.append((kind, f"o{i}", own, "acct", case == 5, None, T0))
    return spark.createDataFrame(snapshot, SNAPSHOT), spark.createDataFrame(mine, MIRROR)


@pytest.mark.parametrize("bits", [None, 0, 2, 12])
def test_digest_diff_finds_what_the_full_diff_finds(spark, bits):
    snapshot, mine = drifted(spark, random.Random(3))
    want = sorted((tuple(r) for r in verify.full_diff(snapshot, mine).collect()), key=repr)
    asked = []

    def texts(keys):
        asked.append(keys)
        return mine.join(keys, ["object_type", "id"], "left_semi")

    got = verify.digest_diff(snapshot, verify.with_digest(mine).drop("data"), texts, bits=bits)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    kinds = {k: sum(w[2] == k for w in want) for k in ("missing", "stale", "orphaned")}
    assert min(kinds.values()) > 5
    # Texts are read of what is stale, and of numbers that are equal in another form; not of other volatile fields.
    assert kinds["stale"] <= asked[0].count() < kinds["stale"] + 20
    assert sorted((tuple(r) for r in verify.digest_diff(snapshot, verify.with_digest(mine), types=["charge"]).collect()), key=repr) == [w for w in want if w[0] == "charge"]


def test_digest_diff_of_nothing(spark):
    none, mine = spark.createDataFrame([], SNAPSHOT), spark.createDataFrame([], MIRROR)
    assert verify.digest_diff(none, verify.with_digest(mine)).count() == 0
    one = spark.createDataFrame([("charge", "a", "{}")], SNAPSHOT)
    assert [tuple(r) for r in verify.digest_diff(one, verify.with_digest(mine)).collect()] == [("charge", "a", "missing")]


def test_table_diff_after_updates(spark, tmp_path):
    """Digests keep up with the table: after upserts the diff of the table is that of its rows."""
    path = str(tmp_path / "mirror")
    snapshot, mine = drifted(spark, random.Random(4))
    writers.write_mirror(mine, path, range_rows=50)
    diff = verify.table_diff(snapshot, path)
    assert sorted(map(tuple, diff.collect()), key=repr) == sorted(map(tuple, verify.full_diff(snapshot, mine).collect()), key=repr)
    bad = verify.drifts(diff).where("kind <> 'orphaned'").select("object_type", F.col("object_id").alias("id"))
    rows = snapshot.distinct().join(bad, ["object_type", "id"], "left_semi")
    writers.update_mirror(path, rows, lambda own: mirror.upsert_objects(own, rows, F.lit(T0)))
    left = {(r.kind, r.object_id) for r in verify.drifts(verify.table_diff(snapshot, path)).collect()}
    assert {k for k, _ in left} == {"orphaned", "stale"} and {i for k, i in left if k == "stale"} <= {r.id for r in snapshot.where("data = '{bad'").collect()}


def test_fingerprints_roll_up(spark):
    rows = spark.range(1000).select(F.lit("charge").alias("object_type"), F.col("id").cast("string").alias("id"), F.xxhash64("id").alias("_print"))
    fine, coarse = verify.fingerprints(rows, 8), verify.fingerprints(rows, 3)
    assert sorted(map(tuple, verify.rolled_up(fine, 5).collect())) == sorted(map(tuple, coarse.collect()))
    assert verify.differing(fine, verify.fingerprints(rows.repartition(7), 8)).count() == 0
    changed = rows.withColumn("_print", F.when(F.col("id") == "77", 1).otherwise(F.col("_print")))
    assert verify.differing(fine, verify.fingerprints(changed, 8)).count() == 1 and verify.differing(fine, verify.fingerprints(rows.where("id <> '5'"), 8)).count() == 1


def test_unreadable_subscriptions_keep_their_items(spark):
    rows = {"ok": '{"items":{"data":[{"id":"i1"}]}}', "none": "{}", "null": '{"items":null}', "empty": '{"items":{"data":[]}}', "bad": '{"items":{"data":[{"id":"i2"}', "list": "[]", "text": "nope", "shape": '{"items":{"data":"x"}}', "kind": '{"items":5}', "gone": None}
    subs = spark.createDataFrame(list(rows.items()), "id string, data string")
    status = {r.subscription: r.status for r in mirror.explode_items(subs).collect()}
    broken = {"bad", "list", "text", "shape", "kind", "gone"}
    assert status == {"ok": "ok", **dict.fromkeys(broken, "unreadable")}
    live = spark.createDataFrame([("subscription_item", f"i_{k}", f'{{"subscription":"{k}"}}', None, False, None, T0) for k in rows], MIRROR)
    out = mirror.refresh_subscriptions(live, subs, F.lit(T0))
    assert {r.id[2:] for r in out.where("is_deleted").collect()} == set(rows) - broken
    assert {r.id for r in out.where("object_type = 'subscription'").collect()} == set(rows) - broken
