"""What lies on disk while a query runs: findings F1 to F3 of the fourth round."""

import datetime as dt
import glob
import time

import pytest
from pyspark.sql import functions as F

from eventmirror.operators import backfill, verify
from eventmirror.plans import queries
from eventmirror.schemas import MIRROR, SNAPSHOT, STATE
from eventmirror.sources import scratch
from eventmirror.sources.tables import read_current, write_table

SF = "/root/testdata/sf0.001"
T0, T1 = dt.datetime(2026, 1, 10), dt.datetime(2026, 1, 11)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def shuffle_files(spark):
    return set(glob.glob(f"{spark.sparkContext.getConf().get('spark.local.dir')}/**/shuffle_*", recursive=True))


def account(spark):
    """(snapshot, mirror, state, listing): drift of every kind, repeated and null keys, cut, unreadable and deleted subscriptions."""
    up, mine, state, listing = [], [], [], []
    for i in range(120):
        kind, text = ("charge", "customer")[i % 2], f'{{"id":"o{i}","n":{i}}}'
        up += [(kind, f"o{i}", text)] * (0 if i % 10 == 1 else 2 if i % 10 == 2 else 1)
        if i % 10 != 3:
            mine.append((kind, f"o{i}", text if i % 10 != 4 else '{"id":"x"}', "acct", i % 10 == 5, None, T0))
        state.append((kind, f"o{i}", T0, T1 if i % 3 else T0, f"e{i}", "payload", 0, T0, f"e{i}"))
        item = lambda n: f'{{"id":"i{i}_{n}","subscription":"s{i}"}}'  # noqa: B023, E731
        cut = '{"items":{"data":[%s],"has_more":%s}}' % (item(0), "true" if i % 4 == 0 else "false")
        up += [("subscription", f"s{i}", "{bad" if i % 12 == 7 else cut)] * (i % 5 != 0)
        listing += [(f"s{i}", item(n)) for n in range(3) if i % 16]
        mine.append(("subscription", f"s{i}", cut if i % 3 else "{}", "acct", False, None, T0))
        mine.append(("subscription_item", f"i{i}_9", f'{{"id":"i{i}_9","subscription":"s{i}"}}', "acct", False, None, T0))
    mine.append(("charge", None, "{}", "acct", False, None, T0))
    return spark.createDataFrame(up, SNAPSHOT), spark.createDataFrame(mine, MIRROR), spark.createDataFrame(state, STATE), spark.createDataFrame(listing, "subscription string, data string")


def test_f1_f2_f3_stored_leaves_no_shuffle_files(spark):
    before, setting = shuffle_files(spark), spark.conf.get(scratch._FREED, None)
    out = scratch.stored(spark.range(1000).repartition(3, "id"), "dealt")
    for _ in range(50):
        if not shuffle_files(spark) - before:
            break
        time.sleep(0.2)
    assert not shuffle_files(spark) - before and spark.conf.get(scratch._FREED, None) == setting
    assert out.agg(F.sum("id")).first()[0] == sum(range(1000))


def test_f1_f2_f3_parts_grow_with_the_stored_tables(spark, monkeypatch):
    table = scratch.stored(spark.range(1000), "t")
    assert scratch.parts_for(table, table) == 1
    monkeypatch.setattr(scratch, "PART_BYTES", 1)
    assert scratch.parts_for(table) == scratch.MOST_PARTS
    scratch.discard(table)
    assert not glob.glob(table._scratch.removeprefix("file://"))


@pytest.mark.parametrize("parts", [1, 3])
def test_f2_f3_parts_give_the_whole(spark, parts):
    up, mine, state, listing = account(spark)
    at = F.lit(T1).cast("timestamp")
    for run in (verify.diff_and_repair, lambda *a, **b: backfill.backfill(*a[:3], F.lit(T0).cast("timestamp"), *a[3:], **b)):
        want, got = run(up, mine, state, at, listing), run(up, mine, state, at, listing, parts=parts)
        assert [rows(g) for g in got] == [rows(w) for w in want]
    diff = verify.diff_and_repair(up, mine, state, at, listing, parts=parts)[0]
    assert {r.kind for r in diff.collect()} == {None, "missing", "stale", "orphaned"}
    mirror = verify.with_digest(mine)
    assert rows(verify.digest_diff(up, mirror, parts=parts)) == rows(diff)


@pytest.mark.parametrize("name, kept", [("v3_table_diff", {"mirror", "digests", "prints", "open", "odd", "stale"}), ("v7_repair", {"drifted", "mirror", "again"}), ("b1_backfill_account", {"writable", "mirror"})])
def test_f1_f2_f3_only_what_the_result_reads_stays(spark, monkeypatch, tmp_path, name, kept):
    query = queries.QUERIES[name]
    want = rows(query(spark, SF))
    monkeypatch.setattr(scratch, "shared_folder", lambda _: f"file://{tmp_path}")
    monkeypatch.setattr(scratch, "PART_BYTES", 1)
    out = query(spark, SF)
    assert {p.name.split("-")[0] for p in tmp_path.iterdir()} == kept
    # Joins of the result move no texts: fields are taken out of them below.
    assert "get_json_object" not in out._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    assert rows(out) == want


def test_f1_a_table_is_written_in_parts(spark, tmp_path):
    df = spark.range(40_000).selectExpr("CAST(id AS string) AS id", "id AS n")
    write_table(df, str(tmp_path / "t"), ["id"], range_rows=100, parts=4)
    files = [(f.parent.name, f.name.split("-", 2)[2]) for f in (tmp_path / "t").glob("run=*/range=*/part-*.parquet")]
    assert len({r for r, _ in files}) == len(files) and len({job for _, job in files}) == 4
    assert rows(read_current(spark, str(tmp_path / "t"), df.schema)) == rows(df)
