"""What grows with the tables is computed once: findings F1 to F14 of the third round."""

import datetime as dt

from pyspark.sql import functions as F

from eventmirror.llm import common, decontaminate, ngram_jaccard
from eventmirror.functions.payload import is_stub
from eventmirror.operators import backfill, fold, quarantine, verify
from eventmirror.plans import adapters, queries
from eventmirror.schemas import MIRROR, STATE
from eventmirror.sources.tables import read_current, write_table

SF = "/root/testdata/sf0.001"
T0 = dt.datetime(2026, 1, 10)


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_f13_events_are_resolved_once(spark):
    above, below = plan_of(fold.coalesce_work(adapters.event_log(spark, SF))).split("Generate inline")
    assert "Filter" in above and "Filter" not in below  # a filter below would parse the payload a second time


def test_f8_items_are_dealt_out_once(spark):
    plan = adapters.subscriptions(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2  # line items, and orders unless they are broadcast


def test_f2_f14_small_ranges_share_a_task(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(5_000).selectExpr("CAST(id AS string) AS id", "id AS n")
    write_table(rows, path, ["id"], range_rows=100)
    files = list((tmp_path / "t").glob("run=*/range=*/part-*.parquet"))
    assert len(files) == 64 and len({f.name.split("-")[1] for f in files}) == 1
    assert read_current(spark, path, rows.schema).agg(F.sum("n")).first()[0] == sum(range(5_000))


def test_f1_f5_what_is_written_is_taken_from_the_snapshot_once(spark, tmp_path):
    snapshot = str(tmp_path / "snapshot_files")
    spark.createDataFrame([("charge", "a", '{"id":"a"}'), ("charge", "b", '{"id":"b"}')], "object_type string, id string, data string").write.parquet(snapshot)
    up, mine, state = spark.read.parquet(snapshot), spark.createDataFrame([("charge", "c", "{}", None, False, None, T0)], MIRROR), spark.createDataFrame([], STATE)
    for out, new_state in (verify.diff_and_repair(up, mine, state, adapters.as_of())[1:], backfill.backfill(up, mine, state, adapters.as_of(), adapters.as_of())):
        assert not any("snapshot_files" in f for f in out.inputFiles() + new_state.inputFiles())
        assert {"a", "b"} <= {r.id for r in out.where("NOT is_deleted").collect()}


def test_f4_failed_objects_are_not_joined_to_themselves(spark):
    bad = quarantine.failed_objects(spark.createDataFrame([("charge", "c", '{"amount":"much"}', None, False, None, T0)], MIRROR), "charge", adapters.as_of())
    assert "Join" not in plan_of(bad)
    assert [(r.retry_key, r.reason, r.text) for r in bad.collect()] == [("charge/c", "amount", '{"amount":"much"}')]


def test_f7_a_diff_is_computed_once_for_a_history(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(queries, "append_verification", lambda report, drifts, *_: seen.append((report, drifts)))
    monkeypatch.setattr(queries, "read_verifications", lambda *_: (spark.createDataFrame([], "id int, object_type string, checked int, drifted int, repaired int, mode string, finished_at timestamp"), spark.createDataFrame([], "verification_id int, object_id string, kind string, repaired boolean")))
    queries.s6_append_verification(spark, SF)
    assert len(seen) == 3 and all("/diff-" in f for pair in seen for df in pair for f in df.inputFiles())


def test_pipeline_whole_texts_are_not_sorted(spark, tmp_path):
    """Texts go past hashed ids; repeated and null ids stay or go as in any semi or anti join."""
    path = str(tmp_path / "docs")
    spark.createDataFrame([(1, "a b c d e"), (1, "x"), (2, "a b c d e"), (None, "y"), (3, None)], "doc_id long, text string").write.parquet(path)
    docs = spark.read.parquet(path)
    ids = spark.createDataFrame([(1,), (1,), (None,)], "doc_id long")
    for how, want in (("left_semi", ["a b c d e", "x"]), ("left_anti", ["", "a b c d e", "y"])):
        df = common.by_ids(docs, ids, how)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "ShuffledHashJoin" in plan and "Sort " not in plan and df.columns == ["doc_id", "text"]
        assert sorted(r.text or "" for r in df.collect()) == want
    for df in (ngram_jaccard.keep_one(docs), decontaminate.remove_leaks(docs, spark.createDataFrame([(1, "p q r s t")], "item_id long, text string"))):
        assert "ShuffledHashJoin" in df._jdf.queryExecution().executedPlan().toString()


def test_f10_f12_texts_of_items_are_made_where_they_are_embedded(spark):
    plan = plan_of(adapters.subscriptions(spark, SF))
    collected = [line for line in plan.splitlines() if "collect_list" in line]
    assert collected and not any("subscription_item" in line.split("collect_list")[1] for line in collected)
    below = plan[plan.index("collect_list"):]
    assert "subscription_item" not in below


def test_f10_f12_texts_without_the_word_are_no_stubs(spark):
    texts = ['{"deleted":true}', r'{"\u0064eleted":true}', "{'deleted':true}", '{"deleted":false}', '{"a":1}', None, "deleted", '{"a":"deleted"}']
    df = spark.createDataFrame([(t,) for t in texts], "data string").select("data", is_stub(F.col("data")).alias("got"))
    assert {r.data: r.got for r in df.collect()} == dict(zip(texts, [True, True, True] + [False] * 5))
    assert plan_of(df).count("ontains(") >= 1
