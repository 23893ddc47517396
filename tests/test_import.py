"""The import of a legacy database over JDBC, from an embedded Derby."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from eventmirror.operators import importer
from eventmirror.schemas import MIRROR, STATE
from eventmirror.sources import readers

T0 = dt.datetime(2026, 1, 10)


@pytest.fixture
def legacy(spark, tmp_path):
    """A database with customers (ids in no order, some with quotes, one null), charges, an empty table and an unknown one."""
    jdbc = {"url": f"jdbc:derby:{tmp_path}/legacy;create=true", "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rnd = random.Random(9)
    ids = [f"cus_{rnd.randrange(10**9):x}{chr(39) if i % 50 == 0 else ''}{'Z' if i % 3 else 'a'}" for i in range(500)]
    with readers._connection(spark, jdbc) as c:
        s = c.createStatement()
        s.execute("CREATE SCHEMA stripe")
        s.execute("CREATE TABLE stripe.customers (id VARCHAR(40), name VARCHAR(40), created TIMESTAMP, deleted BOOLEAN, metadata VARCHAR(200), updated_at TIMESTAMP)")
        rows = ", ".join(f"({readers._quoted(i)}, 'n{k}', TIMESTAMP('2024-01-01 00:00:00'), {'true' if k % 10 == 0 else 'false'}, '{{\"k\":{k},\"none\":null}}', CURRENT_TIMESTAMP)" for k, i in enumerate(ids))
        s.execute(f"INSERT INTO stripe.customers VALUES {rows}")
        s.execute("INSERT INTO stripe.customers (name) VALUES ('nobody')")
        s.execute("CREATE TABLE stripe.charges (id VARCHAR(40), amount BIGINT)")
        s.execute("INSERT INTO stripe.charges VALUES ('ch_1', 5), ('ch_2', 6)")
        s.execute("CREATE TABLE stripe.products (id VARCHAR(40))")
        s.execute("CREATE TABLE stripe.other (id VARCHAR(40))")
        s.execute("CREATE SCHEMA public2")
        s.execute("CREATE TABLE public2.prices (id VARCHAR(40))")
    yield jdbc, ids
    with pytest.raises(Exception, match="08006|shutdown"):
        with readers._connection(spark, {"url": f"jdbc:derby:{tmp_path}/legacy;shutdown=true"}):
            pass


def test_legacy_tables_are_found_and_read_in_ranges(spark, legacy):
    jdbc, ids = legacy
    found = readers.read_legacy_tables(spark, "stripe", jdbc, parts=8)
    assert set(found) == {"customer", "charge", "product"}
    customers = found["customer"]
    assert customers.rdd.getNumPartitions() == 8 and found["charge"].rdd.getNumPartitions() == 1
    assert sorted(r.id or "" for r in customers.select("id").collect()) == sorted([*ids, ""])
    sizes = [r["n"] for r in customers.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) == 8 and max(sizes) < 501 / 4
    assert found["product"].count() == 0 and readers.read_legacy_tables(spark, "nowhere", jdbc) == {}


def test_legacy_rows_become_mirror_rows(spark, legacy):
    jdbc, ids = legacy
    customers = readers.read_legacy_tables(spark, "STRIPE", jdbc)["customer"].where("id IS NOT NULL")
    objects = importer.reconstruct_objects(customers, "customer", ("metadata",))
    known = spark.createDataFrame([("customer", ids[1], "{}", None, False, None, T0)], MIRROR)
    as_of = F.lit(T0).cast("timestamp")
    imported = importer.import_objects(objects, known, as_of)
    assert {(r.object_type, r.imported, r.skipped) for r in importer.import_counts(imported).collect()} == {("customer", 499, 1)}
    out = {r.id: r for r in importer.mirror_with(known, imported, as_of).collect()}
    assert len(out) == 500 and out[ids[1]].data == "{}" and out[ids[10]].is_deleted and not out[ids[11]].is_deleted
    assert json.loads(out[ids[7]].data) == {"id": ids[7], "name": "n7", "created": 1_704_067_200, "deleted": False, "metadata": {"k": 7}, "object": "customer"}
    state = importer.import_state(objects, spark.createDataFrame([], STATE), as_of)
    assert state.where("sync_source = 'import'").count() == 500
