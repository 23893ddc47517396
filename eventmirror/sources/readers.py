"""Sources: deliveries, snapshots, event lists, legacy databases."""

from __future__ import annotations

import contextlib
from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import EVENTS, RAW_DELIVERIES, SNAPSHOT

# The tables a legacy mirror may hold, by object type.
LEGACY_TABLES = {
    "customer": "customers", "product": "products", "price": "prices", "subscription": "subscriptions", "subscription_item": "subscription_items",
    "invoice": "invoices", "charge": "charges", "payment_intent": "payment_intents", "payment_method": "payment_methods", "setup_intent": "setup_intents",
    "refund": "refunds", "dispute": "disputes", "checkout_session": "checkout_sessions",
}


def _reader(spark: SparkSession, path: str, schema, streaming: bool, options: dict) -> DataFrame:
    reader = (spark.readStream if streaming else spark.read).schema(schema).options(**options)
    return reader.json(path) if "json" in path.rsplit("/", 1)[-1].lower() else reader.parquet(path)


def read_raw_deliveries(spark: SparkSession, path: str, streaming: bool = False, **options: str) -> DataFrame:
    """header, body (binary), received_at from JSON lines (a name with `json` in it; bodies in base64) or Parquet."""
    return _reader(spark, path, RAW_DELIVERIES, streaming, options)


def select_snapshot(rows: DataFrame, object_types: Iterable[str] | None = None, since: int | None = None, status: str | None = None) -> DataFrame:
    """Upstream objects by type, created from `since` (epoch seconds) on, with one status; canceled
    subscriptions are included unless a status is asked for. An export with a column `created` (epoch seconds) is
    filtered by that, which its files can be skipped by; else the text is read."""
    if object_types is not None:
        rows = rows.where(F.col("object_type").isin(*object_types))
    if since is not None:
        created = F.col("created") if "created" in rows.columns else F.get_json_object("data", "$.created").try_cast("bigint")
        rows = rows.where(created >= since)
    if status is not None:
        rows = rows.where(F.get_json_object("data", "$.status") == status)
    return rows


def read_snapshot(spark: SparkSession, path: str, object_types: Iterable[str] | None = None, since: int | None = None, status: str | None = None) -> DataFrame:
    """select_snapshot() over Parquet files; if object_type is a partition column, it prunes them."""
    return select_snapshot(spark.read.parquet(path), object_types, since, status).select(*SNAPSHOT.names)


def select_listed_events(rows: DataFrame, window: tuple[datetime | Column, datetime | Column] | None = None, types: Iterable[str] | None = None) -> DataFrame:
    """Listed events created within the window, both ends included, and of the exact types."""
    if window is not None:
        ends = [w if isinstance(w, Column) else F.lit(w).cast("timestamp") for w in window]
        rows = rows.where(F.col("created").between(*ends))
    if types is not None:
        rows = rows.where(F.col("type").isin(*types))
    return rows


def read_listed_events(spark: SparkSession, path: str, window: tuple[datetime, datetime] | None = None, types: Iterable[str] | None = None) -> DataFrame:
    """select_listed_events() over Parquet files of upstream's event list."""
    return select_listed_events(spark.read.schema(EVENTS).parquet(path), window, types)


#: Ids that the bounds of a table's parts are drawn from, and parts of a table at most.
BOUND_SAMPLE, MOST_PARTS = 10_000, 256


@contextlib.contextmanager
def _connection(spark: SparkSession, jdbc: dict[str, str]):
    """A connection of the driver's, for the database's catalogue and for a few bounds."""
    if "driver" in jdbc:
        spark._jvm.java.lang.Class.forName(jdbc["driver"])
    own = spark._jvm.java.util.Properties()
    for k in ("user", "password"):
        if k in jdbc:
            own.setProperty(k, jdbc[k])
    connection = spark._jvm.java.sql.DriverManager.getConnection(jdbc["url"], own)
    try:
        yield connection
    finally:
        connection.close()


def _strings(result, column: int) -> list[str]:
    out = []
    while result.next():
        out.append(result.getString(column))
    return out


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def key_ranges(spark: SparkSession, jdbc: dict[str, str], table: str, parts: int, key: str = "id") -> list[str]:
    """Conditions that cut the table into about `parts` equal ranges of its key, each row in just one; rows of a null key are in the first.

    The bounds are quantiles of a bounded sample of the keys (the BOUND_SAMPLE of smallest hash), which are read alone, and their order
    is the database's own, whatever its collation.
    """
    keys = spark.read.format("jdbc").options(**jdbc).option("dbtable", f"(SELECT {key} FROM {table}) k").load()
    name = keys.columns[0]
    sample = sorted({r[0] for r in keys.where(F.col(name).isNotNull()).orderBy(F.xxhash64(name)).limit(BOUND_SAMPLE).collect()})
    parts = min(parts, MOST_PARTS)
    some = sorted({sample[i * len(sample) // parts] for i in range(1, parts)}) if len(sample) >= parts else []
    if not some:
        return []
    with _connection(spark, jdbc) as connection:
        statement = connection.createStatement()
        bounds = list(dict.fromkeys(_strings(statement.executeQuery(f"SELECT {key} FROM {table} WHERE {key} IN ({', '.join(map(_quoted, some))}) ORDER BY {key}"), 1)))
    inner = [f"{key} >= {_quoted(a)} AND {key} < {_quoted(b)}" for a, b in zip(bounds, bounds[1:])]
    return [f"{key} < {_quoted(bounds[0])} OR {key} IS NULL", *inner, f"{key} >= {_quoted(bounds[-1])}"]


def read_legacy_tables(spark: SparkSession, schema: str, jdbc: dict[str, str] | None = None, parts: int = 16) -> dict[str, DataFrame]:
    """The known tables that a legacy schema holds, by object type, with columns in lower case: from the catalog, or over JDBC with
    these options (url, and user, password, driver where needed).

    Over JDBC the tables are found in the database's catalogue, and each is read in about `parts` ranges of its id at once. A small
    table, or one of fewer ids than that, is read in one.
    """
    if jdbc is None:
        present = {t.name for t in spark.catalog.listTables(schema)}
        return {kind: spark.table(f"{schema}.{name}") for kind, name in LEGACY_TABLES.items() if name in present}
    with _connection(spark, jdbc) as connection:
        tables = connection.getMetaData().getTables(None, None, "%", None)
        present = {}
        while tables.next():
            if (tables.getString("TABLE_SCHEM") or "").lower() == schema.lower():
                present[tables.getString("TABLE_NAME").lower()] = f"{tables.getString('TABLE_SCHEM')}.{tables.getString('TABLE_NAME')}"
    out = {}
    properties = {k: v for k, v in jdbc.items() if k != "url"}
    for kind, name in LEGACY_TABLES.items():
        if name in present:
            ranges = key_ranges(spark, jdbc, present[name], parts)
            rows = spark.read.jdbc(jdbc["url"], present[name], predicates=ranges, properties=properties) if ranges else spark.read.jdbc(jdbc["url"], present[name], properties=properties)
            out[kind] = rows.toDF(*[c.lower() for c in rows.columns])
    return out
