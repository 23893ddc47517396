"""The driver's tables as event logs, upstream exports and mirrors. Times do not depend on the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import MIRROR

#: The moment that stands for now: the end of the month of events.
AS_OF = 1_706_745_600
HALF_TIME = AS_OF - 16 * 86_400
TYPES = {"signup": "customer.created", "view": "customer.updated", "click": "customer.subscription.updated", "purchase": "charge.succeeded", "error": "plan.created"}
PREFIX = {"signup": "cus_", "view": "cus_", "click": "sub_", "purchase": "ch_", "error": "plan_"}


def as_of() -> Column:
    return F.timestamp_seconds(F.lit(AS_OF))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(ts: Column) -> Column:
    """Epoch seconds of a timestamp without zone."""
    return F.timestamp_diff("SECOND", F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")), ts)


def cents(x: Column) -> Column:
    return F.round(x * 100).cast("bigint")


def _pick(mapping: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])[F.col("event_type")]


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of events as a webhook event. created is the day, so ties are frequent; every 37th deletes; every
    third is processed."""
    e = _table(spark, sf_dir, "events")
    received = seconds(F.col("ts"))
    created = received - F.pmod(received, F.lit(86_400))
    name = lambda n: F.concat(F.lit("evt_"), F.lpad(n.cast("string"), 10, "0"))
    body = F.struct(
        F.concat(_pick(PREFIX), F.col("user_id").cast("string")).alias("id"),
        F.when(F.col("event_type").isin("signup", "view"), "customer").when(F.col("event_type") == "click", "subscription").when(F.col("event_type") == "purchase", "charge").otherwise("plan").alias("object"),
        F.concat(F.lit("u"), F.col("event_id").cast("string"), F.lit("@example.com")).alias("email"),
        F.concat(F.lit("cus_"), F.col("user_id").cast("string")).alias("customer"),
        F.when(F.col("event_id") % 3 == 0, "active").when(F.col("event_id") % 3 == 1, "canceled").otherwise("trialing").alias("status"),
        cents(F.col("value")).alias("amount"), created.alias("created"),
        F.when(F.col("event_id") % 37 == 0, True).alias("deleted"),
    )
    event_id = name(F.col("event_id"))
    payload = F.to_json(F.struct(event_id.alias("id"), _pick(TYPES).alias("type"), F.lit("2024-01-01").alias("api_version"), created.alias("created"), F.lit(False).alias("livemode"), F.struct(body.alias("object")).alias("data")))
    at = F.timestamp_seconds(received)
    return e.select(
        event_id.alias("event_id"), _pick(TYPES).alias("type"), F.lit("2024-01-01").alias("api_version"), F.lit("acct_1").alias("account_id"), F.timestamp_seconds(created).alias("created"),
        at.alias("received_at"), F.lit("webhook").alias("source"), payload.alias("payload"), F.when(F.col("event_id") % 3 == 0, at).alias("processed_at"), F.lit(False).alias("livemode"),
    )


def number(event_id: Column) -> Column:
    return F.substring(event_id, 5, 10).cast("bigint")


def early(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events created in the first half of the month, which a log already holds."""
    return event_log(spark, sf_dir).where(F.col("created") < F.timestamp_seconds(F.lit(HALF_TIME)))


def redelivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log and every fifth event again, an hour later, from a sweep."""
    log = event_log(spark, sf_dir)
    again = log.where(number(F.col("event_id")) % 5 == 0).withColumns({"received_at": F.timestamp_seconds(F.unix_seconds("received_at") + 3600), "source": F.lit("sweep")})
    return log.unionByName(again)


def delivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log without every eleventh event, which never arrived."""
    return event_log(spark, sf_dir).where(number(F.col("event_id")) % 11 != 0)


def half(spark: SparkSession, sf_dir: str, first: bool) -> DataFrame:
    """Two batches that cut the log by a hash of the id, so that order is mixed."""
    return event_log(spark, sf_dir).where((F.substring(F.md5("event_id"), 1, 1) < "8") == F.lit(first))


def raw_deliveries(spark: SparkSession, sf_dir: str, secret: str) -> DataFrame:
    """The redelivered log as signed deliveries. Every 13th signature is wrong, every 17th header is missing,
    every 19th has no v1 and every 23rd is stale."""
    rows = redelivered(spark, sf_dir)
    n, t = number(F.col("event_id")), F.unix_seconds("received_at") - F.when(number(F.col("event_id")) % 23 == 0, 1000).otherwise(0)
    from ..functions.signatures import _hmac

    mac = _hmac(F.encode(F.concat(t.cast("string"), F.lit("."), F.col("payload")), "utf-8"), secret)
    mac = F.when(n % 13 == 0, F.reverse(mac)).otherwise(mac)
    header = F.when(n % 17 == 0, F.lit(None)).when(n % 19 == 0, F.concat(F.lit("t="), t.cast("string"))).otherwise(F.concat(F.lit("t="), t.cast("string"), F.lit(",v1="), mac, F.lit(",v0=00")))
    return rows.select(header.alias("header"), F.encode("payload", "utf-8").alias("body"), "received_at")


def _charges(spark: SparkSession, sf_dir: str, mine: bool) -> DataFrame:
    o = _table(spark, sf_dir, "orders")
    m = F.col("o_orderkey") % 50
    amount = cents(F.col("o_totalprice")) + (F.when(m == 1, 1).otherwise(0) if mine else F.lit(0))
    url = F.concat(F.lit("https://r.example/"), F.when(m == 2, "old/").otherwise("") if mine else F.lit(""), F.col("o_orderkey").cast("string"))
    data = F.struct(
        F.concat(F.lit("ch_"), F.col("o_orderkey").cast("string")).alias("id"), F.lit("charge").alias("object"), amount.alias("amount"), F.lit("usd").alias("currency"),
        F.concat(F.lit("cus_"), F.col("o_custkey").cast("string")).alias("customer"), F.lower("o_orderstatus").alias("status"), (F.col("o_orderstatus") == "F").alias("paid"),
        url.alias("receipt_url"), seconds(F.col("o_orderdate")).alias("created"),
    )
    # The mirror's text has other key order, so that equality is structural.
    turned = F.struct(*[data[c].alias(c) for c in ("created", "receipt_url", "paid", "status", "customer", "currency", "amount", "object", "id")])
    return o.select(m.alias("m"), F.lit("charge").alias("object_type"), data["id"].alias("id"), F.to_json(turned if mine else data).alias("data"))


def charge_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upstream's charges: all orders but those of remainder 4."""
    return _charges(spark, sf_dir, False).where("m <> 4").select("object_type", "id", "data")


def charge_mirror(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mirror's: remainder 0 is absent, 1 has another amount, 2 another receipt_url, 3 is deleted."""
    gone = F.col("m") == 3
    at = F.timestamp_seconds(F.lit(AS_OF - 86_400) + F.col("m") * 3600)
    return _charges(spark, sf_dir, True).where("m <> 0").select("object_type", "id", "data", F.lit("acct_1").alias("account_id"), gone.alias("is_deleted"), F.when(gone, at).alias("deleted_at"), at.alias("updated_at")).select(*MIRROR.names)


def charge_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of the mirror's charges: every third was changed by an event after AS_OF - 1000."""
    k = F.substring("id", 4, 20).cast("bigint")
    created = F.timestamp_seconds(F.lit(AS_OF) - F.when(k % 3 == 0, 0).otherwise(2000))
    return charge_mirror(spark, sf_dir).select(
        "object_type", F.col("id").alias("object_id"), as_of().alias("last_synced_at"), created.alias("last_event_created"), F.concat(F.lit("evt_"), F.col("id")).alias("last_event_id"),
        F.lit("payload").alias("sync_source"), F.lit(0).alias("fetch_failures"), created.alias("data_event_created"), F.concat(F.lit("evt_"), F.col("id")).alias("data_event_id"),
    )


def subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, data of a subscription per order, with up to two of its items embedded and has_more if there are others."""
    # Numbers are collected, and texts made of the two items that are embedded alone.
    items = _lines(spark, sf_dir).groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(F.col("l_linenumber").cast("int").alias("n"), "l_linenumber", "x"))).alias("all"))
    o = _table(spark, sf_dir, "orders").withColumn("subscription", F.concat(F.lit("sub_"), F.col("o_orderkey").cast("string")))
    status = F.when(F.col("o_orderstatus") == "F", "active").when(F.col("o_orderstatus") == "O", "trialing").otherwise("canceled")
    head = F.to_json(F.struct(F.col("subscription").alias("id"), F.lit("subscription").alias("object"), F.concat(F.lit("cus_"), F.col("o_custkey").cast("string")).alias("customer"), status.alias("status"), seconds(F.col("o_orderdate")).alias("created")))
    size = F.coalesce(F.size("all"), F.lit(0))
    item = lambda i: _item_text(F.col("o_orderkey"), *[F.get("all", F.lit(i))[c] for c in ("l_linenumber", "x")])
    some = F.when(size > 1, F.concat(item(0), F.lit(","), item(1))).when(size == 1, item(0)).otherwise("")
    tail = F.concat(F.lit(',"items":{"data":['), some, F.lit('],"has_more":'), (size > 2).cast("string"), F.lit("}}"))
    return o.join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.col("subscription").alias("id"), F.concat(F.substring(head, F.lit(1), F.length(head) - 1), tail).alias("data"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """l_orderkey, l_linenumber, x (l_quantity, l_partkey): an item's numbers, dealt out once by their order, so that what groups or joins by it moves
    them no more. Line numbers repeat within an order; of equal ones the largest quantity stays."""
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_partkey").repartition("l_orderkey")
    return lines.groupBy("l_orderkey", "l_linenumber").agg(F.max(F.struct("l_quantity", "l_partkey")).alias("x"))


def _item_id(order: Column, line: Column) -> Column:
    return F.concat(F.lit("si_"), order.cast("string"), F.lit("_"), line.cast("string"))


def _item_text(order: Column, line: Column, x: Column) -> Column:
    subscription = F.concat(F.lit("sub_"), order.cast("string"))
    item, price, quantity = _item_id(order, line), F.concat(F.lit("price_"), x["l_partkey"].cast("string")), x["l_quantity"].cast("bigint")
    whole = F.to_json(F.struct(item.alias("id"), F.lit("subscription_item").alias("object"), subscription.alias("subscription"), F.struct(price.alias("id")).alias("price"), quantity.alias("quantity")))
    # The same text without a JSON writer; it is null if one of the fields is, which the writer leaves out.
    plain = F.concat(F.lit('{"id":"'), item, F.lit('","object":"subscription_item","subscription":"'), subscription, F.lit('","price":{"id":"'), price, F.lit('"},"quantity":'), quantity.cast("string"), F.lit("}"))
    return F.coalesce(plain, whole)


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """l_orderkey, subscription, n, id, data: the complete items."""
    order, line = F.col("l_orderkey"), F.col("l_linenumber")
    subscription = F.concat(F.lit("sub_"), order.cast("string"))
    return _lines(spark, sf_dir).select("l_orderkey", subscription.alias("subscription"), line.cast("int").alias("n"), _item_id(order, line).alias("id"), _item_text(order, line, F.col("x")).alias("data"))


def item_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """subscription, n, id, data: the complete items."""
    return _items(spark, sf_dir).select("subscription", "n", "id", "data")


def subscription_mirror(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subscriptions in a mirror; every seventh order's is deleted."""
    key = F.substring("id", 5, 20).cast("bigint")
    gone = key % 7 == 0
    return subscriptions(spark, sf_dir).select(
        F.lit("subscription").alias("object_type"), "id", "data", F.lit("acct_1").alias("account_id"), gone.alias("is_deleted"), F.when(gone, as_of()).alias("deleted_at"), F.timestamp_seconds(F.lit(AS_OF) - key % 1000).alias("updated_at")
    )


def _customers(spark: SparkSession, sf_dir: str, mine: bool) -> DataFrame:
    k = F.col("c_custkey")
    balance = cents(F.col("c_acctbal")) + (F.when(F.col("c_acctbal") < 0, 1).otherwise(0) if mine else F.lit(0))
    data = F.struct(
        F.concat(F.lit("cus_"), k.cast("string")).alias("id"), F.lit("customer").alias("object"), F.col("c_name").alias("name"), F.lit("usd").alias("currency"), balance.alias("balance"),
        (F.col("c_acctbal") < 0).alias("delinquent"), (F.lit(1_700_000_000) + k).alias("created"),
    )
    return _table(spark, sf_dir, "customer").select(F.lit("customer").alias("object_type"), data["id"].alias("id"), F.to_json(data).alias("data"), "c_mktsegment")


def in_mirror(rows: DataFrame) -> DataFrame:
    """object_type, id, data as live rows of the mirror."""
    none = F.lit(None)
    return rows.select("object_type", "id", "data", F.lit("acct_1").alias("account_id"), F.lit(False).alias("is_deleted"), none.cast("timestamp").alias("deleted_at"), as_of().alias("updated_at"))


def account_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upstream's charges, customers and subscriptions; payment methods and items have no listing of their own."""
    subs = subscriptions(spark, sf_dir).select(F.lit("subscription").alias("object_type"), "id", "data")
    return charge_snapshot(spark, sf_dir).unionByName(_customers(spark, sf_dir, False).select("object_type", "id", "data")).unionByName(subs)


def account_mirror(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mirror of the same account, payment methods and items included: customers with debts have another balance, those of
    the machinery segment are absent, and of charges and subscriptions differ those that their own tables name."""
    customers = in_mirror(_customers(spark, sf_dir, True).where("c_mktsegment <> 'MACHINERY'"))
    methods = in_mirror(payment_methods(spark, sf_dir).select(F.lit("payment_method").alias("object_type"), "id", "data"))
    items = in_mirror(item_listing(spark, sf_dir).select(F.lit("subscription_item").alias("object_type"), "id", "data"))
    return charge_mirror(spark, sf_dir).unionByName(customers).unionByName(subscription_mirror(spark, sf_dir)).unionByName(methods).unionByName(items)


def typed_objects(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Mirror rows of one of the object types that no other adapter makes."""
    text = lambda prefix, key: F.concat(F.lit(prefix), F.col(key).cast("string"))
    when = lambda name: seconds(F.col(name))
    amount = cents(F.col("o_totalprice"))
    paid = F.col("o_orderstatus") == "F"
    order = {"customer": text("cus_", "o_custkey"), "currency": F.lit("usd"), "created": when("o_orderdate"), "livemode": F.col("o_orderpriority") == "1-URGENT"}
    table, prefix, key, fields = {
        "product": ("part", "prod_", "p_partkey", {"name": F.col("p_name"), "active": F.col("p_size") > 10, "type": F.col("p_type"), "created": F.lit(1_700_000_000) + F.col("p_partkey")}),
        "price": ("part", "price_", "p_partkey", {
            "product": text("prod_", "p_partkey"), "active": F.col("p_size") > 10, "currency": F.lit("usd"), "unit_amount": cents(F.col("p_retailprice")),
            "recurring": F.when(F.col("p_size") > 25, F.struct(F.when(F.col("p_size") > 40, "year").otherwise("month").alias("interval"))), "type": F.when(F.col("p_size") > 25, "recurring").otherwise("one_time"),
        }),
        "invoice": ("orders", "in_", "o_orderkey", order | {
            "subscription": text("sub_", "o_orderkey"), "status": F.when(paid, "paid").otherwise("open"), "total": amount, "amount_paid": F.when(paid, amount).otherwise(0), "amount_due": F.when(paid, 0).otherwise(amount),
            "period_start": when("o_orderdate"), "period_end": when("o_orderdate") + 2_592_000, "number": text("N-", "o_orderkey"),
        }),
        "payment_intent": ("orders", "pi_", "o_orderkey", order | {"status": F.when(paid, "succeeded").otherwise("processing"), "amount": amount, "latest_charge": F.when(paid, text("ch_", "o_orderkey"))}),
        "setup_intent": ("customer", "seti_", "c_custkey", {"customer": text("cus_", "c_custkey"), "status": F.lower("c_mktsegment"), "payment_method": F.when(F.col("c_acctbal") > 0, text("pm_", "c_custkey"))}),
        "refund": ("lineitem", "re_", "l_orderkey", {
            "charge": text("ch_", "l_orderkey"), "payment_intent": text("pi_", "l_orderkey"), "status": F.lower("l_linestatus"), "amount": cents(F.col("l_extendedprice")), "currency": F.lit("usd"),
            "reason": F.when(F.col("l_returnflag") == "R", "requested_by_customer"), "created": when("l_shipdate"),
        }),
        "dispute": ("orders", "dp_", "o_orderkey", {
            "charge": text("ch_", "o_orderkey"), "payment_intent": text("pi_", "o_orderkey"), "status": F.lower("o_orderstatus"), "amount": amount, "currency": F.lit("usd"), "reason": F.lower("o_orderpriority"),
            "evidence_details": F.struct((when("o_orderdate") + 604_800).alias("due_by")), "created": when("o_orderdate"),
        }),
        "checkout_session": ("orders", "cs_", "o_orderkey", order | {
            "subscription": F.when(paid, text("sub_", "o_orderkey")), "payment_intent": text("pi_", "o_orderkey"), "status": F.when(paid, "complete").otherwise("open"), "mode": F.when(paid, "subscription").otherwise("payment"), "amount_total": amount,
        }),
    }[kind]
    one = text(prefix, key)
    data = F.to_json(F.struct(one.alias("id"), F.lit(kind).alias("object"), *[c.alias(n) for n, c in fields.items()]))
    return in_mirror(_table(spark, sf_dir, table).select(F.lit(kind).alias("object_type"), one.alias("id"), data.alias("data")))


def payment_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, data of a card per customer."""
    c = F.col("c_custkey").cast("string")
    data = F.to_json(F.struct(F.concat(F.lit("pm_"), c).alias("id"), F.lit("payment_method").alias("object"), F.concat(F.lit("cus_"), c).alias("customer"), F.lit("card").alias("type"), F.struct(F.lit("visa").alias("brand"), F.lpad((F.col("c_custkey") % 10_000).cast("string"), 4, "0").alias("last4")).alias("card")))
    return _table(spark, sf_dir, "customer").select(F.concat(F.lit("pm_"), c).alias("id"), data.alias("data"))


def legacy_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A legacy customers table: typed columns, JSON metadata with nulls, a time, bookkeeping."""
    k = F.col("c_custkey")
    return _table(spark, sf_dir, "customer").select(
        F.concat(F.lit("cus_"), k.cast("string")).alias("id"), F.col("c_name").alias("name"), F.when(k % 4 != 0, F.concat(F.lit("c"), k.cast("string"), F.lit("@example.com"))).alias("email"),
        F.concat(F.lit('{"seg":"'), F.col("c_mktsegment"), F.lit('","none":null,"deep":{"a":null,"b":'), k.cast("string"), F.lit("}}")).alias("metadata"),
        F.when(k % 5 != 0, F.timestamp_micros(F.lit(1_700_000_000_000_000) + k * 1_600_000)).alias("created"),
        (k % 9 == 0).alias("deleted"), as_of().alias("updated_at"),
    )


def legacy_mirror(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mirror that already holds every third legacy customer."""
    k = F.substring("id", 5, 20).cast("bigint")
    return legacy_customers(spark, sf_dir).where(k % 3 == 0).select(F.lit("customer").alias("object_type"), "id", F.lit("{}").alias("data"), F.lit("acct_1").alias("account_id"), F.lit(False).alias("is_deleted"), F.lit(None).cast("timestamp").alias("deleted_at"), as_of().alias("updated_at"))
