import datetime as dt
import hashlib
import hmac
import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from eventmirror.functions.event_types import BACKFILL_TYPES, VERIFY_TYPES, plan, resolve_type, subscribed_types
from eventmirror.functions.json_equal import VOLATILE, canonical_json, json_equal, same_json
from eventmirror.functions.payload import after, event_newer
from eventmirror.functions.signatures import signature_status
from eventmirror.operators.ingest import parse_envelope, resolve_event

UTC = dt.UTC
T0 = dt.datetime(2026, 1, 1, tzinfo=UTC)


def at(seconds):
    return None if seconds is None else T0 + dt.timedelta(seconds=seconds)


def test_resolve_type(spark):
    known = {
        "customer.created": "customer", "customer.subscription.created": "subscription", "customer.subscription.brand_new": "subscription", "invoice.paid": "invoice",
        "charge.dispute.closed": "dispute", "charge.refund.updated": "refund", "charge.succeeded": "charge", "payment_intent.x": "payment_intent", "setup_intent.created": "setup_intent",
        "payment_method.attached": "payment_method", "checkout.session.expired": "checkout_session", "price.updated": "price", "product.deleted": "product", "refund.failed": "refund",
    }
    unknown = ["customer.tax_id.created", "charge.captured.something", "invoiceitem.created", "", "customer", "charge.refund.created", "customer.subscription", "checkout.session.opened", "plan.created", "Customer.created", "payment_method.x", None]
    rows = spark.createDataFrame([(t,) for t in [*known, *unknown]], "type string").select("type", resolve_type(F.col("type")).alias("kind")).collect()
    assert {r.type: r.kind for r in rows} == known | dict.fromkeys(unknown)


def test_subscribed_types_and_plan():
    names = subscribed_types()
    assert len(names) == len(set(names)) == 62 and names == sorted(names)
    assert len(BACKFILL_TYPES) == 12 and len(VERIFY_TYPES) == 11
    assert plan(["charge", "product"]) == ["product", "charge"]
    assert plan() == list(BACKFILL_TYPES)
    with pytest.raises(ValueError):
        plan(["subscription_item"])
    with pytest.raises(ValueError):
        plan(["payment_method"], VERIFY_TYPES)


def test_resolve_event(spark):
    rows = [("customer.created", '{"data":{"object":{"id":"cus_1"}}}', "mapped"), ("plan.created", '{"data":{"object":{"id":"p"}}}', "unknown"), ("customer.created", '{"data":{"object":{}}}', "malformed"), ("customer.created", "no json", "malformed"), ("customer.created", None, "malformed")]
    out = resolve_event(spark.createDataFrame(rows, "type string, payload string, want string")).collect()
    assert [r.resolve_status for r in out] == [r.want for r in out] and len(out) == 5


def sign(t, body, secret="s1"):
    return hmac.new(secret.encode(), f"{t}.".encode() + body, hashlib.sha256).hexdigest()


def test_signatures(spark):
    body, t = b'{"id":"evt"}', int(T0.timestamp())
    good = sign(t, body)
    cases = [
        (f"t={t},v1={good}", body, "ok"), (f"t={t}, v1={good}", body, "ok"), (f"t={t},v1={good.upper()}", body, "ok"),
        (f"t={t},v1={sign(t, body, 's2')}", body, "ok"), (f"t={t},v1={sign(t, body, 'bad')}", body, "no_match"), (f"t={t},v1={good}", body + b" ", "no_match"),
        (None, body, "missing_header"), ("", body, "missing_header"), ("garbage", body, "malformed"), (f"t={t}", body, "malformed"), (f"v1={good}", body, "malformed"),
        (f"t={t},t={t},v1={good}", body, "malformed"), (f"t=x,v1={good}", body, "malformed"), (f"t={t},v1=zz,v1={good}", body, "ok"), (f"t={t},v1=zz", body, "malformed"),
        (f"t={t},v1=00,v1={good},v0=1", body, "ok"), (f"t={t - 300},v1={sign(t - 300, body)}", body, "ok"), (f"t={t - 301},v1={sign(t - 301, body)}", body, "out_of_range"),
        (f"t={t + 301},v1={sign(t + 301, body)}", body, "out_of_range"), (f"t={t},v1={sign(t, bytes([255, 0, 254]))}", bytes([255, 0, 254]), "ok"), (f"t={t},v1={sign(t, b'')}", b"", "ok"),
    ]
    df = spark.createDataFrame([(i, h, bytearray(b), T0, w) for i, (h, b, w) in enumerate(cases)], "i int, header string, body binary, received_at timestamp, want string")
    out = df.select("i", "want", signature_status(F.col("header"), F.col("body"), F.col("received_at"), ["s1", "s2"]).alias("got")).collect()
    assert [(r.i, r.got) for r in out if r.got != r.want] == []


def test_long_secret_and_no_secret(spark):
    body, t, secret = b"x", int(T0.timestamp()), "k" * 100
    df = spark.createDataFrame([(f"t={t},v1={sign(t, body, secret)}", bytearray(body), T0)], "header string, body binary, received_at timestamp")
    status = lambda s: df.select(signature_status(F.col("header"), F.col("body"), F.col("received_at"), s)).first()[0]
    assert status([secret]) == "ok" and status(["", secret]) == "ok" and status([]) == "no_match"


def test_parse_envelope(spark):
    bodies = [b'{"id":"e1","type":"a","api_version":"","created":5,"livemode":true,"data":{}}', b'{"id":"","type":"a"}', b'{"id":"e"}', b"[1]", b"nope", b"", b'{"id":"e","type":"t","pad":"' + b"x" * (1 << 20) + b'"}']
    df = spark.createDataFrame([(None, bytearray(b), T0) for b in bodies], "header string, body binary, received_at timestamp")
    out = parse_envelope(df).collect()
    assert [r.parse_status for r in out] == ["ok", "bad_envelope", "bad_envelope", "bad_envelope", "bad_envelope", "bad_envelope", "too_large"]
    assert (out[0].event_id, out[0].api_version, out[0].created, out[0].livemode) == ("e1", None, dt.datetime(1970, 1, 1, 0, 0, 5), True)


def test_event_newer_is_tuple_order(spark):
    rnd = random.Random(4)
    pairs = [(rnd.randrange(5), rnd.choice("abcB"), rnd.randrange(5), rnd.choice("abcB")) for _ in range(2000)]
    df = spark.createDataFrame([(at(a), i, at(b), j) for a, i, b, j in pairs], "c timestamp, i string, lc timestamp, li string")
    got = [tuple(r) for r in df.select(event_newer(F.col("c"), F.col("i"), F.col("lc"), F.col("li")), after(F.col("c"), F.col("i"), F.col("lc"), F.col("li"))).collect()]
    assert got == [((a, i) > (b, j),) * 2 for a, i, b, j in pairs]


def test_event_newer_nulls(spark):
    values = [(c, i) for c in (None, 1, 2) for i in (None, "a", "b")]

    def model(new, last):
        if new[0] is None:
            return False
        if last[0] is None or new[0] > last[0]:
            return True
        return new[0] == last[0] and new[1] is not None and (last[1] is None or new[1] > last[1])

    cases = list(itertools.product(values, values))
    df = spark.createDataFrame([(at(a[0]), a[1], at(b[0]), b[1]) for a, b in cases], "c timestamp, i string, lc timestamp, li string")
    assert [r[0] for r in df.select(event_newer(F.col("c"), F.col("i"), F.col("lc"), F.col("li"))).collect()] == [model(a, b) for a, b in cases]


def test_json_equal(spark):
    cases = [
        ('{"a":1,"b":[1,2]}', '{ "b" : [1,2], "a" : 1.0 }', "x", True), ('{"a":[1,2]}', '{"a":[2,1]}', "x", False), ('{"a":null}', "{}", "x", False), ("nope", "nope", "x", False),
        ('{"n":100}', '{"n":1e2}', "x", True), ('{"n":9007199254740993}', '{"n":9007199254740992}', "x", True), ('{"receipt_url":1,"a":{"receipt_url":2}}', '{"a":{}}', "charge", True),
        ('{"receipt_url":1}', "{}", "invoice", False), ('{"invoice_pdf":1,"lines":[{"hosted_invoice_url":2}]}', '{"lines":[{}]}', "invoice", True), ('{"a":true}', '{"a":1}', "x", False), (None, "{}", "x", False), ('{"a":"é"}', '{"a":"\\u00e9"}', "x", True),
    ]
    df = spark.createDataFrame(cases, "a string, b string, t string, want boolean")
    assert [r for r in df.select("*", json_equal(F.col("a"), F.col("b"), F.col("t")).alias("got")).collect() if r.got != r.want] == []
    strict = spark.createDataFrame([("9007199254740993", "9007199254740992")], "a string, b string")
    assert not strict.select(json_equal(F.col("a"), F.col("b"), F.lit("x"), strict_ints=True)).first()[0]
    assert strict.select(canonical_json(F.lit('{"b":{"c":null},"a":null}'), F.lit("x"), nulls=False)).first()[0] == '{"b":{}}'


def plain_canonical(text, kind):
    """The canonical form by Python's own reader; None for no JSON."""

    def clean(x):
        if isinstance(x, dict):
            return {k: clean(v) for k, v in x.items() if k not in VOLATILE.get(kind, ())}
        if isinstance(x, list):
            return [clean(v) for v in x]
        return x if isinstance(x, (bool, str)) or x is None else float(x)

    def refuse(name):
        raise ValueError(name)

    try:
        return json.dumps(clean(json.loads(text, parse_constant=refuse)), sort_keys=True, allow_nan=False)
    except (ValueError, TypeError, OverflowError):
        return None


def test_json_equal_against_plain_python(spark):
    rnd = random.Random(8)
    names = ["a", "b", "receipt_url", "invoice_pdf", "é", 'q"', "back\\", "x,y", "{", "receipt_url:"]
    scalars = ["null", "true", "1", "1.0", "1.50", "1.5", "1e2", "100", "-0", "0", "1E-7", "0.0000001", "12345678901234567890", "12345678901234567891.0", '"1"', '"a,null}"', '":null,"', '"\\\\"', '"\\\""', '"\\u00e9"', '"é"', '"receipt_url"', '""']

    def value(depth):
        kind = rnd.randrange(4 if depth else 2)
        if kind < 2:
            return rnd.choice(scalars)
        if kind == 2:
            return "[" + rnd.choice([",", " , "]).join(value(depth - 1) for _ in range(rnd.randrange(4))) + "]"
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=rnd.random() < 0.5)}: {value(depth - 1)}" for k in rnd.choices(names, k=rnd.randrange(5))) + "}"

    def shuffled(text):
        def walk(x):
            if isinstance(x, dict):
                keys = list(x)
                rnd.shuffle(keys)
                return {k: walk(x[k]) for k in keys}
            return [walk(v) for v in x] if isinstance(x, list) else x

        return json.dumps(walk(json.loads(text)), ensure_ascii=rnd.random() < 0.5)

    texts = [value(4) for _ in range(300)]
    odd = ["{bad", '{"a":NaN}', '{"a":1e999}', '{"a":-1e999}', '{"a":"Infinity"}', "", " ", '{"a":1} x', '{"a":1}}', "[1] [2]", "1] [2", "1} x", "1,2", '1,"a":2', '{"a":01}', "{'a':1}", '{"a":1,"a":2}', '{"a":2}', '{"a":"\t"}', None]
    pairs = [(t, t) for t in texts[:40] + odd] + [(t, shuffled(t)) for t in texts] + list(zip(texts, texts[1:])) + list(itertools.product(odd, odd))
    # The same object with other volatile fields, at any depth.
    deep = ['{"a":[{"receipt_url":%s,"b":{"receipt_url":%s}},{"invoice_pdf":%s}]}' % tuple(rnd.choice([*scalars, value(3)]) for _ in range(3)) for _ in range(60)]
    pairs += list(zip(deep, deep[1:]))
    rows = [(a, b, kind, plain_canonical(a, kind) is not None and plain_canonical(a, kind) == plain_canonical(b, kind)) for a, b in pairs for kind in ("charge", "invoice", "x")]
    df = spark.createDataFrame(rows, "a string, b string, t string, want boolean")
    got = df.select("*", json_equal(F.col("a"), F.col("b"), F.col("t")).alias("got"), same_json("a", "b", F.col("t")).alias("quick"))
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    assert [r for r in got.collect() if not (r.got == r.quick == r.want)] == []
    assert 100 < sum(r[3] for r in rows) < len(rows) - 100


def test_canonical_json_is_json(spark):
    rows = [('{"b":1.5,"a":{"receipt_url":null,"x":[null,{"y":null}]},"z":null}', '{"a":{"x":[null,{}]},"b":1.5}'), ('{"a":null,"b":null,"c":1,"d":null,"e":null}', '{"c":1}'), ('{"a":null}', "{}"), ('{"a":":null,","b":null}', '{"a":":null,"}'), ("[null]", "[null]")]
    df = spark.createDataFrame(rows, "t string, want string").select("want", canonical_json(F.col("t"), F.lit("charge"), nulls=False).alias("got"))
    assert [r for r in df.collect() if r.got != r.want] == []


def test_envelopes_are_read_by_type(spark):
    good = '{"id":"e","type":"t","created":5,"livemode":true,"api_version":"v","data":{"object":{"id":"o"}}}'
    cases = {
        good: "ok", good.replace("}}}", '},"object":{"id":"p"}}}'): "ok", '{"id":"x","id":"e","type":"t","created":5}': "ok", '{"id":"e","type":"t"}': "ok", '{"id":"e","type":"t","created":null,"livemode":null,"data":null}': "ok",
        '{"id":"e","type":"t","data":{"object":null}}': "ok", '{"id":"e","type":"t","data":{"object":{"id":null}}}': "ok",
        **dict.fromkeys([
            good.replace("5", '"x"'), good.replace("5", "1.0"), good.replace("5", "1e3"), good.replace("5", "99999999999999999999"), good.replace('"e"', "5"), good.replace('"t"', "true"), good.replace("true", '"true"'), good.replace("true", "1"),
            good.replace('"v"', "1"), good.replace('"o"', "7"), '{"id":"e","type":"t","data":[]}', '{"id":"e","type":"t","data":{"object":"x"}}', good + "x", good + "}", f"[{good}]", '"e"', "null", "", '{"id":"","type":"t"}', '{"id":"e"}', '{"id":"e","type":null}', "{bad",
        ], "bad_envelope"),
    }
    df = spark.createDataFrame([(k, T0) for k in cases], "body string, received_at timestamp")
    got = {r.payload: r for r in parse_envelope(df).collect()}
    assert {k: r.parse_status for k, r in got.items()} == cases
    r = got[good]
    assert (r.event_id, r.type, r.api_version, r.created.timestamp() if r.created.tzinfo else r.created.replace(tzinfo=UTC).timestamp(), r.livemode) == ("e", "t", "v", 5, True)
    assert got['{"id":"x","id":"e","type":"t","created":5}'].event_id == "e" and all(r.event_id is None for k, r in got.items() if cases[k] != "ok" and k not in ('{"id":"","type":"t"}', '{"id":"e"}', '{"id":"e","type":null}'))
