"""DuckDB SQL for the registered queries, written from the operators' rules and not from their plans."""

from __future__ import annotations

from ..functions.event_types import VERIFY_TYPES

AS_OF = 1_706_745_600
HALF_TIME = AS_OF - 16 * 86_400
SECRET = b"whsec_test"
LOG = """
log AS (
  SELECT event_id AS n, 'evt_' || lpad(event_id::VARCHAR, 10, '0') AS event_id, user_id,
    CASE event_type WHEN 'signup' THEN 'customer.created' WHEN 'view' THEN 'customer.updated' WHEN 'click' THEN 'customer.subscription.updated'
      WHEN 'purchase' THEN 'charge.succeeded' ELSE 'plan.created' END AS type,
    CASE WHEN event_type IN ('signup', 'view') THEN 'customer' WHEN event_type = 'click' THEN 'subscription' WHEN event_type = 'purchase' THEN 'charge' END AS object_type,
    CASE WHEN event_type IN ('signup', 'view') THEN 'cus_' WHEN event_type = 'click' THEN 'sub_' WHEN event_type = 'purchase' THEN 'ch_' ELSE 'plan_' END || user_id AS object_id,
    epoch_us(ts) // 1000000 AS received_at, epoch_us(ts) // 86400000000 * 86400 AS created, round(value * 100)::BIGINT AS amount,
    'u' || event_id || '@example.com' AS email, event_id % 37 = 0 AS deletes, event_id % 3 = 0 AS done, 'webhook' AS source
  FROM events),
again AS (SELECT * FROM log UNION ALL SELECT * REPLACE (received_at + 3600 AS received_at, 'sweep' AS source) FROM log WHERE n % 5 = 0),
objects AS (SELECT * FROM log WHERE object_type IS NOT NULL)
"""
CHARGES = f"""
c AS (
  SELECT o_orderkey AS k, o_orderkey % 50 AS m, 'ch_' || o_orderkey AS id, round(o_totalprice * 100)::BIGINT AS amount, lower(o_orderstatus) AS status,
    o_orderstatus = 'F' AS paid, 'cus_' || o_custkey AS customer, epoch_us(o_orderdate) // 1000000 AS created FROM orders),
up AS (SELECT *, 'https://r.example/' || k AS url FROM c WHERE m <> 4),
mine AS (
  SELECT * REPLACE (amount + (m = 1)::INT AS amount), 'https://r.example/' || CASE WHEN m = 2 THEN 'old/' ELSE '' END || k AS url, m = 3 AS is_deleted,
    {AS_OF} - 86400 + m * 3600 AS updated_at, CASE WHEN m = 3 THEN {AS_OF} - 86400 + m * 3600 END::BIGINT AS deleted_at,
    CASE WHEN k % 3 = 0 THEN {AS_OF} ELSE {AS_OF} - 2000 END AS last_created FROM c WHERE m <> 0)
"""
DRIFT = """
d AS (
  SELECT coalesce(u.id, m.id) AS id, coalesce(u.created, m.created) AS created, u.id IS NOT NULL AS listed,
    CASE WHEN m.id IS NULL THEN 'missing' WHEN u.id IS NULL THEN 'orphaned' WHEN u.amount <> m.amount THEN 'stale' END AS kind
  FROM up u FULL JOIN (SELECT * FROM mine WHERE NOT is_deleted) m USING (k))
"""
SUBS = f"""
items AS (
  SELECT l_orderkey AS k, l_linenumber AS n, 'sub_' || l_orderkey AS subscription, 'si_' || l_orderkey || '_' || l_linenumber AS id,
    max(struct_pack(q := l_quantity, p := l_partkey)) AS x FROM lineitem GROUP BY ALL),
subs AS (
  SELECT o_orderkey AS k, 'sub_' || o_orderkey AS id, 'cus_' || o_custkey AS customer, epoch_us(o_orderdate) // 1000000 AS created,
    CASE o_orderstatus WHEN 'F' THEN 'active' WHEN 'O' THEN 'trialing' ELSE 'canceled' END AS status, o_orderkey % 7 = 0 AS is_deleted,
    {AS_OF} - o_orderkey % 1000 AS updated_at FROM orders)
"""
SWEEPS = """
sweeps AS (
  SELECT created // 86400 AS id, created AS started_at, created + 90000 AS finished_at, created AS window_from, created + 86400 AS window_to, count(*) AS events_seen,
    (created // 86400) % 5 AS gaps_found, CASE WHEN (created // 86400) % 7 = 0 THEN 'failed' ELSE 'done' END AS status FROM log GROUP BY created)
"""
FOLDED = """
folded AS (
  SELECT object_type, object_id, max(struct_pack(created := created, event_id := event_id, deletes := deletes)) AS l,
    max(struct_pack(created := created, event_id := event_id, email := email, amount := amount)) FILTER (NOT deletes) AS d
  FROM objects GROUP BY ALL)
"""
#: The account's customers, and every object that is listed or live with what is wrong with it.
CUSTOMERS = """
cust AS (SELECT 'cus_' || c_custkey AS id, 1700000000 + c_custkey AS created, round(c_acctbal * 100)::BIGINT AS balance, c_acctbal < 0 AND c_mktsegment <> 'MACHINERY' AS stale, c_mktsegment = 'MACHINERY' AS absent FROM customer)
"""
ACCOUNT = """
a AS (
  SELECT 'charge' AS object_type, id, created, kind IS DISTINCT FROM 'missing' AS live, kind FROM d
  UNION ALL SELECT 'subscription', id, created, NOT is_deleted, CASE WHEN is_deleted THEN 'missing' END FROM subs
  UNION ALL SELECT 'customer', id, created, NOT absent, CASE WHEN absent THEN 'missing' WHEN stale THEN 'stale' END FROM cust)
"""
ORDERS = """
o AS (
  SELECT o_orderkey AS k, 'cus_' || o_custkey AS customer, round(o_totalprice * 100)::BIGINT AS amount, o_orderstatus = 'F' AS paid, lower(o_orderstatus) AS status, lower(o_orderpriority) AS reason,
    o_orderpriority = '1-URGENT' AS urgent, epoch_us(o_orderdate) // 1000000 AS created FROM orders)
"""
HALF = "halves AS MATERIALIZED (SELECT *, substr(md5(event_id), 1, 1) < '8' AS first FROM objects)"


def hmac(message: str) -> str:
    """HMAC-SHA256 of a text column, from its definition."""
    inner, outer = ("".join(f"{b ^ pad:02x}" for b in SECRET.ljust(64, b"\0")) for pad in (0x36, 0x5C))
    return f"macs AS (SELECT *, sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({message})))) AS mac FROM signed)"


def over(*tables: str, select: str) -> str:
    return "WITH " + ", ".join(t.strip() for t in tables) + " " + select


SQL = {
    "live_customers": over(LOG, FOLDED, select="SELECT object_id AS id, d.email AS email, d.created AS created, NULL::BOOLEAN AS livemode FROM folded WHERE object_type = 'customer' AND d IS NOT NULL AND NOT l.deletes"),
    "s2_select_snapshot": over(CHARGES, select="SELECT id, amount FROM up WHERE created >= 820454400 AND status = 'f'"),
    "s3_listed_events": over(LOG, select=f"SELECT event_id, type, created FROM log WHERE created BETWEEN {AS_OF} - 864000 AND {AS_OF} - 432000 AND type <> 'plan.created'"),
    "p1_verify_signatures": over(LOG, select="SELECT event_id, received_at, CASE WHEN n % 17 = 0 THEN 'missing_header' WHEN n % 19 = 0 THEN 'malformed' WHEN n % 23 = 0 THEN 'out_of_range' WHEN n % 13 = 0 THEN 'no_match' ELSE 'ok' END AS sig_status FROM again"),
    "p2_parse_envelope": over(LOG, select="SELECT event_id, type, '2024-01-01' AS api_version, created, false AS livemode, 'ok' AS parse_status FROM again"),
    "p3_resolve_type": over(LOG, select="SELECT type, object_type, count(*) AS n FROM log GROUP BY ALL"),
    "p4_resolve_event": over(LOG, select="SELECT event_id, CASE WHEN object_type IS NULL THEN 'unknown' ELSE 'mapped' END AS resolve_status, object_type, object_id FROM log"),
    "p5_subscribed_types": over(LOG, select="SELECT type, count(*) AS n FROM log WHERE type <> 'plan.created' GROUP BY 1"),
    "p6_data_object": over(LOG, select="SELECT event_id, email, amount, deletes AS deleted FROM log"),
    "p7_typed_customer": over(LOG, FOLDED, select="SELECT object_id AS id, d.email AS email, NULL::VARCHAR AS name, NULL::VARCHAR AS currency, NULL::BOOLEAN AS delinquent, d.created AS created, NULL::BOOLEAN AS livemode, l.deletes AS is_deleted, 0::BIGINT AS errors FROM folded WHERE object_type = 'customer' AND d IS NOT NULL"),
    "p7_typed_charge": over(CHARGES, select="SELECT id, customer, NULL::VARCHAR AS invoice, status, amount, 'usd' AS currency, paid, NULL::BOOLEAN AS refunded, created, is_deleted FROM mine"),
    "p7_typed_subscription": over(SUBS, select="SELECT id, customer, status, NULL::BOOLEAN AS cancel_at_period_end, created, is_deleted FROM subs"),
    "p7_typed_payment_method": "SELECT 'pm_' || c_custkey AS id, 'cus_' || c_custkey AS customer, 'card' AS type, 'visa' AS card_brand, lpad((c_custkey % 10000)::VARCHAR, 4, '0') AS card_last4 FROM customer",
    "p7_typed_subscription_item": over(SUBS, select="SELECT id, subscription, 'price_' || x.p AS price, x.q::BIGINT AS quantity FROM items"),
    "p7_typed_product": "SELECT 'prod_' || p_partkey AS id, p_name AS name, p_size > 10 AS active, p_type AS type, 1700000000 + p_partkey AS created, 0::BIGINT AS errors FROM part",
    "p7_typed_price": "SELECT 'price_' || p_partkey AS id, 'prod_' || p_partkey AS product, p_size > 10 AS active, 'usd' AS currency, round(p_retailprice * 100)::BIGINT AS unit_amount, CASE WHEN p_size > 40 THEN 'year' WHEN p_size > 25 THEN 'month' END AS recurring_interval, CASE WHEN p_size > 25 THEN 'recurring' ELSE 'one_time' END AS type, 0::BIGINT AS errors FROM part",
    "p7_typed_invoice": over(ORDERS, select="SELECT 'in_' || k AS id, customer, 'sub_' || k AS subscription, CASE WHEN paid THEN 'paid' ELSE 'open' END AS status, amount AS total, CASE WHEN paid THEN amount ELSE 0 END AS amount_paid, CASE WHEN paid THEN 0 ELSE amount END AS amount_due, 'usd' AS currency, created AS period_start, created + 2592000 AS period_end, 'N-' || k AS number, urgent AS livemode, 0::BIGINT AS errors FROM o"),
    "p7_typed_payment_intent": over(ORDERS, select="SELECT 'pi_' || k AS id, customer, CASE WHEN paid THEN 'succeeded' ELSE 'processing' END AS status, amount, 'usd' AS currency, CASE WHEN paid THEN 'ch_' || k END AS latest_charge, created, 0::BIGINT AS errors FROM o"),
    "p7_typed_setup_intent": "SELECT 'seti_' || c_custkey AS id, 'cus_' || c_custkey AS customer, lower(c_mktsegment) AS status, CASE WHEN c_acctbal > 0 THEN 'pm_' || c_custkey END AS payment_method, NULL::BIGINT AS created, 0::BIGINT AS errors FROM customer",
    "p7_typed_refund": "SELECT 're_' || l_orderkey AS id, 'ch_' || l_orderkey AS charge, 'pi_' || l_orderkey AS payment_intent, lower(l_linestatus) AS status, round(l_extendedprice * 100)::BIGINT AS amount, 'usd' AS currency, CASE WHEN l_returnflag = 'R' THEN 'requested_by_customer' END AS reason, epoch_us(l_shipdate) // 1000000 AS created, 0::BIGINT AS errors FROM lineitem",
    "p7_typed_dispute": over(ORDERS, select="SELECT 'dp_' || k AS id, 'ch_' || k AS charge, 'pi_' || k AS payment_intent, status, amount, 'usd' AS currency, reason, created + 604800 AS evidence_due_by, created, 0::BIGINT AS errors FROM o"),
    "p7_typed_checkout_session": over(ORDERS, select="SELECT 'cs_' || k AS id, customer, CASE WHEN paid THEN 'sub_' || k END AS subscription, 'pi_' || k AS payment_intent, CASE WHEN paid THEN 'complete' ELSE 'open' END AS status, CASE WHEN paid THEN 'subscription' ELSE 'payment' END AS mode, amount AS amount_total, 'usd' AS currency, urgent AS livemode, 0::BIGINT AS errors FROM o"),
    "p8_show_event": over(LOG, select="SELECT event_id, type, source, created, received_at, email FROM log WHERE n = 42"),
    "d1_dedupe_events": over(LOG, select=f"SELECT event_id, received_at, source, CASE WHEN created < {HALF_TIME} OR source = 'sweep' THEN 'duplicate' ELSE 'inserted' END AS outcome FROM again"),
    "d2_ingest_outcomes": over(LOG, select=f"SELECT CASE WHEN n % 17 = 0 OR n % 19 = 0 OR n % 23 = 0 OR n % 13 = 0 THEN 'bad_signature' WHEN created < {HALF_TIME} OR source = 'sweep' THEN 'duplicate' ELSE 'inserted' END AS outcome, count(*) AS n FROM again GROUP BY 1"),
    "d2_ingest": over(LOG, select=f"SELECT event_id, received_at, CASE WHEN n % 17 = 0 OR n % 19 = 0 OR n % 23 = 0 OR n % 13 = 0 THEN 'bad_signature' WHEN created < {HALF_TIME} OR source = 'sweep' THEN 'duplicate' ELSE 'inserted' END AS outcome FROM again"),
    "d3_coalesce_work": over(LOG, select="SELECT object_type, object_id, max(created) AS latest_event_created, arg_max(event_id, struct_pack(c := created, e := event_id)) AS latest_event_id FROM objects GROUP BY ALL"),
    "d4_event_newer": over(LOG, HALF, "last AS (SELECT object_type, object_id, max(struct_pack(c := created, e := event_id)) AS w FROM halves WHERE first GROUP BY ALL)", select="SELECT event_id, coalesce(struct_pack(c := h.created, e := h.event_id) > w, true) AS newer FROM halves h LEFT JOIN last USING (object_type, object_id) WHERE NOT first"),
    "d5_fold_latest": over(LOG, FOLDED, select="SELECT object_type, object_id, l.created AS last_event_created, l.event_id AS last_event_id, l.deletes AS is_deleted, d.event_id AS data_event_id, d.email AS email, d.amount AS amount FROM folded"),
    "d6_apply_events": over(LOG, FOLDED, select="SELECT object_type, object_id, d IS NOT NULL AS in_mirror, CASE WHEN d IS NOT NULL THEN l.deletes END AS is_deleted, d.email AS email, l.created AS last_event_created, l.event_id AS last_event_id, d.event_id AS data_event_id, 'payload' AS sync_source FROM folded"),
    "d7_apply_snapshot": over(CHARGES, select=f"""
        SELECT coalesce(u.id, m.id) AS id, CASE WHEN u.id IS NOT NULL THEN u.amount ELSE m.amount END AS amount, u.id IS NULL AS is_deleted,
          {AS_OF}::BIGINT AS updated_at, CASE WHEN u.id IS NULL THEN {AS_OF} END::BIGINT AS deleted_at FROM up u FULL JOIN mine m USING (k)"""),
    "d8_merge_state": over(CHARGES, select=f"""
        SELECT coalesce(u.id, m.id) AS object_id, greatest(m.last_created, CASE WHEN u.id IS NOT NULL THEN {AS_OF} - 1000 END)::BIGINT AS last_event_created,
          CASE WHEN u.id IS NOT NULL AND {AS_OF} - 1000 > coalesce(m.last_created, 0) THEN 'evt_new' ELSE 'evt_' || m.id END AS last_event_id,
          CASE WHEN u.id IS NOT NULL THEN 'fetch' ELSE 'payload' END AS sync_source, {AS_OF}::BIGINT AS last_synced_at
        FROM up u FULL JOIN mine m USING (k)"""),
    "d9_mark_processed": over(LOG, HALF, "upto AS (SELECT object_id, max(created) AS upto FROM halves WHERE first GROUP BY 1)", select=f"SELECT event_id, CASE WHEN done THEN received_at WHEN created <= upto THEN {AS_OF} END::BIGINT AS processed_at FROM log LEFT JOIN upto USING (object_id)"),
    "d10_pending_work": over(LOG, HALF, "w AS (SELECT object_type, object_id, max(struct_pack(c := created, e := event_id)) AS w, max(struct_pack(c := created, e := event_id)) FILTER (first) AS s FROM halves GROUP BY ALL)", select="SELECT object_type, object_id, w.e AS latest_event_id FROM w WHERE s IS NULL OR w > s"),
    "u1_upsert_objects": over(CHARGES, select=f"""
        SELECT coalesce(u.id, m.id) AS id, coalesce(u.amount, m.amount) AS amount, CASE WHEN u.id IS NOT NULL THEN false ELSE m.is_deleted END AS is_deleted,
          CASE WHEN u.id IS NULL THEN m.deleted_at END AS deleted_at, CASE WHEN u.id IS NOT NULL THEN {AS_OF} ELSE m.updated_at END AS updated_at, CASE WHEN m.id IS NOT NULL THEN 'acct_1' END AS account_id
        FROM up u FULL JOIN mine m USING (k)"""),
    "u2_soft_delete": over(SUBS, select=f"""
        SELECT 'subscription' AS object_type, id, is_deleted OR status = 'trialing' AS is_deleted, CASE WHEN is_deleted OR status = 'trialing' THEN {AS_OF} END::BIGINT AS deleted_at,
          CASE WHEN NOT is_deleted AND status = 'trialing' THEN {AS_OF} ELSE updated_at END::BIGINT AS updated_at FROM subs
        UNION ALL SELECT 'subscription_item', i.id, coalesce(s.status = 'trialing' AND NOT s.is_deleted, false) AS gone, CASE WHEN gone THEN {AS_OF} END, {AS_OF} FROM items i LEFT JOIN subs s ON s.id = i.subscription"""),
    "u3_explode_items": over(SUBS, "c AS (SELECT k, count(*) AS c FROM items GROUP BY 1)", "listed AS (SELECT k, c, substr(md5('sub_' || k), 1, 1) <> '0' AS has FROM c)", select="""
        SELECT i.subscription, CASE WHEN c > 2 AND n = 3 AND k < 1000 THEN NULL ELSE i.id END AS item_id, CASE WHEN c > 2 AND n = 3 AND k < 1000 THEN 'no_id' ELSE 'ok' END AS status,
          CASE WHEN c > 2 AND n = 3 AND k < 1000 THEN 1 ELSE x.q END::BIGINT AS quantity, CASE WHEN c > 2 AND n = 3 AND k < 1000 THEN NULL ELSE 'price_' || x.p END AS price
        FROM items i JOIN subs s USING (k) JOIN listed USING (k) WHERE c <= 2 OR has
        UNION ALL SELECT s.id, NULL, 'incomplete', NULL, NULL FROM subs s JOIN listed USING (k) WHERE c > 2 AND NOT has"""),
    "u4_prune_items": over(SUBS, select=f"SELECT i.id, coalesce(s.status <> 'canceled', false) AND n = 2 AS is_deleted, CASE WHEN coalesce(s.status <> 'canceled', false) AND n = 2 THEN {AS_OF} END::BIGINT AS deleted_at, {AS_OF}::BIGINT AS updated_at FROM items i LEFT JOIN subs s USING (k)"),
    "g1_sweep_window": over(LOG, SWEEPS, select=f"SELECT least(max(window_to) - 600, {AS_OF} - 60) AS window_from, {AS_OF} - 60::BIGINT AS window_to FROM sweeps WHERE status = 'done'"),
    "g2_find_gaps": over(LOG, select=f"SELECT event_id, 'sweep' AS source, 'mapped' AS resolve_status, object_id, {AS_OF}::BIGINT AS detected_at, 7::BIGINT AS sweep_id, {AS_OF} - created AS lag_seconds FROM objects WHERE n % 11 = 0"),
    "g2_gap_work": over(LOG, select="SELECT object_type, object_id, arg_max(event_id, struct_pack(c := created, e := event_id)) AS latest_event_id FROM objects WHERE n % 11 = 0 GROUP BY ALL"),
    "g3_sweep_summary": over(LOG, select=f"SELECT 7::BIGINT AS id, count(*) AS events_seen, count(*) FILTER (n % 11 = 0) AS gaps_found, 'done' AS status, 1704067200::BIGINT AS window_from, {AS_OF}::BIGINT AS window_to FROM objects"),
    "g4_delivery_outage": over(LOG, select=f"SELECT count(*) FILTER (n % 11 = 0 AND object_type IS NOT NULL) AS gaps_found, count(*) FILTER (n % 11 <> 0 AND received_at BETWEEN {AS_OF} AND {AS_OF} + 3600) AS arrived, gaps_found > 0 AND arrived = 0 AS outage FROM log"),
    "g5_retention_risk": over(LOG, SWEEPS, select=f"SELECT id, {AS_OF} - window_from > 25 * 86400 AS risk FROM sweeps"),
    "b1_backfill": over(CHARGES, "w AS (SELECT u.*, m.last_created FROM up u LEFT JOIN mine m USING (k) WHERE m.last_created IS NULL OR k % 3 <> 0)", select=f"""
        SELECT coalesce(w.id, m.id) AS id, coalesce(w.amount, m.amount) AS amount, CASE WHEN w.id IS NOT NULL THEN false ELSE m.is_deleted END AS is_deleted,
          CASE WHEN w.id IS NOT NULL THEN 'backfill' ELSE 'payload' END AS sync_source, CASE WHEN w.id IS NOT NULL THEN {AS_OF} - 1500 ELSE m.last_created END::BIGINT AS last_event_created,
          CASE WHEN w.id IS NULL THEN 'evt_' || m.id END AS last_event_id FROM w FULL JOIN mine m USING (k)"""),
    "b1_backfill_account": over(CHARGES, SUBS, CUSTOMERS, "w AS (SELECT u.*, m.last_created FROM up u LEFT JOIN mine m USING (k) WHERE m.last_created IS NULL OR k % 3 <> 0)", select=f"""
        SELECT 'charge' AS object_type, coalesce(w.id, m.id) AS id, coalesce(w.amount, m.amount) AS amount, NULL::VARCHAR AS subscription, CASE WHEN w.id IS NOT NULL THEN false ELSE m.is_deleted END AS is_deleted,
          CASE WHEN w.id IS NOT NULL THEN 'backfill' ELSE 'payload' END AS sync_source, CASE WHEN w.id IS NOT NULL THEN {AS_OF} - 1500 ELSE m.last_created END::BIGINT AS last_event_created FROM w FULL JOIN mine m USING (k)
        UNION ALL SELECT 'customer', id, NULL, NULL, false, 'backfill', {AS_OF} - 1500 FROM cust UNION ALL SELECT 'subscription', id, NULL, NULL, false, 'backfill', {AS_OF} - 1500 FROM subs
        UNION ALL SELECT 'subscription_item', i.id, NULL, subscription, false, NULL, NULL FROM items i JOIN subs USING (k)"""),
    "b2_live_payment_methods": over(SUBS, select="SELECT 'pm_' || c_custkey AS id FROM customer WHERE 'cus_' || c_custkey IN (SELECT customer FROM subs WHERE NOT is_deleted AND status IN ('active', 'trialing', 'past_due'))"),
    "b3_backfill_progress": over(CHARGES, select="""
        SELECT 'charge' AS object_type, ceil(count(*) / 100)::BIGINT AS pages_done, (SELECT count(*) FROM up LEFT JOIN mine m USING (k) WHERE m.k IS NULL OR k % 3 <> 0) AS objects_done FROM up
        UNION ALL SELECT 'payment_method', count(*), count(*) FROM customer"""),
    "b4_resume_after": over(CHARGES, select="SELECT id, created FROM up WHERE created < 852076800 OR (created = 852076800 AND id < 'ch_5')"),
    "b4_resume_customers": "SELECT 'pm_' || c_custkey AS id, 'cus_' || c_custkey AS customer FROM customer WHERE 'cus_' || c_custkey > 'cus_5'",
    "b5_plan": over(CHARGES, select="""
        SELECT t.object_type, i AS place, t.object_type <> 'payment_method' AS verified, coalesce(n, 0) AS n FROM (
          SELECT unnest(['product', 'price', 'customer', 'subscription', 'payment_method', 'invoice', 'charge', 'payment_intent', 'setup_intent', 'refund', 'dispute', 'checkout_session']) AS object_type, generate_subscripts(range(12), 1) - 1 AS i) t
        LEFT JOIN (SELECT 'charge' AS object_type, count(*) AS n FROM up UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'subscription', count(*) FROM orders) c USING (object_type)"""),
    "v1_canonical_json": over(CHARGES, select="""
        SELECT id, '{"amount":' || amount || ',"created":' || created || ',"currency":"usd","customer":"' || customer || '","id":"' || id || '","object":"charge","paid":' || paid || ',"status":"' || status || '"}' AS data FROM mine"""),
    "v2_json_equal": over(CHARGES, select="SELECT m.id, u.amount = m.amount AS same FROM mine m JOIN up u USING (k)"),
    "v3_full_diff": over(CHARGES, DRIFT, SUBS, CUSTOMERS, ACCOUNT, select="SELECT object_type, id AS object_id, kind FROM a WHERE kind IS NOT NULL"),
    "v3_table_diff": over(CHARGES, DRIFT, SUBS, CUSTOMERS, ACCOUNT, select="SELECT object_type, id AS object_id, kind FROM a WHERE kind IS NOT NULL"),
    "v3_diff_of_charges": over(CHARGES, DRIFT, select="SELECT 'charge' AS object_type, id AS object_id, kind FROM d WHERE kind IS NOT NULL"),
    "v3_diff_since": over(CHARGES, DRIFT, SUBS, CUSTOMERS, ACCOUNT, select="SELECT object_type, id AS object_id, kind FROM a WHERE kind IS NOT NULL AND created >= 852076800"),
    "v4_quick_diff": over(CHARGES, DRIFT, SUBS, CUSTOMERS, ACCOUNT, "old AS (SELECT *, row_number() OVER (PARTITION BY object_type ORDER BY md5('1/' || id), id) AS r FROM a WHERE live AND created < 852076800)", select="""
        SELECT object_type, id AS object_id, kind FROM a WHERE created >= 852076800 UNION ALL SELECT object_type, id, kind FROM old WHERE r <= 40"""),
    "v5_spot_check": over(CHARGES, DRIFT, SUBS, CUSTOMERS, ACCOUNT, f"old AS (SELECT *, row_number() OVER (PARTITION BY object_type ORDER BY md5('3/' || id), id) AS r FROM a WHERE live AND created < {AS_OF})", select="SELECT object_type, id AS object_id, kind FROM old WHERE r <= 200"),
    "v6_verify_report": over(CHARGES, DRIFT, SUBS, CUSTOMERS, ACCOUNT, select="SELECT coalesce(object_type, 'total') AS object_type, count(*) AS checked, count(kind) AS drifted, count(kind) AS repaired FROM a GROUP BY ROLLUP (object_type)"),
    "v7_repair": over(CHARGES, DRIFT, SUBS, CUSTOMERS, ACCOUNT, select="""
        SELECT 'charge' AS object_type, coalesce(u.id, m.id) AS id, coalesce(u.amount, m.amount) AS amount, NULL::BIGINT AS balance, u.id IS NULL AS is_deleted, CASE WHEN kind IS NULL THEN 'payload' ELSE 'repair' END AS sync_source,
          'evt_' || m.id AS last_event_id, NULL::VARCHAR AS left_over FROM up u FULL JOIN mine m USING (k) LEFT JOIN d ON d.id = coalesce(u.id, m.id)
        UNION ALL SELECT 'customer', id, NULL, balance, false, CASE WHEN stale OR absent THEN 'repair' END, NULL, NULL FROM cust
        UNION ALL SELECT 'subscription', id, NULL, NULL, false, CASE WHEN is_deleted THEN 'repair' END, NULL, NULL FROM subs
        UNION ALL SELECT 'subscription_item', id, NULL, NULL, false, NULL, NULL, NULL FROM items
        UNION ALL SELECT 'payment_method', 'pm_' || c_custkey, NULL, NULL, false, NULL, NULL, NULL FROM customer"""),
    "i1_reconstruct_objects": """
        SELECT 'cus_' || c_custkey AS id, 'customer' AS object, c_name AS name, CASE WHEN c_custkey % 4 <> 0 THEN 'c' || c_custkey || '@example.com' END AS email,
          CASE WHEN c_custkey % 5 <> 0 THEN 1700000000 + (c_custkey * 16 + 5) // 10 END AS created, c_mktsegment AS seg, c_custkey AS b, c_custkey % 5 = 0 AS has_null, false AS has_bookkeeping,
          c_custkey % 9 = 0 AS deleted FROM customer""",
    "i2_import_objects": f"""
        SELECT 'cus_' || c_custkey AS id, c_custkey % 9 = 0 AND c_custkey % 3 <> 0 AS is_deleted, CASE WHEN c_custkey % 9 = 0 AND c_custkey % 3 <> 0 THEN {AS_OF} END::BIGINT AS deleted_at,
          CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS name FROM customer""",
    "i2_import_counts": "SELECT 'customer' AS object_type, count(*) FILTER (c_custkey % 3 <> 0) AS imported, count(*) FILTER (c_custkey % 3 = 0) AS skipped FROM customer",
    "i3_import_state": f"SELECT 'cus_' || c_custkey AS object_id, CASE WHEN c_custkey % 3 = 0 THEN 'payload' ELSE 'import' END AS sync_source, {AS_OF}::BIGINT AS last_synced_at FROM customer",
    "a1_events_summary": over(LOG, select="SELECT count(*) AS total, count(*) FILTER (NOT done) AS unprocessed, max(received_at) AS last_received FROM log"),
    "a2_unhandled_types": over(LOG, select="SELECT type, count(*) AS n FROM log WHERE NOT done AND object_type IS NULL GROUP BY 1"),
    "a3_work_by_status": over(LOG, HALF, f"w AS (SELECT object_type, object_id, max(struct_pack(c := created, e := event_id)) AS w, max(struct_pack(c := created, e := event_id)) FILTER (first) AS s FROM halves GROUP BY ALL)", select=f"SELECT CASE WHEN substr(md5(object_id), 1, 1) = '0' THEN 'dead' WHEN s IS NULL OR w > s THEN 'pending' ELSE 'done' END AS status, count(*) AS n FROM w GROUP BY 1"),
    "a3_oldest_live": over(LOG, HALF, "w AS (SELECT object_type, object_id, max(struct_pack(c := created, e := event_id)) AS w, max(struct_pack(c := created, e := event_id)) FILTER (first) AS s FROM halves GROUP BY ALL)", select=f"SELECT coalesce(min(w.c), 0) AS oldest FROM w WHERE substr(md5(object_id), 1, 1) <> '0' AND (s IS NULL OR w > s)"),
    "a4_source_counts": over(LOG, select="SELECT count(*) FILTER (source = 'webhook') AS webhook, count(*) FILTER (source = 'sweep') AS sweep, webhook = 0 AND sweep > 0 AS warn FROM again"),
    "a5_gaps_last_day": over(LOG, select=f"SELECT count(*) AS n FROM objects WHERE n % 11 = 0 AND created > {AS_OF} - 6 * 86400"),
    "a6_latest_backfill": over(LOG, SWEEPS, select="""
        SELECT id, status, started_at, finished_at, (SELECT count(*) FROM log WHERE created // 86400 = s.id AND done) AS tasks_done, (SELECT count(*) FROM log WHERE created // 86400 = s.id) AS tasks_total,
          (SELECT sum(n)::BIGINT FROM log WHERE created // 86400 = s.id) AS objects_done FROM sweeps s ORDER BY id DESC LIMIT 1"""),
    "a7_latest_sweep": over(LOG, SWEEPS, select="SELECT window_from, window_to, finished_at, events_seen, gaps_found FROM sweeps WHERE status = 'done' ORDER BY id DESC LIMIT 1"),
    "a7_latest_verification": over(LOG, SWEEPS, select="SELECT 'full' AS mode, started_at, finished_at, events_seen AS checked, gaps_found AS drifted, 0::BIGINT AS repaired FROM sweeps ORDER BY id DESC LIMIT 1"),
    "a8_drift_by_type": over(CHARGES, DRIFT, select=f"SELECT object_type, CASE WHEN object_type = 'charge' THEN (SELECT count(kind) FROM d) ELSE 0 END AS drifted FROM (SELECT unnest({list(VERIFY_TYPES)}) AS object_type)"),
    "a9_delivery_lag_histogram": """
        WITH l AS (SELECT epoch_us(ts) // 1000000 - epoch_us(ts) // 86400000000 * 86400 AS lag FROM events)
        SELECT le, (SELECT count(*) FROM l WHERE le IS NULL OR lag <= le) AS n FROM (SELECT (1 << i)::BIGINT AS le FROM range(18) t(i) UNION ALL SELECT NULL)""",
    "a10_alerts": over(LOG, SWEEPS, CHARGES, DRIFT, select=f"""
        SELECT 'retention_cliff' AS alert, {AS_OF} + 600 - max(window_to) > 25 * 86400 AS firing FROM sweeps WHERE status = 'done'
        UNION ALL SELECT 'sweep_stalled', max(finished_at) < {AS_OF} + 600 - 900 FROM sweeps WHERE status = 'done'
        UNION ALL SELECT 'dead_rows_rising', count(*) > 0 FROM log WHERE object_type IS NULL AND received_at > {AS_OF} - 300
        UNION ALL SELECT 'webhooks_silent', (SELECT count(*) FROM log WHERE n % 11 <> 0 AND received_at < {AS_OF} - 3600 AND received_at > {AS_OF} - 3000) = 0 AND count(*) > 0 FROM objects WHERE n % 11 = 0
        UNION ALL SELECT 'drift_found', count(kind) > 0 FROM d"""),
    "w1_entitlements": over(SUBS, "best AS (SELECT customer, max(struct_pack(c := created, i := id, s := status)) AS b FROM subs WHERE NOT is_deleted GROUP BY 1)", select="SELECT c_custkey AS user_id, 'cus_' || c_custkey AS customer, b.i AS subscription, b.s AS status, coalesce(b.s IN ('active', 'trialing'), false) AS access FROM customer LEFT JOIN best ON best.customer = 'cus_' || c_custkey"),
    "w2_changes_since": over(CHARGES, SUBS, select=f"SELECT 'charge' AS object_type, id FROM mine WHERE updated_at > {AS_OF} - 500 UNION ALL SELECT 'subscription', id FROM subs WHERE updated_at > {AS_OF} - 500"),
    "w3_dead_rows": over(LOG, select="SELECT n AS id, type, 'unknown' AS resolve_status FROM log WHERE object_type IS NULL ORDER BY n LIMIT 50"),
    "w3_quarantine": over(LOG, CHARGES, SUBS, select="""
        SELECT 'envelope' AS source, sha256('{"event":"' || event_id || '"}') AS retry_key, 'bad_envelope' AS reason, true AS resolved FROM log WHERE n % 41 = 0
        UNION ALL SELECT 'event', event_id, 'malformed', false FROM log WHERE n % 31 = 0 AND object_type IS NOT NULL
        UNION ALL SELECT 'typed', 'charge/' || id, 'amount', true FROM mine WHERE k % 29 = 0
        UNION ALL SELECT 'subscription', 'sub_' || o_orderkey, CASE WHEN o_orderkey % 37 = 0 THEN 'unreadable' ELSE 'incomplete' END, o_orderkey % 37 <> 0 FROM orders
          LEFT JOIN (SELECT l_orderkey, count(DISTINCT l_linenumber) AS lines FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
          WHERE o_orderkey % 37 = 0 OR (lines > 2 AND substr(md5('sub_' || o_orderkey), 1, 1) = '0')"""),
    "w3_list_work": over(LOG, HALF, "w AS (SELECT object_type, object_id, max(struct_pack(c := created, e := event_id)) AS w, max(struct_pack(c := created, e := event_id)) FILTER (first) AS s FROM halves GROUP BY ALL)", select="SELECT object_type, object_id, w.e AS latest_event_id, 'pending' AS status FROM w WHERE substr(md5(object_id), 1, 1) <> '0' AND (s IS NULL OR w > s) ORDER BY object_type, object_id LIMIT 100"),
    "r1_purge_events": over(LOG, select=f"""
        SELECT 'event' AS kind, event_id FROM log WHERE NOT (done AND received_at < {AS_OF} - 864000)
        UNION ALL SELECT 'gap', event_id FROM objects WHERE NOT (done AND received_at < {AS_OF} - 864000)"""),
    "t3_silent_webhooks": over(LOG, select="""
        SELECT h * 3600 AS window_start, sum(w)::BIGINT AS webhooks, sum(g)::BIGINT AS gaps, sum(w) = 0 AND sum(g) > 0 AS silent FROM (
          SELECT received_at // 3600 AS h, 1 AS w, 0 AS g FROM log WHERE n % 11 <> 0 AND (received_at // 3600) % 3 <> 0
          UNION ALL SELECT created // 3600, 0, 1 FROM objects WHERE n % 11 = 0) GROUP BY h"""),
    "t3_stream_silent_webhooks": over(LOG, select="""
        SELECT h * 3600 AS window_start, sum(w)::BIGINT AS webhooks, sum(g)::BIGINT AS gaps, sum(w) = 0 AND sum(g) > 0 AS silent FROM (
          SELECT received_at // 3600 AS h, 1 AS w, 0 AS g FROM log WHERE n % 11 <> 0 AND (received_at // 3600) % 3 <> 0
          UNION ALL SELECT created // 3600, 0, 1 FROM objects WHERE n % 11 = 0) GROUP BY h"""),
    "t4_stream_gap_detect": over(LOG, select="SELECT event_id, created FROM log WHERE n % 11 = 0"),
    "t1_stream_ingest": over(LOG, select=f"SELECT event_id, type, created, received_at, (created // 86400)::INTEGER AS created_day FROM log WHERE NOT (n % 17 = 0 OR n % 19 = 0 OR n % 23 = 0 OR n % 13 = 0)"),
    "t2_stream_apply": over(LOG, FOLDED, select="SELECT object_type, object_id, d IS NOT NULL AS in_mirror, CASE WHEN d IS NOT NULL THEN l.deletes END AS is_deleted, d.email AS email, l.created AS last_event_created, l.event_id AS last_event_id, d.event_id AS data_event_id, 'payload' AS sync_source FROM folded"),
    "s7_change_feed": over(LOG, FOLDED, select="SELECT object_type, object_id FROM folded WHERE d IS NOT NULL"),
    "s1_raw_deliveries": over(LOG, """signed AS (SELECT *, received_at - CASE WHEN n % 23 = 0 THEN 1000 ELSE 0 END AS t, '{"id":"' || event_id || '","type":"' || type || '","api_version":"2024-01-01","created":' || created || ',"livemode":false,"data":{"object":{"id":"' || object_id || '","object":"' || coalesce(object_type, 'plan') || '","email":"' || email || '","customer":"cus_' || user_id || '","status":"' || CASE n % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'canceled' ELSE 'trialing' END || '"' || coalesce(',"amount":' || amount, '') || ',"created":' || created || CASE WHEN deletes THEN ',"deleted":true' ELSE '' END || '}}}' AS body FROM again)""", hmac("t || '.' || body"), select="""
        SELECT CASE WHEN n % 17 = 0 THEN NULL WHEN n % 19 = 0 THEN 't=' || t ELSE 't=' || t || ',v1=' || CASE WHEN n % 13 = 0 THEN reverse(mac) ELSE mac END || ',v0=00' END AS header, body, received_at FROM macs"""),
    "s4_legacy_tables": "SELECT 'customer' AS object_type, c_name AS name FROM customer UNION ALL SELECT 'product', p_name FROM part",
    "s5_write_mirror": over(CHARGES, DRIFT, select=f"""
        SELECT coalesce(u.id, m.id) AS id, CASE WHEN kind IN ('stale', 'missing') THEN u.amount ELSE m.amount END AS amount,
          CASE WHEN kind IN ('stale', 'missing') THEN false ELSE m.is_deleted END AS is_deleted, CASE WHEN kind IN ('stale', 'missing') THEN {AS_OF} ELSE m.updated_at END::BIGINT AS updated_at
        FROM up u FULL JOIN mine m USING (k) LEFT JOIN d ON d.id = coalesce(u.id, m.id)"""),
    "s7_mirror_changes": over(CHARGES, DRIFT, select="SELECT 'charge' AS object_type, id AS object_id FROM d WHERE kind IN ('stale', 'missing')"),
    "s5_mirror_in_runs": over(CHARGES, select=f"""
        SELECT coalesce(u.id, m.id) AS id, coalesce(u.amount, m.amount) AS amount, CASE WHEN u.id IS NOT NULL THEN false ELSE m.is_deleted END AS is_deleted,
          CASE WHEN u.id IS NOT NULL THEN {AS_OF} ELSE m.updated_at END::BIGINT AS updated_at FROM up u FULL JOIN mine m USING (k)"""),
    "s6_append_verification": over(CHARGES, DRIFT, "runs AS (SELECT 1::BIGINT AS verification_id, * FROM d UNION ALL SELECT 2, * FROM d WHERE created >= 852076800)", "sums AS (SELECT verification_id, count(*) AS checked, count(kind) AS drifted FROM runs GROUP BY 1)", select=f"""
        SELECT verification_id, id AS object_id, kind, checked, drifted, false AS repaired, 'full' AS mode, {AS_OF}::BIGINT AS finished_at FROM runs JOIN sums USING (verification_id) WHERE kind IS NOT NULL"""),
}
