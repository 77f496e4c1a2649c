"""Registered entity/event queries (I) — ``customer`` as users, ``part`` as
products, ``orders``/``lineitem`` as orders and their lines, ``events`` as
a change log."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusgraph.operators import entities as en
from corpusgraph.plans.common import Registry, rounded
from corpusgraph.sources.tables import table

reg = Registry()


@reg.add("customer_count_by_segment", """
SELECT coalesce(c_mktsegment, 'None') AS value, count(*) AS count FROM customer GROUP BY 1
""")
def q_customer_count_by_segment(spark, sf_dir):
    return en.count_by(table(spark, sf_dir, "customer"), "c_mktsegment")


@reg.add("order_report", """
SELECT 'total_orders' AS metric, NULL AS key, count(*)::DOUBLE AS value FROM orders
UNION ALL SELECT 'revenue', NULL,
  round(coalesce(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 0.0), 2) FROM orders
UNION ALL SELECT 'mean_order_value', NULL, round(coalesce(avg(o_totalprice), 0.0), 6) FROM orders
UNION ALL SELECT 'orders_by_status', o_orderstatus, count(*)::DOUBLE FROM orders GROUP BY 2
""")
def q_order_report(spark, sf_dir):
    r = en.order_report(table(spark, sf_dir, "orders"), "o_orderstatus", "o_totalprice", "F")
    # revenue is a sum of cents: round to cents to drop summation-order noise
    r = r.withColumn("value", F.when(F.col("metric") == "revenue", F.round("value", 2))
                     .otherwise(F.col("value")))
    return rounded(r)


@reg.add("customer_criteria", """
SELECT * FROM customer WHERE c_mktsegment IS NOT DISTINCT FROM 'BUILDING'
  AND c_nationkey IS NOT DISTINCT FROM 3
""")
def q_customer_criteria(spark, sf_dir):
    return en.find_by_criteria(table(spark, sf_dir, "customer"),
                               {"c_mktsegment": "BUILDING", "c_nationkey": 3})


@reg.add("part_filter", """
SELECT * FROM part WHERE p_type = 'ECONOMY' AND p_retailprice >= 950 AND p_retailprice <= 975
""")
def q_part_filter(spark, sf_dir):
    return en.list_filter(table(spark, sf_dir, "part"), equals={"p_type": "ECONOMY"},
                          min_value=("p_retailprice", 950.0), max_value=("p_retailprice", 975.0))


@reg.add("part_page", """
SELECT p.*, (SELECT count(*) FROM part) AS total,
       CAST(ceil((SELECT count(*) FROM part) / 20.0) AS BIGINT) AS pages
FROM part p ORDER BY p_retailprice DESC, p_partkey LIMIT 20 OFFSET 20
""")
def q_part_page(spark, sf_dir):
    return en.page(table(spark, sf_dir, "part"), "p_retailprice", True, 2, 20, "p_partkey")


@reg.add("order_totals", """
SELECT l_orderkey,
       sum(l_extendedprice::DECIMAL(15, 2) * (1 - l_discount::DECIMAL(4, 2)))::DOUBLE AS total,
       sum(l_quantity) AS item_count, count(*) AS lines
FROM lineitem GROUP BY l_orderkey
""")
def q_order_totals(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    # money in exact decimal arithmetic, reported as double
    sub = (F.col("l_extendedprice").cast("decimal(15,2)")
           * (F.lit(1) - F.col("l_discount").cast("decimal(4,2)")))
    t = en.order_totals(li, "l_orderkey", "l_quantity", sub)
    return t.withColumn("total", F.col("total").cast("double"))


@reg.add("orders_overdue", """
SELECT o_orderkey, o_orderstatus, o_orderdate,
       coalesce(TIMESTAMP '1998-08-02 00:00:00' > o_orderdate, false)
         AND NOT coalesce(o_orderstatus = 'F', false) AS is_overdue
FROM orders
""")
def q_orders_overdue(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate")
    return en.due_flags(o, "o_orderdate", "1998-08-02 00:00:00", F.col("o_orderstatus") == "F")


@reg.add("latest_event_per_user", """
SELECT user_id, arg_max(event_id, ts) AS event_id, max(ts) AS ts,
       arg_max(event_type, ts) AS event_type, arg_max(value, ts) AS value
FROM events GROUP BY user_id
""")
def q_latest_event_per_user(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type", "value")
    return en.latest_per_key(e, "user_id", "ts")


def _violations(orders, customers, lines, parts):
    lines = lines.withColumn("line_id", F.concat_ws("/", F.col("l_orderkey").cast("string"),
                                                    F.col("l_linenumber").cast("string")))
    return (en.integrity_violations(orders.withColumnRenamed("o_custkey", "ck"),
                                    customers.withColumnRenamed("c_custkey", "ck"), "ck", "ck",
                                    "order_customer_missing", "o_orderkey")
            .unionByName(en.integrity_violations(lines.withColumnRenamed("l_partkey", "pk"),
                                                 parts.withColumnRenamed("p_partkey", "pk"), "pk", "pk",
                                                 "line_part_missing", "line_id"))
            .unionByName(en.duplicate_values(customers, "c_name", "customer_name_duplicate")))


@reg.add("key_violations", """
SELECT 'order_customer_missing' AS rule, o_orderkey::VARCHAR AS id FROM orders
  WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey)
UNION ALL
SELECT 'line_part_missing', l_orderkey::VARCHAR || '/' || l_linenumber::VARCHAR FROM lineitem
  WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey)
UNION ALL
SELECT 'customer_name_duplicate', c_name FROM customer GROUP BY c_name HAVING count(*) > 1
""")
def q_key_violations(spark, sf_dir):
    """I13 over the real keys and whole names."""
    return _violations(table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"),
                       table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part"))


#: Not the real references (see ``key_violations``) but derived ones, so that
#: every rule reports rows: keys are shifted by 5, which leaves the references
#: to the last customers and parts dangling, and segment and nation stand for
#: the customer's name, which then repeats.
@reg.add("derived_key_violations", """
SELECT 'order_customer_missing' AS rule, o_orderkey::VARCHAR AS id FROM orders
  WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey + 5)
UNION ALL
SELECT 'line_part_missing', l_orderkey::VARCHAR || '/' || l_linenumber::VARCHAR FROM lineitem
  WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey + 5)
UNION ALL
SELECT 'customer_name_duplicate', c_mktsegment || '/' || c_nationkey FROM customer
  GROUP BY c_mktsegment || '/' || c_nationkey HAVING count(*) > 1
""")
def q_derived_key_violations(spark, sf_dir):
    return _violations(
        table(spark, sf_dir, "orders").withColumn("o_custkey", F.col("o_custkey") + 5),
        table(spark, sf_dir, "customer").withColumn("c_name", F.concat_ws(
            "/", "c_mktsegment", F.col("c_nationkey").cast("string"))),
        table(spark, sf_dir, "lineitem").withColumn("l_partkey", F.col("l_partkey") + 5),
        table(spark, sf_dir, "part"))


@reg.add("order_notifications", """
SELECT o_custkey AS recipient_id, 'order' AS type, o_orderdate AS created_at,
       o_orderdate + INTERVAL 30 DAY AS expires_at
FROM orders
""")
def q_order_notifications(spark, sf_dir):
    return en.notifications(table(spark, sf_dir, "orders"), "o_custkey", "order", "o_orderdate")


#: Language folders stand for the service's paths.
_SERVICE_PATHS = (("/en/", "/api/docs"), ("/de/", "/api/health"), ("/fr/", "/api/auth/login"))


@reg.add("page_public_paths", r"""
SELECT page_id, path, regexp_matches(
  path, '^/api/auth/login$|^/api/auth/register$|^/api/health$|^/api/docs') AS is_public
FROM (SELECT page_id, CASE WHEN contains(p, '/en/') THEN '/api/docs' || p
                           WHEN contains(p, '/de/') THEN '/api/health'
                           WHEN contains(p, '/fr/') THEN '/api/auth/login' ELSE p END AS path
      FROM (SELECT page_id, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS p
            FROM pages))
""")
def q_page_public_paths(spark, sf_dir):
    p = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    path = p
    for folder, service in reversed(_SERVICE_PATHS):
        path = F.when(p.contains(folder), F.concat(F.lit(service), p) if service == "/api/docs"
                      else F.lit(service)).otherwise(path)
    pages = table(spark, sf_dir, "pages").select("page_id", path.alias("path"))
    return pages.withColumn("is_public", en.public_path("path"))


@reg.add("purchase_value_asof", """
WITH w AS (SELECT user_id, ts, value FROM events WHERE event_type = 'purchase'),
r AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'view')
SELECT r.user_id, r.ts, r.event_id, w.ts AS written_at, w.value,
       coalesce(r.ts <= w.ts + INTERVAL 3 DAY, false) AS valid
FROM r ASOF LEFT JOIN w ON r.user_id = w.user_id AND r.ts >= w.ts
""")
def q_purchase_value_asof(spark, sf_dir):
    """For every page view, the user's latest purchase value at that
    time, valid for three days (as-of join with a time-to-live)."""
    e = table(spark, sf_dir, "events")
    writes = e.where(F.col("event_type") == "purchase").select("user_id", "ts", "value")
    reads = e.where(F.col("event_type") == "view").select("user_id", "ts", "event_id")
    return en.asof_lookup(reads, writes, "user_id", "ts", "value", ttl_seconds=3 * 86_400)


@reg.add("product_report", """
SELECT 'products' AS report, NULL AS dimension, NULL AS key, metric, value FROM (
  SELECT count(*)::DOUBLE AS total, count_if(p_size > 0)::DOUBLE AS available,
         count_if(p_size <= 0)::DOUBLE AS out_of_stock,
         round(sum(p_retailprice * p_size), 2)::DOUBLE AS inventory_value FROM part)
  UNPIVOT (value FOR metric IN (total, available, out_of_stock, inventory_value))
UNION ALL
SELECT 'products', 'p_type', coalesce(p_type, 'None'), metric, value FROM (
  SELECT p_type, count(*)::DOUBLE AS total, count_if(p_size > 0)::DOUBLE AS available,
         count_if(p_size <= 0)::DOUBLE AS out_of_stock,
         round(sum(p_retailprice * p_size), 2)::DOUBLE AS inventory_value FROM part GROUP BY p_type)
  UNPIVOT (value FOR metric IN (total, available, out_of_stock, inventory_value))
""")
def q_product_report(spark, sf_dir):
    """I2 (products): totals, available / out of stock (size as stock),
    Σ price·stock, overall and per type, in one grouping-sets pass."""
    part = table(spark, sf_dir, "part")
    r = en.breakdown_report(part, "products", ["p_type"], {
        "total": "count(*)", "available": "count_if(p_size > 0)",
        "out_of_stock": "count_if(p_size <= 0)",
        "inventory_value": "round(sum(p_retailprice * p_size), 2)"})
    return rounded(r)


@reg.add("user_report", """
SELECT 'users' AS report, NULL AS dimension, NULL AS key, metric, value FROM (
  SELECT count(*)::DOUBLE AS total, count_if(c_acctbal > 0)::DOUBLE AS active,
         count_if(c_mktsegment = 'BUILDING')::DOUBLE AS admins FROM customer)
  UNPIVOT (value FOR metric IN (total, active, admins))
UNION ALL
SELECT 'users', 'c_mktsegment', coalesce(c_mktsegment, 'None'), metric, value FROM (
  SELECT c_mktsegment, count(*)::DOUBLE AS total, count_if(c_acctbal > 0)::DOUBLE AS active,
         count_if(c_mktsegment = 'BUILDING')::DOUBLE AS admins
  FROM customer GROUP BY c_mktsegment) UNPIVOT (value FOR metric IN (total, active, admins))
""")
def q_user_report(spark, sf_dir):
    """I2 (users): total, active (positive balance) and admins (one segment
    stands for the role), overall and per segment (the role breakdown)."""
    return en.breakdown_report(table(spark, sf_dir, "customer"), "users", ["c_mktsegment"], {
        "total": "count(*)", "active": "count_if(c_acctbal > 0)",
        "admins": "count_if(c_mktsegment = 'BUILDING')"})


@reg.add("task_report", """
WITH t AS (SELECT o_orderstatus, o_orderpriority,
                  o_orderstatus <> 'F' AND o_orderdate + INTERVAL 30 DAY < TIMESTAMP '1998-01-01' AS overdue
           FROM orders)
SELECT 'tasks' AS report, NULL AS dimension, NULL AS key, metric, value FROM (
  SELECT count(*)::DOUBLE AS total, count_if(overdue)::DOUBLE AS overdue FROM t)
  UNPIVOT (value FOR metric IN (total, overdue))
UNION ALL
SELECT 'tasks', 'o_orderstatus', o_orderstatus, metric, value FROM (
  SELECT o_orderstatus, count(*)::DOUBLE AS total, count_if(overdue)::DOUBLE AS overdue
  FROM t GROUP BY 1) UNPIVOT (value FOR metric IN (total, overdue))
UNION ALL
SELECT 'tasks', 'o_orderpriority', o_orderpriority, metric, value FROM (
  SELECT o_orderpriority, count(*)::DOUBLE AS total, count_if(overdue)::DOUBLE AS overdue
  FROM t GROUP BY 1) UNPIVOT (value FOR metric IN (total, overdue))
""")
def q_task_report(spark, sf_dir):
    """I2 (tasks): orders as tasks, due 30 days after their date; total and
    overdue, overall, per status and per priority."""
    return en.breakdown_report(
        table(spark, sf_dir, "orders"), "tasks", ["o_orderstatus", "o_orderpriority"],
        {"total": "count(*)", "overdue": "count_if(o_orderstatus <> 'F' AND "
                                         "o_orderdate + INTERVAL 30 DAYS < TIMESTAMP_NTZ '1998-01-01')"})


@reg.add("all_notifications", """
SELECT user_id AS recipient_id, 'user' AS type, ts AS created_at, ts + INTERVAL 30 DAY AS expires_at
FROM events
UNION ALL
SELECT l_suppkey, 'task', CAST(l_shipdate AS TIMESTAMP), CAST(l_shipdate AS TIMESTAMP) + INTERVAL 30 DAY
FROM lineitem
UNION ALL
SELECT o_custkey, 'order', CAST(o_orderdate AS TIMESTAMP), CAST(o_orderdate AS TIMESTAMP) + INTERVAL 30 DAY
FROM orders
""")
def q_all_notifications(spark, sf_dir):
    """The three kinds: user events, tasks (line items of a supplier), orders."""
    def kind(name, user, label, at):
        rows = table(spark, sf_dir, name).select(
            F.col(user).cast("long").alias("who"), F.col(at).cast("timestamp_ntz").alias("at"))
        return en.notifications(rows, "who", label, "at")

    return (kind("events", "user_id", "user", "ts").unionByName(kind("lineitem", "l_suppkey", "task", "l_shipdate"))
            .unionByName(kind("orders", "o_custkey", "order", "o_orderdate")))


#: Statuses asked for along a customer's orders, by the order's priority.
_STATUS_OF = {"1-URGENT": "active", "2-HIGH": "completed", "3-MEDIUM": "pending",
              "4-NOT SPECIFIED": "failed", "5-LOW": "cancelled"}
_CASES = " ".join(f"WHEN '{p}' THEN '{s}'" for p, s in _STATUS_OF.items())


@reg.add("customer_status_transitions", f"""
WITH RECURSIVE e AS (
  SELECT o_custkey AS k, CASE o_orderpriority {_CASES} END AS s,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
r AS (
  SELECT k, 0::BIGINT AS n, 'pending' AS state, 0::BIGINT AS ok FROM (SELECT DISTINCT k FROM e)
  UNION ALL
  SELECT k, n, CASE WHEN legal THEN s ELSE state END, ok + legal::BIGINT FROM (
    SELECT e.k, e.n, e.s, r.state, r.ok, coalesce(
      r.state = 'pending' AND e.s IN ('active', 'cancelled')
      OR r.state = 'active' AND e.s IN ('completed', 'failed', 'cancelled')
      OR r.state = 'failed' AND e.s = 'pending', false) AS legal
    FROM r JOIN e ON e.k = r.k AND e.n = r.n + 1))
SELECT k AS o_custkey, arg_max(state, n) AS final_status, max(ok) AS accepted, max(n) - max(ok) AS rejected
FROM r GROUP BY k
""")
def q_customer_status_transitions(spark, sf_dir):
    """I8: each customer's orders in turn ask for a status."""
    cases = F.expr(f"CASE o_orderpriority {_CASES} END")
    asked = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", cases.alias("status"))
    return en.apply_transitions(asked, "o_custkey", "o_orderkey", "status")


@reg.add("part_stock_allocation", """
WITH RECURSIVE e AS (
  SELECT l_partkey AS k, l_orderkey AS o, CAST(l_quantity AS BIGINT) AS q, CAST(p_size AS BIGINT) * 10 AS s0,
         row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_quantity) AS n
  FROM lineitem JOIN part ON p_partkey = l_partkey),
r AS (
  SELECT DISTINCT k, 0::BIGINT AS n, 0::BIGINT AS o, 0::BIGINT AS q, s0 AS s, false AS ok FROM e
  UNION ALL
  SELECT e.k, e.n, e.o, e.q, CASE WHEN e.q <= r.s THEN r.s - e.q ELSE r.s END, e.q <= r.s
  FROM r JOIN e ON e.k = r.k AND e.n = r.n + 1)
SELECT k AS l_partkey, o AS l_orderkey, q AS quantity, ok AS allocated,
       min(s) OVER (PARTITION BY k) AS stock_left, min(s) OVER (PARTITION BY k) > 0 AS is_available
FROM r QUALIFY n > 0
""")
def q_part_stock_allocation(spark, sf_dir):
    """Order lines take a part's stock (ten times its size) in order."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_partkey", "l_orderkey", F.col("l_quantity").cast("long").alias("quantity"))
    stock = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"), (F.col("p_size").cast("long") * 10).alias("stock"))
    return en.allocate_stock(lines, stock, "l_partkey", "l_orderkey", "quantity", "stock")


#: Twenty accepted per sliding day and event type: a request is accepted unless
#: the twentieth accepted one before it lies less than a day back.
@reg.add("event_type_rate_limit", """
WITH RECURSIVE e AS (
  SELECT event_type AS k, ts, row_number() OVER (PARTITION BY event_type ORDER BY ts) AS n FROM events),
r AS (
  SELECT k, ts, n, true AS accepted, [ts] AS live FROM e WHERE n = 1
  UNION ALL
  SELECT k, ts, n, len(live) < 20, CASE WHEN len(live) < 20 THEN list_append(live, ts) ELSE live END
  FROM (SELECT e.k, e.ts, e.n, list_filter(r.live, lambda a: a > e.ts - INTERVAL 1 DAY) AS live
        FROM r JOIN e ON e.k = r.k AND e.n = r.n + 1))
SELECT k AS event_type, ts, accepted FROM r
""")
def q_event_type_rate_limit(spark, sf_dir):
    """I14 as a batch: at most 20 accepted events per type and sliding day."""
    return en.rate_limit(table(spark, sf_dir, "events").select("event_type", "ts"),
                         "event_type", "ts", 20, 86_400)
