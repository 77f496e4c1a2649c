"""Registered tabular queries (H) over ``events``, ``lineitem``, ``customer``
and ``orders``.

``events`` has no nulls; the null-handling operators (H2, H11) read a
derived view in which ``value`` is null for error events and
``event_type`` is null for page views.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusgraph.operators import tabular as tb
from corpusgraph.plans.common import Registry, rounded
from corpusgraph.sources.tables import table

reg = Registry()

GAPPY_SQL = """gappy AS (
  SELECT event_id, ts, user_id,
         CASE WHEN event_type = 'view' THEN NULL ELSE event_type END AS event_type,
         CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value, props
  FROM events)"""


def events_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id", "ts", "user_id",
        F.when(F.col("event_type") != "view", F.col("event_type")).alias("event_type"),
        F.when(F.col("event_type") != "error", F.col("value")).alias("value"),
        "props")


@reg.add("events_clean", f"""
WITH {GAPPY_SQL},
d AS (SELECT DISTINCT user_id, event_type, value FROM gappy)
SELECT coalesce(user_id::DOUBLE, (SELECT avg(user_id) FROM d)) AS user_id,
       coalesce(event_type, 'Unknown') AS event_type,
       round(coalesce(value, (SELECT avg(value) FROM d)), 6) AS value
FROM d
""")
def q_events_clean(spark, sf_dir):
    g = events_with_gaps(spark, sf_dir).select("user_id", "event_type", "value")
    return rounded(tb.clean(g))


@reg.add("events_statistics", """
SELECT round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median,
       round(stddev_pop(value), 6) AS std, min(value) AS min, max(value) AS max,
       round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS q2,
       round(quantile_cont(value, 0.75), 6) AS q3
FROM events
""")
def q_events_statistics(spark, sf_dir):
    return rounded(tb.statistics(table(spark, sf_dir, "events"), "value"))


@reg.add("lineitem_aggregate", """
SELECT l_returnflag, l_linestatus,
       round(sum(l_quantity), 6) AS l_quantity_sum, round(avg(l_quantity), 6) AS l_quantity_mean,
       max(l_quantity) AS l_quantity_max,
       round(sum(l_extendedprice), 2) AS l_extendedprice_sum,
       round(stddev_samp(l_extendedprice), 6) AS l_extendedprice_std,
       count(DISTINCT l_orderkey) AS l_orderkey_nunique
FROM lineitem WHERE l_returnflag IS NOT NULL AND l_linestatus IS NOT NULL
GROUP BY l_returnflag, l_linestatus
""")
def q_lineitem_aggregate(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    out = tb.aggregate(li, ["l_returnflag", "l_linestatus"], {
        "l_quantity": ["sum", "mean", "max"],
        "l_extendedprice": ["sum", "std"],
        "l_orderkey": ["nunique"]})
    # a sum of cents is whole cents; rounding to them removes summation-order noise
    return rounded(out.withColumn("l_extendedprice_sum", F.round("l_extendedprice_sum", 2)))


def _resample_sql(bin_expr: str, cal: str, agg: str, fill: str) -> str:
    return f"""
WITH b AS (SELECT {bin_expr} AS bin, ts, value FROM events),
per AS (SELECT bin, {agg} AS value FROM b GROUP BY bin),
cal AS ({cal})
SELECT cal.bin, {fill} AS value FROM cal LEFT JOIN per USING (bin)
"""


@reg.add("events_resample_daily", _resample_sql(
    "ts::DATE",
    "SELECT unnest(generate_series(min(bin), max(bin), INTERVAL 1 DAY))::DATE AS bin FROM b",
    "avg(value)", "round(per.value, 6)"))
def q_events_resample_daily(spark, sf_dir):
    return rounded(tb.resample(table(spark, sf_dir, "events"), "ts", "D", "mean", ["value"]))


@reg.add("events_resample_weekly", _resample_sql(
    "ts::DATE + ((7 - dayofweek(ts::DATE)) % 7)::INT",
    "SELECT unnest(generate_series(min(bin), max(bin), INTERVAL 7 DAY))::DATE AS bin FROM b",
    "sum(value)", "round(coalesce(per.value, 0.0), 6)"))
def q_events_resample_weekly(spark, sf_dir):
    return rounded(tb.resample(table(spark, sf_dir, "events"), "ts", "W", "sum", ["value"]))


@reg.add("events_resample_monthly", _resample_sql(
    "last_day(ts::DATE)",
    "SELECT last_day(unnest(generate_series(date_trunc('month', min(bin)), "
    "date_trunc('month', max(bin)), INTERVAL 1 MONTH))::DATE) AS bin FROM b",
    "arg_max(value, ts) FILTER (WHERE value IS NOT NULL)", "per.value"))
def q_events_resample_monthly(spark, sf_dir):
    return rounded(tb.resample(table(spark, sf_dir, "events"), "ts", "M", "last", ["value"]))


@reg.add("events_anomalies", """
WITH s AS (SELECT avg(value) AS mu, stddev_samp(value) AS sd FROM events)
SELECT event_id, value,
       round(CASE WHEN sd <> 0 THEN abs(value - mu) / sd END, 6) AS z_score,
       coalesce(CASE WHEN sd <> 0 THEN abs(value - mu) / sd END > 3.0, false) AS is_anomaly
FROM events, s
""")
def q_events_anomalies(spark, sf_dir):
    return rounded(tb.detect_anomalies(table(spark, sf_dir, "events"), "value", 3.0,
                                       keep=["event_id"]))


def _ma_sql(w: int) -> str:
    frame = (f"OVER (PARTITION BY user_id ORDER BY ts, event_id "
             f"ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)")
    return (f"round(CASE WHEN count(value) {frame} = {w} THEN avg(value) {frame} END, 6) AS ma_{w}, "
            f"round(CASE WHEN count(value) {frame} = {w} THEN stddev_samp(value) {frame} END, 6) "
            f"AS ma_std_{w}")


@reg.add("events_moving_average", f"""
SELECT event_id, user_id, value, {_ma_sql(3)}, {_ma_sql(7)} FROM events
""")
def q_events_moving_average(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    return rounded(tb.moving_averages(e, "value", [3, 7], order_by=["ts", "event_id"],
                                      partition_by=["user_id"]).drop("ts"))


@reg.add("events_transform", """
SELECT event_id, user_id, round(value * 100) AS value_cents
FROM events WHERE event_type = 'purchase'
""")
def q_events_transform(spark, sf_dir):
    steps = [
        lambda d: d.withColumn("value_cents", F.round(F.col("value") * 100)),
        lambda d: d.where(F.col("event_type") == "purchase"),
        lambda d: d.select("event_id", "user_id", "value_cents"),
    ]
    return tb.transform_all(table(spark, sf_dir, "events"), steps)


@reg.add("customer_orders_merge", """
SELECT coalesce(c.custkey, o.custkey) AS custkey, c.value, c.c_name,
       o.value AS value_secondary, o.o_orderstatus
FROM (SELECT c_custkey AS custkey, c_acctbal AS value, c_name FROM customer) c
FULL OUTER JOIN (SELECT o_custkey AS custkey, o_totalprice AS value, o_orderstatus FROM orders) o
  ON c.custkey IS NOT DISTINCT FROM o.custkey
""")
def q_customer_orders_merge(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("custkey"), F.col("c_acctbal").alias("value"), "c_name")
    o = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("custkey"), F.col("o_totalprice").alias("value"), "o_orderstatus")
    return tb.merge(c, o, "custkey", "outer")


def _quality_sql() -> str:
    cols = ["event_id", "ts", "user_id", "event_type", "value", "props"]
    numeric = ["event_id", "user_id", "value"]
    parts = [
        "SELECT 'total_rows' AS metric, NULL AS column, count(*)::DOUBLE AS value FROM gappy",
        f"SELECT 'total_columns', NULL, {float(len(cols))}",
        "SELECT 'duplicate_rows', NULL, ((SELECT count(*) FROM gappy) - "
        "(SELECT count(*) FROM (SELECT DISTINCT * FROM gappy)))::DOUBLE",
    ]
    for c in cols:
        parts.append(f"SELECT 'null_count', '{c}', count_if({c} IS NULL)::DOUBLE FROM gappy")
        parts.append(f"SELECT 'null_percent', '{c}', "
                     f"round(count_if({c} IS NULL) * 100.0 / count(*), 6) FROM gappy")
    for c in numeric:
        parts.append(f"SELECT 'nunique', '{c}', count(DISTINCT {c})::DOUBLE FROM gappy")
        parts.append(f"SELECT 'min', '{c}', round(min({c})::DOUBLE, 6) FROM gappy")
        parts.append(f"SELECT 'max', '{c}', round(max({c})::DOUBLE, 6) FROM gappy")
        parts.append(f"SELECT 'mean', '{c}', round(avg({c}), 6) FROM gappy")
        parts.append(f"SELECT 'std', '{c}', round(stddev_samp({c}), 6) FROM gappy")
    body = "\nUNION ALL ".join(parts)
    return (f"WITH {GAPPY_SQL}\nSELECT * FROM ({body}) "
            "WHERE NOT (metric IN ('null_count', 'null_percent') AND value <= 0)")


@reg.add("events_data_quality", _quality_sql())
def q_events_data_quality(spark, sf_dir):
    return rounded(tb.data_quality(events_with_gaps(spark, sf_dir)))


@reg.add("lineitem_order_statistics", """
SELECT l_suppkey, median(l_extendedprice) AS l_extendedprice_median, median(l_discount) AS l_discount_median,
       arg_min(l_quantity, (l_orderkey, l_linenumber, l_quantity)) AS l_quantity_first,
       arg_max(l_quantity, (l_orderkey, l_linenumber, l_quantity)) AS l_quantity_last
FROM lineitem WHERE l_suppkey IS NOT NULL GROUP BY l_suppkey
""")
def q_lineitem_order_statistics(spark, sf_dir):
    """H4: exact medians, and first and last by order line, per supplier."""
    return rounded(tb.aggregate(table(spark, sf_dir, "lineitem"), ["l_suppkey"], {
        "l_extendedprice": ["median"], "l_discount": ["median"], "l_quantity": ["first", "last"]},
        order_by=["l_orderkey", "l_linenumber"]))


@reg.add("event_type_quartiles", """
SELECT event_type, round(quantile_cont(value, 0.25), 6) AS q0, round(quantile_cont(value, 0.5), 6) AS q1,
       round(quantile_cont(value, 0.75), 6) AS q2
FROM events GROUP BY event_type
""")
def q_event_type_quartiles(spark, sf_dir):
    """H4: exact quartiles of all event types in one selection."""
    return rounded(tb.grouped_quantiles(table(spark, sf_dir, "events"), ["event_type"], "value", [0.25, 0.5, 0.75]))
