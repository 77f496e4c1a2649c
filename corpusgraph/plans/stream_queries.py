"""Registered streaming queries (K1–K4): file streams over the driver
tables run with ``availableNow`` into parquet sinks, read back as tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusgraph.operators import entities as en
from corpusgraph.plans.common import Registry, rounded
from corpusgraph.streaming import streams as st

reg = Registry()

RATE_LIMIT_MAX = 2            # accepted requests per client ...
RATE_LIMIT_WINDOW_S = 86_400  # ... per sliding day
LATEST_TTL_S = 7 * 86_400
SWEEP_AS_OF = "1998-08-02 00:00:00"


@reg.add("events_daily_stream", """
WITH d AS (SELECT date_trunc('day', ts) AS window_start, avg(value) AS mean, sum(value) AS sum,
                  count(*) AS n FROM events GROUP BY 1)
SELECT window_start, window_start + INTERVAL 1 DAY AS window_end, round(mean, 6) AS mean,
       round(sum, 6) AS sum, n
FROM d
""")
def q_events_daily_stream(spark, sf_dir):
    """K2: every window, the open one included, as last updated."""
    s = st.resample_stream(st.table_stream(spark, sf_dir, "events"), "ts", "value",
                           "1 day", "1 hour")
    raw = st.run_to_table(s, "events_daily", "update")
    return rounded(en.latest_per_key(raw, "window_start", "_batch").drop("_batch"))


#: Two accepted per sliding day: a request is accepted unless the last but
#: one accepted request lies less than a day back.
@reg.add("rate_limit_decisions", """
WITH RECURSIVE e AS (
  SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events),
r AS (
  SELECT user_id, ts, n, true AS accepted, ts AS a1, CAST(NULL AS TIMESTAMP) AS a2 FROM e WHERE n = 1
  UNION ALL
  SELECT user_id, ts, n, ok, CASE WHEN ok THEN ts ELSE a1 END, CASE WHEN ok THEN a1 ELSE a2 END
  FROM (SELECT e.user_id, e.ts, e.n, r.a1, r.a2,
               r.a2 IS NULL OR r.a2 <= e.ts - INTERVAL 1 DAY AS ok
        FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1))
SELECT user_id AS client, ts, accepted FROM r
""")
def q_rate_limit_decisions(spark, sf_dir):
    """K1: per user, at most 2 accepted events per sliding day."""
    s = st.rate_limit_stream(st.table_stream(spark, sf_dir, "events"), "user_id", "ts",
                             RATE_LIMIT_MAX, RATE_LIMIT_WINDOW_S)
    out = st.run_to_table(s, "rate_limit")
    return out.select("client", F.col("ts").cast("timestamp_ntz").alias("ts"), "accepted")


@reg.add("latest_value_stream", f"""
WITH m AS (SELECT user_id, max(ts) AS mts FROM events GROUP BY user_id)
SELECT e.user_id AS key, epoch_us(m.mts) AS written_us, max(e.value) AS value,
       epoch_us(m.mts) + {LATEST_TTL_S * 1_000_000} AS expires_us
FROM events e JOIN m ON e.user_id = m.user_id AND e.ts = m.mts
GROUP BY e.user_id, m.mts
""")
def q_latest_value_stream(spark, sf_dir):
    """K3: newest value per user with its expiry time."""
    s = st.latest_value_stream(st.table_stream(spark, sf_dir, "events"), "user_id", "ts",
                               "value", LATEST_TTL_S)
    # the processor appends one row per key and micro-batch; the table's
    # current view is each key's newest row
    raw = st.run_to_table(s, "latest_value")
    return en.latest_per_key(raw, "key", "written_us")


@reg.add("expired_notifications_stream", f"""
SELECT o_custkey AS recipient_id, 'order' AS type, o_orderdate AS created_at,
       o_orderdate + INTERVAL 30 DAY AS expires_at, TIMESTAMP '{SWEEP_AS_OF}' AS swept_at
FROM orders WHERE TIMESTAMP '{SWEEP_AS_OF}' > o_orderdate + INTERVAL 30 DAY
""")
def q_expired_notifications_stream(spark, sf_dir):
    """K4: order notifications (I21) already expired at the sweep time."""
    notes = en.notifications(st.table_stream(spark, sf_dir, "orders"), "o_custkey", "order",
                             "o_orderdate")
    return st.run_to_table(st.expiry_sweep_stream(notes, "expires_at", SWEEP_AS_OF),
                           "expiry_sweep")


LIFETIME_TTL_S = 12 * 3600


@reg.add("value_lifetimes_stream", f"""
WITH m AS (SELECT (epoch_ms(max(ts)) - 3600000) * 1000 AS mark FROM events),
w AS (SELECT user_id AS key, epoch_us(ts) AS written_us, value, mark,
             lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, value) AS next
      FROM events, m WHERE epoch_us(ts) <= mark),
e AS (SELECT *, written_us + {LIFETIME_TTL_S * 1_000_000} AS ended FROM w)
SELECT key, written_us, value, coalesce(least(next, ended), ended) AS ended_us,
       CASE WHEN next <= ended THEN 'replaced' ELSE 'expired' END AS reason
FROM e WHERE next IS NOT NULL OR ended < mark
""")
def q_value_lifetimes_stream(spark, sf_dir):
    """K3: every user's values until they are replaced or, after twelve hours
    of event time, expire."""
    s = st.lifetimes_stream(st.table_stream(spark, sf_dir, "events"), "user_id", "ts", "value", LIFETIME_TTL_S)
    return st.run_to_table(s, "value_lifetimes")


@reg.add("notification_expiry_stream", """
SELECT o_custkey AS recipient_id, 'order' AS type, CAST(o_orderdate AS TIMESTAMP) AS created_at,
       CAST(o_orderdate AS TIMESTAMP) + INTERVAL 30 DAY AS expires_at
FROM orders WHERE o_orderdate + INTERVAL 30 DAY < (SELECT max(o_orderdate) - INTERVAL 1 HOUR FROM orders)
""")
def q_notification_expiry_stream(spark, sf_dir):
    """K4: order notifications that expire as the orders' own time goes on."""
    notes = en.notifications(st.table_stream(spark, sf_dir, "orders"), "o_custkey", "order", "o_orderdate")
    out = st.run_to_table(st.expiry_timer_stream(notes, "created_at", "expires_at"), "notification_expiry")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("created_at", "expires_at")})
