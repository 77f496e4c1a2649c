"""Streaming forms equal their batch forms (K1, K2)."""

import datetime as dt

from pyspark.sql import functions as F

from corpusgraph.operators import entities as en
from corpusgraph.streaming import streams as st
from tests.conftest import SF_SMALL


def test_rate_limit_stream_equals_batch(spark):
    out = st.run_to_table(st.rate_limit_stream(st.table_stream(spark, SF_SMALL, "events"),
                                               "user_id", "ts", 2, 86400), "t_k1")
    batch = en.rate_limit(spark.read.parquet(f"{SF_SMALL}/events.parquet"), "user_id", "ts", 2, 86400)
    b = batch.select(F.col("user_id").alias("client"), F.col("ts").cast("timestamp").alias("ts"),
                     "accepted")
    assert out.count() == b.count() > 0
    assert out.exceptAll(b).count() == 0 and b.exceptAll(out).count() == 0
    assert out.where("not accepted").count() > 0


def test_resample_stream_closed_windows_equal_batch(spark):
    out = st.run_to_table(st.resample_stream(st.table_stream(spark, SF_SMALL, "events"), "ts", "value"),
                          "t_k2")
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    daily = {r["d"]: r["n"] for r in ev.groupBy(F.to_date("ts").alias("d")).count()
             .withColumnRenamed("count", "n").collect()}
    got = {r["window_start"].date(): r["n"] for r in out.collect()}
    assert got and all(daily[d] == n for d, n in got.items())
    last = max(daily)
    assert last not in got  # the newest window is still open under the watermark


def test_file_layout_and_order_do_not_matter(spark, tmp_path):
    """One file, a folder of several, and a folder in shuffled order agree."""
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    ev.repartition(4).write.parquet(str(tmp_path / "many" / "events.parquet"))
    ev.orderBy(F.desc("ts")).coalesce(1).write.option("maxRecordsPerFile", 300).parquet(
        str(tmp_path / "back" / "events.parquet"))
    outs = []
    for d in (SF_SMALL, str(tmp_path / "many"), str(tmp_path / "back")):
        s = st.rate_limit_stream(st.table_stream(spark, d, "events"), "user_id", "ts", 2, 86400)
        out = st.run_to_table(s, "t_layout")
        assert out.where("accepted is null").count() == 0
        daily = st.run_to_table(st.resample_stream(st.table_stream(spark, d, "events"), "ts", "value"),
                                "t_daily", "update")
        assert daily.agg(F.sum("n")).first()[0] == ev.count()
        outs.append(sorted(map(tuple, out.collect())))
    assert outs[0] == outs[1] == outs[2]


def test_late_rows_are_told(spark, tmp_path):
    """Several micro-batches in the wrong order: undecided, or a failure."""
    import pytest

    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet").orderBy(F.desc("ts")).coalesce(1)
    ev.write.option("maxRecordsPerFile", 300).parquet(str(tmp_path / "events.parquet"))
    s = st.rate_limit_stream(st.table_stream(spark, str(tmp_path), "events", 1), "user_id", "ts", 2, 86400)
    out = st.run_to_table(s, "t_late")
    assert out.count() == ev.count()
    with pytest.raises(RuntimeError, match="after their watermark"):
        st.run_to_table(st.resample_stream(st.table_stream(spark, str(tmp_path), "events", 1),
                                           "ts", "value"), "t_late_daily")


def _changes(spark, tmp_path, rows, per_file):
    """Rows in their order, ``per_file`` a file and micro-batch."""
    (spark.createDataFrame(rows, "k string, t timestamp_ntz, v double").coalesce(1)
     .write.option("maxRecordsPerFile", per_file).parquet(str(tmp_path / "events.parquet")))
    return spark.read.parquet(str(tmp_path / "events.parquet"))


def test_lifetimes_stream_equals_batch_whatever_the_micro_batches(spark, tmp_path):
    import random
    r = random.Random(5)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(r.choice(["hot", "hot", "a", "b"]), t0 + dt.timedelta(minutes=5 * i, seconds=r.randrange(900)),
             None if r.random() < 0.1 else float(r.randrange(5))) for i in range(300)]
    rows += [("hot", None, 1.0)]
    outs = []
    for per_file in (40, 1000):
        batch = _changes(spark, tmp_path / str(per_file), rows, per_file)
        s = st.table_stream(spark, str(tmp_path / str(per_file)), "events", 1)
        out = st.run_to_table(st.lifetimes_stream(s, "k", "t", "v", 1200), "t_lives")
        want = st.lifetimes(batch, "k", "t", "v", 1200)
        key = lambda x: tuple((v is not None, v or 0) for v in x)
        outs.append(sorted(map(tuple, out.collect()), key=key))
        assert outs[-1] == sorted(map(tuple, want.collect()), key=key)
        assert {x[4] for x in outs[-1]} == {"replaced", "expired"}
    assert outs[0] == outs[1]


def test_late_rows_go_to_the_side_table(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    hour = lambda h: t0 + dt.timedelta(hours=h)
    rows = [("a", hour(0), 1.0), ("a", hour(10), 2.0),           # first micro-batch
            ("a", hour(3), 3.0), ("a", hour(9.5), 4.0),          # one late, one on time
            ("a", hour(30), 5.0), ("a", hour(8), 6.0)]           # late as well
    _changes(spark, tmp_path, rows, 2)
    source = st.table_stream(spark, str(tmp_path), "events", 1)
    on_time, late = st.split_late(source, "t", "1 hour", "t_split")
    assert sorted(r["v"] for r in late.collect()) == [3.0, 6.0]
    out = st.run_to_table(st.lifetimes_stream(on_time, "k", "t", "v", 3600), "t_split_lives")
    kept = spark.createDataFrame([x for x in rows if x[2] not in (3.0, 6.0)], "k string, t timestamp_ntz, v double")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, st.lifetimes(kept, "k", "t", "v", 3600).collect()))


def test_expiry_timers_equal_batch(spark):
    orders = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    notes = en.notifications(st.table_stream(spark, SF_SMALL, "orders"), "o_custkey", "order", "o_orderdate")
    twice = notes.unionByName(notes)
    got = st.run_to_table(st.expiry_timer_stream(twice, "created_at", "expires_at"), "t_expiry")
    mark = orders.agg(F.max("o_orderdate")).first()[0]
    want = orders.where(F.col("o_orderdate") < F.lit(mark - dt.timedelta(days=30, hours=1))).count()
    assert got.count() == 2 * want > 0 and got.columns == notes.columns


def test_expiry_state_is_kept_by_bucket_and_lasts_over_batches(spark, tmp_path, monkeypatch):
    """Chunks of a day's rows; what a micro-batch leaves goes in a later one."""
    monkeypatch.setattr(st, "EXPIRY_BUCKETS", 2)
    monkeypatch.setattr(st.Expiring, "CHUNK", 3)
    t0 = dt.datetime(2024, 5, 1)
    rows = [(i % 9, t0 + dt.timedelta(minutes=20 * b, milliseconds=i), t0 + dt.timedelta(minutes=(7 * i) % 120, milliseconds=i))
            for b in range(6) for i in range(30)]
    rows += [(0, t0, None), (1, t0 + dt.timedelta(hours=5), t0 + dt.timedelta(days=3))]
    for i in range(0, len(rows), 30):
        spark.createDataFrame(rows[i:i + 30], "k int, t timestamp_ntz, e timestamp_ntz").coalesce(1).write.mode(
            "append").parquet(f"{tmp_path}/notes.parquet")
    stream = st.expiry_timer_stream(st.table_stream(spark, str(tmp_path), "notes", 1), "t", "e", "2 hours")
    plan = stream._jdf.queryExecution().analyzed().toString()
    assert "bucket" in plan and "day" in plan  # the state is keyed by these, not by the row
    got = st.run_to_table(stream, "t_buckets")
    want = [r for r in rows if r[2] and r[2] < t0 + dt.timedelta(hours=3)]
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 150


def test_streams_leave_the_session_alone(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    s = st.table_stream(spark, SF_SMALL, "events")
    assert s.sparkSession.conf.get(key) == st.ROCKSDB and spark.conf.get(key, None) == before
    assert s.sparkSession.conf.get("spark.sql.shuffle.partitions") == spark.conf.get("spark.sql.shuffle.partitions")
