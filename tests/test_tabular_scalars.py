"""Tabular goldens (FIXTURES.md §8), scalar functions, entity folds."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from corpusgraph.functions import scalars as sc
from corpusgraph.operators import entities as en
from corpusgraph.operators import tabular as tb


def test_statistics_golden(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (8.0,)], "x double")
    r = tb.statistics(df, "x").first()
    assert (r["q1"], r["q2"], r["q3"]) == (1.75, 3.0, 5.0)
    assert r["std"] == pytest.approx(2.680951, abs=1e-6)
    assert r["median"] == 3.0 and r["mean"] == 3.75


def test_exact_quantiles_selection_path(spark):
    df = spark.range(5000).select((F.col("id") * 7 % 5000).cast("double").alias("x"))
    # force the bucket-refinement path with a tiny fetch bound
    got = tb.exact_quantiles(df, "x", [0.25, 0.5, 0.9], buckets=16)
    assert got == pytest.approx([1249.75, 2499.5, 4499.1])


def test_merge_null_keys_match(spark):
    a = spark.createDataFrame([(None, 1), ("k", 2)], "key string, v int")
    b = spark.createDataFrame([(None, 10), ("z", 20)], "key string, v int")
    rows = sorted(tb.merge(a, b, "key", "left").collect(), key=lambda r: r["v"])
    assert rows[0]["key"] is None and rows[0]["v_secondary"] == 10
    assert rows[1]["v_secondary"] is None
    with pytest.raises(ValueError):
        tb.merge(a, b, "nope")


def test_resample_empty_middle_day(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 5), 1.0), (dt.datetime(2024, 1, 3, 7), 3.0)],
                               "ts timestamp_ntz, v double")
    mean = {r["bin"]: r["v"] for r in tb.resample(df, "ts", "D", "mean").collect()}
    total = {r["bin"]: r["v"] for r in tb.resample(df, "ts", "D", "sum").collect()}
    assert mean[dt.date(2024, 1, 2)] is None and total[dt.date(2024, 1, 2)] == 0.0
    weekly = tb.resample(df, "ts", "W", "last").collect()
    assert [r["bin"] for r in weekly] == [dt.date(2024, 1, 7)]   # weeks end on Sunday
    with pytest.raises(ValueError):
        tb.resample(df, "ts", "D", "median")


def test_rolling_leading_nulls(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(5)], "i int, v double")
    rows = tb.moving_averages(df, "v", [3], order_by=["i"]).orderBy("i").collect()
    assert [r["ma_3"] for r in rows] == [None, None, 1.0, 2.0, 3.0]
    assert rows[2]["ma_std_3"] == pytest.approx(1.0)


def test_anomalies_zero_std(spark):
    df = spark.createDataFrame([(5.0,), (5.0,)], "x double")
    assert [r["is_anomaly"] for r in tb.detect_anomalies(df, "x").collect()] == [False, False]


def test_aggregate_names_and_null_keys(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 9.0)], "k string, x double")
    r = tb.aggregate(df, ["k"], {"x": ["mean", "nunique"]}).collect()
    assert [(x["k"], x["x_mean"], x["x_nunique"]) for x in r] == [("a", 2.0, 2)]


def test_count_by_lists(spark):
    df = spark.createDataFrame([(["a", "b"],), ([],), (None,), (["a", None],)], "tags array<string>")
    from corpusgraph.operators import entities as en
    assert dict(map(tuple, en.count_by(df, "tags").collect())) == {"a": 2, "b": 1, "None": 2}


def test_validate_schema(spark):
    df = spark.createDataFrame([(1, "a", 2.0)], "id int, name string, extra double")
    found = {tuple(r) for r in
             tb.validate_schema(df, {"id": int, "name": int, "missing": str}).collect()}
    assert found == {("missing", "missing", "str", None), ("type", "name", "int", "string"),
                     ("unexpected", "extra", None, "double")}


def test_quantiles_with_non_finite_values(spark):
    import math

    def quantiles(values, probs=(0.0, 0.25, 0.5, 1.0)):
        df = spark.createDataFrame([(v,) for v in values], "x double")
        return tb.exact_quantiles(df, "x", probs, buckets=4)

    inf = float("inf")
    assert quantiles([1.0, 2.0, inf, -inf, 3.0, None]) == [-inf, 1.0, 2.0, inf]
    assert quantiles([inf, inf]) == [inf] * 4 and quantiles([None]) == [None] * 4
    assert all(math.isnan(q) for q in quantiles([1.0, float("nan")]))
    wide = [-1.7e308, 1.7e308, 5e-324, 0.0, -0.0, 1e-300]
    assert quantiles(wide, (0.0, 0.2, 0.8, 1.0)) == [-1.7e308, 0.0, 1e-300, 1.7e308]


def test_moving_averages_keep_rows_with_null_keys(spark):
    df = spark.createDataFrame([(None if i % 2 else "a", i, float(i)) for i in range(10)],
                               "k string, t int, v double")
    got = tb.moving_averages(df, "v", [2], ["t"], ["k"]).collect()
    assert len(got) == 10
    assert {r["t"]: r["ma_2"] for r in got if r["k"] is None} == {1: None, 3: 2.0, 5: 4.0, 7: 6.0, 9: 8.0}


def test_scalar_functions(spark):
    df = spark.createDataFrame([("CamelCaseName", "snake_case_words", "x" * 20, "a<b>:c.txt.. ",
                                 "me@example.com", "https://host.org/p?q", "2024-01-02")],
                               "c string, s string, t string, f string, e string, u string, d string")
    r = df.select(sc.camel_to_snake("c").alias("a"), sc.snake_to_camel("s").alias("b"),
                  sc.snake_to_camel("s", False).alias("b2"), sc.truncate("t", 10).alias("t"),
                  sc.sanitize_filename("f").alias("f"), sc.is_valid_email("e").alias("e"),
                  sc.is_valid_url("u").alias("u"), sc.parse_datetime("d").alias("d"),
                  sc.format_bytes(F.lit(1280)).alias("kb"), sc.format_bytes(F.lit(1023)).alias("b1"),
                  sc.chunk(F.array(*[F.lit(i) for i in range(5)]), 2).alias("ch"),
                  sc.clamp(F.lit(15), 0, 10).alias("cl"), sc.safe_divide(F.lit(1), F.lit(0), -1.0).alias("sd"),
                  sc.sku(F.lit("electronics"), F.lit("abc123def9")).alias("sku"),
                  sc.title_case(F.lit("input_validation x2y")).alias("tc")).first()
    assert r["a"] == "camel_case_name" and r["b"] == "SnakeCaseWords" and r["b2"] == "snakeCaseWords"
    assert r["t"] == "xxxxxxx..." and r["f"] == "a_b__c.txt"
    assert r["e"] and r["u"] and r["d"] == dt.datetime(2024, 1, 2)
    assert r["kb"] == "1.2 KB" and r["b1"] == "1023.0 B"        # half-even like Python
    assert r["ch"] == [[0, 1], [2, 3], [4]] and r["cl"] == 10 and r["sd"] == -1.0
    assert r["sku"] == "ELE-ABC123DE" and r["tc"] == "Input_Validation X2Y"


def test_deep_merge_and_flatten(spark):
    df = spark.createDataFrame(
        [({"a": 1, "n": {"x": 1, "y": None}, "m": {"k": "1"}},
          {"a": None, "n": {"x": 2, "y": 3}, "m": {"k": "2", "j": "3"}})],
        "l struct<a:int, n:struct<x:int, y:int>, m:map<string,string>>, "
        "r struct<a:int, n:struct<x:int, y:int>, m:map<string,string>>")
    dtype = df.schema["l"].dataType
    merged = df.select(sc.deep_merge("l", "r", dtype).alias("z"))
    r = sc.flatten_struct(merged.select("z.*")).first().asDict()
    assert r["a"] == 1 and r["n.x"] == 2 and r["n.y"] == 3 and r["m"] == {"k": "2", "j": "3"}


def test_rate_limit_golden(spark):
    base = dt.datetime(2024, 1, 1)
    req = spark.createDataFrame([("c", base + dt.timedelta(seconds=s)) for s in (0, 1, 2, 9, 10, 11, 12)],
                                "client string, ts timestamp_ntz")
    got = [r["accepted"] for r in en.rate_limit(req, "client", "ts", 2, 10).orderBy("ts").collect()]
    assert got == [True, True, False, False, True, True, False]


def test_status_transitions(spark):
    ev = spark.createDataFrame([(1, 1, "active"), (1, 2, "pending"), (1, 3, "completed"),
                                (2, 1, "completed"), (2, 2, "cancelled")],
                               "id int, seq int, status string")
    got = {r["id"]: (r["final_status"], r["accepted"], r["rejected"])
           for r in en.apply_transitions(ev, "id", "seq", "status").collect()}
    assert got == {1: ("completed", 2, 1), 2: ("cancelled", 1, 1)}


def test_latest_per_key_and_route(spark):
    ch = spark.createDataFrame([(1, 1, "a", False), (1, 2, "b", False), (2, 1, "x", False),
                                (2, 5, None, True)], "id int, ver int, val string, deleted boolean")
    assert [tuple(r) for r in en.latest_per_key(ch, "id", "ver", "deleted").collect()] == [(1, 2, "b")]
    import re
    rx = en.route_regex("/api/users/{user_id}/posts")
    assert re.match(rx, "/api/users/42/posts") and not re.match(rx, "/api/users/4/2/posts")


def test_stock_allocation_and_progress(spark):
    lines = spark.createDataFrame([("p", 1, 3), ("p", 2, 5), ("p", 3, 2), ("q", 1, 1)],
                                  "product string, seq int, qty int")
    stock = spark.createDataFrame([("p", 5), ("q", 0)], "product string, stock int")
    got = {(r["product"], r["seq"]): r["allocated"] for r in
           en.allocate_stock(lines, stock, "product", "seq", "qty", "stock").collect()}
    assert got == {("p", 1): True, ("p", 2): False, ("p", 3): True, ("q", 1): False}
    tasks = spark.createDataFrame([("t", None, "active"), ("a", "t", "completed"), ("b", "t", "active"),
                                   ("solo", None, "completed")], "id string, parent_id string, status string")
    prog = {r["id"]: r["progress"] for r in en.task_progress(tasks).collect()}
    assert prog == {"t": 50.0, "a": 100.0, "b": 0.0, "solo": 100.0}


def test_rules_arrays_serialize_patch(spark):
    cfg = spark.createDataFrame([("x", 70000, 1, 5), ("y", 80, 9, 2)], "id string, port int, lo int, hi int")
    fails = sorted(map(tuple, en.validate_rules(cfg, [("port_range", F.col("port").between(1, 65535)),
                                                      ("lo_le_hi", F.col("lo") <= F.col("hi"))], "id").collect()))
    assert fails == [("x", "port_range"), ("y", "lo_le_hi")]
    u = spark.createDataFrame([(["user"], {"a": "1"}, {"a": "2", "b": "3"})],
                              "roles array<string>, p1 map<string,string>, p2 map<string,string>")
    r = u.select(en.add_if_absent("roles", "admin").alias("r1"), en.add_if_absent("roles", "user").alias("r2"),
                 en.remove_value("roles", "user").alias("r3"), en.merge_maps("p1", "p2").alias("m")).first()
    assert r["r1"] == ["user", "admin"] and r["r2"] == ["user"] and r["r3"] == [] and r["m"] == {"a": "2", "b": "3"}
    ts = spark.createDataFrame([(1, dt.datetime(2024, 1, 2, 3, 4, 5))], "id int, at timestamp_ntz")
    assert en.serialize(ts).first()["json"] == '{"id":1,"at":"2024-01-02T03:04:05.000000"}'
    base = spark.createDataFrame([("u1", "owner", "old", True), ("u2", "other", "x", True)],
                                 "id string, owner_id string, name string, is_active boolean")
    actors = spark.createDataFrame([("owner", False), ("boss", True)], "id string, is_admin boolean")
    patches = spark.createDataFrame([("u1", "owner", "new", False), ("u2", "owner", "hack", None),
                                     ("u2", "boss", None, False), ("u9", "boss", "z", None)],
                                    "id string, actor_id string, name string, is_active boolean")
    res = sorted(tuple(r) for r in en.partial_update(base, patches, actors, "id", "owner_id",
                                                     ["name", "is_active"]).collect())
    assert res == [("u1", "new", True, True, None), ("u2", "x", False, True, None),
                   ("u2", "x", True, False, "forbidden"), ("u9", None, None, False, "not_found")]


def test_asof_lookup_carries_across_buckets(spark):
    t = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    writes = spark.createDataFrame([("k", t(1), 1.0), ("k", t(5), 2.0), ("k", t(80), 3.0), ("z", t(2), 9.0)],
                                   "key string, ts timestamp_ntz, v double")
    reads = spark.createDataFrame([("k", t(0), "r0"), ("k", t(5), "r1"), ("k", t(60), "r2"),
                                   ("k", t(81), "r3"), ("q", t(3), "r4")],
                                  "key string, ts timestamp_ntz, rid string")
    got = {r["rid"]: (r["v"], r["valid"]) for r in
           en.asof_lookup(reads, writes, "key", "ts", "v", ttl_seconds=24 * 3600).collect()}
    # r1 reads at the write's own time (inclusive); r2 two days later: found but expired
    assert got == {"r0": (None, False), "r1": (2.0, True), "r2": (2.0, False), "r3": (3.0, True),
                   "r4": (None, False)}


def test_answer_parsers(spark):
    from corpusgraph.operators import answers as an
    df = spark.createDataFrame([
        ('  {"functionality": "f", "complexity": 3, "quality": 8}',),
        ('prose ```json\n{"functionality": "g", "complexity": 1, "quality": 2}\n``` tail',),
        ("no braces at all",), ('{"functionality": "cut', )], "t string")
    loose = [r["p"] for r in df.select(an.parse_answer_loose("t").alias("p")).collect()]
    assert (loose[0]["functionality"], loose[0]["complexity"], loose[0]["is_default"]) == ("f", 3, False)
    assert loose[1]["functionality"] == "g"
    assert (loose[2]["complexity"], loose[2]["quality"], loose[2]["is_default"]) == (5, 7, True)
    fenced = [r["p"] for r in df.select(an.parse_answer_fenced("t").alias("p")).collect()]
    assert fenced[0]["functionality"] == "f" and fenced[1]["functionality"] == "g"
    assert fenced[2]["is_default"] and fenced[3]["is_default"]
    s = spark.createDataFrame([("0.75",), ("85%",), ("-0.5",), ("none",)], "t string")
    assert [r[0] for r in s.select(an.parse_score("t")).collect()] == [0.75, 1.0, 0.5, 0.0]
    n = spark.createDataFrame([('名称："数据处理器模块很长的名字"',), ("   ",)], "t string")
    assert [r[0] for r in n.select(an.clean_name("t")).collect()] == ["数据处理器模块很长的", "未知功能"]
    rf = spark.createDataFrame([('x {"issues": ["a"], "suggestions": [], "improvements": ["b"], '
                                 '"priority": "high"} y',), ("nothing",)], "t string")
    got = [r[0] for r in rf.select(an.parse_refactoring("t")).collect()]
    assert got[0]["priority"] == "high" and got[0]["issues"] == ["a"] and got[1]["priority"] == "medium"


def test_due_purge_notifications(spark):
    rows = spark.createDataFrame([(1, dt.datetime(2024, 1, 1), False), (2, dt.datetime(2024, 3, 1), False),
                                  (3, dt.datetime(2024, 1, 1), True), (4, None, False)],
                                 "id int, due timestamp_ntz, done boolean")
    flags = {r["id"]: r["is_overdue"] for r in
             en.due_flags(rows, "due", "2024-02-01 00:00:00", F.col("done")).collect()}
    assert flags == {1: True, 2: False, 3: False, 4: False}
    kept, purged = en.purge_expired(rows, "due", "2024-02-01 00:00:00")
    assert sorted(r["id"] for r in kept.collect()) == [2, 4] and purged.first()["purged"] == 2
    notes = en.notifications(rows, "id", "task", "due").where("recipient_id = 1").first()
    assert notes["expires_at"] == dt.datetime(2024, 1, 31)


def test_key_violations_of_real_keys_and_whole_names(spark, tmp_path):
    import duckdb

    import __spark_entry__ as entry
    tables = {
        "customer": spark.createDataFrame(
            [(k, f"Customer#00000{k:04d}") for k in range(1, 111) if k != 100] + [(111, "Customer#000000110")],
            "c_custkey long, c_name string"),
        "orders": spark.createDataFrame(
            [(1, 100), (2, 105), (3, 110), (4, None)], "o_orderkey long, o_custkey long"),
        "part": spark.createDataFrame([(k,) for k in range(1, 21) if k != 7], "p_partkey long"),
        "lineitem": spark.createDataFrame(
            [(1, 1, 7), (1, 2, 12), (2, 1, 20)], "l_orderkey long, l_linenumber int, l_partkey long")}
    con = duckdb.connect()
    for name, df in tables.items():
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    got = sorted(map(tuple, entry.queries()["key_violations"](spark, str(tmp_path)).collect()))
    assert got == [("customer_name_duplicate", "Customer#000000110"), ("line_part_missing", "1/1"),
                   ("order_customer_missing", "1"), ("order_customer_missing", "4")]
    assert got == sorted(con.execute(entry.oracle_sql()["key_violations"]).fetchall())
