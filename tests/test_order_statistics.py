"""Order statistics per group, first and last by an order, and the profile."""

import random

import numpy as np
import pytest

from corpusgraph.operators import tabular as tb


def _rows(seed, n):
    r = random.Random(seed)
    inf = float("inf")
    out = []
    for _ in range(n):
        k = r.choice(["hot", "hot", "a", "b", None, "same", "ends", "nulls"])
        v = {"same": 7.0, "nulls": None, "ends": r.choice([-inf, inf, 1e300, -1.7e308, 1.7e308, 0.0])}.get(
            k, r.choice([r.gauss(0, 1e-9), r.gauss(0, 1e9), float(r.randrange(5)), None]))
        out.append((k, r.randrange(3), v))
    return out + [("one", 1, 3.5), ("nan", 1, float("nan")), ("nan", 1, 2.0)]


@pytest.mark.parametrize("buckets", [2, 1024])
def test_grouped_quantiles(spark, buckets):
    rows, probs = _rows(1, 900), [0.0, 0.1, 0.5, 0.75, 1.0]
    df = spark.createDataFrame(rows, "k string, j int, v double").repartition(5)
    got = {(r["k"], r["j"]): r[2:] for r in tb.grouped_quantiles(df, ["k", "j"], "v", probs, buckets).collect()}
    want = {}
    for k, j, v in rows:
        want.setdefault((k, j), []).append(v)
    assert got.keys() == want.keys()
    for key, vs in want.items():
        vs = sorted(v for v in vs if v is not None)
        for p, q in zip(probs, got[key]):
            if not vs:
                assert q is None
            elif any(np.isnan(vs)):
                assert np.isnan(q)
            else:
                at = p * (len(vs) - 1)
                lo, hi = vs[int(at)], vs[min(int(at) + 1, len(vs) - 1)]
                x = lo if lo == hi or at == int(at) else lo + (hi - lo) * (at - int(at))
                assert q == x or q == pytest.approx(x, rel=1e-12) or (np.isnan(x) and np.isnan(q))
    assert tb.grouped_quantiles(df.limit(0), ["k"], "v", probs).count() == 0


def test_aggregate_medians_first_and_last(spark):
    rows = [("a", 3, 1.0, 9), ("a", 1, None, 9), ("a", 2, 5.0, 9), ("a", 2, 4.0, 9), ("b", 1, None, 1), (None, 1, 1.0, 1)]
    df = spark.createDataFrame(rows, "k string, o int, v double, w int").repartition(3)
    got = {r["k"]: tuple(r)[1:] for r in tb.aggregate(
        df, ["k"], {"v": ["first", "last", "median", "count"]}, order_by=["o"]).collect()}
    assert got == {"a": (4.0, 1.0, 4.0, 3), "b": (None, None, None, 0)}
    assert tb.aggregate(df, ["k"], {"v": ["median"]}).columns == ["k", "v_median"]
    with pytest.raises(ValueError):
        tb.aggregate(df, ["k"], {"v": ["mode"]})
    with pytest.raises(ValueError):
        tb.aggregate(df, ["k"], {"v": ["first"]}, order_by=["none"])


def test_data_quality_counts(spark):
    nan = float("nan")
    rows = [(1, 0.0, "x"), (1, -0.0, "x"), (1, 0.0, "x"), (2, nan, None), (2, nan, None), (None, None, "")]
    df = spark.createDataFrame(rows, "a int, b double, c string")
    got = {(r["metric"], r["column"]): r["value"] for r in tb.data_quality(df).collect()}
    assert got["total_rows", None] == 6 and got["duplicate_rows", None] == 6 - df.distinct().count()
    assert got["nunique", "a"] == 2 and got["nunique", "b"] == 2 and got["null_count", "c"] == 2
    empty = {(r["metric"], r["column"]): r["value"] for r in tb.data_quality(df.limit(0)).collect()}
    assert empty["total_rows", None] == 0 and empty["duplicate_rows", None] == 0 and empty["nunique", "a"] == 0
    clash = {(r["metric"], r["column"]): r["value"] for r in tb.data_quality(
        df.selectExpr("a as value", "b as of", "c as rows")).collect()}
    assert clash["nunique", "value"] == 2
