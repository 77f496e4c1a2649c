"""Distributed folds and carries against plain Python, with a key that holds
a third and more of all rows, cut into many blocks and partitions."""

import datetime as dt
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from corpusgraph.operators import entities as en
from corpusgraph.operators import folds

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(params=[7, 1024])
def rows_a_block(request, monkeypatch):
    monkeypatch.setattr(folds, "ROWS", request.param)


def keyed(seed, n, make):
    r = random.Random(seed)
    return [(None if r.random() < 0.05 else "hot" if r.random() < 0.4 else f"k{r.randrange(15)}", *make(r, i))
            for i in range(n)]


def by_key(rows):
    out = defaultdict(list)
    for k, *rest in rows:
        out[k].append(tuple(rest))
    return out


def test_transitions(spark, rows_a_block):
    names = ["pending", "active", "completed", "failed", "cancelled", "unknown", None]
    rows = keyed(1, 900, lambda r, i: (i // 3, r.choice(names[:2] + names[3:4] if r.random() < 0.9 else names)))
    want = {}
    for k, seq in by_key(rows).items():
        state, ok = "pending", 0
        for _, s in sorted(seq, key=lambda x: (x[0], x[1] is not None, x[1] or "")):
            if s in en.ORDER_TRANSITIONS.get(state, []):
                state, ok = s, ok + 1
        want[k] = (state, ok, len(seq) - ok)
    df = spark.createDataFrame(rows, "id string, seq int, status string").repartition(6)
    got = {r["id"]: (r["final_status"], r["accepted"], r["rejected"])
           for r in en.apply_transitions(df, "id", "seq", "status").collect()}
    assert got == want
    assert en.apply_transitions(df.limit(0), "id", "seq", "status").count() == 0


@pytest.mark.parametrize("largest", [3, 40, 5000])
def test_stock(spark, rows_a_block, largest):
    def quantity(r, i):
        return None if r.random() < 0.02 else r.randrange(-1, 2 + r.randrange(largest))
    rows = keyed(2, 900, lambda r, i: (i // 2, quantity(r, i)))
    stock = {"hot": 900 * 7, **{f"k{i}": i * 37 % 900 for i in range(14)}}  # k14 has no row
    want = []
    for k, seq in by_key(rows).items():
        if k in stock:
            left, own = stock[k], []
            for o, q in sorted(seq, key=lambda x: (x[0], x[1] is not None, x[1] or 0)):
                ok = q is not None and 0 <= q <= left
                left -= q if ok else 0
                own.append((k, o, q, ok))
            want += [(*x, left, left > 0) for x in own]
    got = en.allocate_stock(spark.createDataFrame(rows, "p string, o int, q int").repartition(6),
                            spark.createDataFrame(list(stock.items()), "p string, s int"), "p", "o", "q", "s")
    key = lambda x: tuple((v is not None, v or 0) for v in x)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(want, key=key)


def test_chain_passes_blocks_without_looking(spark, monkeypatch):
    """Stock that lasts: only blocks in which it halves are looked into."""
    monkeypatch.setattr(folds, "ROWS", 16)
    looked = []
    cut = folds.cut_lineage
    monkeypatch.setattr(folds, "cut_lineage", lambda df: looked.append(df.columns) or cut(df))
    lines = spark.range(4000).selectExpr("'p' as p", "id as o", "1L as q")
    got = en.allocate_stock(lines, spark.createDataFrame([("p", 1 << 14)], "p string, s long"), "p", "o", "q", "s")
    assert got.agg(F.count_if("allocated"), F.min("stock_left")).first() == (4000, (1 << 14) - 4000)
    assert len(looked) < 12  # of 250 blocks


@pytest.mark.parametrize("limit,window", [(1, 30), (3, 60), (5, 100_000)])
def test_rate_limit(spark, rows_a_block, limit, window):
    rows = keyed(3, 700, lambda r, i: (T0 + dt.timedelta(seconds=r.randrange(2000)),))
    want = []
    for k, seq in by_key(rows).items():
        taken = []
        for (t,) in sorted(seq):
            ok = sum(a > t - dt.timedelta(seconds=window) for a in taken) < limit
            taken += [t] if ok else []
            want.append((k or "", t, ok))
    df = spark.createDataFrame(rows + [("hot", None)], "c string, t timestamp_ntz").repartition(6)
    got = [(r["c"] or "", r["t"], r["accepted"]) for r in en.rate_limit(df, "c", "t", limit, window).collect()]
    assert sorted(x for x in got if x[1]) == sorted(want)
    assert [x for x in got if not x[1]] == [("hot", None, None)]


def test_rate_limit_without_a_pause_takes_as_many_steps_as_partitions(spark, monkeypatch):
    """One client far beyond its limit all the time: 250 blocks, few partitions."""
    monkeypatch.setattr(folds, "ROWS", 16)
    made = []
    cut = folds.cut_lineage
    monkeypatch.setattr(folds, "cut_lineage", lambda df: made.append(df.columns) or cut(df))
    df = spark.range(4000).selectExpr("'c' as c", "timestamp_seconds(id + id % 3) as t")
    got = [(r["t"], r["accepted"]) for r in en.rate_limit(df, "c", "t", 3, 100).collect()]
    taken, want = [], []
    for t in sorted(x[0] for x in got):
        ok = sum(a > t - dt.timedelta(seconds=100) for a in taken[-3:]) < 3
        taken += [t] if ok else []
        want.append((t, ok))
    assert sorted(got) == sorted(want)
    assert len(made) <= 4 + 2 * 8  # at most 8 partitions in these tests' session


def test_asof_over_partitions_and_one_second(spark):
    """A key with most rows, many of them in one second."""
    r = random.Random(4)
    events = [("hot" if r.random() < 0.5 else r.choice(["a", "b", "c", None]),
               T0 + dt.timedelta(seconds=5 if r.random() < 0.4 else r.randrange(40)), i, i % 4 == 0,
               None if r.random() < 0.1 else float(r.randrange(9))) for i in range(1500)]
    writes = [(k, t, v) for k, t, _, w, v in events if w and not (k == "c" and t > T0)]
    reads = [(k, t, i) for k, t, i, w, _ in events if not w] + [("none", T0, -1), ("a", None, -2)]
    got = {x["i"]: (x["written_at"], x["v"]) for x in en.asof_lookup(
        spark.createDataFrame(reads, "k string, t timestamp_ntz, i int").repartition(5),
        spark.createDataFrame(writes, "k string, t timestamp_ntz, v double").repartition(5), "k", "t", "v").collect()}
    assert len(got) == len(reads)
    for k, t, i in reads:
        before = [(x, v is not None, v or 0.0) for c, x, v in writes if t and c == k and k and x <= t]
        top = max(before, default=None)
        assert got[i] == ((top[0], top[2] if top[1] else None) if top else (None, None))


def test_asof_without_writes_or_other_columns(spark):
    reads = spark.createDataFrame([("a", T0), ("b", T0)], "k string, t timestamp_ntz")
    writes = spark.createDataFrame([("a", T0, 1)], "k string, t timestamp_ntz, v int")
    assert en.asof_lookup(reads, writes.limit(0), "k", "t", "v").count() == 2
    assert sorted((x["k"], x["v"]) for x in en.asof_lookup(reads, writes, "k", "t", "v").collect()) == \
        [("a", 1), ("b", None)]
    assert en.asof_lookup(reads.limit(0), writes, "k", "t", "v").count() == 0
