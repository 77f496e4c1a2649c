"""Community metrics and modularity on the golden graphs of FIXTURES.md §2."""

import pytest
from pyspark.sql import functions as F

from corpusgraph.operators import components as cc
from corpusgraph.operators import graph as g
from corpusgraph.operators import quality as qm
from tests.conftest import membership_of


def q(spark, edges, groups, resolution=1.0):
    return qm.modularity(membership_of(spark, groups), edges, resolution).first()["modularity"]


@pytest.mark.parametrize("groups, expected", [
    (["AB", "CDEF", "GH"], 0.295918),
    (["ABCD", "EFGH"], 0.357143),
    (["AB", "CD", "EFGH"], 0.336735),
    (["AB", "CD", "EF", "GH"], 0.316327),
    (["ABCDEFGH"], 0.0),
    (list("ABCDEFGH"), -0.132653),
])
def test_path_modularity(spark, path_graph, groups, expected):
    _, edges = path_graph
    assert q(spark, edges, groups) == pytest.approx(expected, abs=1e-6)


def test_path_details_fixed_partition(spark, path_graph):
    _, edges = path_graph
    d = {r["community"]: r for r in qm.community_details(
        membership_of(spark, ["AB", "CDEF", "GH"]), edges).collect()}
    want = {"0": (2, 1, 1, 3, 1.0, 1 / 3), "1": (4, 3, 2, 8, 0.5, 0.25), "2": (2, 1, 1, 3, 1.0, 1 / 3)}
    for c, (size, internal, external, total, coh, coup) in want.items():
        r = d[c]
        assert (r["size"], r["internal_edges"], r["external_edges"], r["total_edges"]) == \
            (size, internal, external, total)
        assert r["cohesion"] == pytest.approx(coh)
        assert r["coupling"] == pytest.approx(coup)


def test_summary_and_rules(spark, path_graph):
    _, edges = path_graph
    det = qm.community_details(membership_of(spark, ["AB", "CDEF", "GH"]), edges)
    s = qm.community_summary(det).first()
    assert (s["num_communities"], s["largest_community"], s["smallest_community"]) == (3, 4, 2)
    rules = {(r["community"], r["rule"]) for r in qm.recommendations(det).collect()}
    assert rules == {(None, "small_community")}


def test_rules_single_community_g4(spark):
    det = spark.createDataFrame([("0", 25, 0.2, 0.8)],
                                "community string, size long, cohesion double, coupling double")
    rules = {r["rule"] for r in qm.recommendations(det).collect()}
    assert rules == {"large_community", "low_cohesion", "high_coupling"}


def test_self_loop_and_duplicates(spark):
    raw = spark.createDataFrame([("A", "B"), ("B", "A"), ("A", "B"), ("C", "C")], "src string, dst string")
    edges = g.canonical_edges(raw)
    assert sorted(map(tuple, edges.select("src", "dst").collect())) == [("A", "B"), ("C", "C")]
    nodes = spark.createDataFrame([("A",), ("B",), ("C",), ("D",)], "node string")
    deg = {r["node"]: (r["deg_incident"], r["deg_weighted"]) for r in g.degrees(nodes, edges).collect()}
    assert deg == {"A": (1, 1.0), "B": (1, 1.0), "C": (1, 2.0), "D": (0, 0.0)}
    # self-loop: counts once in incident totals, is internal, not external
    d = {r["community"]: r for r in qm.community_details(
        membership_of(spark, ["AB", "C", "D"]), edges).collect()}
    assert (d["1"]["total_edges"], d["1"]["external_edges"], d["1"]["internal_edges"]) == (1, 0, 0)
    assert d["2"]["coupling"] == 0.0 and d["2"]["cohesion"] == 0.0


def test_edgeless_modularity_zero(spark):
    edges = spark.createDataFrame([], "src string, dst string")
    assert q(spark, edges, ["A", "B"]) == 0.0


def test_connected_components_g2(spark):
    edges = spark.createDataFrame([("A", "B"), ("B", "C"), ("D", "E")], "src string, dst string")
    nodes = spark.createDataFrame([(c,) for c in "ABCDEF"], "node string")
    m = dict(map(tuple, cc.connected_components(nodes, edges).collect()))
    assert m == {"A": "A", "B": "A", "C": "A", "D": "D", "E": "D", "F": "F"}


def test_components_long_chain(spark):
    n = 200
    edges = spark.createDataFrame([(i, i + 1) for i in range(n - 1)], "src long, dst long")
    nodes = spark.range(n).withColumnRenamed("id", "node")
    m = cc.connected_components(nodes, edges)
    assert m.select("community").distinct().collect()[0][0] == 0


@pytest.mark.parametrize("ids", ["descending", "shuffled"])
def test_components_of_a_path_in_few_rounds(spark, ids, monkeypatch):
    """A 10 000-node path whose ids do not follow it: O(log n) rounds."""
    import random
    n = 10_000
    order = list(range(n, 0, -1)) if ids == "descending" else random.Random(3).sample(range(1, n + 1), n)
    order.insert(0, 0) if ids == "descending" else None
    edges = spark.createDataFrame(list(zip(order, order[1:])), "src long, dst long")
    rounds = []
    keep = cc.RoundKeeper.keep_signed
    monkeypatch.setattr(cc.RoundKeeper, "keep_signed", lambda self, df: rounds.append(1) or keep(self, df))
    m = cc.connected_components(spark.createDataFrame([(i,) for i in order], "node long"), edges)
    assert m.agg(F.count("*"), F.count_distinct("community"), F.min("community")).first() == (
        len(order), 1, min(order))
    assert len(rounds) <= 2 * 14  # O(log n): log2 of 10 000 is 13.3


def test_co_occurrence_star_edges(spark):
    pairs = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x"), (3, "y"), (4, "y"), (5, "z")],
                                  "e long, k string")
    edges = sorted(map(tuple, g.co_occurrence_edges(pairs, "e", "k").select("src", "dst").collect()))
    # a key held by n entities yields n - 1 edges to its smallest holder
    assert edges == [(1, 2), (1, 3), (3, 4)]


def test_graph_summary(spark, path_graph):
    nodes, edges = path_graph
    s = g.graph_summary(nodes, edges).first()
    assert (s["num_nodes"], s["num_edges"]) == (8, 7)
    assert s["density_published"] == pytest.approx(7 / 64)
    assert s["avg_degree"] == pytest.approx(14 / 8)


def test_size_histogram_bin_rules(spark):
    det = spark.createDataFrame([(str(i), s) for i, s in enumerate([1, 1, 2, 5, 9])],
                                "community string, size long")
    fixed = {r["bin"]: r["num_communities"] for r in qm.size_histogram(det, 4).collect()}
    assert fixed == {1: 3, 3: 1, 4: 1}                     # last bin closed on the right
    auto = {r["bin"]: r["num_communities"] for r in qm.size_histogram(det, "distinct").collect()}
    assert sum(auto.values()) == 5 and max(auto) == 4     # min(15, 4 distinct sizes) bins
