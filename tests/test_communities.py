"""Invariants of the iterative detectors (D1–D4, D7, D11) on small graphs."""

import pytest
from pyspark.sql import functions as F

from corpusgraph.operators import communities as cm
from corpusgraph.operators import components as cc
from corpusgraph.operators import moving
from corpusgraph.operators import quality as qm


def two_triangles(spark):
    e = [("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("y", "z"), ("x", "z"), ("c", "x")]
    edges = spark.createDataFrame(e, "src string, dst string")
    nodes = spark.createDataFrame([(n,) for n in "abcxyzq"], "node string")  # q isolated
    return nodes, edges


def check_partition(nodes, memb):
    assert memb.count() == nodes.count()
    assert memb.select("node").distinct().count() == nodes.count()
    # label = smallest member
    bad = memb.groupBy("community").agg(F.min("node").alias("m")).where("m <> community").count()
    assert bad == 0


@pytest.mark.parametrize("algo", ["louvain", "leiden", "label_propagation"])
def test_two_triangles(spark, algo):
    nodes, edges = two_triangles(spark)
    memb, used = cm.detect(nodes, edges, algo)
    assert used == algo
    check_partition(nodes, memb)
    groups = sorted(sorted(r["nodes"]) for r in memb.groupBy("community")
                    .agg(F.collect_list("node").alias("nodes")).collect())
    assert groups == [["a", "b", "c"], ["q"], ["x", "y", "z"]]
    q = qm.modularity(memb, edges).first()["modularity"]
    assert q == pytest.approx(5 / 14, abs=1e-6)


def test_louvain_path_reaches_good_partition(spark, path_graph):
    nodes, edges = path_graph
    memb = cm.louvain(nodes, edges)
    check_partition(nodes, memb)
    q = qm.modularity(memb, edges).first()["modularity"]
    assert q >= 0.3367 - 1e-6  # at least the best 3-way split of G1


def test_leiden_communities_connected(spark, path_graph):
    nodes, edges = path_graph
    memb = cm.leiden(nodes, edges)
    # every community is one connected piece of its induced subgraph
    e = (edges.join(memb.select(F.col("node").alias("src"), F.col("community").alias("cs")), "src")
         .join(memb.select(F.col("node").alias("dst"), F.col("community").alias("cd")), "dst")
         .where("cs = cd").select("src", "dst"))
    comps = cc.connected_components(memb.select("node"), e).withColumnRenamed("community", "piece")
    per = comps.join(memb, "node").groupBy("community").agg(F.count_distinct("piece").alias("n"))
    assert all(r["n"] == 1 for r in per.collect())


def test_cpm_resolution_changes_granularity(spark, path_graph):
    nodes, edges = path_graph
    coarse = cm.leiden(nodes, edges, resolution=0.01).select("community").distinct().count()
    fine = cm.leiden(nodes, edges, resolution=2.0).select("community").distinct().count()
    assert coarse < fine


def test_deterministic(spark):
    nodes, edges = two_triangles(spark)
    a = sorted(map(tuple, cm.louvain(nodes, edges).collect()))
    b = sorted(map(tuple, cm.louvain(nodes, edges).collect()))
    assert a == b


def test_fallback_and_guards(spark):
    nodes = spark.createDataFrame([("a",), ("b",)], "node string")
    no_edges = spark.createDataFrame([], "src string, dst string")
    memb, used = cm.detect(nodes, no_edges, "leiden")
    assert used == "default" and sorted(map(tuple, memb.collect())) == [("a", "a"), ("b", "b")]
    assert qm.modularity(memb, no_edges).first()["modularity"] == 0.0
    with pytest.raises(ValueError):
        cm.detect(nodes, no_edges, "nope")
    with pytest.raises(ValueError):
        cm.detect(spark.createDataFrame([], "node string"), no_edges, "leiden")


def test_contraction_preserves_weight_and_modularity(spark):
    nodes, edges = two_triangles(spark)
    lg = cm._level0(nodes.where("node <> 'q'"), edges)
    assign = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x"), ("z", "x")],
                                   "v string, c string")
    total = lg.wedges.agg(F.sum("weight")).first()[0]
    small = cm._contract(lg, assign)
    assert small.wedges.agg(F.sum("weight")).first()[0] == total
    assert small.vertices.agg(F.sum("k")).first()[0] == 2 * total

    def modularity(level, communities):
        return qm.modularity(communities.withColumnsRenamed({"v": "node", "c": "community"}),
                             level.wedges).first()["modularity"]

    assert modularity(lg, assign) == pytest.approx(5 / 14, abs=1e-6)


def test_path_graph_label_propagation(spark, path_graph):
    nodes, edges = path_graph
    q = qm.modularity(cm.label_propagation(nodes, edges), edges).first()["modularity"]
    assert q >= 0.3367 - 1e-6


def _graph(kind, n):
    if kind == "grid":
        a = int(n ** 0.5)
        return ([(i * a + j, i * a + j + 1) for i in range(a) for j in range(a - 1)]
                + [(i * a + j, (i + 1) * a + j) for i in range(a - 1) for j in range(a)])
    return [(i, i + 1) for i in range(n - 1)] + [(n - 1, 0)] * (kind == "ring")


def _modularity(memb, pairs):
    m, inside, mass = len(pairs), 0, {}
    for a, b in pairs:
        inside += memb[a] == memb[b]
        for v in (a, b):
            mass[memb[v]] = mass.get(memb[v], 0) + 1
    return inside / m - sum(k * k for k in mass.values()) / (4 * m * m)


@pytest.mark.parametrize("kind,n,algo", [("path", 200, "louvain"), ("path", 100, "leiden"),
                                         ("ring", 100, "louvain"), ("grid", 64, "leiden")])
def test_tied_gains_do_not_stall(spark, kind, n, algo):
    """Unweighted graphs, all gains tied: at least 95 % of the modularity of
    the best cut into equal pieces (of consecutive ids)."""
    pairs = _graph(kind, n)
    edges = spark.createDataFrame(pairs, "src long, dst long")
    memb, _ = cm.detect(spark.range(n).withColumnRenamed("id", "node"), edges, algo)
    best = max(_modularity({i: i * k // n for i in range(n)}, pairs) for k in range(1, n))
    assert _modularity(dict(map(tuple, memb.collect())), pairs) >= 0.95 * best


def _rounds(monkeypatch, run):
    """Rounds of local moving that ``run`` takes."""
    seen = []
    keep = cm.RoundKeeper.keep_counts
    monkeypatch.setattr(cm.RoundKeeper, "keep_counts", lambda self, df, **c: seen.append(1) or keep(self, df, **c))
    out = run()
    monkeypatch.undo()
    return len(seen), out


def test_a_large_community_dissolves_in_few_rounds(spark, monkeypatch):
    """Leaves that start together, apart from the hub that all of them want to
    join, go at once, however many they are."""
    rounds = {}
    for n in (20, 400):
        edges = spark.range(1, n + 1).selectExpr("0L as src", "id as dst").unionByName(
            spark.range(n + 1, 3 * n, 2).selectExpr("id as src", "id + 1 as dst"))
        nodes = edges.selectExpr("src as node").union(edges.selectExpr("dst")).distinct()
        lg = cm._level0(nodes, edges)
        start = lg.vertices.selectExpr("v", f"if(v between 1 and {n}, 1, v) as c")
        rounds[n], (memb, moves) = _rounds(
            monkeypatch, lambda: cm._local_moves(lg, start, float(edges.count()), 1.0, "modularity"))
        assert memb.where(f"v between 0 and {n}").select("c").distinct().count() == 1 and moves >= n
    assert rounds[400] <= rounds[20] + 2 <= 8


def test_rising_gains_along_a_path_take_few_rounds(spark, monkeypatch):
    """Every vertex wants the next one, the last edge weighs most."""
    n = 200
    edges = spark.range(n - 1).selectExpr("id as src", "id + 1 as dst", "1.0 + id / 100 as weight")
    lg = cm._level0(spark.range(n).selectExpr("id as node"), edges)
    m = edges.agg(F.sum("weight")).first()[0]
    rounds, _ = _rounds(monkeypatch, lambda: cm._local_moves(
        lg, lg.vertices.selectExpr("v", "v as c"), m, 1.0, "modularity"))
    assert rounds < 30


def test_many_that_want_one_community_take_few_rounds(spark, monkeypatch):
    """Leaves of one hub under the constant Potts model: any hundred of them
    gain beside it, no one gains enough for half of all the others."""
    n, gamma = 400, 0.01
    edges = spark.range(1, n + 1).selectExpr("0L as src", "id as dst")
    lg = cm._level0(spark.range(n + 1).selectExpr("id as node"), edges)
    rounds, (memb, moves) = _rounds(monkeypatch, lambda: cm._local_moves(
        lg, lg.vertices.selectExpr("v", "v as c"), float(n), gamma, "cpm"))
    sizes = sorted(r["count"] for r in memb.groupBy("c").count().collect())
    assert moves >= 99 and sizes == [1] * (n - 99) + [100]
    assert rounds < 30


def test_rounds_on_large_graphs_broadcast_nothing(spark, monkeypatch):
    """Beyond ``MERGED`` vertices no join of a round passes through the driver,
    and the memberships are those of the broadcast joins."""
    nodes, edges = two_triangles(spark)
    plans, keep = [], cm.RoundKeeper.keep_counts
    monkeypatch.setattr(cm.RoundKeeper, "keep_counts", lambda self, df, **c: plans.append(
        df._jdf.queryExecution().executedPlan().toString()) or keep(self, df, **c))
    found = {}
    for most in (cm.MERGED, 0):
        monkeypatch.setattr(cm, "MERGED", most)
        plans.clear()
        found[most] = [sorted(map(tuple, f(nodes, edges).collect())) for f in (cm.label_propagation, cm.louvain)]
        hinted = [p for p in plans if "SortMergeJoin" in p]
    assert len(hinted) == len(plans) and len({str(x) for x in found.values()}) == 1


def _objective(memb, pairs, gamma):
    """Modularity at γ = 1, else weight inside less γ per pair of members."""
    if gamma == 1.0:
        return _modularity(memb, pairs)
    sizes = {}
    for c in memb.values():
        sizes[c] = sizes.get(c, 0) + 1
    return (sum(memb[a] == memb[b] for a, b in pairs)
            - gamma * sum(n * (n - 1) / 2 for n in sizes.values()))


def test_resolutions_swept_together(spark, monkeypatch):
    """Cliques on a ring with an isolated node: every resolution of one run is
    a partition with the smallest members as labels, about as good as the best
    cut of the ring into equal stretches, and the cliques or lone nodes where
    these are best; the shared arcs are written once."""
    size, cliques, gammas = 5, 8, (0.01, 0.3, 1.0, 2.0, 0.3)
    n = size * cliques
    pairs = [(c * size + i, c * size + j) for c in range(cliques) for i in range(size) for j in range(i)]
    pairs += [(c * size, (c + 1) % cliques * size + 1) for c in range(cliques)]
    edges = spark.createDataFrame(pairs, "src long, dst long")
    nodes = spark.range(n + 1).withColumnRenamed("id", "node")
    shared, write = [], cm.write_table
    monkeypatch.setattr(cm, "write_table", lambda df, kind="table": (
        shared.append(df.count()) if "k" in df.columns and kind == "arcs" else None) or write(df, kind))
    found = cm.cut_lineage(cm.resolution_memberships(nodes, edges, gammas))
    monkeypatch.undo()
    rows = found.collect()
    assert shared == [2 * len(pairs)]
    assert len(rows) == 4 * (n + 1)
    scores = {r["resolution"]: r for r in cm.resolution_scores(found, edges, gammas).collect()}
    assert sorted(scores) == sorted(set(gammas))
    for g, row in scores.items():
        memb = {r["node"]: r["community"] for r in rows if r["resolution"] == g}
        assert sorted(memb) == list(range(n + 1))
        assert all(min(v for v in memb if memb[v] == c) == c for c in memb.values())
        best = max(_objective({v: v * k // n for v in range(n)}, pairs, g) for k in range(1, n + 1))
        assert _objective(memb, pairs, g) >= 0.95 * best
        assert row["num_communities"] == len(set(memb.values()))
        assert row["modularity"] == pytest.approx(_modularity(memb, pairs))
        if g == 0.3:
            assert memb == {v: v // size * size for v in memb}
        if g == 2.0:
            assert all(v == c for v, c in memb.items())


def test_resolutions_without_edges_and_of_names(spark, path_graph):
    nodes, _ = path_graph
    none = spark.createDataFrame([], "src string, dst string")
    rows = cm.resolution_memberships(nodes, none, (0.5, 1.0)).collect()
    assert len(rows) == 16 and all(r["node"] == r["community"] for r in rows)
    with pytest.raises(ValueError):
        cm.resolution_memberships(nodes, none, ())
    nodes, edges = two_triangles(spark)
    rows = cm.resolution_memberships(nodes, edges, (0.4, 1.0)).collect()
    for g in (0.4, 1.0):
        assert {r["node"]: r["community"] for r in rows if r["resolution"] == g} == dict(zip("abcxyzq", "aaaxxxq"))


def test_a_sweep_in_one_task_finds_what_rounds_of_joins_find(spark, monkeypatch):
    """A small graph's sweep keeps no round's state, and its memberships are
    those of the rounds: hubs that many want, cliques, ties, a loop, an end that
    is no node, a node listed twice, names of several bytes."""
    pairs = [(0, i) for i in range(1, 25)] + [(i, i + 1) for i in range(20, 40)] + [(50, 50), (51, 90)]
    pairs += [(c + i, c + j) for c in (41, 45) for i in range(4) for j in range(i)] + [(40, 41), (44, 45)]
    named = lambda i: "é" * (i % 3) + f"n{i}"
    edges = spark.createDataFrame([(named(a), named(b)) for a, b in pairs], "src string, dst string")
    nodes = spark.createDataFrame([(named(i),) for i in [*range(53), 3, 46]], "node string")
    gammas = (0.05, 1.0)
    rounds, here = _rounds(monkeypatch, lambda: sorted(cm.resolution_memberships(nodes, edges, gammas).collect()))
    assert rounds == 0 and len(here) == 2 * 53
    monkeypatch.setattr(cm, "ONE_TASK", 0)
    rounds, there = _rounds(monkeypatch, lambda: sorted(cm.resolution_memberships(nodes, edges, gammas).collect()))
    assert rounds > 10 and here == there


def test_hashes_and_decimals_of_arrays_are_sparks(spark):
    rows = spark.range(-50, 50).selectExpr(
        "xxhash64(struct(3, id)) as seed", "xxhash64(struct(3, id), 7) as h",
        "xxhash64(struct(3, id), 7, 'side') as side", "xxhash64(struct(3, id), 7, 'level') as level").toPandas()
    h = moving.hash_int(7, rows["seed"].to_numpy().view("uint64"))
    assert (h.view("int64") == rows["h"]).all()
    for text in ("side", "level"):
        assert (moving.hash_text(text.encode(), h).view("int64") == rows[text]).all()
    rows = spark.range(1000).selectExpr("id / 8e6 + id % 7 as x").selectExpr(
        "x", "cast(cast(x as decimal(28, 6)) * 1000000 as bigint) as y").toPandas()
    assert (moving.micros(rows["x"].to_numpy()) == rows["y"]).all()


def test_sweep_invariants_of_documents_keep_no_round(spark, monkeypatch, tmp_path):
    """What the registered query reports, without a written table per round."""
    from corpusgraph.plans.community_queries import RESOLUTIONS, q_resolution_sweep_invariants

    line = "a line that is long enough to count, number {}".format
    texts = ["\n".join([line(i // 4), line(f"{i} alone")] + [line("bridge")] * (i in (3, 4))) for i in range(12)]
    spark.createDataFrame([*enumerate(texts), (12, None)], "doc_id long, text string") \
        .write.parquet(f"{tmp_path}/documents.parquet")
    rounds, rows = _rounds(monkeypatch, lambda: q_resolution_sweep_invariants(spark, str(tmp_path)).collect())
    assert rounds == 0
    assert sorted(map(tuple, rows)) == [(g, 13, 13, 0, 0, 0, int(g <= 1)) for g in RESOLUTIONS]
