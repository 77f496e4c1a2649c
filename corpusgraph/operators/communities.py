"""Iterative community detection on DataFrames.

All algorithms take ``nodes(node)`` and ``edges(src, dst[, weight])`` and
return ``membership(node, community)``.  Every round is a handful of joins
and grouped aggregates (partial aggregation keeps hub nodes from gathering
their neighbourhood in one task); every round ends in a reliable checkpoint
and the driver reads only scalars (number of moves, modularity).

Determinism: the reference is unseeded; here every choice is a function of
ids and the round's number (hashes for roles and ties), so a re-run gives the
same output.  Community labels are the smallest member id.
"""

from __future__ import annotations

import functools
import itertools
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F, types as T

from corpusgraph.operators import moving
from corpusgraph.operators.components import connected_components
from corpusgraph.operators.moving import EPS, FRONTIER, next_rule
from corpusgraph.operators.quality import community_details, modularity_of
from corpusgraph.session import RoundKeeper, cut_lineage, delete_table, write_table

_DEBUG = bool(__import__("os").environ.get("CG_DEBUG"))


def _log(*a):
    if _DEBUG:
        import time
        print(f"[cg {time.strftime('%H:%M:%S')}]", *a, flush=True)


#: Up to so many vertices a round's joins may be broadcasts, which pass through
#: the driver; beyond it they are merges, so that what the driver gets does not
#: grow with the graph.
MERGED = 150_000

#: Up to so many edges, counted once for each resolution, a sweep's rounds run in
#: one task: its arrays take some 130 bytes for each, while a round of stages
#: takes seconds however few they are.  The second is the most weight in all,
#: below which gains in millionths can be summed as whole numbers.
ONE_TASK, MOST_WEIGHT = 4_000_000, 1e12


def _sized(text: str, n: int) -> str:
    """A round's statement for ``n`` vertices, without its merge hints if few."""
    return text if n > MERGED else re.sub(r"/\*\+.*?\*/ ", "", text)


def _weighted(edges: DataFrame) -> DataFrame:
    w = F.col("weight") if "weight" in edges.columns else F.lit(1.0)
    return edges.select("src", "dst", w.cast("double").alias("weight"))


def weighted_arcs(edges: DataFrame) -> DataFrame:
    """Non-loop arcs in both directions: ``a, b, w``."""
    e = _weighted(edges).where(F.col("src") != F.col("dst"))
    return (e.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("weight").alias("w"))
            .unionByName(e.select(F.col("dst").alias("a"), F.col("src").alias("b"),
                                  F.col("weight").alias("w"))))


def relabel_min(membership: DataFrame) -> DataFrame:
    """Label every community by its smallest member (partial aggregate)."""
    lab = membership.groupBy("community").agg(F.min("node").alias("_lab"))
    return membership.join(lab, "community").select("node", F.col("_lab").alias("community"))


def singletons(nodes: DataFrame) -> DataFrame:
    """D7 last resort: every node its own community."""
    return nodes.select("node", F.col("node").alias("community"))


def split_isolated(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes that touch an edge, singleton membership of the rest).

    Isolated nodes never move and never change a neighbour, so iterative
    rounds only need the others; on sparse graphs that is most of the work
    saved.  Semi/anti joins against the distinct endpoints."""
    ends = (edges.select(F.col("src").alias("node"))
            .unionByName(edges.select(F.col("dst").alias("node"))).distinct())
    n = nodes.select("node")
    return n.join(ends, "node", "left_semi"), singletons(n.join(ends, "node", "left_anti"))


# --------------------------------------------------------------------- D1
#: One round: ``state(node, label, r)`` to every node's next label and mark
#: (2 changed, 1 unsettled, 0 settled).  ``unsettled`` nodes have a label that
#: another one outnumbers among their neighbours.
_LABELS = """
WITH seen AS (
  SELECT a, label, sum(n) AS n, max(own) AS own, max(r) AS r FROM (
    SELECT /*+ MERGE(arcs, s, o) */ a, label, 1 AS n, false AS own, r FROM {{arcs}} arcs JOIN {{state}} s ON b = node {open}
    UNION ALL SELECT node, label, 0, true, r FROM {{state}})
  GROUP BY a, label),
best AS (
  SELECT a, max(struct(n, label)) AS top, max(if(own, n, null)) AS n, max(r) AS r FROM seen GROUP BY a),
unsettled AS (
  SELECT a, top.label AS label, struct(xxhash64(a, r) AS h, a AS id) AS prio FROM best WHERE n < top.n),
turn AS ({turn})
SELECT /*+ MERGE(state, turn) */ node, if(goes, turn.label, state.label) AS label, r + 1 AS r,
       CASE WHEN goes THEN 2 WHEN a IS NOT NULL THEN 1 ELSE 0 END AS mark
FROM {{state}} state LEFT JOIN turn ON a = node
"""
_TURN = {
    "half": "SELECT a, label, pmod(prio.h, 2) = 0 AS goes FROM unsettled",
    "set": """
  SELECT /*+ MERGE(u, s) */ u.a, u.label, coalesce(u.prio > rival, true) AS goes FROM unsettled u LEFT JOIN (
    SELECT /*+ MERGE(arcs, o, v) */ arcs.a, max(v.prio) AS rival FROM {{arcs}} arcs LEFT SEMI JOIN unsettled o ON o.a = arcs.a
    JOIN unsettled v ON v.a = b GROUP BY arcs.a) s ON s.a = u.a""",
}


def label_propagation(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Majority label; keep the current label when it is among the most
    frequent, otherwise take the largest of them.  Isolated nodes keep their
    own label.  Semi-synchronous by default: the first round lets half of
    the unsettled nodes (hash parity) change; later rounds let an independent
    set of them change (each beats all unsettled neighbours by a per-round
    hash priority), which rules out the oscillation of synchronous updates: a
    change adds edges inside labels and no neighbour changes with it, so the
    number of such edges only grows and the loop ends.  A round looks at the
    unsettled nodes and the neighbours of changed ones only, as nothing else
    can have become unsettled.  It stops when every node's label is among its
    most frequent neighbour labels; there is no cap on rounds.
    """
    nodes, isolated = split_isolated(nodes, edges)
    arcs = weighted_arcs(edges).select("a", "b")
    arcs_path = write_table(arcs, "arcs")
    spark = arcs.sparkSession
    arcs = spark.read.schema(arcs.schema).parquet(arcs_path)
    state = nodes.select("node", F.col("node").alias("label"), F.lit(0).alias("r"))
    keeper, frontier, n = RoundKeeper(), False, nodes.count()
    for r in itertools.count():
        views = {"state": state, "arcs": arcs}
        if frontier:
            went = state.where("mark = 2").select(F.col("node").alias("b"))
            views["open"] = (arcs.join(went, "b", "left_semi").select(F.col("a").alias("node"))
                             .unionByName(state.where("mark = 1").select("node")))
        text = _LABELS.format(turn=_TURN["set" if r else "half"].format(),
                              open="LEFT SEMI JOIN {open} o ON o.node = arcs.a" if frontier else "")
        state, seen = keeper.keep_counts(
            spark.sql(_sized(text, n), **views), changed=F.count_if(F.col("mark") == 2),
            waiting=F.count_if(F.col("mark") == 1), n=F.count("*"))
        _log(f"label-propagation round {r}: {seen}")
        if not seen["changed"] and not seen["waiting"]:
            break
        frontier = seen["changed"] * FRONTIER < seen["n"]
    delete_table(spark, arcs_path)
    return relabel_min(state.select("node", F.col("label").alias("community"))).unionByName(isolated)


# --------------------------------------------------------------------- D2–D4
@dataclass
class LevelGraph:
    """A (possibly contracted) weighted graph: ``vertices(v, k, size)`` and
    ``wedges(src, dst, weight)`` in canonical form, self-loops allowed.  With
    lanes (see ``Scale``) a vertex is ``(g, v)``; ``shared`` wedges are kept
    once for all lanes and lead between plain ``v``."""

    vertices: DataFrame
    wedges: DataFrame
    shared: bool = False


@dataclass
class Scale:
    """What a move gains: ``link`` per unit of edge weight less ``unit`` per
    pair of masses (a vertex column).  One per resolution; with several,
    ``lanes`` is set, every vertex carries its resolution's number as ``g``
    and all of them move in the same rounds."""

    link: list
    unit: list
    mass: list
    lanes: bool = False

    @classmethod
    def of(cls, m: float, terms: list, lanes: bool = False) -> Scale:
        """From ``(resolution, objective)`` and the graph's edge weight."""
        mod = [objective == "modularity" for _, objective in terms]
        return cls([1.0 / m if q else 1.0 for q in mod],
                   [g / (2.0 * m * m) if q else float(g) for (g, _), q in zip(terms, mod)],
                   ["k" if q else "size" for q in mod], lanes)

    def pick(self, values: list, vertex: str) -> str:
        """SQL: the value that holds for the lane of ``vertex``."""
        return f"element_at(array({', '.join(values)}), {vertex}.g + 1)" if self.lanes else values[0]

    def number(self, name: str, vertex: str) -> str:
        return self.pick([f"{x}D" for x in getattr(self, name)], vertex)

    def mass_of(self, vertex: str, table: str = "") -> str:
        degree = self.pick([str(x == "k").lower() for x in self.mass], vertex)
        return f"CAST(if({degree}, {table}k, {table}size) AS DOUBLE)"


def _level0(nodes: DataFrame, edges: DataFrame) -> LevelGraph:
    e = (_weighted(edges)
         .select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "weight")
         .groupBy("src", "dst").agg(F.max("weight").alias("weight")))
    return _with_degrees(nodes.select(F.col("node").alias("v"), F.lit(1).cast("long").alias("size")), e)


def _with_degrees(vs: DataFrame, wedges: DataFrame) -> LevelGraph:
    deg = (wedges.select(F.col("src").alias("v"),
                         F.when(F.col("src") == F.col("dst"), 2 * F.col("weight"))
                         .otherwise(F.col("weight")).alias("k"))
           .unionByName(wedges.where(F.col("src") != F.col("dst"))
                        .select(F.col("dst").alias("v"), F.col("weight").alias("k")))
           .groupBy("v").agg(F.sum("k").alias("k")))
    vertices = (vs.join(deg, "v", "left")
                .select("v", F.coalesce("k", F.lit(0.0)).alias("k"), "size"))
    return LevelGraph(cut_lineage(vertices), cut_lineage(wedges))


#: One round of local moving: ``state(v, c, x, r)`` and ``arcs(a, b, w, x)``
#: (x: the constant mass of a) to every vertex's next community and mark (2
#: moved, 1 waits, 0 rests).  ``wanted`` has the best move that gains of each
#: open vertex; one aggregate by (vertex, community) holds links, mass and the
#: vertex's own community.  The rest decides which are made, see
#: ``_local_moves``.  The round's number r is a column: as a literal it would
#: make each round's generated code new to the compiler.
_ROUND = """
WITH tot AS (SELECT c AS cb, sum(x) AS tot, count(*) AS n, max(r) AS r FROM {{state}} GROUP BY c),
seen AS (
  SELECT a, cb, sum(w) AS kic, max(x) AS x, max(own) AS own FROM (
    {links}
    UNION ALL SELECT v, c, 0.0D, x, true FROM {{state}})
  GROUP BY a, cb),
rated AS (
  SELECT /*+ MERGE(seen, tot) */ a, cb, x, own, n, r, {link} * kic - {unit} * x * (tot - if(own, x, 0.0D)) AS gain
  FROM seen JOIN tot USING (cb)),
best AS (
  SELECT a, max(if(own, null, struct(gain, xxhash64(cb, r) AS h, cb))) AS t, max(x) AS x, max(r) AS r,
         max(if(own, cb, null)) AS cur, max(if(own, gain, null)) AS stay, max(if(own, n, null)) AS n
  FROM rated GROUP BY a),
wanted AS (
  SELECT a, cur, t.cb AS to, x, r, t.gain - stay AS delta, {level} AS lvl,
         struct(t.gain - stay AS delta, xxhash64(a, r) AS h, a, t.cb AS to) AS rank
  FROM best WHERE t.gain - stay > {eps} {alone}),
sides AS (
  SELECT c, {by} coalesce(sum(if(goes, null, gain)), 0) AS gain_in, coalesce(sum(if(goes, gain, null)), 0) AS gain_out,
         coalesce(sum(if(goes, null, x)), 0) AS x_in, coalesce(sum(if(goes, x, null)), 0) AS x_out,
         max(if(goes, null, rank)) AS first_in, max(if(goes, rank, null)) AS first_out, max(r) AS r
  FROM (SELECT explode(array(struct(to AS c, false AS goes), struct(cur AS c, true AS goes))) AS e, e.c, e.goes,
               CAST(delta / {link} AS DECIMAL(28, 6)) AS gain, x, rank, r, lvl FROM wanted)
  GROUP BY {by} c),
roles AS (SELECT c, {by} x_in, x_out, first_in, first_out, {gives} AS gives FROM {sides}),
made AS (
  SELECT /*+ MERGE(w, f, t) */ w.a, w.to, f.gives AND NOT t.gives AND {fits} AS accepted
  FROM wanted w JOIN roles f ON f.c = w.cur {at_f} JOIN roles t ON t.c = w.to {at_t})
SELECT /*+ MERGE(s, made) */ v, if(accepted, to, c) AS c, x, r + 1 AS r,
       CASE WHEN accepted THEN 2 WHEN to IS NOT NULL THEN 1 ELSE 0 END AS mark
FROM {{state}} s LEFT JOIN made ON a = v
"""
#: The links of open vertices to the communities beside them, by (arcs shared
#: by all lanes, open vertices known).
_LINKS = {
    (False, False): "SELECT /*+ MERGE(arcs, s) */ a, c AS cb, w, arcs.x, false AS own "
                    "FROM {{arcs}} arcs JOIN {{state}} s ON b = v",
    (False, True): "SELECT /*+ MERGE(arcs, s, o) */ a, c AS cb, w, arcs.x, false AS own FROM {{arcs}} arcs JOIN {{state}} s ON b = v "
                   "LEFT SEMI JOIN {{open}} o ON o.v = arcs.a",
    (True, False): "SELECT /*+ MERGE(arcs, s) */ struct(s.v.g AS g, arcs.a AS v) AS a, s.c AS cb, w, {x} AS x, false AS own "
                   "FROM {{arcs}} arcs JOIN {{state}} s ON arcs.b = s.v.v",
    (True, True): "SELECT /*+ MERGE(o, arcs, s) */ o.v AS a, s.c AS cb, w, {x} AS x, false AS own FROM {{open}} o "
                  "JOIN {{arcs}} arcs ON arcs.a = o.v.v JOIN {{state}} s ON s.v = struct(o.v.g AS g, arcs.b AS v)",
}
#: How the moves wanted are ranked against each other: all alike, or by levels,
#: each with half the moves of the one below, of which a move bears all the mass
#: above it (twice, as a pair on one level shares its cost).
_ALIKE = {"level": "0", "by": "", "sides": "sides", "at_f": "", "at_t": ""}
_LEVELS = {
    "level": "bit_count((xxhash64(a, r, 'level') & 9223372036854775807) - 1 & ~xxhash64(a, r, 'level'))",
    "by": "lvl,", "at_f": "AND f.lvl = w.lvl", "at_t": "AND t.lvl = w.lvl",
    "sides": """(
  SELECT c, lvl, r, sum(gain_in) OVER whole AS gain_in, sum(gain_out) OVER whole AS gain_out,
         -x_in + 2 * sum(x_in) OVER above AS x_in, -x_out + 2 * sum(x_out) OVER above AS x_out,
         max(first_in) OVER whole AS first_in, max(first_out) OVER whole AS first_out
  FROM sides WINDOW whole AS (PARTITION BY c),
    above AS (PARTITION BY c ORDER BY lvl DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""",
}
_GIVES = {
    "sums": "gain_out > gain_in OR gain_out = gain_in AND coalesce("
            "xxhash64(c, r, 'side') > xxhash64(first_out.to, r, 'side'), false)",
    "coin": "pmod(xxhash64(c, r, 'side'), 2) = 0",
    "single": "first_in IS NULL OR coalesce(first_out > first_in, false)",
}


def _local_moves(lg: LevelGraph, start: DataFrame, m: float, resolution: float, objective: str,
                 merge_only: bool = False) -> tuple[DataFrame, int]:
    """``_move`` for one resolution: (``v, c``) and the number of moves."""
    out, moves = _move(lg, start, Scale.of(m, [(resolution, objective)]), merge_only)
    return out, moves[0]


def _open_vertices(state: DataFrame, arcs: DataFrame, shared: bool) -> DataFrame:
    """The neighbours of the vertices that moved and those whose move waits."""
    waits, went = state.where("mark = 1").select("v"), state.where("mark = 2").select("v")
    if not shared:
        beside = arcs.join(went.withColumnRenamed("v", "b"), "b", "left_semi").select(F.col("a").alias("v"))
        return beside.unionByName(waits)
    beside = (went.select(F.col("v.g").alias("g"), F.col("v.v").alias("b")).join(arcs, "b")
              .select(F.struct("g", F.col("a").alias("v")).alias("v")))
    return beside.unionByName(waits).distinct()


def _shared_arcs(lg: LevelGraph) -> DataFrame:
    """Both directions of the shared wedges with the masses of a."""
    of_a = lg.vertices.groupBy(F.col("v.v").alias("a")).agg(F.max("k").alias("k"), F.max("size").alias("size"))
    return weighted_arcs(lg.wedges).join(of_a, "a").select("a", "b", "w", "k", "size")


def _move(lg: LevelGraph, start: DataFrame, scale: Scale, merge_only: bool = False) -> tuple[DataFrame, list]:
    """Parallel local moving on one level from ``start(v, c)``; returns
    (``v, c``) and the number of moves of every lane.

    Per round every open vertex names the community it gains most from, and
    an independent set of these moves is made, any number of them out of or
    into one community, so that the rounds do not grow with the size of
    communities.  Open are first all vertices, then the neighbours of those
    that moved and those whose move was not accepted.

    Communities are givers or takers for the round and moves lead from givers
    to takers, so no move changes what another one joins or leaves behind,
    but for vertices that share their source or their target.  Two that share
    one cost each other the null-model term of their pair; a move is accepted
    if it gains more than half of that with all others wanted there, so the
    accepted ones raise the objective together, whichever they are.

    A community gives if moves out of it gain more in sum than moves into it;
    summed over all such givers some move then leads to a taker.  Where both
    sums are equal it gives if the round's hash puts it above the community
    that its first move leads to, so of two that want each other one gives.

    Where many want the same community, none may gain enough for all the
    others.  So after a round that accepted few of the moves wanted they are
    ranked by levels, drawn by hash, each with half the moves of the one below:
    a move bears the whole cost of the pairs with higher levels and half of
    those on its own, so each pair is paid for and the few on high levels go.
    After a round by levels that accepted few, the hash alone chooses the next
    givers, which lets a quarter of the moves pass whatever the gains; after
    one that moved nothing a community's first move (gain, then hash) decides
    and only moves that come first on both sides are made: the first of all
    always is.  So the loop ends, without a cap, when no open vertex gains.

    With ``merge_only`` only vertices that are still alone may move (the
    refinement of Leiden).  All figures are partial aggregates; the driver
    reads one row of counts per round.
    """
    masses = lg.vertices.select("v", F.expr(scale.mass_of("v")).alias("x"))
    if lg.shared:
        arcs = _shared_arcs(lg)
    else:
        arcs = weighted_arcs(lg.wedges).join(masses.withColumnRenamed("v", "a"), "a").select("a", "b", "w", "x")
    arcs_path = write_table(arcs, "arcs")
    arcs = arcs.sparkSession.read.schema(arcs.schema).parquet(arcs_path)
    state = masses.join(start, "v").select("v", "c", "x", F.lit(0).alias("r"))
    keeper, spark, n = RoundKeeper(), arcs.sparkSession, lg.vertices.count()
    mode, levels, frontier, total_moves = "sums", False, False, [0] * len(scale.mass)
    went = F.col("mark") == 2
    of_lane = {f"moved{g}": F.count_if(went & (F.col("v.g") == g) if scale.lanes else went)
               for g in range(len(scale.mass))}
    for r in itertools.count():
        fits = (f"w.delta > {scale.number('unit', 'w.a')} / 2 * w.x * (t.x_in + f.x_out - 2 * w.x) + {EPS}"
                if mode != "single" else "f.first_out.a = w.a AND t.first_in.a = w.a")
        text = _ROUND.format(
            link=scale.number("link", "a"), unit=scale.number("unit", "a"), eps=EPS, gives=_GIVES[mode],
            fits=f"({fits})", **(_LEVELS if levels else _ALIKE), alone="AND n = 1" if merge_only else "",
            links=_LINKS[lg.shared, frontier].format(x=scale.mass_of("s.v", "arcs.")))
        views = {"state": state, "arcs": arcs}
        if frontier:
            views["open"] = _open_vertices(state, arcs, lg.shared)
        state, seen = keeper.keep_counts(
            spark.sql(_sized(text, n), **views), waiting=F.count_if(F.col("mark") == 1), n=F.count("*"), **of_lane)
        now = [seen[name] for name in of_lane]
        moved, waiting = sum(now), seen["waiting"]
        _log(f"local-move round {r}: {moved} moved, {waiting} wait ({mode}{', levels' * levels})")
        total_moves = [x + y for x, y in zip(total_moves, now)]
        if not moved and not waiting:
            delete_table(spark, arcs_path)
            return state.select("v", "c"), total_moves
        mode, levels = next_rule(mode, levels, moved, waiting)
        frontier = moved * FRONTIER < seen["n"]


def _ends(lg: LevelGraph, assign: DataFrame) -> DataFrame:
    """The edges with the communities ``cs``, ``cd`` of their ends; shared ones
    become every lane's own."""
    edges, src = lg.wedges, assign.select(F.col("v").alias("src"), F.col("c").alias("cs"))
    dst = assign.select(F.col("v").alias("dst"), F.col("c").alias("cd"))
    if not lg.shared:
        return edges.join(src, "src").join(dst, "dst")
    ends = [F.struct("g", F.col(end).alias("v")).alias(end) for end in ("src", "dst")]
    own = edges.join(src.select("src.g", F.col("src.v").alias("src"), "cs"), "src")
    return own.select(*ends, "weight", "cs").join(dst, "dst")


def _contract(lg: LevelGraph, assign: DataFrame) -> LevelGraph:
    """Communities become vertices; their degree and size are their members' sums."""
    e = (_ends(lg, assign)
         .select(F.least("cs", "cd").alias("src"), F.greatest("cs", "cd").alias("dst"), "weight")
         .groupBy("src", "dst").agg(F.sum("weight").alias("weight")))
    vs = assign.join(lg.vertices, "v").groupBy(F.col("c").alias("v")).agg(
        F.sum("k").alias("k"), F.sum("size").alias("size"))
    return LevelGraph(cut_lineage(vs), cut_lineage(e))


def _inside(lg: LevelGraph, assign: DataFrame) -> DataFrame:
    """The edges whose ends share a community."""
    return cut_lineage(_ends(lg, assign).where(F.col("cs") == F.col("cd")).select("src", "dst", "weight"))


def _split_disconnected(graph: LevelGraph, membership: DataFrame) -> DataFrame:
    """Every community's connected parts, on the graph of the nodes."""
    inside = _inside(graph, membership.select(F.col("node").alias("v"), F.col("community").alias("c")))
    return connected_components(membership.select("node"), inside)


def louvain(nodes: DataFrame, edges: DataFrame, resolution: float = 1.0,
            objective: str = "modularity", refine: bool = False) -> DataFrame:
    """D2 (``refine=False``), D3 (``refine=True``), D4 (``objective='cpm'``).

    Levels repeat until local moving leaves every vertex where it is.  With
    ``refine`` a level's communities are first refined: each is taken apart
    and its vertices merge again inside it only, and the graph is contracted
    by these smaller communities while the next level starts from the
    larger ones, so that badly attached parts can leave together.
    """
    if objective not in ("modularity", "cpm"):
        raise ValueError(f"unknown objective {objective}")
    all_nodes = nodes
    nodes, isolated = split_isolated(nodes, edges)
    lg = _level0(nodes, edges)
    graph = lg
    m = lg.wedges.agg(F.coalesce(F.sum("weight"), F.lit(0.0))).first()[0]
    if m <= 0:
        return singletons(all_nodes)
    #: node -> vertex of the current level; start: vertex -> community
    place = cut_lineage(nodes.select("node", F.col("node").alias("v")))
    start = cut_lineage(lg.vertices.select("v", F.col("v").alias("c")))
    while True:
        assign, moves = _local_moves(lg, start, m, resolution, objective)
        _log(f"level done: {moves} moves")
        if not moves:
            break
        parts = assign
        if refine:
            inside = _inside(lg, assign)
            alone = lg.vertices.select("v", F.col("v").alias("c"))
            parts, _ = _local_moves(LevelGraph(lg.vertices, inside), alone, m, resolution, objective,
                                    merge_only=True)
        place = cut_lineage(place.join(parts, "v").select("node", F.col("c").alias("v")))
        joint = parts.withColumnRenamed("c", "p").join(assign, "v") if refine else assign.withColumn("p", F.col("c"))
        start = joint.groupBy(F.col("p").alias("v")).agg(F.min("c").alias("c"))
        start = cut_lineage(start) if refine else start
        lg = _contract(lg, parts)
    membership = cut_lineage(place.join(start, "v").select("node", F.col("c").alias("community")))
    if refine:  # a vertex that left may have held two parts together
        membership = _split_disconnected(graph, membership)
    return relabel_min(membership).unionByName(isolated)


def leiden(nodes: DataFrame, edges: DataFrame, resolution: float = 1.0) -> DataFrame:
    """Modularity at γ = 1, constant Potts model otherwise."""
    objective = "modularity" if resolution == 1.0 else "cpm"
    return louvain(nodes, edges, resolution, objective=objective, refine=True)


# --------------------------------------------------------------------- D7, D9–D11
ALGORITHMS = ("leiden", "louvain", "label_propagation", "girvan_newman")


def detect(nodes: DataFrame, edges: DataFrame, algorithm: str = "leiden",
           resolution: float = 1.0, **kw) -> tuple[DataFrame, str]:
    """Run one algorithm; an edgeless graph falls back to singletons
    (algorithm ``default``).  Empty node table or unknown name → ValueError."""
    if algorithm not in ALGORITHMS:
        raise ValueError(f"unknown algorithm {algorithm!r}")
    if nodes.isEmpty():
        raise ValueError("graph is empty")
    if edges.isEmpty():
        return singletons(nodes), "default"
    if algorithm == "leiden":
        return leiden(nodes, edges, resolution), algorithm
    if algorithm == "louvain":
        return louvain(nodes, edges, resolution), algorithm
    if algorithm == "label_propagation":
        return label_propagation(nodes, edges), algorithm
    raise NotImplementedError(
        "girvan_newman needs all-pairs shortest paths per edge removal; not built yet")


def compare(nodes: DataFrame, edges: DataFrame,
            algorithms=("leiden", "louvain", "label_propagation")) -> DataFrame:
    """One row per algorithm (communities, modularity at γ=1, status,
    seconds); ``best`` marks the first strictly highest modularity.  A failure
    is raised: a lost executor is no result of an algorithm."""
    import time
    spark = nodes.sparkSession
    rows = []
    best, best_q = None, -1.0
    for i, name in enumerate(algorithms):
        t0 = time.time()
        memb, used = detect(nodes, edges, name)
        memb = cut_lineage(memb)
        took = time.time() - t0
        q = modularity_of(community_details(memb, edges)).first()
        rows.append((i, name, used, int(q["num_communities"]), float(q["modularity"]), "ok", round(took, 3)))
        if q["modularity"] > best_q:
            best, best_q = name, q["modularity"]
    df = spark.createDataFrame(rows, "ord int, algorithm string, used string, "
                                     "num_communities int, modularity double, "
                                     "status string, seconds double")
    return df.withColumn("best", F.col("algorithm") == F.lit(best))


def _in_lanes(col, lanes: int):
    """``(g, v)`` for every lane g of a node."""
    return F.explode(F.transform(F.sequence(F.lit(0), F.lit(lanes - 1)),
                                 lambda g: F.struct(g.alias("g"), col.alias("v"))))


def resolution_memberships(nodes: DataFrame, edges: DataFrame,
                           resolutions=(0.01, 0.5, 1.0, 2.0)) -> DataFrame:
    """``(resolution, node, community)``, Leiden at every resolution (as
    ``leiden``: modularity at γ = 1, constant Potts model otherwise) in one
    run.  The state is keyed by (resolution, vertex): a round of local moving
    reads the edges once and moves the vertices of all resolutions, on the
    nodes' own graph over one copy of the arcs.  A resolution that moved
    nothing on a level is finished and leaves the later levels.  Repeated
    resolutions count once; without edges every node is alone.  Up to
    ``ONE_TASK`` edges all rounds run in one task, over arrays; beyond it, where
    a round's data outweigh its stages, they are joins and aggregates.  Both
    find the same communities.
    """
    gammas = list(dict.fromkeys(float(r) for r in resolutions))
    if not gammas:
        raise ValueError("no resolutions")
    everyone, n = nodes.select("node"), len(gammas)
    nodes, isolated = split_isolated(nodes, edges)
    base = _level0(nodes, edges)
    m, num_edges, unknown = base.wedges.agg(
        F.coalesce(F.sum("weight"), F.lit(0.0)), F.count("*"), F.count_if(F.col("weight").isNull())).first()
    own = lambda df: df.select(_in_lanes(F.col("node"), n).alias("node")).withColumn("community", F.col("node"))
    if m <= 0:
        membership = own(everyone)
    else:
        scale = Scale.of(m, [(g, "modularity" if g == 1.0 else "cpm") for g in gammas], lanes=True)
        one_task = num_edges * n <= ONE_TASK and m < MOST_WEIGHT and not unknown and _numbered(base)
        membership = (_sweep_in_one_task if one_task else _sweep_by_rounds)(base, scale).unionByName(own(isolated))
    return membership.select(F.element_at(F.array(*map(F.lit, gammas)), F.col("node.g") + 1).alias("resolution"),
                             F.col("node.v").alias("node"), F.col("community.v").alias("community"))


def _numbered(base: LevelGraph) -> bool:
    """Whether the ids are of a type that arrays can number in Spark's order."""
    ids = {base.vertices.schema["v"].dataType, *(base.wedges.schema[x].dataType for x in ("src", "dst"))}
    return len(ids) == 1 and ids <= {T.StringType(), T.LongType(), T.IntegerType(), T.ShortType(), T.ByteType()}


def _sweep_in_one_task(base: LevelGraph, scale: Scale) -> DataFrame:
    """``(node, community)`` of lanes over the nodes' own graph: the edges and
    nodes go to one task, which makes all rounds of all levels there."""
    terms = list(zip(scale.link, scale.unit, scale.mass))
    arcs = _shared_arcs(LevelGraph(base.vertices.select(F.struct("v").alias("v"), "k", "size"), base.wedges, True))
    arcs_path = write_table(arcs, "arcs")
    spark, id_type = arcs.sparkSession, base.vertices.schema["v"].dataType
    arcs = spark.read.schema(arcs.schema).parquet(arcs_path).select("a", "b", "w")
    named = F.array(*[F.xxhash64(F.lit(g), "v") for g in range(len(terms))])
    nodes = (base.vertices.groupBy("v").agg(F.max("k").alias("k"), F.count("*").alias("copies"))
             .select(F.col("v").alias("a"), "k", "copies", named.alias("named")))
    rows = nodes.unionByName(arcs, allowMissingColumns=True).repartition(1)
    schema = T.StructType([T.StructField("g", T.IntegerType()), T.StructField("node", id_type),
                           T.StructField("community", id_type)])
    found = cut_lineage(rows.mapInArrow(functools.partial(moving.sweep_rows, terms=terms), schema))
    delete_table(spark, arcs_path)
    return found.select(*[F.struct("g", F.col(x).alias("v")).alias(x) for x in ("node", "community")])


def _sweep_by_rounds(base: LevelGraph, scale: Scale) -> DataFrame:
    """The same by ``_move``, whose rounds are joins and aggregates."""
    n = len(scale.link)
    graph = lg = LevelGraph(
        cut_lineage(base.vertices.select(_in_lanes(F.col("v"), n).alias("v"), "k", "size")), base.wedges, True)
    place = graph.vertices.select(F.col("v").alias("node"), "v")
    start, active, done = lg.vertices.select("v", F.col("v").alias("c")), set(range(n)), []
    while active:
        assign, moves = _move(lg, start, scale)
        _log(f"level done: {moves} moves")
        rests = sorted(g for g in active if not moves[g])
        if rests:
            done.append(cut_lineage(place.where(F.col("v.g").isin(rests)).join(assign, "v")
                                    .select("node", F.col("c").alias("community"))))
            active -= set(rests)
            if not active:
                break
            goes = lambda df, v: df.where(F.col(f"{v}.g").isin(sorted(active)))
            place, assign = goes(place, "v"), goes(assign, "v")
            lg = LevelGraph(goes(lg.vertices, "v"), lg.wedges if lg.shared else goes(lg.wedges, "src"), lg.shared)
        alone = lg.vertices.select("v", F.col("v").alias("c"))
        parts, _ = _move(LevelGraph(lg.vertices, _inside(lg, assign)), alone, scale, merge_only=True)
        place = cut_lineage(place.join(parts, "v").select("node", F.col("c").alias("v")))
        start = cut_lineage(parts.withColumnRenamed("c", "p").join(assign, "v")
                            .groupBy(F.col("p").alias("v")).agg(F.min("c").alias("c")))
        lg = _contract(lg, parts)
    membership = functools.reduce(DataFrame.unionByName, done)
    return relabel_min(_split_disconnected(graph, membership))


def by_resolution(memberships: DataFrame, edges: DataFrame, resolutions) -> tuple[DataFrame, DataFrame]:
    """Membership and edges whose nodes are ``(g, v)``, g the resolution."""
    of = F.explode(F.array(*[F.lit(float(r)) for r in dict.fromkeys(resolutions)]))
    keyed = lambda *cols: [F.struct("g", F.col(c).alias("v")).alias(c) for c in cols]
    return (memberships.withColumnRenamed("resolution", "g").select(*keyed("node", "community")),
            _weighted(edges).withColumn("g", of).select(*keyed("src", "dst"), "weight"))


def resolution_scores(memberships: DataFrame, edges: DataFrame, resolutions) -> DataFrame:
    """(resolution, #communities, modularity at γ=1) of ``memberships``; one
    aggregate for all resolutions."""
    details = community_details(*by_resolution(memberships, edges, resolutions))
    return modularity_of(details.withColumn("resolution", F.col("community.g")), by=("resolution",))


def resolution_sweep(nodes: DataFrame, edges: DataFrame,
                     resolutions=(0.01, 0.5, 1.0, 2.0)) -> DataFrame:
    """``resolution_scores`` of ``resolution_memberships``."""
    return resolution_scores(cut_lineage(resolution_memberships(nodes, edges, resolutions)), edges, resolutions)


def compare_memberships(edges: DataFrame, runs: list) -> DataFrame:
    """D9/E14 from finished runs ``(algorithm, membership, seconds)``: one
    row per algorithm with communities and modularity (γ = 1); ``best`` marks
    the first strictly highest modularity."""
    parts = []
    for i, (name, memb, secs) in enumerate(runs):
        parts.append(modularity_of(community_details(memb, edges)).select(
            F.lit(i).alias("ord"), F.lit(name).alias("algorithm"), "num_communities",
            "modularity", F.lit("ok").alias("status"), F.lit(float(secs)).alias("seconds")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    best = out.agg(F.max("modularity")).scalar()
    first = out.where(F.col("modularity") == best).agg(F.min("ord")).scalar()
    return out.withColumn("best", F.col("ord") == first)
