"""Community metrics (E1–E15) and modularity.

Inputs are the long tables ``membership(node, community)`` and
``edges(src, dst, weight)``.  Per-edge community labels come from two
equi-joins; every per-community figure is then one grouped aggregate over an
"endpoint" view of the annotated edges, so no community is ever gathered
into one task.  Global figures (edge totals, medians) are scalar subqueries,
never an unpartitioned window or a cross join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from corpusgraph.operators.tabular import exact_quantiles
from corpusgraph.session import cut_lineage

# Fixed thresholds of the rules (E6) and of the bands.
LARGEST_COMMUNITY_LIMIT = 20      # largest > 20
SMALLEST_COMMUNITY_LIMIT = 3      # smallest < 3 (and more than one community)
LOW_COHESION = 0.3                # cohesion < 0.3
HIGH_COUPLING = 0.7               # coupling > 0.7
CORE_MIN_SIZE = 5                 # core communities: size >= 5
CORE_LISTED_NODES = 10            # first 10 nodes listed


def annotate_edges(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """``src, dst, weight, cs, cd`` — community of both endpoints."""
    w = F.col("weight") if "weight" in edges.columns else F.lit(1.0)
    ms = membership.select(F.col("node").alias("src"), F.col("community").alias("cs"))
    md = membership.select(F.col("node").alias("dst"), F.col("community").alias("cd"))
    return (edges.select("src", "dst", w.alias("weight"))
            .join(ms, "src").join(md, "dst"))


def _endpoint_rows(annotated: DataFrame) -> DataFrame:
    """One row per (edge, endpoint community); a self-loop gives one row.

    Columns: community, incident (1), external (0/1), internal (non-loop
    internal edge, counted on the src side only), deg (weighted degree, a
    loop counts twice), inside (weight of an internal edge incl. loops, src
    side only).
    """
    loop = F.col("src") == F.col("dst")
    same = F.col("cs") == F.col("cd")
    w = F.col("weight")
    src_side = F.struct(
        F.col("cs").alias("community"), F.lit(1).alias("incident"),
        F.when(same, 0).otherwise(1).alias("external"),
        F.when(same & ~loop, 1).otherwise(0).alias("internal"),
        F.when(loop, 2 * w).otherwise(w).alias("deg"),
        F.when(same, w).otherwise(0.0).alias("inside"))
    dst_side = F.struct(
        F.col("cd").alias("community"), F.lit(1).alias("incident"),
        F.when(same, 0).otherwise(1).alias("external"),
        F.lit(0).alias("internal"), w.alias("deg"), F.lit(0.0).alias("inside"))
    rows = F.when(loop, F.array(src_side)).otherwise(F.array(src_side, dst_side))
    return annotated.select(F.inline(rows))


def community_details(membership: DataFrame, edges: DataFrame) -> DataFrame:
    """Size, internal/external/total edges, cohesion, coupling, and
    the modularity ingredients ``deg_sum`` (k_c) and ``inside_weight`` (L_c).
    """
    sizes = membership.groupBy("community").agg(F.count("*").alias("size"))
    stats = (_endpoint_rows(annotate_edges(edges, membership))
             .groupBy("community")
             .agg(F.sum("internal").cast("long").alias("internal_edges"),
                  F.sum("external").cast("long").alias("external_edges"),
                  F.sum("incident").cast("long").alias("total_edges"),
                  F.sum("deg").alias("deg_sum"),
                  F.sum("inside").alias("inside_weight")))
    d = sizes.join(stats, "community", "left").na.fill(
        0, ["internal_edges", "external_edges", "total_edges"]).na.fill(
        0.0, ["deg_sum", "inside_weight"])
    possible = (F.col("size") * (F.col("size") - 1)) / 2  # whole: n(n-1) is even
    return d.select(
        "community", "size", "internal_edges", "external_edges", "total_edges",
        F.coalesce(F.try_divide(F.col("internal_edges").cast("double"),
                                F.floor(possible).cast("double")), F.lit(0.0)).alias("cohesion"),
        F.coalesce(F.try_divide(F.col("external_edges").cast("double"),
                                F.col("total_edges").cast("double")), F.lit(0.0)).alias("coupling"),
        "deg_sum", "inside_weight")


def modularity_of(details: DataFrame, resolution: float = 1.0, by: tuple = ()) -> DataFrame:
    """D6 from E-details: Q = Σ L_c/m − γ Σ (k_c / 2m)², m = Σ k_c / 2; one
    row, or one per value of the columns ``by``.

    A graph without edges has modularity 0.0.
    """
    g = details.groupBy(*by).agg(F.sum("inside_weight").alias("L"),
                    F.sum("deg_sum").alias("K"),
                    F.sum(F.col("deg_sum") * F.col("deg_sum")).alias("K2"),
                    F.count("*").alias("num_communities"))
    m = F.col("K") / 2.0
    q = F.when(F.col("K") > 0,
               F.col("L") / m - F.lit(resolution) * F.col("K2") / (4.0 * m * m)
               ).otherwise(F.lit(0.0))
    return g.select(*by, "num_communities", F.coalesce(q, F.lit(0.0)).alias("modularity"))


def modularity(membership: DataFrame, edges: DataFrame, resolution: float = 1.0) -> DataFrame:
    return modularity_of(community_details(membership, edges), resolution)


def community_summary(details: DataFrame) -> DataFrame:
    """E5: count, mean/largest/smallest size (all-zero when empty)."""
    return details.agg(
        F.count("*").alias("num_communities"),
        F.coalesce(F.avg("size"), F.lit(0.0)).alias("avg_community_size"),
        F.coalesce(F.max("size"), F.lit(0)).cast("long").alias("largest_community"),
        F.coalesce(F.min("size"), F.lit(0)).cast("long").alias("smallest_community"))


def recommendations(details: DataFrame) -> DataFrame:
    """E6 rules → ``(community, rule, value)``.

    Global rules carry a null community; their thresholds are strict.
    """
    summ = community_summary(details)
    global_rules = summ.select(F.inline(F.array(
        F.struct(F.lit(None).cast(details.schema["community"].dataType).alias("community"),
                 F.lit("large_community").alias("rule"),
                 F.when(F.col("largest_community") > LARGEST_COMMUNITY_LIMIT,
                        F.col("largest_community").cast("double")).alias("value")),
        F.struct(F.lit(None).cast(details.schema["community"].dataType).alias("community"),
                 F.lit("small_community").alias("rule"),
                 F.when((F.col("smallest_community") < SMALLEST_COMMUNITY_LIMIT)
                        & (F.col("num_communities") > 1),
                        F.col("smallest_community").cast("double")).alias("value")),
    ))).where(F.col("value").isNotNull())
    per = details.select(F.inline(F.array(
        F.struct("community", F.lit("low_cohesion").alias("rule"),
                 F.when(F.col("cohesion") < LOW_COHESION, F.col("cohesion")).alias("value")),
        F.struct("community", F.lit("high_coupling").alias("rule"),
                 F.when(F.col("coupling") > HIGH_COUPLING, F.col("coupling")).alias("value")),
    ))).where(F.col("value").isNotNull())
    return global_rules.unionByName(per)


def first_nodes(membership: DataFrame, k: int) -> DataFrame:
    """The ``k`` smallest node ids per community as a sorted array.

    ``row_number() <= k`` is planned as a window group limit, which trims
    every map partition to k rows per community before the shuffle, so a
    hot community never ships more than k rows per partition.
    """
    w = Window.partitionBy("community").orderBy("node")
    return (membership.withColumn("_rn", F.row_number().over(w))
            .where(F.col("_rn") <= k)
            .groupBy("community")
            .agg(F.array_sort(F.collect_list("node")).alias("nodes")))


def core_communities(details: DataFrame, membership: DataFrame,
                     min_size: int = CORE_MIN_SIZE, listed: int = CORE_LISTED_NODES) -> DataFrame:
    """Communities of at least ``min_size``; first ``listed`` nodes."""
    core = details.where(F.col("size") >= min_size).select(
        "community", "size", "cohesion", "coupling", F.col("size").alias("total_nodes"))
    members = membership.join(core.select("community"), "community", "left_semi")
    return core.join(first_nodes(members, listed), "community", "left")


def top_communities(details: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` largest communities (ties by community id)."""
    return details.orderBy(F.desc("size"), F.asc("community")).limit(k)


def size_histogram(details: DataFrame, bins: int | str = 10) -> DataFrame:
    """Equal-width bins over [min, max] of sizes, last bin closed.

    ``bins`` is a number, ``"communities"`` (min(10, #communities)) or
    ``"distinct"`` (min(15, #distinct sizes)) — the three choices of the
    reference's plots.  A single distinct size puts every community in bin 1.
    """
    lo = details.agg(F.min("size")).scalar()
    hi = details.agg(F.max("size")).scalar()
    if bins == "communities":
        nb = F.least(F.lit(10), details.agg(F.count("*")).scalar())
    elif bins == "distinct":
        nb = F.least(F.lit(15), details.agg(F.count_distinct("size")).scalar())
    else:
        nb = F.lit(int(bins))
    b = F.when(hi == lo, F.lit(1)).otherwise(
        F.least(nb, F.floor((F.col("size") - lo) * nb / (hi - lo)).cast("int") + 1))
    return (details.select(b.alias("bin"))
            .groupBy("bin").agg(F.count("*").alias("num_communities")))


def size_share(details: DataFrame) -> DataFrame:
    """Percentage of all nodes per community, one decimal."""
    total = details.agg(F.sum("size")).scalar()
    return details.select("community", "size",
                          F.round(F.col("size") * 100.0 / total, 1).alias("share_pct"))


def quadrants(details: DataFrame, use_median: bool = False) -> DataFrame:
    """cohesion/coupling quadrant by 0.5 lines or by the medians."""
    if use_median:
        details = cut_lineage(details)
        ch, cp = (F.lit(exact_quantiles(details, c, [0.5])[0]) for c in ("cohesion", "coupling"))
    else:
        ch, cp = F.lit(0.5), F.lit(0.5)
    hi_c = F.col("cohesion") >= ch
    hi_p = F.col("coupling") >= cp
    q = (F.when(hi_c & ~hi_p, "high_cohesion_low_coupling")
         .when(hi_c & hi_p, "high_cohesion_high_coupling")
         .when(~hi_c & ~hi_p, "low_cohesion_low_coupling")
         .otherwise("low_cohesion_high_coupling"))
    return details.select("community", "cohesion", "coupling", q.alias("quadrant"))


def dashboard(nodes: DataFrame, edges: DataFrame, details: DataFrame) -> DataFrame:
    """Nodes, links, communities, mean community size."""
    return nodes.sparkSession.range(1).select(
        nodes.agg(F.count("*")).scalar().alias("num_nodes"),
        edges.agg(F.count("*")).scalar().alias("num_links"),
        details.agg(F.count("*")).scalar().alias("num_communities"),
        details.agg(F.coalesce(F.avg("size"), F.lit(0.0))).scalar().alias("avg_size"))


def bands(details: DataFrame) -> DataFrame:
    """Cohesion low (<= 0.2) / medium (<= 0.4) / high; coupling
    independent (0) or low, the bands read off the published table."""
    return details.select(
        "community",
        F.when(F.col("cohesion") <= 0.2, "low").when(F.col("cohesion") <= 0.4, "medium")
        .otherwise("high").alias("cohesion_band"),
        F.when(F.col("coupling") == 0, "independent").otherwise("low").alias("coupling_band"))


def community_profiles(membership: DataFrame, details: DataFrame, elements: DataFrame | None = None,
                       min_size: int = 5) -> tuple[DataFrame, DataFrame]:
    """Communities of at least ``min_size`` with their real cohesion and
    coupling (the reference hard-wires 0.0 there), plus one row of counts
    (total / kept / filtered).  Member and element lists stay long tables:
    ``members`` = membership semi-joined to the kept communities."""
    kept = details.where(F.col("size") >= min_size).select("community", "size", "cohesion", "coupling")
    members = membership.join(kept.select("community"), "community", "left_semi")
    if elements is not None:
        members = members.join(elements, "node", "left")
    counts = details.agg(F.count("*").alias("total"),
                         F.count_if(F.col("size") >= min_size).alias("kept"),
                         F.count_if(F.col("size") < min_size).alias("filtered"))
    return kept.join(members.groupBy("community").agg(F.count("*").alias("members")), "community"), counts


def profile_elements(membership: DataFrame, details: DataFrame, elements: DataFrame,
                     min_size: int = 5) -> DataFrame:
    """The element rows of the profiled communities, ``community, node,
    kind, name, file_path, docstring``, one row for each member that is an
    element; a long table, so a community of any size spreads over tasks."""
    kept = details.where(F.col("size") >= min_size).select("community")
    cols = ["kind", "name", "file_path", "docstring"]
    own = elements.select("node", *[F.col(c) if c in elements.columns else F.lit(None).cast("string").alias(c)
                                    for c in cols])
    return membership.join(kept, "community", "left_semi").join(own, "node").select("community", "node", *cols)
