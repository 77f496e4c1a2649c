"""Graph construction (edges by equi-joins, node table, degrees, summary).

Edge table schema: ``src, dst, relationship string, weight double`` with the
canonical undirected form ``src <= dst`` and one row per unordered pair.
Node ids may be strings or 64-bit integers; every operator here only needs
equality and ordering on them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpusgraph.session import cut_lineage

# Characters stripped from both ends of a line before it is compared.
LINE_TRIM = " \t\r"


def text_lines(docs: DataFrame, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """One row per line of every text: ``doc_id, line_no (1-based), line``."""
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.posexplode(F.split(F.col(text_col), "\n")).alias("pos", "line"),
    ).select("doc_id", (F.col("pos") + 1).alias("line_no"), "line")


def _trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(LINE_TRIM))


def co_occurrence_edges(pairs: DataFrame, entity: str, key: str,
                        relationship: str = "co_occurrence") -> DataFrame:
    """Entities that share a key are linked.

    Every entity holding a key is linked to the key's *anchor*, the smallest
    entity holding it.  That yields the same connectivity as linking all
    pairs but emits ``n - 1`` edges for a key held by ``n`` entities instead
    of ``n (n - 1) / 2``, so a key shared by a third of the corpus costs a
    third of the corpus, not its square.  The anchor per key is a partial
    (map-side combined) aggregate; the join back to the pairs is a plain
    equi-join that AQE splits when one key is hot.
    """
    keyed = pairs.select(F.col(entity).alias("_e"), F.col(key).alias("_k"))
    anchors = (keyed.groupBy("_k")
               .agg(F.min("_e").alias("_anchor"), F.max("_e").alias("_last"))
               .where(F.col("_anchor") < F.col("_last"))  # held by >= 2 entities
               .select("_k", "_anchor"))
    return (keyed.join(anchors, "_k")
            .where(F.col("_e") != F.col("_anchor"))
            .select(F.col("_anchor").alias("src"), F.col("_e").alias("dst"))
            .distinct()
            .select("src", "dst", F.lit(relationship).alias("relationship"),
                    F.lit(1.0).alias("weight")))


def distinctive_lines(docs: DataFrame, min_chars: int = 20) -> DataFrame:
    """``(doc_id, line)`` for trimmed lines longer than ``min_chars``."""
    return (text_lines(docs)
            .select("doc_id", _trimmed(F.col("line")).alias("line"))
            .where(F.length("line") > min_chars))


def line_keys(docs: DataFrame, min_chars: int = 20) -> DataFrame:
    """``(doc_id, key)``: 128-bit hashes of a document's distinctive lines,
    repeats inside a document dropped before anything is shuffled."""
    lines = F.transform(F.split("text", "\n"), _trimmed)
    keys = F.transform(F.array_distinct(F.filter(lines, lambda x: F.length(x) > min_chars)),
                       lambda x: F.unhex(F.md5(x)))
    return docs.select("doc_id", F.explode(keys).alias("key"))


def shared_line_edges(docs: DataFrame, min_chars: int = 20) -> DataFrame:
    """Documents linked when they share a distinctive line (C7 on text):
    star edges to the line's smallest holder.  Only hashes are shuffled."""
    return co_occurrence_edges(line_keys(docs, min_chars), "doc_id", "key", "shared_line")


def canonical_edges(edges: DataFrame) -> DataFrame:
    """Simple undirected edge set, ``src <= dst``, one row per pair.

    When the same pair arrives with several relationships the greatest
    relationship name is kept (deterministic); weights are not summed, as in
    a simple graph.
    """
    rel = F.col("relationship") if "relationship" in edges.columns else F.lit("edge")
    return (edges.select(F.least("src", "dst").alias("src"),
                         F.greatest("src", "dst").alias("dst"),
                         rel.alias("relationship"))
            .groupBy("src", "dst")
            .agg(F.max("relationship").alias("relationship"))
            .withColumn("weight", F.lit(1.0)))


def node_table(nodes: DataFrame, node_col: str, edges: DataFrame | None = None) -> DataFrame:
    """C4: every node, isolated ones included (endpoints of edges added)."""
    base = nodes.select(F.col(node_col).alias("node"))
    if edges is not None:
        base = base.unionByName(edges.select(F.col("src").alias("node"))) \
                   .unionByName(edges.select(F.col("dst").alias("node")))
    return base.distinct()


def endpoint_view(edges: DataFrame) -> DataFrame:
    """Both directions of every edge; a self-loop appears once.

    Columns ``node, neighbor, weight, is_loop``.
    """
    w = F.col("weight") if "weight" in edges.columns else F.lit(1.0)
    fwd = edges.select(F.col("src").alias("node"), F.col("dst").alias("neighbor"),
                       w.alias("weight"))
    back = (edges.where(F.col("src") != F.col("dst"))
            .select(F.col("dst").alias("node"), F.col("src").alias("neighbor"),
                    w.alias("weight")))
    return fwd.unionByName(back).withColumn(
        "is_loop", F.col("node") == F.col("neighbor"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``deg_incident`` counts a self-loop once, ``deg_weighted`` twice."""
    ep = endpoint_view(edges).groupBy("node").agg(
        F.count("*").alias("deg_incident"),
        F.sum(F.when(F.col("is_loop"), 2 * F.col("weight"))
              .otherwise(F.col("weight"))).alias("deg_weighted"))
    return (nodes.select("node").join(ep, "node", "left")
            .select("node",
                    F.coalesce("deg_incident", F.lit(0)).cast("long").alias("deg_incident"),
                    F.coalesce("deg_weighted", F.lit(0.0)).alias("deg_weighted")))


def graph_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of counts, both density figures and average degree."""
    n = nodes.agg(F.count("*").alias("n")).scalar()
    m = edges.agg(F.count("*").alias("m")).scalar()
    nd, md = n.cast("double"), m.cast("double")
    return nodes.sparkSession.range(1).select(
        n.alias("num_nodes"), m.alias("num_edges"),
        F.when(n > 1, md * 2.0 / (nd * (nd - 1.0))).otherwise(F.lit(0.0)).alias("density"),
        F.when(n > 0, md / (nd * nd)).otherwise(F.lit(0.0)).alias("density_published"),
        F.when(n > 0, md * 2.0 / nd).otherwise(F.lit(0.0)).alias("avg_degree"),
    )


def name_match_edges(refs: DataFrame, targets: DataFrame, relationship: str) -> DataFrame:
    """C1/C2 core: ``refs(node, ref)`` ⋈ ``targets(node, name)`` on ref = name.

    Many-to-many by design (a name defined in several files links to all of
    them).  Both sides are shuffled on the name; AQE splits a hot name.
    """
    t = targets.select(F.col("node").alias("dst"), F.col("name").alias("_ref"))
    return (refs.select(F.col("node").alias("src"), F.col("ref").alias("_ref"))
            .distinct()
            .join(t, "_ref")
            .select("src", "dst", F.lit(relationship).alias("relationship"),
                    F.lit(1.0).alias("weight")))


def inheritance_edges(elements: DataFrame) -> DataFrame:
    """Class → class whose ``name`` equals one of its base texts."""
    classes = elements.where(F.col("kind") == "class")
    refs = classes.select(F.col("element_id").alias("node"),
                          F.explode("inheritance").alias("ref"))
    return name_match_edges(refs, classes.select(
        F.col("element_id").alias("node"), "name"), "inherits")


def call_edges(elements: DataFrame) -> DataFrame:
    """Function → function whose name equals a *bare* call text."""
    funcs = elements.where(F.col("kind") == "function")
    refs = (funcs.select(F.col("element_id").alias("node"),
                         F.explode(F.array_distinct("calls")).alias("ref"))
            .where(~F.col("ref").contains(".")))
    return name_match_edges(refs, funcs.select(
        F.col("element_id").alias("node"), "name"), "calls")


def code_graph(elements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (every element) and the canonical edge set of C1 ∪ C2."""
    edges = canonical_edges(inheritance_edges(elements).unionByName(call_edges(elements)))
    nodes = elements.select(F.col("element_id").alias("node")).distinct()
    return nodes, edges


# ------------------------------------------------------------------ C1, C2 by hubs
def _call_ends(elements: DataFrame, *keep: str) -> DataFrame:
    """``node, name, calls, kind`` and the columns ``keep``: for calls of functions by bare names and for
    bases of classes, the referring (``calls`` 1) and the defining end (0)."""
    def ends(kind: str, refs) -> DataFrame:
        own, node = elements.where(F.col("kind") == kind), F.col("element_id").alias("node")
        return own.select(node, *keep, F.explode(refs).alias("name"), F.lit(1).alias("calls")) \
            .unionByName(own.select(node, *keep, "name", F.lit(0).alias("calls"))) \
            .withColumn("kind", F.lit(kind))

    bare = F.filter(F.array_distinct("calls"), lambda c: ~c.contains("."))
    return ends("function", bare).unionByName(ends("class", F.array_distinct("inheritance"))).where("name is not null")


def name_hubs(elements: DataFrame) -> DataFrame:
    """C1/C2 in linear form: ``node, kind, name, calls, callers, definitions``.

    Instead of one edge per caller and definition, every name with both is a
    hub that its callers and its definitions are joined to, so a name used in
    every file costs one row a use.  Counts are partial aggregates; the join
    back on a hot name is one that adaptive execution can split."""
    ends = _call_ends(elements)
    hubs = ends.groupBy("kind", "name").agg(
        F.count_if(F.col("calls") == 1).alias("callers"), F.count_if(F.col("calls") == 0).alias("definitions"))
    return ends.join(hubs.where("callers > 0 and definitions > 0"), ["kind", "name"])


def hub_degrees(elements: DataFrame) -> DataFrame:
    """C5 over C1/C2: ``node, out_degree, in_degree``, the definitions a node's
    references lead to and the references that lead to it, counted with
    multiplicity and without listing a single edge."""
    return name_hubs(elements).groupBy("node").agg(
        F.sum(F.when(F.col("calls") == 1, F.col("definitions")).otherwise(0)).alias("out_degree"),
        F.sum(F.when(F.col("calls") == 0, F.col("callers")).otherwise(0)).alias("in_degree"))


def hub_components(elements: DataFrame) -> DataFrame:
    """D8 over C1/C2: the components of the graph of all caller-definition
    edges, found through the hubs; elements without an edge are alone."""
    from corpusgraph.operators.components import connected_components

    hub = F.struct(F.lit(1).alias("hub"), F.concat_ws(" ", "kind", "name").alias("id"))
    node = lambda c: F.struct(F.lit(0).alias("hub"), F.col(c).cast("string").alias("id"))
    edges = name_hubs(elements).select(node("node").alias("src"), hub.alias("dst"))
    nodes = elements.select(node("element_id").alias("node")).distinct()
    # elements sort before hubs, so the smallest member is an element
    return connected_components(nodes, edges).select(
        F.col("node.id").alias("node"), F.col("community.id").alias("community"))


def hub_modularity(elements: DataFrame, membership: DataFrame, resolution: float = 1.0) -> DataFrame:
    """D6 over C1/C2 (multiplicities kept): ``num_edges, modularity`` of a
    ``membership(node, community)`` from counts per (name, community), which alone
    are shuffled: a name's edges inside a community are its callers there times its definitions there."""
    sides = [F.count_if(F.col("calls") == 1).alias("c"), F.count_if(F.col("calls") == 0).alias("d")]
    own = membership.select(F.col("node").alias("element_id"), "community")
    # an end's row is no longer needed once it is counted for its name and community
    lists = {c: F.array_distinct(c) for c in ("calls", "inheritance")}
    there = _call_ends(elements.withColumns(lists).join(own, "element_id"), "community").where("community is not null") \
        .groupBy("kind", "name", "community").agg(*sides)
    hubs = _call_ends(elements).groupBy("kind", "name").agg(
        F.count_if(F.col("calls") == 1).alias("callers"), F.count_if(F.col("calls") == 0).alias("definitions"))
    hubs = there.join(hubs.where("callers > 0 and definitions > 0"), ["kind", "name"])
    both = cut_lineage(hubs.groupBy("community").agg(
        F.sum(F.col("c") * F.col("definitions") + F.col("d") * F.col("callers")).cast("double").alias("mass"),
        F.sum(F.col("c") * F.col("d")).cast("double").alias("inside")))
    m = both.agg(F.sum("mass")).select(F.col("sum(mass)") / 2).scalar()
    return both.agg(F.sum(F.col("inside") / m - resolution * F.pow(F.col("mass") / (2 * m), 2)).alias("q")).select(
        F.coalesce(m, F.lit(0.0)).cast("long").alias("num_edges"), F.coalesce("q", F.lit(0.0)).alias("modularity"))
