"""Registered community-detection and description queries.

* D1–D3 on the shared-line document graph (no SQL oracle: iterative;
  invariants are tested in ``tests/test_communities.py``).
* F1–F5, F14, F18 on the part co-order graph: parts are linked when they
  appear in the same order (star edges per order, C7), the partition is the
  part's brand, node identifiers are ``<part name>_<part key>``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusgraph.operators import communities as cm
from corpusgraph.operators import components as cc
from corpusgraph.operators import describe as ds
from corpusgraph.operators import graph as g
from corpusgraph.operators import naming as nm
from corpusgraph.operators import quality as qm
from corpusgraph.plans.common import Registry, rounded
from corpusgraph.plans.graph_queries import DETAILS_CTE, GRAPH_CTE, doc_graph
from corpusgraph.session import cut_lineage
from corpusgraph.sources.tables import table

reg = Registry()


# ------------------------------------------------------------------ D1–D3
DETECTORS = {"label_propagation": cm.label_propagation, "louvain": cm.louvain, "leiden": cm.leiden}


def _detected(spark, sf_dir, algorithm):
    """(edges, membership as a written table)."""
    nodes, edges = doc_graph(spark, sf_dir)
    return edges, cut_lineage(DETECTORS[algorithm](nodes, edges))


@reg.add("label_propagation")
def q_label_propagation(spark, sf_dir):
    return _detected(spark, sf_dir, "label_propagation")[1]


@reg.add("louvain")
def q_louvain(spark, sf_dir):
    return _detected(spark, sf_dir, "louvain")[1]


@reg.add("leiden")
def q_leiden(spark, sf_dir):
    return _detected(spark, sf_dir, "leiden")[1]


@reg.add("leiden_modularity")
def q_leiden_modularity(spark, sf_dir):
    edges, members = _detected(spark, sf_dir, "leiden")
    return rounded(qm.modularity(members, edges))


# What must hold of a detector's membership: rows, different nodes, nodes whose
# label is not their community's smallest member, and for each detector what
# it promises: communities in several pieces (Leiden), a score below that of
# the components (Louvain, Leiden), nodes that a neighbour label outnumbers
# (label propagation).
def _invariants_sql(*promises: str) -> str:
    return ("SELECT count(*) AS num_rows, count(DISTINCT doc_id) AS nodes, 0::BIGINT AS mislabelled"
            + "".join(f", 0::BIGINT AS {p}" for p in promises) + " FROM documents")


def _in_pieces(nodes, edges, members):
    ends = [members.select(F.col("node").alias(e), F.col("community").alias(f"c_{e}"))
            for e in ("src", "dst")]
    inside = edges.join(ends[0], "src").join(ends[1], "dst").where("c_src = c_dst").select("src", "dst")
    pieces = cc.connected_components(nodes, inside).withColumnRenamed("community", "piece")
    return (members.join(pieces, "node").groupBy("community")
            .agg((F.min("piece") < F.max("piece")).alias("torn")).agg(F.count_if("torn")).scalar())


def _below_components(nodes, edges, members):
    score, trivial = (qm.modularity(m, edges).select("modularity").scalar()
                      for m in (members, cc.connected_components(nodes, edges)))
    return (score < trivial - 1e-9).cast("long")


def _outnumbered(nodes, edges, members):
    seen = (cm.weighted_arcs(edges).select("a", "b")
            .join(members.select(F.col("node").alias("b"), F.col("community").alias("label")), "b")
            .groupBy("a", "label").agg(F.count("*").alias("n")))
    mine = members.select(F.col("node").alias("a"), F.col("community").alias("own"))
    return (seen.join(mine, "a").groupBy("a").agg(
        F.max("n").alias("most"),
        F.coalesce(F.max(F.when(F.col("label") == F.col("own"), F.col("n"))), F.lit(0)).alias("n_own"))
        .agg(F.count_if(F.col("n_own") < F.col("most"))).scalar())


PROMISES = {"in_pieces": _in_pieces, "below_components": _below_components, "outnumbered": _outnumbered}


def _invariants(spark, sf_dir, algorithm, *promises):
    nodes, edges = doc_graph(spark, sf_dir)
    members = cut_lineage(DETECTORS[algorithm](nodes, edges))
    smallest = members.groupBy("community").agg(F.min("node").alias("least"))
    return members.agg(F.count("*").alias("num_rows"), F.count_distinct("node").alias("nodes")).select(
        "num_rows", "nodes",
        smallest.agg(F.count_if(F.col("community") != F.col("least"))).scalar().alias("mislabelled"),
        *[PROMISES[p](nodes, edges, members).alias(p) for p in promises])


@reg.add("louvain_invariants", _invariants_sql("below_components"))
def q_louvain_invariants(spark, sf_dir):
    return _invariants(spark, sf_dir, "louvain", "below_components")


@reg.add("leiden_invariants", _invariants_sql("in_pieces", "below_components"))
def q_leiden_invariants(spark, sf_dir):
    return _invariants(spark, sf_dir, "leiden", "in_pieces", "below_components")


@reg.add("label_propagation_invariants", _invariants_sql("outnumbered"))
def q_label_propagation_invariants(spark, sf_dir):
    return _invariants(spark, sf_dir, "label_propagation", "outnumbered")


# ------------------------------------------------------------------ D10
RESOLUTIONS = (0.01, 0.5, 1.0, 2.0)


def _swept(spark, sf_dir):
    nodes, edges = doc_graph(spark, sf_dir)
    return nodes, edges, cut_lineage(cm.resolution_memberships(nodes, edges, RESOLUTIONS))


@reg.add("resolution_sweep")
def q_resolution_sweep(spark, sf_dir):
    _, edges, found = _swept(spark, sf_dir)
    return rounded(cm.resolution_scores(found, edges, RESOLUTIONS))


# Per resolution: rows, different nodes, labels that are not the smallest
# member, communities in several pieces, whether the score is below that of
# lone nodes, and whether anything merged (each edge weighs 1, so under the
# constant Potts model linked nodes merge below γ = 1 and none above).
@reg.add("resolution_sweep_invariants", "WITH " + GRAPH_CTE.strip() + f"""
SELECT resolution, (SELECT count(*) FROM documents) AS num_rows,
       (SELECT count(DISTINCT doc_id) FROM documents) AS nodes, 0::BIGINT AS mislabelled,
       0::BIGINT AS in_pieces, 0::BIGINT AS below_alone,
       (resolution <= 1 AND EXISTS (SELECT * FROM edges))::BIGINT AS merged
FROM (VALUES {", ".join(f"({g}::DOUBLE)" for g in RESOLUTIONS)}) AS v(resolution)
""")
def q_resolution_sweep_invariants(spark, sf_dir):
    nodes, edges, found = _swept(spark, sf_dir)
    members, arcs = cm.by_resolution(found, edges, RESOLUTIONS)
    inside = qm.annotate_edges(arcs, members).where("cs = cd").select("src", "dst")
    pieces = cc.connected_components(members.select("node"), inside).withColumnRenamed("community", "piece")
    torn = (members.join(pieces, "node").groupBy("community").agg(
        F.count("*").alias("n"), F.count_distinct("node").alias("nodes"), F.min("node").alias("least"),
        (F.min("piece") < F.max("piece")).alias("torn")))
    details = qm.community_details(members, arcs).select("community", "deg_sum", "inside_weight")
    g, size, edge_weight = F.col("resolution"), F.col("n"), F.sum("deg_sum") / 2
    lone = (_weighted_degrees(edges).agg(F.coalesce(F.sum(F.col("k") * F.col("k")), F.lit(0.0))).scalar())
    potts = F.sum("inside_weight") - F.first("resolution") * F.sum(size * (size - 1) / 2)
    mod = F.sum("inside_weight") - (F.sum(F.col("deg_sum") * F.col("deg_sum")) - lone) / (4 * edge_weight)
    return (torn.join(details, "community").withColumn("resolution", F.col("community.g")).groupBy(g)
            .agg(F.sum("n").alias("num_rows"), F.sum("nodes").alias("nodes"),
                 F.count_if(F.col("least") != F.col("community")).alias("mislabelled"),
                 F.count_if("torn").alias("in_pieces"),
                 (F.when(F.first("resolution") == 1, F.coalesce(mod, F.lit(0.0))).otherwise(potts) < -1e-6)
                 .cast("long").alias("below_alone"),
                 F.max(size > 1).cast("long").alias("merged")))


def _weighted_degrees(edges):
    return cm.weighted_arcs(edges).groupBy("a").agg(F.sum("w").alias("k"))


# ------------------------------------------------------------------ F
PART_GRAPH_CTE = """
pn AS (SELECT p_partkey, p_name || '_' || p_partkey::VARCHAR AS node, p_brand FROM part),
pairs AS (SELECT pn.node AS e, l.l_orderkey AS k FROM lineitem l JOIN pn ON pn.p_partkey = l.l_partkey),
anchors AS (SELECT k, min(e) AS anchor FROM pairs GROUP BY k HAVING min(e) < max(e)),
edges AS (
  SELECT DISTINCT a.anchor AS src, p.e AS dst, 1.0::DOUBLE AS weight
  FROM pairs p JOIN anchors a USING (k) WHERE p.e <> a.anchor),
membership AS (SELECT node, p_brand AS community FROM pn)
"""


def part_graph(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(
        "p_partkey", "p_brand",
        F.concat(F.col("p_name"), F.lit("_"), F.col("p_partkey").cast("string")).alias("node"))
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey")
    pairs = li.join(part.select(F.col("p_partkey").alias("l_partkey"), "node"), "l_partkey")
    edges = g.co_occurrence_edges(pairs, "node", "l_orderkey", "co_ordered")
    membership = part.select("node", F.col("p_brand").alias("community"))
    return membership, edges


def _tags_sql() -> str:
    parts = []
    for tag, pats in ds.TAG_PATTERNS:
        cond = " OR ".join(f"contains(lower(node), '{p}')" for p in pats)
        parts.append(f"SELECT community, '{tag}' AS tag FROM membership WHERE {cond}")
    return " UNION ALL ".join(parts)


def _pattern_sql() -> str:
    whens = " ".join(f"WHEN max(contains(lower(node), '{s}')::INT) = 1 THEN '{n}'"
                     for s, n in ds.PATTERN_ORDER)
    return f"SELECT community, CASE {whens} ELSE '{ds.DEFAULT_PATTERN}' END AS architecture_pattern " \
           f"FROM membership GROUP BY community"


@reg.add("brand_descriptions", "WITH " + PART_GRAPH_CTE.strip() + DETAILS_CTE + f""",
tg AS (SELECT community, array_to_string(list(DISTINCT tag ORDER BY tag), ',') AS tags
       FROM ({_tags_sql()}) GROUP BY community),
pt AS ({_pattern_sql()})
SELECT d.community, d.size, coalesce(tg.tags, 'general') AS functional_tags,
       pt.architecture_pattern,
       greatest(1, least(10, trunc(d.cohesion * 10 - d.coupling * 20 + 5)::INT)) AS design_quality,
       CASE WHEN d.cohesion < 0.3 AND d.coupling > 0.3 THEN 'raise_cohesion,lower_coupling'
            WHEN d.cohesion < 0.3 THEN 'raise_cohesion'
            WHEN d.coupling > 0.3 THEN 'lower_coupling' ELSE 'keep_design' END AS refactor_suggestions,
       CASE WHEN d.size >= 20 THEN 'large' WHEN d.size >= 10 THEN 'medium' ELSE 'small' END AS size_name
FROM details d LEFT JOIN tg USING (community) JOIN pt USING (community)
""")
def q_brand_descriptions(spark, sf_dir):
    membership, edges = part_graph(spark, sf_dir)
    det = qm.community_details(membership, edges)
    out = ds.basic_descriptions(membership, det)
    return out.select("community", "size",
                      F.array_join("functional_tags", ",").alias("functional_tags"),
                      "architecture_pattern", "design_quality",
                      F.array_join("refactor_suggestions", ",").alias("refactor_suggestions"),
                      "size_name")


@reg.add("brand_member_digest", "WITH " + PART_GRAPH_CTE.strip() + """,
ranked AS (SELECT community, node, row_number() OVER (PARTITION BY community ORDER BY node) AS rn,
                  count(*) OVER (PARTITION BY community) AS n FROM membership)
SELECT community, array_to_string(list(node ORDER BY node), ', ')
       || CASE WHEN max(n) > 20 THEN ' ... and ' || (max(n) - 20)::VARCHAR || ' more' ELSE '' END
       AS digest
FROM ranked WHERE rn <= 20 GROUP BY community
""")
def q_brand_member_digest(spark, sf_dir):
    membership, _ = part_graph(spark, sf_dir)
    return ds.member_digest(membership, 20)


# ------------------------------------------------------------------ F6–F15
def _split_sql(x: str) -> str:
    runs = f"regexp_extract_all({x}, '([A-Z][a-z]*|[a-z]+|[0-9]+)', 1)"
    parts = f"CASE WHEN contains({x}, '_') THEN string_split({x}, '_') ELSE []::VARCHAR[] END"
    return (f"list_filter(list_transform(list_concat({runs}, {parts}), lambda w: trim(lower(w))), "
            f"lambda w: length(w) > 2 AND regexp_full_match(w, '\\p{{L}}+'))")


def _title_sql(x: str) -> str:
    from corpusgraph.plans.text_queries import TITLE_SQL
    return TITLE_SQL.format(x=x)


def _map_sql(w: str) -> str:
    from corpusgraph.operators.naming import FUNCTION_WORDS
    from corpusgraph.plans.text_queries import TITLE_SQL
    cases = " ".join(f"WHEN lower({w}) = '{k}' THEN '{v}'" for k, v in FUNCTION_WORDS["en"].items())
    return f"CASE {cases} ELSE {TITLE_SQL.format(x=w)} END"


@reg.add("brand_names", "WITH " + PART_GRAPH_CTE.strip() + f""",
el AS (SELECT pn.node, m.community, p.p_name AS name, lower(p.p_type) AS kind
       FROM pn JOIN part p USING (p_partkey) JOIN membership m USING (node)),
words AS (SELECT community, node, pos, word
          FROM el, unnest({_split_sql('name')}) WITH ORDINALITY AS t(word, pos)),
wc AS (SELECT community, word, count(*) AS cnt, min({{'node': node, 'pos': pos}}) AS first
       FROM words GROUP BY community, word HAVING count(*) > 1),
top AS (SELECT community, word, row_number() OVER (PARTITION BY community ORDER BY cnt DESC, first) AS rn
        FROM wc QUALIFY rn <= 3),
named AS (SELECT community,
            array_to_string(list({_map_sql('word')} ORDER BY rn) FILTER (WHERE rn <= 2), ' ')
              || ' Module' AS name
          FROM top GROUP BY community),
kinds AS (SELECT community, kind, row_number() OVER (PARTITION BY community ORDER BY count(*) DESC,
                 min(node)) AS rn FROM el GROUP BY community, kind QUALIFY rn = 1),
sizes AS (SELECT community, count(*) AS size FROM membership GROUP BY community)
SELECT s.community, s.size,
  coalesce(n.name, CASE WHEN k.kind <> 'unknown' THEN {_title_sql('k.kind')} || ' Group' END,
           CASE WHEN s.size >= 20 THEN 'Large Functional Module'
                WHEN s.size >= 10 THEN 'Medium Functional Module' ELSE 'Small Functional Module' END)
    AS name
FROM sizes s LEFT JOIN named n USING (community) LEFT JOIN kinds k USING (community)
""")
def q_brand_names(spark, sf_dir):
    from corpusgraph.operators import naming as nm
    membership, _ = part_graph(spark, sf_dir)
    part = table(spark, sf_dir, "part")
    el = part.select(F.concat(F.col("p_name"), F.lit("_"), F.col("p_partkey").cast("string")).alias("node"),
                     F.col("p_name").alias("name"), F.lower("p_type").alias("kind"))
    return nm.community_names(membership, el)


@reg.add("algorithm_comparison")
def q_algorithm_comparison(spark, sf_dir):
    """The three detectors on the document graph, modularity at γ=1."""
    import time
    nodes, edges = doc_graph(spark, sf_dir)
    runs = []
    for name in ("leiden", "louvain", "label_propagation"):
        t0 = time.time()
        memb = cut_lineage(DETECTORS[name](nodes, edges))
        runs.append((name, memb, time.time() - t0))
    return rounded(cm.compare_memberships(edges, runs)).drop("seconds")


@reg.add("brand_profiles", "WITH " + PART_GRAPH_CTE.strip() + DETAILS_CTE + """
SELECT d.community, d.size, round(d.cohesion, 6) AS cohesion, round(d.coupling, 6) AS coupling,
       d.size AS members
FROM details d WHERE d.size >= 5
""")
def q_brand_profiles(spark, sf_dir):
    """Brand communities of at least 5 parts with real cohesion/coupling."""
    membership, edges = part_graph(spark, sf_dir)
    kept, _ = qm.community_profiles(membership, qm.community_details(membership, edges))
    return rounded(kept)


@reg.add("brand_prompts", "WITH " + PART_GRAPH_CTE.strip() + DETAILS_CTE + """,
ranked AS (SELECT community, node, row_number() OVER (PARTITION BY community ORDER BY node) AS rn,
                  count(*) OVER (PARTITION BY community) AS n FROM membership),
dg AS (SELECT community, array_to_string(list(node ORDER BY node), ', ')
              || CASE WHEN max(n) > 20 THEN ' ... and ' || (max(n) - 20)::VARCHAR || ' more' ELSE '' END
              AS digest FROM ranked WHERE rn <= 20 GROUP BY community)
SELECT d.community, printf('Describe this code community of %d members (cohesion %.3f, coupling %.3f). '
  || 'Members: %s. Answer as JSON with functionality, architecture_pattern, design_quality, '
  || 'refactor_suggestions, functional_tags, external_dependencies.',
  d.size, d.cohesion, d.coupling, dg.digest) AS prompt
FROM details d JOIN dg USING (community)
""")
def q_brand_prompts(spark, sf_dir):
    """one request text per brand community."""
    membership, edges = part_graph(spark, sf_dir)
    det = qm.community_details(membership, edges)
    j = det.join(ds.member_digest(membership, 20), "community")
    return j.select("community", ds.prompt_text().alias("prompt"))


@reg.add("brand_profile_elements", """
WITH pn AS (SELECT p_name || '_' || p_partkey::VARCHAR AS node, p_brand AS community, p_name, p_type FROM part),
kept AS (SELECT community FROM pn GROUP BY community HAVING count(*) >= 5)
SELECT community, node, p_type AS kind, p_name AS name, community AS file_path, NULL::VARCHAR AS docstring
FROM pn JOIN kept USING (community)
""")
def q_brand_profile_elements(spark, sf_dir):
    """The element rows of the profiled brands, parts as elements."""
    membership, edges = part_graph(spark, sf_dir)
    elements = table(spark, sf_dir, "part").select(
        F.concat_ws("_", "p_name", F.col("p_partkey").cast("string")).alias("node"), F.col("p_type").alias("kind"),
        F.col("p_name").alias("name"), F.col("p_brand").alias("file_path"))
    return qm.profile_elements(membership, qm.community_details(membership, edges), elements)


@reg.add("document_element_prompts", """
SELECT doc_id, 'Analyse this code and answer as JSON with functionality, complexity (1-10), quality (1-10), '
  || 'suggestions, tags, dependencies.' || chr(10) || chr(10) || left(coalesce(text, ''), 2000) AS prompt
FROM documents
""")
def q_document_element_prompts(spark, sf_dir):
    """one element request per document; the cut at 2000 characters is
    the request's own."""
    return table(spark, sf_dir, "documents").select("doc_id", ds.element_prompt("text").alias("prompt"))


@reg.add("brand_naming_prompts", """
WITH pn AS (SELECT p_brand AS community, p_name, p_type FROM part),
f AS (SELECT community, array_to_string(list(v ORDER BY v), ', ') AS t FROM (
  SELECT DISTINCT community, p_name AS v FROM pn QUALIFY dense_rank() OVER (PARTITION BY community ORDER BY p_name) <= 5)
  GROUP BY community),
n AS (SELECT community, count(*) AS size FROM pn GROUP BY community)
SELECT community, 'Name this code community in two to six words by what it does.' || chr(10) || 'Id: ' || community
  || chr(10) || 'Members: ' || size || chr(10) || 'Files: ' || coalesce(t, '') || chr(10) || 'Functions: '
  || coalesce(t, '') || chr(10) || 'Classes: ' || chr(10) || 'Answer with the name alone.' AS prompt
FROM n LEFT JOIN f USING (community)
""")
def q_brand_naming_prompts(spark, sf_dir):
    """one naming request per brand, parts as functions in files of
    their names."""
    membership, edges = part_graph(spark, sf_dir)
    elements = table(spark, sf_dir, "part").select(
        F.concat_ws("_", "p_name", F.col("p_partkey").cast("string")).alias("node"), F.col("p_name").alias("name"),
        F.lit("function").alias("kind"), F.concat(F.lit("src/"), "p_name", F.lit(".py")).alias("file_path"))
    return ds.naming_prompt(nm.context_sample(membership, elements), qm.community_details(membership, edges))
