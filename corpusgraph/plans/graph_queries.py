"""Registered graph queries over ``documents`` (C, D6, D8, E).

The graph: one node per document; two documents are linked when they share
a distinctive line (trimmed, longer than 20 characters), every holder of a
line being linked to the line's smallest holder (see ``co_occurrence_edges``).
Two partitions are scored: the fixed partition by ``source`` and the
connected components (D8).
"""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusgraph.operators import components as cc
from corpusgraph.operators import graph as g
from corpusgraph.operators import quality as qm
from corpusgraph.plans.common import Registry, rounded
from corpusgraph.session import cut_lineage
from corpusgraph.sources.tables import table

reg = Registry()

# ---------------------------------------------------------------- DuckDB side
GRAPH_CTE = """
lines AS (
  SELECT doc_id, trim(l, ' ' || chr(9) || chr(13)) AS line
  FROM documents, unnest(string_split(text, chr(10))) AS t(l)
),
dl AS (SELECT doc_id, line FROM lines WHERE length(line) > 20),
anchors AS (
  SELECT line, min(doc_id) AS anchor FROM dl GROUP BY line
  HAVING min(doc_id) < max(doc_id)
),
edges AS (
  SELECT DISTINCT a.anchor AS src, d.doc_id AS dst, 1.0::DOUBLE AS weight
  FROM dl d JOIN anchors a USING (line) WHERE d.doc_id <> a.anchor
),
nodes AS (SELECT doc_id AS node FROM documents)
"""

COMPONENTS_CTE = GRAPH_CTE + """,
arcs AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges),
reach(node, r) AS (
  SELECT node, node FROM nodes
  UNION
  SELECT arcs.b, reach.r FROM reach JOIN arcs ON reach.node = arcs.a
),
membership AS (SELECT node, min(r) AS community FROM reach GROUP BY node)
"""

SOURCE_CTE = GRAPH_CTE + """,
membership AS (SELECT doc_id AS node, source AS community FROM documents)
"""

DETAILS_CTE = """,
ann AS (
  SELECT e.src, e.dst, e.weight, ms.community AS cs, md.community AS cd
  FROM edges e JOIN membership ms ON e.src = ms.node
               JOIN membership md ON e.dst = md.node
),
ep AS (
  SELECT cs AS community, 1 AS incident, CASE WHEN cs = cd THEN 0 ELSE 1 END AS external,
         CASE WHEN cs = cd AND src <> dst THEN 1 ELSE 0 END AS internal,
         CASE WHEN src = dst THEN 2 * weight ELSE weight END AS deg,
         CASE WHEN cs = cd THEN weight ELSE 0.0 END AS inside
  FROM ann
  UNION ALL
  SELECT cd, 1, CASE WHEN cs = cd THEN 0 ELSE 1 END, 0, weight, 0.0
  FROM ann WHERE src <> dst
),
st AS (
  SELECT community, sum(internal)::BIGINT AS internal_edges,
         sum(external)::BIGINT AS external_edges, sum(incident)::BIGINT AS total_edges,
         sum(deg) AS deg_sum, sum(inside) AS inside_weight
  FROM ep GROUP BY community
),
sizes AS (SELECT community, count(*) AS size FROM membership GROUP BY community),
details AS (
  SELECT s.community, s.size,
         coalesce(st.internal_edges, 0)::BIGINT AS internal_edges,
         coalesce(st.external_edges, 0)::BIGINT AS external_edges,
         coalesce(st.total_edges, 0)::BIGINT AS total_edges,
         CASE WHEN s.size > 1
              THEN coalesce(st.internal_edges, 0) / (s.size * (s.size - 1) // 2)::DOUBLE
              ELSE 0.0 END AS cohesion,
         CASE WHEN coalesce(st.total_edges, 0) > 0
              THEN st.external_edges / st.total_edges::DOUBLE ELSE 0.0 END AS coupling,
         coalesce(st.deg_sum, 0.0) AS deg_sum,
         coalesce(st.inside_weight, 0.0) AS inside_weight
  FROM sizes s LEFT JOIN st USING (community)
)
"""

DETAIL_COLS = ("community, size, internal_edges, external_edges, total_edges, "
               "round(cohesion, 6) AS cohesion, round(coupling, 6) AS coupling, "
               "round(deg_sum, 6) AS deg_sum, round(inside_weight, 6) AS inside_weight")

MODULARITY_SQL = """
SELECT count(*) AS num_communities,
       round(CASE WHEN sum(deg_sum) > 0
             THEN sum(inside_weight) / (sum(deg_sum) / 2.0)
                  - sum(deg_sum * deg_sum) / (4.0 * (sum(deg_sum) / 2.0) * (sum(deg_sum) / 2.0))
             ELSE 0.0 END, 6) AS modularity
FROM details
"""

SUMMARY_SQL = """
SELECT count(*) AS num_communities, round(coalesce(avg(size), 0.0), 6) AS avg_community_size,
       coalesce(max(size), 0)::BIGINT AS largest_community,
       coalesce(min(size), 0)::BIGINT AS smallest_community
FROM details
"""


def _with(cte: str, body: str) -> str:
    return "WITH RECURSIVE " + cte.strip() + "\n" + body


# ---------------------------------------------------------------- Spark side
def doc_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the shared-line document graph.  The edges are a
    written table, so a query that uses them more than once derives them once."""
    docs = table(spark, sf_dir, "documents")
    edges = cut_lineage(g.shared_line_edges(docs.select("doc_id", "text")))
    return docs.select(F.col("doc_id").alias("node")), edges


def source_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("node"), F.col("source").alias("community"))


def _source_details(spark, sf_dir):
    _, edges = doc_graph(spark, sf_dir)
    return qm.community_details(source_membership(spark, sf_dir), edges)


def _components(spark, sf_dir):
    """(nodes, edges, membership by component, details)."""
    nodes, edges = doc_graph(spark, sf_dir)
    members = cc.connected_components(nodes, edges)
    return nodes, edges, members, qm.community_details(members, edges)


@reg.add("shared_line_edges", _with(GRAPH_CTE, "SELECT src, dst, weight FROM edges"))
def q_shared_line_edges(spark, sf_dir):
    _, edges = doc_graph(spark, sf_dir)
    return edges.select("src", "dst", "weight")


@reg.add("graph_summary", _with(GRAPH_CTE, """
SELECT (SELECT count(*) FROM nodes) AS num_nodes, (SELECT count(*) FROM edges) AS num_edges,
       round(2.0 * (SELECT count(*) FROM edges) / ((SELECT count(*) FROM nodes)::DOUBLE
             * ((SELECT count(*) FROM nodes) - 1)), 6) AS density,
       round((SELECT count(*) FROM edges) / ((SELECT count(*) FROM nodes)::DOUBLE
             * (SELECT count(*) FROM nodes)), 6) AS density_published,
       round(2.0 * (SELECT count(*) FROM edges) / (SELECT count(*) FROM nodes)::DOUBLE, 6)
             AS avg_degree
"""))
def q_graph_summary(spark, sf_dir):
    nodes, edges = doc_graph(spark, sf_dir)
    return rounded(g.graph_summary(nodes, edges))


@reg.add("node_degrees", _with(GRAPH_CTE, """
SELECT n.node, coalesce(d.deg_incident, 0)::BIGINT AS deg_incident,
       round(coalesce(d.deg_weighted, 0.0), 6) AS deg_weighted
FROM nodes n LEFT JOIN (
  SELECT node, count(*) AS deg_incident, sum(w) AS deg_weighted FROM (
    SELECT src AS node, CASE WHEN src = dst THEN 2 * weight ELSE weight END AS w FROM edges
    UNION ALL SELECT dst, weight FROM edges WHERE src <> dst) GROUP BY node) d USING (node)
"""))
def q_node_degrees(spark, sf_dir):
    nodes, edges = doc_graph(spark, sf_dir)
    return rounded(g.degrees(nodes, edges))


@reg.add("connected_components", _with(COMPONENTS_CTE, "SELECT node, community FROM membership"))
def q_connected_components(spark, sf_dir):
    return _components(spark, sf_dir)[2]


@reg.add("component_stats", _with(COMPONENTS_CTE + DETAILS_CTE, f"SELECT {DETAIL_COLS} FROM details"))
def q_component_stats(spark, sf_dir):
    return rounded(_components(spark, sf_dir)[3])


@reg.add("source_community_stats", _with(SOURCE_CTE + DETAILS_CTE, f"SELECT {DETAIL_COLS} FROM details"))
def q_source_community_stats(spark, sf_dir):
    return rounded(_source_details(spark, sf_dir))


@reg.add("source_modularity", _with(SOURCE_CTE + DETAILS_CTE, MODULARITY_SQL))
def q_source_modularity(spark, sf_dir):
    return rounded(qm.modularity_of(_source_details(spark, sf_dir)))


@reg.add("component_modularity", _with(COMPONENTS_CTE + DETAILS_CTE, MODULARITY_SQL))
def q_component_modularity(spark, sf_dir):
    return rounded(qm.modularity_of(_components(spark, sf_dir)[3]))


@reg.add("component_summary", _with(COMPONENTS_CTE + DETAILS_CTE, SUMMARY_SQL))
def q_component_summary(spark, sf_dir):
    return rounded(qm.community_summary(_components(spark, sf_dir)[3]))


RULES_SQL = """
SELECT * FROM (
  SELECT NULL AS community, 'large_community' AS rule,
         CASE WHEN max(size) > 20 THEN max(size)::DOUBLE END AS value FROM details
  UNION ALL
  SELECT NULL, 'small_community',
         CASE WHEN min(size) < 3 AND count(*) > 1 THEN min(size)::DOUBLE END FROM details
  UNION ALL
  SELECT community, 'low_cohesion', CASE WHEN cohesion < 0.3 THEN round(cohesion, 6) END FROM details
  UNION ALL
  SELECT community, 'high_coupling', CASE WHEN coupling > 0.7 THEN round(coupling, 6) END FROM details
) WHERE value IS NOT NULL
"""


@reg.add("source_recommendations", _with(SOURCE_CTE + DETAILS_CTE, RULES_SQL))
def q_source_recommendations(spark, sf_dir):
    return rounded(qm.recommendations(_source_details(spark, sf_dir)))


@reg.add("component_recommendations", _with(COMPONENTS_CTE + DETAILS_CTE, RULES_SQL))
def q_component_recommendations(spark, sf_dir):
    return rounded(qm.recommendations(_components(spark, sf_dir)[3]))


@reg.add("core_components", _with(COMPONENTS_CTE + DETAILS_CTE, """
SELECT d.community, d.size, round(d.cohesion, 6) AS cohesion, round(d.coupling, 6) AS coupling,
       d.size AS total_nodes,
       (SELECT array_to_string(list(node ORDER BY node), ',') FROM (
          SELECT node FROM membership m WHERE m.community = d.community ORDER BY node LIMIT 10))
         AS nodes
FROM details d WHERE d.size >= 5
"""))
def q_core_components(spark, sf_dir):
    _, _, members, details = _components(spark, sf_dir)
    core = qm.core_communities(details, members)
    return rounded(core.withColumn("nodes", F.array_join(
        F.transform("nodes", lambda x: x.cast("string")), ",")))


@reg.add("top_components", _with(COMPONENTS_CTE + DETAILS_CTE, f"""
SELECT {DETAIL_COLS} FROM details ORDER BY size DESC, community LIMIT 10
"""))
def q_top_components(spark, sf_dir):
    return rounded(qm.top_communities(_components(spark, sf_dir)[3], 10))


@reg.add("component_size_histogram", _with(COMPONENTS_CTE + DETAILS_CTE, """
SELECT bin, count(*) AS num_communities FROM (
  SELECT CASE WHEN mx = mn THEN 1
              ELSE least(10, floor((size - mn) * 10 / (mx - mn))::INT + 1) END AS bin
  FROM details, (SELECT min(size) AS mn, max(size) AS mx FROM details)
) GROUP BY bin
"""))
def q_component_size_histogram(spark, sf_dir):
    return qm.size_histogram(_components(spark, sf_dir)[3], 10)


@reg.add("source_size_share", _with(SOURCE_CTE + DETAILS_CTE, """
SELECT community, size, round(size * 100.0 / (SELECT sum(size) FROM details), 1) AS share_pct
FROM details
"""))
def q_source_size_share(spark, sf_dir):
    return qm.size_share(_source_details(spark, sf_dir))


@reg.add("source_quadrants", _with(SOURCE_CTE + DETAILS_CTE, """
SELECT community, round(cohesion, 6) AS cohesion, round(coupling, 6) AS coupling,
  CASE WHEN cohesion >= mc AND coupling < mp THEN 'high_cohesion_low_coupling'
       WHEN cohesion >= mc AND coupling >= mp THEN 'high_cohesion_high_coupling'
       WHEN cohesion < mc AND coupling < mp THEN 'low_cohesion_low_coupling'
       ELSE 'low_cohesion_high_coupling' END AS quadrant
FROM details, (SELECT median(cohesion) AS mc, median(coupling) AS mp FROM details)
"""))
def q_source_quadrants(spark, sf_dir):
    return rounded(qm.quadrants(_source_details(spark, sf_dir),
                                use_median=True))


@reg.add("component_dashboard", _with(COMPONENTS_CTE + DETAILS_CTE, """
SELECT (SELECT count(*) FROM nodes) AS num_nodes, (SELECT count(*) FROM edges) AS num_links,
       (SELECT count(*) FROM details) AS num_communities,
       round((SELECT avg(size) FROM details), 6) AS avg_size
"""))
def q_component_dashboard(spark, sf_dir):
    nodes, edges, _, details = _components(spark, sf_dir)
    return rounded(qm.dashboard(nodes, edges, details))


@reg.add("source_bands", _with(SOURCE_CTE + DETAILS_CTE, """
SELECT community,
  CASE WHEN cohesion <= 0.2 THEN 'low' WHEN cohesion <= 0.4 THEN 'medium' ELSE 'high' END
    AS cohesion_band,
  CASE WHEN coupling = 0 THEN 'independent' ELSE 'low' END AS coupling_band
FROM details
"""))
def q_source_bands(spark, sf_dir):
    return qm.bands(_source_details(spark, sf_dir))
