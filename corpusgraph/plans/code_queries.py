"""Registered queries on code-like elements and terms derived from the driver
tables (B7, B13, C1/C2 by hubs, C5, D6, D8, F12, F13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusgraph.operators import graph as g
from corpusgraph.operators import naming as nm
from corpusgraph.operators import postings as po
from corpusgraph.plans.common import Registry, rounded
from corpusgraph.plans.text_queries import LINES_SQL
from corpusgraph.sources.tables import table

reg = Registry()


@reg.add("document_search_indexed", f"""
WITH {LINES_SQL}
SELECT doc_id, line_no, line FROM lines WHERE regexp_matches(line, 'Licen[sc]e')
""")
def q_document_search_indexed(spark, sf_dir):
    """B7 through written trigram postings: only texts with ``Licen`` are scanned."""
    index = po.build_index(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return po.search_pattern(index, "Licen[sc]e")


@reg.add("part_name_symbols", "SELECT p_partkey FROM part WHERE contains(p_name, 'widget')")
def q_part_name_symbols(spark, sf_dir):
    """Names that hold a string, through postings of the names."""
    index = po.build_index(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey", "p_name", parts=8)
    return po.find_texts(index, "widget")


#: Every document as a function: named by its first word, calling every word.
_ELEMENTS_SQL = """
w AS (SELECT doc_id, source, regexp_extract_all(lower(text), '[a-z]+') AS ws FROM documents),
def AS (SELECT doc_id, source, ws[1] AS name FROM w WHERE len(ws) > 0),
call AS (SELECT doc_id, source, unnest(list_distinct(ws)) AS name FROM w),
defs AS (SELECT name, count(*) AS n FROM def GROUP BY name),
calls AS (SELECT name, count(*) AS n FROM call GROUP BY name)
"""


def _elements(spark, sf_dir):
    words = F.expr("regexp_extract_all(lower(text), '[a-z]+', 0)")
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("element_id"), "source", F.lit("function").alias("kind"), words.alias("calls")).withColumn(
        "name", F.get("calls", 0)).withColumn("inheritance", F.array().cast("array<string>"))


@reg.add("call_degrees", f"""
WITH {_ELEMENTS_SQL}
SELECT node, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM (
  SELECT doc_id AS node, defs.n AS o, 0 AS i FROM call JOIN defs USING (name)
  UNION ALL SELECT doc_id, 0, calls.n FROM def JOIN calls USING (name))
GROUP BY node
""")
def q_call_degrees(spark, sf_dir):
    """Calls by name and calls received, with no edge listed."""
    return g.hub_degrees(_elements(spark, sf_dir))


@reg.add("call_modularity", f"""
WITH {_ELEMENTS_SQL},
e AS (SELECT c.source AS cs, d.source AS ds, count(*) AS n
      FROM call c JOIN def d USING (name) GROUP BY 1, 2),
m AS (SELECT sum(n) AS m FROM e),
k AS (SELECT s, sum(n) AS k FROM (SELECT cs AS s, n FROM e UNION ALL SELECT ds, n FROM e) GROUP BY s)
SELECT CAST(m AS BIGINT) AS num_edges,
       round((SELECT sum(n) FROM e WHERE cs = ds) / m - (SELECT sum(k * k) FROM k) / (4.0 * m * m), 6) AS modularity
FROM m
""")
def q_call_modularity(spark, sf_dir):
    """Modularity of the sources over all caller-definition edges."""
    elements = _elements(spark, sf_dir)
    members = elements.select(F.col("element_id").alias("node"), F.col("source").alias("community"))
    return rounded(g.hub_modularity(elements, members))


#: Words of the texts that stand for dictionary terms.
_TERMS = (("the ", "缓存管理 "), ("and ", "auth "), ("of ", "数据分析 "), ("to ", "scheduler "), ("in ", "API接口 "))


def _values() -> str:
    return ", ".join(f"({i}, '{t}', '{kw}')" for i, (t, kw) in enumerate(nm.keyword_terms("en")))


def _terms_sql() -> str:
    text = "text"
    for word, term in _TERMS:
        text = f"replace({text}, '{word}', '{term}')"
    return text


@reg.add("document_keywords", f"""
WITH t AS (SELECT doc_id, lower({_terms_sql()}) AS x FROM documents),
terms(rank, term, keyword) AS (VALUES {_values()}),
hit AS (SELECT doc_id, keyword, min(rank) AS rank FROM t JOIN terms ON contains(x, term) GROUP BY 1, 2)
SELECT t.doc_id, coalesce(k, []) AS keywords FROM t LEFT JOIN (
  SELECT doc_id, (list(keyword ORDER BY rank))[:2] AS k FROM hit GROUP BY doc_id) USING (doc_id)
""")
def q_document_keywords(spark, sf_dir):
    """first two keywords of every document, by one automaton of all terms."""
    text = F.col("text")
    for word, term in _TERMS:
        text = F.replace(text, F.lit(word), F.lit(term))
    docs = table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))
    return nm.with_keywords(docs, "text").select("doc_id", "keywords")


def _shown() -> str:
    words = nm.FUNCTION_WORDS["en"]
    return ", ".join(f"('{kw}', '{words.get(kw) or kw.title()}')"
                     for kw in dict.fromkeys(kw for _, kw in nm.keyword_terms("en")))


@reg.add("document_keyword_names", f"""
WITH t AS (SELECT doc_id, lower({_terms_sql()}) AS x FROM documents),
terms(rank, term, keyword) AS (VALUES {_values()}),
shown(keyword, word) AS (VALUES {_shown()}),
hit AS (SELECT doc_id, keyword, min(rank) AS rank FROM t JOIN terms ON contains(x, term) GROUP BY 1, 2),
two AS (SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY rank) <= 2),
n AS (SELECT doc_id, string_agg(word, ' ' ORDER BY rank) || ' Module' AS name FROM two JOIN shown USING (keyword)
      GROUP BY doc_id)
SELECT t.doc_id, name FROM t LEFT JOIN n USING (doc_id)
""")
def q_document_keyword_names(spark, sf_dir):
    """a document's name from the keywords of its text."""
    text = F.col("text")
    for word, term in _TERMS:
        text = F.replace(text, F.lit(word), F.lit(term))
    docs = nm.with_keywords(table(spark, sf_dir, "documents").select("doc_id", text.alias("text")), "text")
    none = F.array().cast("array<string>")
    return docs.select("doc_id", nm.name_from_description(
        "text", none, F.lit(None).cast("string"), keywords="keywords").alias("name"))
