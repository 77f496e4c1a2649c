"""Registered corpus-search, hashing, similarity and scalar-function queries
(A11, B7–B9, B12, B16, G8, J1–J10, J13–J16) over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusgraph.functions import scalars as sc
from corpusgraph.operators import search as se
from corpusgraph.plans.common import Registry, rounded
from corpusgraph.plans.graph_queries import GRAPH_CTE, doc_graph
from corpusgraph.session import cut_lineage, delete_table, write_table
from corpusgraph.sources.tables import table

reg = Registry()

LINES_SQL = """lines AS (
  SELECT doc_id, i AS line_no, l AS line
  FROM documents, unnest(string_split(text, chr(10))) WITH ORDINALITY AS t(l, i))"""


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text")


@reg.add("document_search", f"""
WITH {LINES_SQL}
SELECT doc_id, line_no, line FROM lines WHERE regexp_matches(line, 'Licen[sc]e')
""")
def q_document_search(spark, sf_dir):
    return se.search_pattern(_docs(spark, sf_dir), "Licen[sc]e")


#: Prose turned into something that looks like source, in order: each word
#: that occurs becomes a token that the code searches look for.
CODE_WORDS = (("in ", "async def "), ("the ", "def "), ("and ", "class "), ("of ", "import "),
              ("to ", "if __name__ "), ("with ", "test_ "))


def _code(spark, sf_dir):
    text = F.col("text")
    for word, token in CODE_WORDS:
        text = F.replace(text, F.lit(word), F.lit(token))
    return _docs(spark, sf_dir).withColumn("text", text)


def _code_sql() -> str:
    text = "text"
    for word, token in CODE_WORDS:
        text = f"replace({text}, '{word}', '{token}')"
    return f"(SELECT doc_id, {text} AS text FROM documents)"


CODE_LINES_SQL = LINES_SQL.replace("FROM documents", f"FROM {_code_sql()} AS documents")


@reg.add("document_definitions", f"""
WITH {CODE_LINES_SQL}
SELECT doc_id, line_no, line FROM lines WHERE contains(line, 'def ')
""")
def q_document_definitions(spark, sf_dir):
    return se.find_definitions(_code(spark, sf_dir), "def")


@reg.add("document_imports", f"""
WITH {CODE_LINES_SQL}
SELECT doc_id, line_no, line FROM lines WHERE contains(line, 'import')
""")
def q_document_imports(spark, sf_dir):
    return se.list_imports(_code(spark, sf_dir))


@reg.add("document_references", f"""
WITH {LINES_SQL}
SELECT doc_id, line_no, line FROM lines
WHERE regexp_matches(line, '(^|[^A-Za-z0-9_])MIT([^A-Za-z0-9_]|$)')
""")
def q_document_references(spark, sf_dir):
    return se.referencing_lines(_docs(spark, sf_dir), "MIT")


def _panel_sql() -> str:
    cols = ", ".join(
        f"((length(coalesce(text, '')) - length(replace(coalesce(text, ''), '{p}', ''))) "
        f"// {len(p)})::BIGINT AS {name}" for name, p in se.PATTERN_PANEL)
    return f"SELECT doc_id, {cols} FROM {_code_sql()}"


@reg.add("document_pattern_panel", _panel_sql())
def q_document_pattern_panel(spark, sf_dir):
    return se.pattern_panel(_code(spark, sf_dir))


@reg.add("large_corpus_flag", """
SELECT count(*) AS files, count(*) > 50 AS is_large FROM documents
""")
def q_large_corpus_flag(spark, sf_dir):
    return se.large_corpus_flag(_docs(spark, sf_dir))


@reg.add("exact_duplicate_documents", """
SELECT sha256(text) AS sha256, count(*) AS copies, min(doc_id) AS first_id
FROM documents GROUP BY 1 HAVING count(*) > 1
""")
def q_exact_duplicate_documents(spark, sf_dir):
    return se.exact_duplicates(_docs(spark, sf_dir))


TOKENS_SQL = """toks AS (
  SELECT DISTINCT doc_id AS id, tok
  FROM documents, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')) AS t(tok)
  WHERE tok <> '')"""


@reg.add("document_similarity_pairs", "WITH RECURSIVE " + GRAPH_CTE.strip() + f""",
{TOKENS_SQL},
sz AS (SELECT id, count(*) AS n FROM toks GROUP BY id),
inter AS (
  SELECT e.src, e.dst, count(*) AS common
  FROM edges e JOIN toks a ON a.id = e.src JOIN toks b ON b.id = e.dst AND b.tok = a.tok
  GROUP BY e.src, e.dst)
SELECT e.src, e.dst, coalesce(i.common, 0)::BIGINT AS common,
       round(coalesce(coalesce(i.common, 0)
             / nullif(coalesce(s1.n, 0) + coalesce(s2.n, 0) - coalesce(i.common, 0), 0)::DOUBLE,
             0.0), 6) AS jaccard
FROM edges e LEFT JOIN inter i USING (src, dst)
LEFT JOIN sz s1 ON s1.id = e.src LEFT JOIN sz s2 ON s2.id = e.dst
""")
def q_document_similarity_pairs(spark, sf_dir):
    """Of the star edges of shared lines only; all similar pairs are in document_class_pairs."""
    _, edges = doc_graph(spark, sf_dir)
    # tokenise only the documents that are endpoints of a pair
    ends = (edges.select(F.col("src").alias("doc_id"))
            .unionByName(edges.select(F.col("dst").alias("doc_id"))).distinct())
    docs = _docs(spark, sf_dir).join(ends, "doc_id", "left_semi")
    return rounded(se.pair_jaccard(edges, se.token_arrays(docs)))


#: Every document with its token set, the empty one included.
SETS_SQL = f"""{TOKENS_SQL},
sets AS (
  SELECT d.doc_id, coalesce(list_sort(list(tok) FILTER (tok IS NOT NULL)), []) AS s
  FROM documents d LEFT JOIN toks ON toks.id = d.doc_id GROUP BY d.doc_id),
members AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY s) AS class_id FROM sets)"""


@reg.add("document_classes", f"WITH {SETS_SQL} SELECT doc_id, class_id FROM members")
def q_document_classes(spark, sf_dir):
    """Documents of equal token sets, the members of document_class_pairs."""
    keyed = se.token_keys(se.token_arrays(_docs(spark, sf_dir))).select("id", "key")
    return se.token_classes(cut_lineage(keyed)).withColumnRenamed("id", "doc_id")


@reg.add("document_class_pairs", f"""
WITH {SETS_SQL},
c AS (SELECT toks.id, tok FROM toks JOIN members ON doc_id = toks.id WHERE doc_id = class_id),
sz AS (SELECT id, count(*) AS n FROM c GROUP BY id),
inter AS (
  SELECT a.id AS src, b.id AS dst, count(*) AS common
  FROM c a JOIN c b ON a.tok = b.tok AND a.id < b.id GROUP BY 1, 2)
SELECT src, dst, common::BIGINT AS common,
       round(common / (s1.n + s2.n - common)::DOUBLE, 6) AS jaccard
FROM inter JOIN sz s1 ON s1.id = src JOIN sz s2 ON s2.id = dst
WHERE 5 * common >= 4 * (s1.n + s2.n - common)
""")
def q_document_class_pairs(spark, sf_dir):
    """All pairs of different token sets with a Jaccard of at least 0.8."""
    sets = se.token_keys(se.token_arrays(_docs(spark, sf_dir)))
    path = write_table(sets)
    pairs = se.similar_classes(spark.read.schema(sets.schema).parquet(path), 4, 5)
    delete_table(spark, path)
    return rounded(pairs)


@reg.add("embedding_label_cosine", """
WITH comps AS (
  SELECT vec_id, label, i AS pos, x::DOUBLE AS x
  FROM embeddings, unnest(embedding) WITH ORDINALITY AS t(x, i)),
cent AS (SELECT label, pos, avg(x) AS m FROM comps GROUP BY label, pos),
dots AS (
  SELECT c.vec_id, c.label, sum(c.x * ce.m) AS dot, sqrt(sum(c.x * c.x)) AS na
  FROM comps c JOIN cent ce USING (label, pos) GROUP BY c.vec_id, c.label),
norms AS (SELECT label, sqrt(sum(m * m)) AS nb FROM cent GROUP BY label)
SELECT vec_id, label, round(coalesce(dot / nullif(na * nb, 0), 0.0), 6) AS cosine
FROM dots JOIN norms USING (label)
""")
def q_embedding_label_cosine(spark, sf_dir):
    emb = table(spark, sf_dir, "embeddings").select(
        "vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    return rounded(se.centroid_cosine(emb, "vec_id", "embedding", "label"))


# ------------------------------------------------------------------ J
TITLE_SQL = ("array_to_string(list_transform(regexp_extract_all({x}, '(\\p{{L}}+|\\P{{L}}+)', 1), "
             "lambda r: CASE WHEN regexp_matches(r, '^\\p{{L}}') "
             "THEN upper(left(r, 1)) || lower(substr(r, 2)) ELSE r END), '')")


def _camel_sql(x: str) -> str:
    parts = f"string_split({x}, '_')"
    return f"array_to_string(list_transform({parts}, lambda p: {TITLE_SQL.format(x='p')}), '')"


def _snake_sql(x: str) -> str:
    s1 = f"regexp_replace({x}, '(.)([A-Z][a-z]+)', '\\1_\\2', 'g')"
    return f"lower(regexp_replace({s1}, '([a-z0-9])([A-Z])', '\\1_\\2', 'g'))"


@reg.add("part_text_functions", f"""
WITH p AS (SELECT p_partkey, p_name, p_type, p_brand, p_retailprice,
                  replace(p_name, ' ', '_') AS snake FROM part),
c AS (SELECT *, {_camel_sql('snake')} AS camel FROM p)
SELECT p_partkey, camel, {_snake_sql('camel')} AS snake_again,
       CASE WHEN length(p_name) <= 8 THEN p_name ELSE left(p_name, 5) || '...' END AS short_name,
       CASE WHEN length(s) > 255 THEN left(regexp_replace(s, '\\.[^.]*$', ''),
                 255 - length(regexp_extract(s, '(\\.[^.]*)$', 1))) || regexp_extract(s, '(\\.[^.]*)$', 1)
            ELSE s END AS file_name,
       CASE WHEN coalesce(p_type, '') = '' THEN 'PRD' ELSE upper(left(p_type, 3)) END
         || '-' || upper(left(p_partkey::VARCHAR, 8)) AS sku,
       'USD ' || printf('%.2f', p_retailprice) AS price_text
FROM (SELECT *, trim(translate(p_brand || ':' || p_name || '?.txt', '<>:"/\\|?*', '_________'), '. ')
             AS s FROM c)
""")
def q_part_text_functions(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("snake", F.regexp_replace("p_name", " ", "_"))
    p = p.withColumn("camel", sc.snake_to_camel("snake"))
    return p.select(
        "p_partkey", "camel", sc.camel_to_snake("camel").alias("snake_again"),
        sc.truncate("p_name", 8).alias("short_name"),
        sc.sanitize_filename(F.concat("p_brand", F.lit(":"), "p_name", F.lit("?.txt"))).alias("file_name"),
        sc.sku("p_type", "p_partkey").alias("sku"),
        sc.price_text(F.lit("USD"), "p_retailprice").alias("price_text"))


@reg.add("document_emails", r"""
SELECT doc_id, tok AS email
FROM documents, unnest(regexp_split_to_array(text, '\s+')) AS t(tok)
WHERE regexp_matches(tok, '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$')
""")
def q_document_emails(spark, sf_dir):
    toks = _docs(spark, sf_dir).select("doc_id", F.explode(F.split("text", r"\s+")).alias("email"))
    return toks.where(sc.is_valid_email("email"))


@reg.add("page_url_parts", """
SELECT page_id, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1) AS scheme,
       regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS netloc,
       coalesce(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1) <> ''
                AND regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) <> '', false)
         AS is_valid
FROM pages
""")
def q_page_url_parts(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    scheme, netloc = sc.url_parts("url")
    return pages.select("page_id", scheme.alias("scheme"), netloc.alias("netloc"),
                        sc.is_valid_url("url").alias("is_valid"))


# date text written in one of five formats chosen by the order priority
_PRIORITY_FORMATS = [("1-URGENT", "%Y-%m-%d %H:%M:%S", "yyyy-MM-dd HH:mm:ss"),
                     ("2-HIGH", "%Y/%m/%d", "yyyy/MM/dd"),
                     ("3-MEDIUM", "%d/%m/%Y", "dd/MM/yyyy"),
                     ("4-NOT SPECIFIED", "%Y-%m-%dT%H:%M:%SZ", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
                     ("5-LOW", "%d-%m-%Y", "dd-MM-yyyy")]


def _date_text_sql() -> str:
    cases = " ".join(f"WHEN o_orderpriority = '{p}' THEN strftime(o_orderdate, '{f}')"
                     for p, f, _ in _PRIORITY_FORMATS)
    parse = ", ".join(f"try_strptime(date_text, '{f}')" for f, _ in sc.DATE_FORMATS)
    return f"""
WITH t AS (SELECT o_orderkey, CASE {cases} END AS date_text FROM orders)
SELECT o_orderkey, date_text, coalesce({parse})::TIMESTAMP AS parsed FROM t
"""


@reg.add("order_date_parse", _date_text_sql())
def q_order_date_parse(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    txt = None
    for p, _, jp in _PRIORITY_FORMATS:
        c = F.date_format("o_orderdate", jp)
        txt = F.when(F.col("o_orderpriority") == p, c) if txt is None else \
            txt.when(F.col("o_orderpriority") == p, c)
    t = o.select("o_orderkey", txt.alias("date_text"))
    return t.select("o_orderkey", "date_text",
                    sc.parse_datetime("date_text").cast("timestamp_ntz").alias("parsed"))


def _bytes_sql(x: str) -> str:
    units = ["B", "KB", "MB", "GB", "TB"]
    parts = " ".join(f"WHEN {x} / {float(1024 ** i)} < 1024.0 THEN printf('%.1f', {x} / "
                     f"{float(1024 ** i)}) || ' {u}'" for i, u in enumerate(units))
    return f"CASE {parts} ELSE printf('%.1f', {x} / {float(1024 ** 5)}) || ' PB' END"


@reg.add("document_size_text", f"""
SELECT doc_id, {_bytes_sql('n_chars::DOUBLE')} AS size_text,
       {_bytes_sql('(n_chars * n_chars * n_chars)::DOUBLE')} AS cube_text,
       len(list_transform(range(0, CAST(ceil(len(string_split(text, ' ')) / 3.0) AS BIGINT)),
                          lambda i: 1)) AS word_chunks
FROM documents
""")
def q_document_size_text(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(
        "doc_id", "n_chars", F.split("text", " ", -1).alias("words"))
    # chunk a column, not the split expression: inside the lambda an inlined
    # expression would be evaluated once per element
    return d.select("doc_id", sc.format_bytes("n_chars").alias("size_text"),
                    sc.format_bytes(F.col("n_chars") * F.col("n_chars") * F.col("n_chars"))
                    .alias("cube_text"),
                    F.size(sc.chunk(F.col("words"), 3)).cast("long").alias("word_chunks"))


@reg.add("events_props_flat", """
SELECT event_id, json_extract(props, '$.k')::INTEGER AS props_k FROM events
""")
def q_events_props_flat(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(
        "event_id", F.from_json("props", "k INT").alias("props"))
    return sc.flatten_struct(e, sep="_")


@reg.add("lineitem_safe_ratios", """
SELECT l_orderkey, l_linenumber,
       round(CASE WHEN l_tax = 0 THEN 0.0 ELSE l_discount / l_tax END, 6) AS discount_per_tax,
       CASE WHEN l_quantity IS NOT NULL THEN greatest(10.0, least(40.0, l_quantity)) END AS clamped_quantity
FROM lineitem
""")
def q_lineitem_safe_ratios(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return rounded(li.select("l_orderkey", "l_linenumber",
                             sc.safe_divide("l_discount", "l_tax", 0.0).alias("discount_per_tax"),
                             sc.clamp("l_quantity", 10.0, 40.0).alias("clamped_quantity")))
