"""Registered queries of the operators in this package (`opN_<name>`), each
over its whole table with production parameters, and their DuckDB SQL."""

from __future__ import annotations

from corpusgraph.llm.hard_negatives import mine
from corpusgraph.llm.html_text import extract
from corpusgraph.llm.nbest import segmentations
from corpusgraph.llm.packing import pack
from corpusgraph.llm.ppm_lang import identify
from corpusgraph.llm.prefix_trie import trie
from corpusgraph.llm.quality_pu import quality
from corpusgraph.llm.rules import judge
from corpusgraph.llm.simhash import near_duplicates
from corpusgraph.llm.suffixes import remove_repeats
from corpusgraph.llm.url_cascade import BLOCKED, judge_urls
from corpusgraph.llm.vectors import near_vectors
from corpusgraph.llm.warc import round_trip
from corpusgraph.plans.common import Registry
from corpusgraph.sources.tables import table

reg = Registry()


@reg.add("op1_packing")
def op1_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))


@reg.add("op2_quality_classifier")
def op2_quality_classifier(spark, sf_dir):
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_OP3 = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS e,
         coalesce(len(embedding) > 0
                  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                  AND len(list_filter(embedding, lambda x: x <> 0)) > 0, false) AS ok
  FROM embeddings),
l AS (
  SELECT a.r AS x, b.r AS y FROM v a JOIN v b ON a.r <> b.r AND len(a.e) = len(b.e)
  WHERE a.ok AND b.ok AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (
  SELECT r AS x, r AS y FROM v UNION SELECT reach.x, l.y FROM reach JOIN l ON l.x = reach.y),
c AS (SELECT reach.x AS r, min(v.vec_id) AS component_id FROM reach JOIN v ON v.r = reach.y GROUP BY 1),
n AS (SELECT x AS r, count(*) AS n FROM l GROUP BY 1)
SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, component_id,
       vec_id IS NOT DISTINCT FROM component_id AS kept
FROM v JOIN c USING (r) LEFT JOIN n USING (r)
"""


@reg.add("op3_embedding_near_dedup", _OP3)
def op3_embedding_near_dedup(spark, sf_dir):
    return near_vectors(table(spark, sf_dir, "embeddings"))


@reg.add("op4_suffix_dedup")
def op4_suffix_dedup(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents"))


#: Base32 of SHA-1 from its bits: digit j is bits 5j to 5j + 4.
_OP5 = """
WITH d AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex
  FROM pages),
b AS (
  SELECT *, array_to_string(list_transform(range(0, 32), lambda j: substr(
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + CAST(((('0x' || substr(hex, 1 + 10 * (j // 8), 10))::BIGINT
                      >> (35 - 5 * (j % 8))) & 31) AS INTEGER), 1)), '') AS payload_digest
  FROM d),
m AS (SELECT payload_digest, max(page_id) AS largest FROM b GROUP BY payload_digest)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN largest IS NOT NULL AND page_id IS DISTINCT FROM largest
            THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM largest THEN largest END AS refers_to
FROM b JOIN m USING (payload_digest)
"""


@reg.add("op5_warc", _OP5)
def op5_warc(spark, sf_dir):
    return round_trip(table(spark, sf_dir, "pages"))


@reg.add("op6_nbest_segmentation")
def op6_nbest_segmentation(spark, sf_dir):
    return segmentations(table(spark, sf_dir, "documents"))


@reg.add("op7_html_extraction")
def op7_html_extraction(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages"))


_OP8 = """
WITH u AS (
  SELECT page_id,
         CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) END AS rest
  FROM pages),
p AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(rest, '^[^/?#]*'),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM u),
f AS (
  SELECT *, CASE
      WHEN (host = 'example.org' OR ends_with(host, '.example.org'))
           AND starts_with(path, '/en/1') THEN 'example.org/en/1'
      WHEN (host = 'example.org' OR ends_with(host, '.example.org'))
           AND starts_with(path, '/es/') THEN 'example.org/es/'
      WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
      WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
      WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/'
    END AS rule
  FROM p)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('org/', 'com/fr/') THEN 'allow'
    WHEN rule IS NOT NULL THEN 'block'
    WHEN list_has_any(string_split(host, '.')[:-2], [{names}]) THEN 'block'
    ELSE 'allow' END AS verdict
FROM f
""".format(names=", ".join(f"'{n}'" for n in BLOCKED))


@reg.add("op8_url_filter", _OP8)
def op8_url_filter(spark, sf_dir):
    return judge_urls(table(spark, sf_dir, "pages"))


@reg.add("op9_simhash")
def op9_simhash(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


#: The rules of ``rules.RULES``, as SQL over the same counts.
_OP10 = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)),
                     lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
win AS (
  SELECT rid, p, ws[p] || ' ' || ws[p + 1] || ' ' || ws[p + 2] AS k
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS p FROM d)),
rep AS (SELECT rid, k FROM win GROUP BY rid, k HAVING count(*) > 1),
cov AS (
  SELECT rid, count(DISTINCT p + o) AS n
  FROM win JOIN rep USING (rid, k) CROSS JOIN range(0, 3) r(o) GROUP BY rid),
c AS (
  SELECT doc_id, t, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         len(ls) AS n_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN cov USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed
            OR word_chars < 3 * n_words OR word_chars > 10 * n_words
            OR 10 * n_symbols > n_words
            OR 10 * n_dup_lines > 3 * n_lines
            OR 10 * len(regexp_extract_all(t, '\p{Lu}')) > 3 * word_chars
            OR 10 * len(regexp_extract_all(t, '\p{L}')) < 6 * word_chars
            OR 100 * len(regexp_extract_all(
                 t, '\.\.\.[\x20\x09\r]*(\n|\z)|…[\x20\x09\r]*(\n|\z)')) > 30 * n_lines) AS kept
FROM b
"""


@reg.add("op10_quality_rules", _OP10)
def op10_quality_rules(spark, sf_dir):
    return judge(table(spark, sf_dir, "documents"))


#: CRC-32 bit by bit: a digit is mixed in, then eight shifts (-1) follow.
_OP11 = """
WITH o AS (
  SELECT conv_id AS c, length(coalesce(text, '')) AS size,
         sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k, turn
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, k, size, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, k) AS p FROM o),
conv AS (
  SELECT c, c - c % 100 AS base, xor(4294967295, list_reduce(
           list_prepend(4294967295, flatten(list_transform(string_split(CAST(c AS VARCHAR), ''),
             lambda d: list_prepend(CAST(ord(d) AS BIGINT), [-1, -1, -1, -1, -1, -1, -1, -1])))),
           lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384)
                             ELSE a // 2 END)) % 6 AS h
  FROM (SELECT DISTINCT c FROM own)),
n_base AS (SELECT conv.c, count(own.c) AS n FROM conv LEFT JOIN own ON own.c = base AND p <= h GROUP BY 1),
r AS (
  SELECT conv.c, own.p AS d, k, size FROM conv JOIN own ON own.c = base AND own.p <= h
  UNION ALL
  SELECT conv.c, own.p - h + n, k, size FROM conv JOIN n_base USING (c) JOIN own ON own.c = conv.c AND own.p > h),
m AS (
  SELECT c, d, size, string_agg(k, '') OVER (PARTITION BY c ORDER BY d) AS path FROM r
  UNION ALL SELECT c, 0, 0, '' FROM conv),
last AS (SELECT c, max(d) AS d, arg_max(path, d) AS path FROM m GROUP BY c),
e AS (SELECT path, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) AS ends FROM last GROUP BY path),
node AS (SELECT d, path, min(c) AS c, count(*) AS n, any_value(size) AS size FROM m GROUP BY d, path),
kids AS (SELECT left(path, 64 * (d - 1)) AS path, count(*) AS n FROM node WHERE d > 0 GROUP BY 1),
under AS (
  SELECT left(node.path, 64 * x) AS path, sum(CAST(kids.path IS NULL AS INTEGER)) AS leaves,
         sum((node.n - 1) * size) AS saved
  FROM node LEFT JOIN kids ON kids.path = node.path, unnest(range(0, node.d + 1)) u(x) GROUP BY 1)
SELECT node.c AS conv_id, CAST(node.d AS BIGINT) AS depth, up.c AS parent_conv_id,
       CAST(node.n AS BIGINT) AS n_convs, CAST(coalesce(kids.n, 0) AS BIGINT) AS n_children,
       CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens,
       coalesce(ends, sha256('')) AS ends_sha256
FROM node JOIN under USING (path) LEFT JOIN kids USING (path) LEFT JOIN e USING (path)
LEFT JOIN node up ON node.d > 0 AND up.path = left(node.path, 64 * (node.d - 1))
"""


@reg.add("op11_prefix_trie", _OP11)
def op11_prefix_trie(spark, sf_dir):
    return trie(table(spark, sf_dir, "conversations"))


@reg.add("op12_language_id")
def op12_language_id(spark, sf_dir):
    return identify(table(spark, sf_dir, "documents"))


_OP13 = """
WITH t AS (
  SELECT row_number() OVER () AS r, vec_id,
         CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(floor(256 * x) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.r, a.vec_id AS anchor_id, b.r AS br, b.vec_id AS vec_id, a.label = b.label AS same,
         CAST(list_sum(list_transform(list_zip(a.v, b.v),
              lambda p: coalesce(p[1], 0) * coalesce(p[2], 0))) AS BIGINT) AS score
  FROM t a JOIN t b ON a.r <> b.r WHERE a.vec_id % 100 = 0),
p AS (
  SELECT r, anchor_id, br AS pr, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id, br) <= 5)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id,
       p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.r = p.r AND NOT s.same
  AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
WINDOW w AS (PARTITION BY p.r, p.pr ORDER BY s.score DESC, s.vec_id, s.br)
QUALIFY row_number() OVER w <= 5
"""


@reg.add("op13_hard_negatives", _OP13)
def op13_hard_negatives(spark, sf_dir):
    return mine(table(spark, sf_dir, "embeddings"))
