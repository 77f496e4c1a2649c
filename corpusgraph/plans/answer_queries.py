"""Registered answer-parsing, cache and similarity-score queries (G1–G3,
G5–G7).  Answers are built from ``conversations`` by expression: assistant
turns carry a JSON record (inside prose, or inside a fence), user turns are
plain prose, system turns hold a stray brace — so every parse path runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusgraph.operators import answers as an
from corpusgraph.plans.common import Registry
from corpusgraph.sources.tables import table

reg = Registry()


def _record(spark_cols=True):
    return F.to_json(F.struct(F.col("text").alias("functionality"),
                              (F.col("turn") + 1).alias("complexity"),
                              F.length("role").alias("quality"),
                              F.array("role", "text").alias("suggestions"),
                              F.array("role").alias("tags")))


REC_SQL = ("json_object('functionality', text, 'complexity', turn + 1, 'quality', length(role), "
           "'suggestions', [role, text], 'tags', [role])")
#: The list fields joined; the records hold no dependencies.
LISTS_SQL = """
  CASE WHEN ok THEN array_to_string(json_extract(js, '$.suggestions')::VARCHAR[], ';') ELSE '' END AS suggestions,
  CASE WHEN ok THEN array_to_string(json_extract(js, '$.tags')::VARCHAR[], ';') ELSE '' END AS tags,
  '' AS dependencies,"""


def _flat(parsed):
    """The parsed struct as columns, lists joined."""
    fields = ("functionality", "complexity", "quality", "is_default")
    return [*(parsed[f].alias(f) for f in fields),
            *(F.array_join(parsed[f], ";").alias(f) for f in an.LIST_FIELDS)]


def _conv(spark, sf_dir):
    return table(spark, sf_dir, "conversations")


def _fields_sql(js: str) -> dict:
    return {"functionality": f"json_extract_string({js}, '$.functionality')",
            "complexity": f"TRY_CAST(json_extract_string({js}, '$.complexity') AS INTEGER)",
            "quality": f"TRY_CAST(json_extract_string({js}, '$.quality') AS INTEGER)"}


LOOSE_ANSWER_SQL = f"""CASE WHEN role = 'assistant' THEN 'Result: ' || {REC_SQL} || ' Done.'
     WHEN role = 'system' THEN 'Note {{ ' || text ELSE text END"""


@reg.add("answer_parse_loose", f"""
WITH a AS (SELECT conv_id, turn, {LOOSE_ANSWER_SQL} AS t FROM conversations),
j AS (SELECT *, CASE WHEN instr(t, '{{') > 0 AND instr(t, '}}') > 0
                      AND length(t) - instr(reverse(t), '}}') + 1 >= instr(t, '{{')
                 THEN substring(t, instr(t, '{{'),
                                length(t) - instr(reverse(t), '}}') + 1 - instr(t, '{{') + 1) END AS js
      FROM a),
v AS (SELECT *, coalesce(json_valid(js), false) AS ok FROM j)
SELECT conv_id, turn,
  CASE WHEN ok THEN {_fields_sql('js')['functionality']}
       WHEN length(t) > 200 THEN left(t, 200) || '...' ELSE t END AS functionality,
  CASE WHEN ok THEN {_fields_sql('js')['complexity']} ELSE 5 END AS complexity,
  CASE WHEN ok THEN {_fields_sql('js')['quality']} ELSE 7 END AS quality,{LISTS_SQL}
  NOT ok AS is_default
FROM v
""")
def q_answer_parse_loose(spark, sf_dir):
    c = _conv(spark, sf_dir)
    t = (F.when(F.col("role") == "assistant", F.concat(F.lit("Result: "), _record(), F.lit(" Done.")))
         .when(F.col("role") == "system", F.concat(F.lit("Note { "), F.col("text")))
         .otherwise(F.col("text")))
    p = an.parse_answer_loose(t)
    return c.select("conv_id", "turn", *_flat(p))


FENCED_ANSWER_SQL = f"""CASE WHEN role = 'assistant' THEN 'Here:' || chr(10) || '```json' || chr(10)
                              || {REC_SQL} || chr(10) || '```'
     WHEN role = 'user' THEN '```' || chr(10) || {REC_SQL} || chr(10) || '```' ELSE text END"""


def _between_sql(t: str, opener: str) -> str:
    after = f"substring({t}, instr({t}, '{opener}') + {len(opener)})"
    return (f"trim(CASE WHEN instr({after}, '```') > 0 THEN substring({after}, 1, instr({after}, '```') - 1) "
            f"ELSE substring({after}, 1, length({after}) - 1) END)")


@reg.add("answer_parse_fenced", f"""
WITH a AS (SELECT conv_id, turn, {FENCED_ANSWER_SQL} AS t FROM conversations),
j AS (SELECT *, CASE WHEN starts_with(trim(t), '{{') THEN trim(t)
                     WHEN contains(t, '```json') THEN {_between_sql('t', '```json')}
                     WHEN contains(t, '```') THEN {_between_sql('t', '```')} END AS js FROM a),
v AS (SELECT *, coalesce(json_valid(js), false) AS ok FROM j)
SELECT conv_id, turn,
  CASE WHEN ok THEN {_fields_sql('js')['functionality']} ELSE 'analysis failed' END AS functionality,
  CASE WHEN ok THEN {_fields_sql('js')['complexity']} ELSE 5 END AS complexity,
  CASE WHEN ok THEN {_fields_sql('js')['quality']} ELSE 5 END AS quality,{LISTS_SQL}
  NOT ok AS is_default
FROM v
""")
def q_answer_parse_fenced(spark, sf_dir):
    c = _conv(spark, sf_dir)
    nl = F.lit("\n")
    t = (F.when(F.col("role") == "assistant",
                F.concat(F.lit("Here:"), nl, F.lit("```json"), nl, _record(), nl, F.lit("```")))
         .when(F.col("role") == "user", F.concat(F.lit("```"), nl, _record(), nl, F.lit("```")))
         .otherwise(F.col("text")))
    p = an.parse_answer_fenced(t)
    return c.select("conv_id", "turn", *_flat(p))


#: A rating text by expression: no number on blogs, else 0.x, 1.x or 2.x.
_RATING_SQL = """CASE WHEN contains(url, 'blog') THEN 'unrated'
  ELSE 'rated ' || (length(url) // 30)::VARCHAR || '.' || (length(url) % 10)::VARCHAR || ' of 1' END"""


@reg.add("page_url_score", r"""
SELECT page_id,
  coalesce(CASE WHEN regexp_extract(t, '0?\.\d+|\d+\.?\d*', 0) <> ''
                THEN greatest(0.0, least(1.0, TRY_CAST(regexp_extract(t, '0?\.\d+|\d+\.?\d*', 0)
                                                       AS DOUBLE))) END, 0.0) AS score
FROM (SELECT page_id, """ + _RATING_SQL + """ AS t FROM pages)
""")
def q_page_url_score(spark, sf_dir):
    n = F.length("url")
    rating = F.when(F.col("url").contains("blog"), "unrated").otherwise(F.concat(
        F.lit("rated "), F.floor(n / 30).cast("string"), F.lit("."), (n % 10).cast("string"), F.lit(" of 1")))
    return table(spark, sf_dir, "pages").select("page_id", an.parse_score(rating).alias("score"))


@reg.add("conversation_names", """
WITH t AS (SELECT conv_id, turn, CASE role WHEN 'assistant' THEN '名称：' || text WHEN 'system' THEN '""'
                                 ELSE '"' || text || '"' END AS raw FROM conversations),
s AS (SELECT conv_id, turn, CASE WHEN starts_with(trim(raw), '名称：') THEN trim(substr(trim(raw), 4))
                                 ELSE trim(raw) END AS raw FROM t)
SELECT conv_id, turn, CASE WHEN left(trim(raw, '"' || chr(39)), 10) = '' THEN '未知功能'
                           ELSE left(trim(raw, '"' || chr(39)), 10) END AS name
FROM s
""")
def q_conversation_names(spark, sf_dir):
    raw = (F.when(F.col("role") == "assistant", F.concat(F.lit("名称："), F.col("text")))
           .when(F.col("role") == "system", F.lit('""'))
           .otherwise(F.concat(F.lit('"'), F.col("text"), F.lit('"'))))
    return _conv(spark, sf_dir).select("conv_id", "turn", an.clean_name(raw).alias("name"))


@reg.add("uncached_prompts", """
WITH prompts AS (SELECT conv_id, turn, text AS prompt FROM conversations WHERE role = 'user'),
cache AS (
  SELECT DISTINCT sha256(p.prompt) AS prompt_key
  FROM prompts p JOIN conversations a
    ON a.conv_id = p.conv_id AND a.turn = p.turn + 1 AND a.role = 'assistant')
SELECT conv_id, turn, sha256(prompt) AS prompt_key FROM prompts
WHERE sha256(prompt) NOT IN (SELECT prompt_key FROM cache)
""")
def q_uncached_prompts(spark, sf_dir):
    c = _conv(spark, sf_dir)
    prompts = c.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("prompt"))
    replies = c.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"))
    cache = prompts.join(replies, ["conv_id", "turn"]).select(
        an.prompt_key("prompt").alias("prompt_key")).distinct()
    return an.uncached(prompts, cache).select("conv_id", "turn", "prompt_key")


@reg.add("answers_with_defaults", f"""
WITH items AS (SELECT conv_id, turn FROM conversations WHERE role = 'user'),
ans AS (SELECT conv_id, turn - 1 AS turn, {REC_SQL} AS js FROM conversations WHERE role = 'assistant')
SELECT i.conv_id, i.turn,
  coalesce({_fields_sql('a.js')['functionality']}, 'analysis failed') AS functionality,
  coalesce({_fields_sql('a.js')['complexity']}, 5) AS complexity,
  coalesce({_fields_sql('a.js')['quality']}, 5) AS quality,
  a.js IS NULL AS is_default
FROM items i LEFT JOIN ans a ON a.conv_id = i.conv_id AND a.turn = i.turn
""")
def q_answers_with_defaults(spark, sf_dir):
    c = _conv(spark, sf_dir)
    items = c.where(F.col("role") == "user").select("conv_id", "turn")
    ans = c.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"),
        an.parse_answer_fenced(_record()).alias("parsed"))
    out = an.with_defaults(items.withColumn("k", F.struct("conv_id", "turn")),
                           ans.withColumn("k", F.struct("conv_id", "turn")).drop("conv_id", "turn"),
                           "k", "parsed", an.FENCED_DEFAULT)
    return out.select(F.col("k.conv_id").alias("conv_id"), F.col("k.turn").alias("turn"),
                      "functionality", "complexity", "quality", "is_default")
