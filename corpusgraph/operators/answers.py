"""Parsing model answers, answer caching and failure isolation.

No remote calls: answers are a table ``(id, text)``; parsing is JSON
functions on columns (``try_parse_json`` validates, ``get_json_object``
reads fields), the cache is an anti join on the prompt hash, and failures
become default records through a left join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# ---- fixed values -------------------------------------------------------
LOOSE_FALLBACK_CHARS = 200          # fallback keeps the first 200 characters
LOOSE_FALLBACK = {"complexity": 5, "quality": 7}
FENCED_DEFAULT = {"functionality": "analysis failed", "complexity": 5, "quality": 5}
LIST_FIELDS = ("suggestions", "tags", "dependencies")   # empty lists by default
NAME_PREFIXES = ["社区名称：", "名称：", "生成的社区名称：", "社区："]  # stripped in this order
NAME_QUOTES = "\"'"
NAME_MAX_CHARS = 10
NAME_UNKNOWN = "未知功能"
SCORE_PATTERN = r"0?\.\d+|\d+\.?\d*"
# -------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _fields(js: Column) -> dict[str, Column]:
    return {"functionality": F.get_json_object(js, "$.functionality"),
            "complexity": F.get_json_object(js, "$.complexity").try_cast("int"),
            "quality": F.get_json_object(js, "$.quality").try_cast("int")}


def _lists(js: Column, ok: Column) -> list[Column]:
    """The list fields of a valid answer; absent ones are empty."""
    parsed = F.from_json(js, ", ".join(f"{name} array<string>" for name in LIST_FIELDS))
    return [F.coalesce(F.when(ok, parsed[name]), F.array().cast("array<string>")).alias(name)
            for name in LIST_FIELDS]


def parse_answer_loose(text) -> Column:
    """G1: JSON between the first ``{`` and the last ``}``; otherwise (or if
    invalid) the first 200 characters (+ ``...``) with complexity 5,
    quality 7.  Returns a struct with ``is_default``."""
    t = _c(text)
    start = F.instr(t, "{")
    end = F.length(t) - F.instr(F.reverse(t), "}") + 1
    js = F.when((start > 0) & (F.instr(t, "}") > 0) & (end >= start),
                F.substring(t, start, end - start + 1))
    ok = F.coalesce(F.try_parse_json(js).isNotNull(), F.lit(False))
    f = _fields(js)
    fallback_text = F.when(F.length(t) > LOOSE_FALLBACK_CHARS,
                           F.concat(F.left(t, F.lit(LOOSE_FALLBACK_CHARS)), F.lit("..."))).otherwise(t)
    return F.struct(
        F.when(ok, f["functionality"]).otherwise(fallback_text).alias("functionality"),
        F.when(ok, f["complexity"]).otherwise(F.lit(LOOSE_FALLBACK["complexity"])).alias("complexity"),
        F.when(ok, f["quality"]).otherwise(F.lit(LOOSE_FALLBACK["quality"])).alias("quality"),
        *_lists(js, ok),
        (~ok).alias("is_default"))


def _between(t: Column, opener: str) -> Column:
    """Text after the first ``opener`` up to the next fence, trimmed."""
    after = F.substring(t, F.instr(t, opener) + len(opener), 1 << 30)
    body = F.when(F.instr(after, "```") > 0, F.substring(after, 1, F.instr(after, "```") - 1)) \
        .otherwise(F.substring(after, 1, F.length(after) - 1))
    return F.trim(body)


def parse_answer_fenced(text) -> Column:
    """Whole text when it starts with ``{``; else a json fence; else any
    fence; else the default record.  Invalid JSON → default."""
    t = _c(text)
    stripped = F.trim(t)
    js = (F.when(stripped.startswith("{"), stripped)
          .when(t.contains("```json"), _between(t, "```json"))
          .when(t.contains("```"), _between(t, "```")))
    ok = F.coalesce(F.try_parse_json(js).isNotNull(), F.lit(False))
    f = _fields(js)
    return F.struct(
        F.when(ok, f["functionality"]).otherwise(F.lit(FENCED_DEFAULT["functionality"])).alias("functionality"),
        F.when(ok, f["complexity"]).otherwise(F.lit(FENCED_DEFAULT["complexity"])).alias("complexity"),
        F.when(ok, f["quality"]).otherwise(F.lit(FENCED_DEFAULT["quality"])).alias("quality"),
        *_lists(js, ok),
        (~ok).alias("is_default"))


def parse_score(text) -> Column:
    """First number, clamped to [0, 1]; none → 0.0."""
    first = F.regexp_extract(_c(text), SCORE_PATTERN, 0)
    v = F.when(first != "", first.try_cast("double"))
    # least/greatest skip nulls: clamp only a present number
    return F.coalesce(F.when(v.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))), F.lit(0.0))


def clean_name(text) -> Column:
    """Trim, strip known prefixes in order, strip quotes, at most 10
    characters, empty → unknown."""
    n = F.trim(F.coalesce(_c(text), F.lit("")))
    for p in NAME_PREFIXES:
        n = F.when(n.startswith(p), F.trim(F.substring(n, len(p) + 1, 1 << 30))).otherwise(n)
    n = F.btrim(n, F.lit(NAME_QUOTES))
    n = F.left(n, F.lit(NAME_MAX_CHARS))
    return F.when(n == "", F.lit(NAME_UNKNOWN)).otherwise(n)


def prompt_key(prompt) -> Column:
    """Cache key of a request = sha-256 of its text."""
    return F.sha2(_c(prompt), 256)


def uncached(requests: DataFrame, cache: DataFrame, prompt_col: str = "prompt") -> DataFrame:
    """Requests whose prompt has no cached answer (anti join on the key)."""
    keyed = requests.withColumn("prompt_key", prompt_key(prompt_col))
    return keyed.join(cache.select("prompt_key"), "prompt_key", "left_anti")


def with_defaults(items: DataFrame, answers: DataFrame, key: str, parsed: str,
                  default: dict) -> DataFrame:
    """Every item gets its parsed answer, or the default record when the
    answer is missing or failed; ``is_default`` says which."""
    j = items.join(answers, key, "left")
    cols = [F.coalesce(F.col(f"{parsed}.{k}"), F.lit(v)).alias(k) for k, v in default.items()]
    miss = F.col(parsed).isNull() | F.coalesce(F.col(f"{parsed}.is_default"), F.lit(True))
    return j.select(key, *cols, miss.alias("is_default"))


# ---- fixed values: default refactoring record --------------------------
REFACTOR_DEFAULT = {"issues": ["not_analysed"], "suggestions": ["check_configuration"],
                    "improvements": ["no_connection"], "priority": "medium"}
# -------------------------------------------------------------------------


def parse_refactoring(text) -> Column:
    """Like G1 (first ``{`` to last ``}``) with fields issues,
    suggestions, improvements (string lists) and priority; anything else →
    the default record."""
    t = _c(text)
    start = F.instr(t, "{")
    end = F.length(t) - F.instr(F.reverse(t), "}") + 1
    js = F.when((start > 0) & (F.instr(t, "}") > 0) & (end >= start),
                F.substring(t, start, end - start + 1))
    ok = F.coalesce(F.try_parse_json(js).isNotNull(), F.lit(False))
    parsed = F.from_json(js, "issues array<string>, suggestions array<string>, "
                             "improvements array<string>, priority string")

    def lit_list(v):
        return F.array(*[F.lit(x) for x in v])
    return F.struct(
        F.when(ok, parsed["issues"]).otherwise(lit_list(REFACTOR_DEFAULT["issues"])).alias("issues"),
        F.when(ok, parsed["suggestions"]).otherwise(lit_list(REFACTOR_DEFAULT["suggestions"])).alias("suggestions"),
        F.when(ok, parsed["improvements"]).otherwise(lit_list(REFACTOR_DEFAULT["improvements"]))
        .alias("improvements"),
        F.when(ok, parsed["priority"]).otherwise(F.lit(REFACTOR_DEFAULT["priority"])).alias("priority"),
        (~ok).alias("is_default"))
