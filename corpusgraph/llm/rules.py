"""Document quality rules as a short-circuit cascade, in DataFrame functions.

A ``Rule`` holds a condition under which a text is rejected.  ``order_rules``
measures every rule on a sample: its cost (time over the sample beyond a scan
of it) and its selectivity (share rejected), and sorts by rejections per unit
of cost.  ``cascade`` puts the conditions in that order into one ``CASE``, whose
later branches are not evaluated for a row that an earlier one has rejected.
A text is kept when no rule rejects it, so the order decides the time spent,
never the verdict.

Words are maximal runs of characters other than the six ASCII white-space
characters.  All counts are exact over whole texts.  Repeated word windows are
found inside a row by sorting one long per window (hash bits above the
position); windows that meet there are compared again by their full 64-bit
hash.

Defined cases: null text counts as empty (no words, rejected); every input row
gives one row, repeated rows included; an empty table gives no rows; other
columns are kept out of the way by working on a projection of the two that
are needed.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from corpusgraph.session import cut_lineage

MIN_WORDS, MAX_REPEAT_SHARE = 50, 0.5
#: Rows of the sample on which rules are measured, in expectation.
SAMPLE_ROWS = 2000
SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"


# ------------------------------------------------------------------ counts
def word_counts(docs: DataFrame) -> DataFrame:
    """Adds ``_text`` (null as empty) and the counts ``n_words, word_chars,
    n_symbols, n_dup_lines, n_lines, n_repeat_words``."""
    def bits(n):
        return F.length(F.bin(n))

    def meets(a, i, value):
        """Whether element i of a sorted array equals a neighbour."""
        here = value(a[i])
        return ((i > 0) & (here == value(F.get(a, i - 1)))) | (
            (i < F.size(a) - 1) & (here == value(F.get(a, i + 1))))

    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select("*", text.alias("_text"))
    d = d.withColumn("_words", F.array_remove(F.split("_text", SPACE + "+"), ""))
    d = d.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: x.rlike(NOT_SPACE)))
    w = F.col("_words")
    # one long per 3-word window: its hash, shifted up over its position
    d = d.withColumn("_hashes", F.when(F.size(w) < 3, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.size(w) - 3),
                    lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))))
    h = F.col("_hashes")
    d = d.withColumn("_shift", bits(F.size(h)))
    shift = F.col("_shift")
    d = d.withColumn("_sorted", F.sort_array(F.transform(
        h, lambda x, i: F.call_function("shiftleft", x, shift).bitwiseOR(i.cast("long")))))
    s = F.col("_sorted")
    near = F.filter(s, lambda x, i: meets(s, i, lambda v: F.call_function("shiftright", v, shift)))
    at = lambda x: x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), shift) - 1)
    d = d.withColumn("_near", F.sort_array(F.transform(near, lambda x: F.struct(
        F.get(h, at(x).cast("int")).alias("h"), at(x).alias("at")))))
    n = F.col("_near")
    d = d.withColumn("_again", F.sort_array(F.transform(
        F.filter(n, lambda x, i: meets(n, i, lambda v: v["h"])), lambda x: x["at"])))
    # positions covered by windows of three, each counted once
    a = F.col("_again")
    covered = F.aggregate(
        F.transform(a, lambda x, i: F.least(F.lit(3).cast("long"), F.coalesce(
            F.get(a, i + 1) - x, F.lit(3).cast("long")))),
        F.lit(0).cast("long"), lambda acc, x: acc + x)
    lines = F.col("_lines")
    return d.select(
        *docs.columns, "_text",
        F.size(w).cast("long").alias("n_words"),
        F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.size(lines).cast("long").alias("n_lines"),
        covered.alias("n_repeat_words"))


def base_failed() -> Column:
    return ((F.col("n_words") < MIN_WORDS)
            | (100 * F.col("n_repeat_words") > int(100 * MAX_REPEAT_SHARE) * F.col("n_words")))


# ------------------------------------------------------------------- rules
@dataclass(frozen=True)
class Rule:
    """``rejects`` builds the condition from columns of ``word_counts``; null
    counts as not rejected."""

    name: str
    rejects: Callable[[], Column]

    def condition(self) -> Column:
        return F.coalesce(self.rejects(), F.lit(False))


RULES = (
    Rule("word_length", lambda: (F.col("word_chars") < 3 * F.col("n_words"))
         | (F.col("word_chars") > 10 * F.col("n_words"))),
    Rule("symbols", lambda: 10 * F.col("n_symbols") > F.col("n_words")),
    Rule("duplicate_lines", lambda: 10 * F.col("n_dup_lines") > 3 * F.col("n_lines")),
    Rule("capitals", lambda: 10 * F.regexp_count("_text", F.lit(r"\p{Lu}"))
         > 3 * F.col("word_chars")),
    Rule("few_letters", lambda: 10 * F.regexp_count("_text", F.lit(r"\p{L}"))
         < 6 * F.col("word_chars")),
    Rule("open_lines", lambda: 100 * F.regexp_count("_text", F.lit(
        r"\.\.\.[\x20\x09\r]*(\n|\z)|…[\x20\x09\r]*(\n|\z)"))
         > 30 * F.col("n_lines")),
)


def order_rules(docs: DataFrame, rules=RULES, sample_rows: int = SAMPLE_ROWS,
                seed: int = 7) -> list[tuple[Rule, float, float]]:
    """Rules by rejections per cost, most first, with each one's selectivity
    and cost in seconds.  ``docs(doc_id, text)`` is sampled by a share that
    gives about ``sample_rows`` rows; the sample is written with its counts,
    so that a rule's time is its own."""
    total = docs.count()
    if not total:
        return [(r, 0.0, 0.0) for r in rules]
    sample = cut_lineage(word_counts(docs.sample(min(1.0, sample_rows / total), seed)))

    def timed(condition):
        """Least of two runs: the first one also compiles code."""
        took = []
        for _ in range(2):
            t = time.perf_counter()
            n, hit = sample.agg(F.count("*"), F.count_if(condition)).first()
            took.append(time.perf_counter() - t)
        return min(took), hit / max(1, n)

    scan = timed(F.length("_text") < 0)[0]
    measured = []
    for rule in rules:
        took, share = timed(rule.condition())
        measured.append((rule, share, max(took - scan, 1e-4)))
    return sorted(measured, key=lambda m: (-m[1] / m[2], m[2], m[0].name))


def cascade(ordered) -> Column:
    """Name of the first rule, in the given order, that rejects; else null."""
    out = None
    for rule in ordered:
        out = F.when(rule.condition(), rule.name) if out is None else out.when(
            rule.condition(), rule.name)
    return F.lit(None).cast("string") if out is None else out


def judge(docs: DataFrame, rules=RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept``, one row per document."""
    return _judged(docs.select("doc_id", "text"), rules, sample_rows).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", _kept().alias("kept"))


def kept_documents(docs: DataFrame, rules=RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows that no rule rejects, in one pass over the texts."""
    return _judged(docs, rules, sample_rows).where(_kept()).select(*docs.columns)


def _kept() -> Column:
    """The row number keeps a filter on this above the counts: pushed below
    them it would evaluate the word arrays again for every array element."""
    return F.col("_rejected").isNull() & (F.col("_row") >= 0)


def _judged(docs: DataFrame, rules, sample_rows: int) -> DataFrame:
    ordered = [m[0] for m in order_rules(docs.select("doc_id", "text"), rules, sample_rows)]
    counted = word_counts(docs).withColumn("base_failed", base_failed())
    return counted.withColumn("_rejected", F.when(F.col("base_failed"), F.lit("base")).otherwise(
        cascade(ordered))).select("*", F.monotonically_increasing_id().alias("_row"))
