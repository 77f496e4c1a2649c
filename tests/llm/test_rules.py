import collections
import re

from pyspark.sql import functions as F

from corpusgraph.llm import rules as R

WORD = r"[^\x20\x09-\x0D]+"


def brute(text):
    text = text or ""
    words = re.findall(WORD, text)
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    seen = collections.Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) if seen[tuple(words[i:i + 3])] > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
            len(lines) - len(set(lines)), len(covered))


TEXTS = [None, "", " \n\t", "one", "a b c a b c", "a a a a", "x y z\x0bq\x0cr", "l1\nl1\n\nl1 \nl2",
         "# * $ % & | < >", "é😀 " * 70, "the cat sat on the mat " * 30, "w " * 30_000,
         " ".join(f"word{i}" for i in range(80)), "A!! B!! " * 40,
         " ".join(f"clean{i} text" for i in range(60)) + ".", "dup\n" * 60 + " ".join(f"v{i}" for i in range(90))]


def test_counts_and_base_rule(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(0, None, "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words string, _words int")
    got = R.judge(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        want = brute(TEXTS[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.kept and r.base_failed)


def test_order_is_by_rejections_per_cost_and_never_changes_the_verdict(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    ordered = R.order_rules(docs)
    rate = [share / cost for _, share, cost in ordered]
    assert rate == sorted(rate, reverse=True) and len(ordered) == len(R.RULES)
    counted = R.word_counts(docs)
    one, other = [m[0] for m in ordered], [m[0] for m in reversed(ordered)]
    both = counted.select(R.cascade(one).isNull().alias("a"), R.cascade(other).isNull().alias("b"))
    assert both.where(F.col("a") != F.col("b")).count() == 0


def test_cascade_stops_at_the_first_rule(spark):
    never = R.Rule("never", lambda: F.raise_error(F.lit("evaluated")).cast("boolean"))
    always = R.Rule("always", lambda: F.col("doc_id") >= 0)
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    assert docs.select(R.cascade([always, never]).alias("r")).first().r == "always"


def test_kept_documents_are_the_kept_rows(spark):
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(TEXTS)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    want = sorted(r.doc_id for r in R.judge(docs).where("kept").collect())
    out = R.kept_documents(docs)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == want


def test_empty_table(spark):
    assert R.judge(spark.createDataFrame([], "doc_id long, text string")).count() == 0
