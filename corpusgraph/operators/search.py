"""Corpus search (B7–B16), content hashing (A11) and similarity.

A corpus is any table with an id/path column and a text column; every
operator scans whole texts (lines come from ``split`` + ``posexplode``,
which is a narrow, per-row transformation — no shuffle).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from corpusgraph.operators.graph import text_lines
from corpusgraph.session import cut_lineage

# ---- fixed values: the five patterns of the symbol panel (substrings) ----
PATTERN_PANEL = [
    ("classes", "class "),
    ("functions", "def "),
    ("async_functions", "async def"),
    ("main_functions", "if __name__"),
    ("tests", "test_"),
]
LARGE_CORPUS_FILES = 50      # "large" corpus: more than 50 source files
IMPORTANT_FILE_SYMBOLS = 5   # "important" file: more than 5 symbols
# ---------------------------------------------------------------------------


def search_pattern(corpus: DataFrame, pattern: str, id_col: str = "doc_id",
                   text_col: str = "text", path_col: str | None = None,
                   extensions: list[str] | None = None) -> DataFrame:
    """``(id, line_no, line)`` for every line matching ``pattern``
    (Java regex).  ``extensions`` filters by path suffix (the reference
    accepts the argument but ignores it; here it works)."""
    src = corpus
    if extensions and path_col:
        cond = None
        for ext in extensions:
            c = F.col(path_col).endswith(ext)
            cond = c if cond is None else cond | c
        src = src.where(cond)
    return text_lines(src, id_col, text_col).where(F.col("line").rlike(pattern))


def _lines_with(corpus: DataFrame, needle: str, id_col: str, text_col: str) -> DataFrame:
    """Lines that hold ``needle``; texts without it are never split."""
    return (text_lines(corpus.where(F.col(text_col).contains(needle)), id_col, text_col)
            .where(F.col("line").contains(needle)))


def find_definitions(corpus: DataFrame, kind: str, name: str | None = None,
                     id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Lines containing ``def <name>`` / ``class <name>`` (substring)."""
    if kind not in ("def", "class"):
        raise ValueError("kind is 'def' or 'class'")
    needle = f"{kind} {name or ''}"
    return _lines_with(corpus, needle, id_col, text_col)


def list_imports(corpus: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Lines containing ``import``."""
    return _lines_with(corpus, "import", id_col, text_col)


def file_structure(paths: DataFrame, path_col: str = "path") -> DataFrame:
    """One row: files, ``.py`` files, distinct directories (every
    proper prefix of every path)."""
    p = paths.select(F.col(path_col).alias("p"))
    segs = F.split("p", "/")
    prefixes = F.filter(F.sequence(F.lit(1), F.greatest(F.size(segs) - 1, F.lit(1))),
                        lambda i: i < F.size(segs))
    dirs = p.select(F.explode(F.transform(prefixes, lambda i: F.array_join(F.slice(segs, 1, i), "/")))
                    .alias("d"))
    return paths.sparkSession.range(1).select(
        p.agg(F.count_distinct("p")).scalar().alias("files"),
        p.where(F.col("p").endswith(".py")).agg(F.count_distinct("p")).scalar().alias("py_files"),
        dirs.agg(F.count_distinct("d")).scalar().alias("directories"))


def symbol_overview(elements: DataFrame) -> DataFrame:
    """Per file, classes and functions; ``important`` if > 5 symbols."""
    return (elements.groupBy("file_path")
            .agg(F.count_if(F.col("kind") == "class").alias("classes"),
                 F.count_if(F.col("kind") == "function").alias("functions"))
            .withColumn("important", (F.col("classes") + F.col("functions")) > IMPORTANT_FILE_SYMBOLS))


def pattern_panel(corpus: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  patterns=PATTERN_PANEL) -> DataFrame:
    """Per text, occurrences of each panel substring (whole text)."""
    def occurrences(needle: str) -> Column:
        t = F.coalesce(F.col(text_col), F.lit(""))
        return ((F.length(t) - F.length(F.replace(t, F.lit(needle), F.lit("")))) /
                F.lit(len(needle))).cast("long")
    return corpus.select(F.col(id_col).alias(id_col),
                         *[occurrences(p).alias(name) for name, p in patterns])


def find_symbol(elements: DataFrame, name: str, kind: str | None = None,
                file_path: str | None = None) -> DataFrame:
    """Name substring, optional kind and file equality."""
    out = elements.where(F.col("name").contains(name))
    if kind:
        out = out.where(F.col("kind") == kind)
    if file_path:
        out = out.where(F.col("file_path") == file_path)
    return out


def find_references(elements: DataFrame, symbol: str) -> DataFrame:
    """Elements whose calls name ``symbol`` (bare or as last dotted part)."""
    calls = elements.select("element_id", "name", "file_path", F.explode("calls").alias("call"))
    return (calls.where((F.col("call") == symbol) | F.col("call").endswith("." + symbol))
            .select("element_id", "name", "file_path").distinct())


def referencing_lines(corpus: DataFrame, symbol: str, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """``(id, line_no, line)`` of lines that hold ``symbol`` as a whole
    identifier; texts without it are never split."""
    whole = rf"(^|[^A-Za-z0-9_])\Q{symbol}\E([^A-Za-z0-9_]|$)"
    return (text_lines(corpus.where(F.col(text_col).contains(symbol)), id_col, text_col)
            .where(F.col("line").rlike(whole)))


def lookup(corpus: DataFrame, key, id_col: str = "doc_id") -> DataFrame:
    """The row(s) of one file/document."""
    return corpus.where(F.col(id_col) == F.lit(key))


def large_corpus_flag(corpus: DataFrame) -> DataFrame:
    """More than 50 files."""
    n = corpus.agg(F.count("*")).scalar()
    return corpus.sparkSession.range(1).select(n.alias("files"),
                                               (n > LARGE_CORPUS_FILES).alias("is_large"))


# ------------------------------------------------------------------ A11
def content_hashes(corpus: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Sha-256 of every text."""
    return corpus.select(id_col, F.sha2(F.col(text_col), 256).alias("sha256"))


def exact_duplicates(corpus: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of identical texts: ``(sha256, copies, first_id)``.  A partial
    aggregate, so a text copied a million times is no hotter than any other."""
    return (content_hashes(corpus, id_col, text_col).groupBy("sha256")
            .agg(F.count("*").alias("copies"), F.min(id_col).alias("first_id"))
            .where(F.col("copies") > 1))


# ------------------------------------------------------------------ G8
def token_arrays(corpus: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, toks)``: 64-bit hashes of a text's distinct lower-case word
    tokens, one array per text."""
    words = F.array_remove(F.split(F.lower(F.col(text_col)), r"[^\p{L}\p{N}]+"), "")
    return corpus.select(F.col(id_col).alias("id"), F.coalesce(
        F.transform(F.array_distinct(words), lambda w: F.xxhash64(w)),
        F.array().cast("array<bigint>")).alias("toks"))


def token_keys(tokens: DataFrame) -> DataFrame:
    """``(id, key, toks)``: texts of equal token sets have equal keys."""
    t = tokens.select("id", F.array_sort("toks").alias("toks"))
    return t.select("id", F.unhex(F.md5(F.array_join("toks", ",").cast("binary"))).alias("key"), "toks")


def token_classes(keyed: DataFrame) -> DataFrame:
    """``(id, class_id)``: the smallest id of those with the same key."""
    least = keyed.groupBy("key").agg(F.min("id").alias("class_id"))
    return keyed.select("id", "key").join(least, "key").select("id", "class_id")


#: Tokens with a code of two bytes, by frequency (1 MB on the driver).
COMMON_TOKENS = 1 << 16
#: Bits of a set's sketch by the most tokens it serves; the last serves all others too.
SKETCHES = ((64, 112), (128, 224), (256, 448), (512, 896))
LONGS = SKETCHES[-1][0] // 64
#: Odd factor of the min-hashes.
MIX = np.int64(0x1E3779B97F4A7C15)
#: Pairs that are verified together, about.
CELL = 1 << 12


#: Counters, one byte each, that order the tokens without a code (4 MB on the driver).
COUNTERS = 1 << 22


def _frequencies(keyed: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent tokens, rarest first (a token's place is its code),
    and hashed counts, up to 255, of the others found more than once."""
    n = cut_lineage(keyed.select(F.explode("toks").alias("tok")).groupBy("tok")
                    .agg(F.count("*").alias("n")).where("n > 1"))
    top = n.orderBy(F.desc("n"), "tok").limit(COMMON_TOKENS).orderBy("n", "tok").toPandas()
    counters = np.zeros(COUNTERS, np.uint8)
    if len(top) == COMMON_TOKENS:
        rest = (n.where(F.col("n") <= int(top["n"].iloc[0]))
                .groupBy(F.pmod("tok", F.lit(COUNTERS)).cast("int").alias("at"))
                .agg(F.least(F.sum("n"), F.lit(255)).cast("short").alias("n")).toPandas())
        counters[rest["at"].to_numpy()] = rest["n"].to_numpy()
    return top["tok"].to_numpy(np.int64), counters


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Values, their rows, their places within the rows, and the rows' sizes."""
    ends = column.offsets.to_numpy().astype(np.int64)
    sizes = np.diff(ends)
    rows = np.repeat(np.arange(len(column)), sizes)
    flat = column.values.to_numpy()[ends[0]:ends[-1]]
    return flat, rows, np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], sizes), sizes


def _coded(keyed: DataFrame, common: np.ndarray, counters: np.ndarray) -> DataFrame:
    """``(id, rare, common)``: a set's tokens without a code, and the codes of
    the others, both from rare to frequent."""
    by = np.argsort(common)
    known = common[by]

    def lists(values, rows, n):
        ends = np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=n)))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))

    def run(batches):
        for b in batches:
            toks, rows, _, _ = _lists(b.column(1))
            at = np.minimum(np.searchsorted(known, toks), max(len(known) - 1, 0))
            hit = known[at] == toks if len(known) else np.zeros(len(toks), bool)
            codes, own = by[at[hit]] if len(known) else at[hit], rows[hit]
            toks, rare_row = toks[~hit], rows[~hit]
            toks = toks[np.lexsort((toks, counters[toks % COUNTERS], rare_row))]
            codes = (codes[np.lexsort((codes, own))] - (1 << 15)).astype(np.int16)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), lists(toks, rare_row, len(b)), lists(codes, own, len(b))],
                ["id", "rare", "common"])

    return keyed.select(F.col("id").cast("long"), "toks").mapInArrow(
        run, "id long, rare array<bigint>, common array<smallint>")


def _prefixes(classes: DataFrame, common: np.ndarray, num: int, den: int) -> DataFrame:
    """``(tok, id, n, pos, m, s0, s1, ...)`` of the rarest tokens of each class: two
    sets of Jaccard num/den share one.  Any order of the tokens is exact; the
    counts only keep the frequent ones out of the prefixes.  A sketch has
    the parity of the set's tokens at each bit, so two sketches of a width
    differ in no more bits than the sets in tokens; ``m`` is a min-hash, mostly
    equal where sets are close."""
    def run(batches):
        for whole in batches:
            for k in range(0, len(whole), 500):
                b = whole.slice(k, 500)
                rare, rare_row, rare_pos, rares = _lists(b.column(1))
                code, code_row, code_pos, codes = _lists(b.column(2))
                code = code.astype(np.int64) + (1 << 15)
                n, row = rares + codes, np.concatenate((rare_row, code_row))
                width = np.array([w for w, _ in SKETCHES])[
                    np.minimum(np.searchsorted([most for _, most in SKETCHES], n), len(SKETCHES) - 1)]
                toks = np.concatenate((rare, common[code]))
                bit = (toks >> 20) % width[row]
                least = np.full(len(b), np.iinfo(np.int64).max)
                np.minimum.at(least, row, (toks * MIX) & ((1 << 31) - 1))
                odd = np.bincount(row * 64 * LONGS + bit, minlength=len(b) * 64 * LONGS) & 1
                sketch = np.packbits(odd.astype(np.uint8)).view(np.int64).reshape(len(b), LONGS)
                pos = np.concatenate((rare_pos, code_pos + rares[code_row]))
                kept = pos < (n + (-num * n // den) + 1)[row]
                row = row[kept]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c) for c in (np.concatenate((rare, code))[kept], b.column(0).to_numpy()[row],
                                           n[row], pos[kept], least[row], *sketch[row].T)], names)

    names = ["tok", "id", "n", "pos", "m", *(f"s{i}" for i in range(LONGS))]
    return classes.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def _sketches_differ():
    """In how many bits two sketches differ: the wider one is folded, as sizes
    that can be similar are at most one width apart."""
    def level(n):
        return sum((n > most).cast("int") for _, most in SKETCHES[:-1])

    x = [F.col(f"s{i}_a").bitwiseXOR(F.col(f"s{i}_b")) for i in range(LONGS)]
    a, b = level(F.col("n_a")), level(F.col("n_b"))
    out = F.when(a == b, sum(map(F.bit_count, x[1:]), F.bit_count(x[0])))
    for k, (bits, _) in enumerate(SKETCHES[:-1]):
        half = [F.bit_count(x[i].bitwiseXOR(x[i + bits // 64])) for i in range(bits // 64)]
        out = out.when(F.least(a, b) == k, sum(half[1:], half[0]))
    return out


def similar_classes(keyed: DataFrame, num: int, den: int) -> DataFrame:
    """G8 (text): all pairs of different token sets whose Jaccard is at least
    num/den: ``src, dst, common, jaccard``, each set under its smallest id.
    ``keyed`` is a written table of ``token_keys``; it is not read later on.

    Candidates share a token of their prefixes, after which the rest of both
    is long enough if it is the first they share, and their sketches differ in
    no more bits than the sets may in tokens; both are judged within the join,
    so that only pairs that are close are written.  A hot token is one key of
    an equi-join, which AQE splits.  Each candidate is verified, with common
    tokens as codes."""
    least = cut_lineage(keyed.groupBy("key").agg(F.min("id").alias("id")).select("id"))
    common, counters = _frequencies(keyed)
    classes = cut_lineage(_coded(keyed, common, counters).join(least, "id", "left_semi"))
    p = _prefixes(classes, common, num, den)
    a, b = (p.select("tok", *(F.col(c).alias(f"{c}_{s}") for c in p.columns[1:])) for s in "ab")
    both = F.col("n_a") + F.col("n_b")
    rest = F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b"))
    pairs = cut_lineage(
        a.join(b, "tok")
        .where((F.col("id_a") < F.col("id_b")) & (rest * (num + den) >= num * both))
        .where(_sketches_differ() * (num + den) <= (den - num) * both)
        .groupBy(F.col("id_a").alias("src"), F.col("id_b").alias("dst"))
        .agg(F.min("m_a").alias("m_a"), F.min("m_b").alias("m_b")))
    return _verified(pairs, classes, num, den)


def _verified(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """``src, dst, common, jaccard`` of the pairs ``(src, dst, m_a, m_b)`` of at
    least num/den.

    Pairs of the same two min-hashes are counted together, so a set goes once
    to where many of its pairs are, not once a pair.  Two min-hashes with many
    pairs are split by both ends into cells."""
    groups = max(1, pairs.count() // CELL)
    many = pairs.groupBy("m_a", "m_b").agg(F.count("*").alias("k")).where(F.col("k") > CELL)
    parts = F.ceil(F.sqrt(F.coalesce("k", F.lit(1)) / CELL))
    dealt = cut_lineage(pairs.join(many, ["m_a", "m_b"], "left").select("src", "dst", F.pmod(F.xxhash64(
        "m_a", "m_b", *(F.pmod(F.xxhash64(end), parts) for end in ("src", "dst"))), F.lit(groups)).alias("g")))
    needed = dealt.select(F.explode(F.array("src", "dst")).alias("id"), F.col("g").alias("to")).distinct()

    def count(pairs, sets):
        rare, rare_row, _, rares = _lists(sets["rare"].combine_chunks())
        code, code_row, _, codes = _lists(sets["common"].combine_chunks())
        rare = np.unique(rare, return_inverse=True)[1] + COMMON_TOKENS
        row = np.concatenate((rare_row, code_row))
        toks = np.concatenate((rare, code.astype(np.int64) + (1 << 15)))[np.argsort(row, kind="stable")]
        sets_of = np.split(toks, np.cumsum(rares + codes)[:-1])
        ids = pd.DataFrame({"id": sets["id"].to_numpy(), "row": np.arange(len(sets))})
        both = (pairs.select(["src", "dst"]).to_pandas().merge(ids, left_on="src", right_on="id")
                .merge(ids, left_on="dst", right_on="id", suffixes=("_a", "_b")).sort_values("row_a"))
        a, b = both["row_a"].to_numpy(), both["row_b"].to_numpy()
        held, last, common = np.zeros(COMMON_TOKENS + len(rare) + 1, bool), None, np.zeros(len(a), np.int64)
        for k, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
            if x != last:
                if last is not None:
                    held[sets_of[last]] = False
                held[sets_of[x]], last = True, x
            common[k] = np.count_nonzero(held[sets_of[y]])
        jaccard = common / ((rares + codes)[a] + (rares + codes)[b] - common)
        return pa.table({"src": both["src"].to_numpy(), "dst": both["dst"].to_numpy(), "common": common,
                         "jaccard": jaccard}).filter(jaccard >= num / den)

    return (dealt.groupBy("g").cogroup(needed.join(classes, "id").groupBy("to"))
            .applyInArrow(count, "src long, dst long, common long, jaccard double"))


def pair_jaccard(pairs: DataFrame, tokens: DataFrame) -> DataFrame:
    """G8 (text): token-set Jaccard for the given pairs ``(src, dst)``.

    Pairs come from elsewhere (graph edges); no candidate pairs are
    generated here, so nothing is quadratic in a group.  Each pair meets its
    two token arrays by two equi-joins and intersects them in place; a hub's
    array goes to each of its pairs once and is never exploded.
    """
    left, right = (tokens.select(F.col("id").alias(side), F.col("toks").alias(f"t_{side}"))
                   for side in ("src", "dst"))
    both = pairs.select("src", "dst").join(left, "src", "left").join(right, "dst", "left")
    none = F.array().cast("array<bigint>")
    a, b = F.coalesce("t_src", none), F.coalesce("t_dst", none)
    both = both.select("src", "dst", F.size(F.array_intersect(a, b)).cast("long").alias("common"),
                       (F.size(a) + F.size(b)).alias("n"))
    return both.select("src", "dst", "common", F.coalesce(F.try_divide(
        F.col("common").cast("double"), (F.col("n") - F.col("common")).cast("double")),
        F.lit(0.0)).alias("jaccard"))


def centroid_cosine(vectors: DataFrame, id_col: str, vec_col: str, group_col: str) -> DataFrame:
    """G8 (vectors): cosine of every vector to its group's centroid.

    The centroid is an element-wise mean built by ``posexplode`` + grouped
    average (bounded by groups × dimensions), then gathered per group."""
    comps = vectors.select(group_col, F.posexplode(vec_col).alias("pos", "x"))
    cent = (comps.groupBy(group_col, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
            .groupBy(group_col)
            .agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("c"))
            .select(group_col, F.transform("c", lambda s: s["m"]).alias("centroid")))
    v = vectors.join(cent, group_col)
    dot = F.aggregate(F.zip_with(F.col(vec_col), F.col("centroid"), lambda a, b: a * b),
                      F.lit(0.0), lambda acc, x: acc + x)
    na = F.sqrt(F.aggregate(F.transform(F.col(vec_col), lambda a: a * a), F.lit(0.0),
                            lambda acc, x: acc + x))
    nb = F.sqrt(F.aggregate(F.transform(F.col("centroid"), lambda a: a * a), F.lit(0.0),
                            lambda acc, x: acc + x))
    return v.select(id_col, group_col,
                    F.coalesce(F.try_divide(dot, na * nb), F.lit(0.0)).alias("cosine"))
