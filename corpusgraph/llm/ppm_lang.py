"""Language identification by prediction by partial matching.

Every language has a context tree over bytes: the counts of all strings of 1
to ``ORDER + 1`` bytes of its training texts.  The code length of a byte is
that of PPM with escape method C and full exclusion.  Coding starts in the
longest context that the tree holds; a byte seen there costs
``log2((total + distinct) / count)``; else an escape is paid,
``log2((total + distinct) / distinct)``, and coding goes on in the next
shorter context without the bytes already excluded; below order 0 the bytes
not seen at all share the rest evenly.  Statistics are frozen, so the cost of
a byte depends on its last ``ORDER`` bytes alone, and what an exclusion leaves
of a shorter context is a number of the longer one, computed once.

A text's length under a language is the sum over all its bytes plus
``-log2`` of the language's share of the training documents.  Costs are whole
multiples of 2 ** -16 bit, so sums are exact and do not depend on how rows are
batched.  The shortest code wins, ties go to the name first in order; the
score is the winner's posterior, ``2 ** -length`` over the sum of all.

Fitting draws rows by a hash of the id, about ``MAX_BYTES`` of text a language
and ``MAX_TOTAL_BYTES`` over all, but at least about ``MIN_ROWS`` rows a
language, and counts their strings by Spark; strings of four
bytes and more need ``MIN_COUNT`` sightings.  The shares are counted over all
training documents.  Scoring is one map-only pass over whole texts, read from
the Arrow buffers in blocks of ``BLOCK`` bytes; a worker keeps the costs of
windows it has met in a table of fixed size.

Defined cases: null text, and text without a letter (Unicode category L),
gives ``und`` with score 0, as does every text when nothing can be learned;
rows with null id are scored, marked not held out, and never trained on; rows
with null text or null language teach nothing; repeated rows are scored once
each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

ORDER = 4
MAX_BYTES, MAX_TOTAL_BYTES = 2 << 20, 8 << 20
MIN_COUNT, MIN_ROWS = 2, 16
FOLDS = 5
#: Bytes scored at once, and slots times languages of a worker's table.
BLOCK, TABLE_CELLS = 1 << 19, 1 << 22
UNIT = 1 << 16


# ------------------------------------------------------------------ strings
# A string of n bytes is the number 1 followed by its bytes: 2^(8n) + bytes.
def suffix(codes: np.ndarray, n: int) -> np.ndarray:
    """The last ``n`` bytes of strings of at least n bytes."""
    return (codes & ((1 << 8 * n) - 1)) | (1 << 8 * n)


def windows(data: np.ndarray, history: np.ndarray, order: int = ORDER) -> np.ndarray:
    """For each byte, the string of its last ``min(history, order)`` bytes and
    itself; ``history`` counts the bytes before it in its text.  ``data``
    starts with ``order`` bytes that are context only."""
    n = len(data) - order
    codes = data[order:].astype(np.int64)
    for k in range(1, order + 1):
        codes |= data[order - k:order - k + n].astype(np.int64) << 8 * k
    codes |= 1 << 8 * (order + 1)
    short = np.flatnonzero(history < order)
    for i in short:
        codes[i] = suffix(codes[i], int(history[i]) + 1)
    return codes


def lengths(codes: np.ndarray) -> np.ndarray:
    """Bytes of each string."""
    return (np.frexp(codes.astype(float))[1] - 1) // 8


# -------------------------------------------------------------------- model
@dataclass
class Tree:
    """Context tree of one language.  ``strings`` are sorted with ``log_count``;
    ``contexts`` are sorted, with the logarithm of the denominator and the
    escape's cost in the context itself (``top``, ``top_escape``) and in the
    next shorter one without this one's bytes (``rest``, ``rest_escape``)."""

    strings: np.ndarray
    log_count: np.ndarray
    contexts: np.ndarray
    top: np.ndarray
    top_escape: np.ndarray
    rest: np.ndarray
    rest_escape: np.ndarray
    unseen: float


def _find(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Index of each x in the sorted table, or -1."""
    if not len(table):
        return np.full(len(x), -1)
    at = np.minimum(np.searchsorted(table, x), len(table) - 1)
    return np.where(table[at] == x, at, -1)


def _log(x: np.ndarray) -> np.ndarray:
    return np.log2(np.maximum(x, 1))


def grow(codes: np.ndarray, counts: np.ndarray) -> Tree:
    """The tree of string counts (all suffixes of a string are counted too)."""
    by = np.argsort(codes)
    codes, counts = codes[by].astype(np.int64), counts[by].astype(np.int64)
    parents = codes >> 8
    contexts, at = np.unique(parents, return_inverse=True)
    total = np.bincount(at, counts, len(contexts)).astype(np.int64)
    distinct = np.bincount(at, minlength=len(contexts))
    # what a context's bytes count in the next shorter context
    n = lengths(codes)
    below = np.zeros(len(codes), np.int64)
    for k in range(2, int(n.max(initial=0)) + 1):
        own = n == k
        below[own] = counts[_find(codes, suffix(codes[own], k - 1))]
    gone = np.bincount(at, below, len(contexts)).astype(np.int64)
    size = lengths(contexts)
    shorter = np.zeros(len(contexts), np.int64)
    for k in range(1, int(size.max(initial=0)) + 1):
        own = size == k
        shorter[own] = _find(contexts, suffix(contexts[own], k - 1))
    fresh = distinct[shorter] - distinct
    rest = total[shorter] - gone + fresh
    root = int(distinct[0]) if len(contexts) else 0
    return Tree(codes, _log(counts), contexts, _log(total + distinct),
                _log(total + distinct) - _log(distinct), _log(rest), _log(rest) - _log(fresh),
                float(np.log2(max(1, 256 - root))))


def costs(tree: Tree, codes: np.ndarray) -> np.ndarray:
    """Code length in bits of the last byte of each string, given the others."""
    n, out = lengths(codes), np.zeros(len(codes))
    if not len(tree.strings):
        return out + tree.unseen
    for size in np.unique(n):
        own = np.flatnonzero(n == size)
        bits, longer = np.zeros(len(own)), np.full(len(own), -1)
        left = np.arange(len(own))
        for k in range(int(size), 0, -1):
            x = suffix(codes[own[left]], k)
            ctx, hit = _find(tree.contexts, x >> 8), _find(tree.strings, x)
            came = longer[left]
            top = came < 0
            denominator = np.where(top, tree.top[ctx], tree.rest[came])
            escape = np.where(top, tree.top_escape[ctx], tree.rest_escape[came])
            found, known = hit >= 0, ctx >= 0
            bits[left[found]] += (denominator - tree.log_count[hit])[found]
            missed = ~found & known
            bits[left[missed]] += escape[missed]
            longer[left[missed]] = ctx[missed]
            left = left[~found]
        bits[left] += tree.unseen
        out[own] = bits
    return out


@dataclass
class Model:
    """Names in order, ``-log2`` of their shares, and their trees."""

    names: list[str]
    share_bits: np.ndarray
    trees: list[Tree]

    def units(self, codes: np.ndarray) -> np.ndarray:
        """Cost of each string under each language, in units."""
        return np.stack([np.rint(costs(t, codes) * UNIT) for t in self.trees], 1).astype(np.int32)


class Scorer:
    """Sums costs over texts; windows met before are looked up."""

    def __init__(self, model: Model) -> None:
        self.model = model
        bits = max(8, int(np.log2(TABLE_CELLS // max(1, len(model.names)))))
        self.shift = np.uint64(64 - bits)
        self.keys = np.zeros(1 << bits, np.int64)
        self.units = np.zeros((1 << bits, len(model.names)), np.int32)

    def _costs(self, codes: np.ndarray) -> np.ndarray:
        slot = ((codes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)
        out = self.units[slot]
        cold = np.flatnonzero(self.keys[slot] != codes)
        if len(cold):
            new, at = np.unique(codes[cold], return_inverse=True)
            units = self.model.units(new)
            out[cold] = units[at]
            first = np.zeros(len(new), np.int64)
            first[at] = slot[cold]
            # several new windows of one slot: the last one written stays whole
            self.keys[first] = new
            kept = self.keys[first] == new
            self.units[first[kept]] = units[kept]
        return out

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Units of each text under each language; text i is
        ``data[offsets[i]:offsets[i + 1]]``."""
        total = np.zeros((len(offsets) - 1, len(self.model.names)), np.int64)
        start, end = int(offsets[0]), int(offsets[-1])
        for lo in range(start, end, BLOCK):
            hi = min(end, lo + BLOCK)
            block = np.zeros(hi - lo + ORDER, np.uint8)
            take = min(ORDER, lo - start)
            block[ORDER - take:] = data[lo - take:hi]
            first = np.searchsorted(offsets, lo, "right") - 1
            last = np.searchsorted(offsets, hi, "left")
            starts = np.maximum(offsets[first:last], lo) - lo
            sizes = np.diff(np.append(starts, hi - lo))
            history = np.arange(lo, hi) - np.repeat(offsets[first:last], sizes)
            units = self._costs(windows(block, history))
            full = sizes > 0
            total[first:last][full] += np.add.reduceat(units, starts[full], axis=0, dtype=np.int64)
        return total

    def choose(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
        bits = self.texts(data, offsets) / UNIT + self.model.share_bits
        best = bits.argmin(1)
        gap = bits - bits.min(1, keepdims=True)
        return [self.model.names[i] for i in best], 1 / np.exp2(-np.minimum(gap, 1000)).sum(1)


# -------------------------------------------------------------------- spark
def fold_of(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), at


def _counts(sample: DataFrame) -> DataFrame:
    """``lang, code, n`` of the strings in ``sample(lang, text)``."""
    def run(batches):
        for b in batches:
            langs = np.array(b.column(0).to_pylist(), object)
            for lang in sorted(set(langs)):
                own = b.column(1).filter(pa.array(langs == lang))
                data, at = _buffers(own)
                for first in range(0, len(own), 512):
                    cut = at[first:first + 513]
                    history = np.arange(cut[0], cut[-1]) - np.repeat(cut[:-1], np.diff(cut))
                    pad = np.concatenate([np.zeros(ORDER, np.uint8), data[cut[0]:cut[-1]]])
                    full = windows(pad, history)
                    for k in range(1, ORDER + 2):
                        codes, n = np.unique(suffix(full[history >= k - 1], k), return_counts=True)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([lang] * len(codes), pa.string()), pa.array(codes, pa.int64()),
                             pa.array(n, pa.int64())], ["lang", "code", "n"])

    return (sample.select("lang", "text").mapInArrow(run, "lang string, code long, n long")
            .groupBy("lang", "code").agg(F.sum("n").alias("n")))


def train(docs: DataFrame, max_bytes: int = MAX_BYTES,
          max_total_bytes: int = MAX_TOTAL_BYTES) -> Model | None:
    """Trees from ``documents(doc_id, text, lang)`` outside the held-out fold;
    None if there is nothing to learn."""
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()
                      & (fold_of(F.col("doc_id")) != 0)).select(
        F.col("doc_id").cast("string").alias("doc_id"), "text",
        F.col("lang").cast("string").alias("lang"))
    seen = {r["lang"]: r for r in rows.groupBy("lang").agg(
        F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size")).collect()}
    names = sorted(seen)
    if not names:
        return None
    bound = min(max_bytes, max_total_bytes // len(names))
    limit = F.create_map(*[F.lit(x) for n in names for x in (
        n, int((1 << 30) * min(1.0, max(bound / max(1, seen[n]["size"]),
                                        MIN_ROWS / seen[n]["n"]))))])
    sample = rows.where(F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 30))
                        < limit[F.col("lang")])
    # the code of a string of four bytes begins at 2 ** 32
    kept = _counts(sample).where((F.col("code") < 1 << 32) | (F.col("n") >= MIN_COUNT)).toPandas()
    trees = []
    for name in names:
        own = kept[kept["lang"] == name]
        trees.append(grow(own["code"].to_numpy(np.int64), own["n"].to_numpy(np.int64)))
    n = np.array([seen[name]["n"] for name in names], float)
    return Model(names, -np.log2(n / n.sum()), trees)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``, one row per document."""
    held: list[Scorer] = []

    def run(batches):
        if model is not None and not held:
            held.append(Scorer(model))
        for b in batches:
            for first in range(0, b.num_rows, 4096):
                part = b.slice(first, 4096)
                names, score = ["und"] * part.num_rows, np.zeros(part.num_rows)
                if model is not None:
                    names, score = held[0].choose(*_buffers(part.column(1)))
                letters = part.column(2).to_numpy(zero_copy_only=False).astype(bool)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.where(letters, names, "und"), pa.string()),
                     pa.array(np.where(letters, score, 0.0))], ["doc_id", "lang_pred", "score"])

    scored = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text",
        F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters")).mapInArrow(
        run, "doc_id long, lang_pred string, score double")
    return scored.select("doc_id", F.coalesce(fold_of(F.col("doc_id")) == 0, F.lit(False)).alias(
        "held_out"), "lang_pred", "score")


def identify(docs: DataFrame) -> DataFrame:
    """Train and predict in one call."""
    return predict(docs, train(docs))
