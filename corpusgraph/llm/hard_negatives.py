"""Hard-negative mining: integer inner products of anchors with all rows by
Strassen's multiplication, positives and windowed negatives in mergeable heaps.

Components become ``floor(256 x)``.  The anchors (``vec_id`` divisible by
``EVERY``) are a stated query set: groups of about ``GROUP`` anchors meet parts
of about ``PART`` rows in cells, and every cell is a key of its own, so no task
holds more than one group and one part and no row is left out.  First each
label's anchors meet that label's rows and keep the ``POSITIVES`` best; a hot
label has as many cells as its rows need.  Then all anchors, carrying the
scores of their positives, meet all rows, and each (anchor, positive) keeps
the ``NEGATIVES`` best rows of other labels whose score s fulfils
``low * positive <= 100 * s <= 100 * positive``.  A heap is a sorted array of a
few best rows per anchor; heaps of tiles are merged in the task, those of
tasks by a rank over at most a few rows a task.

In a cell the tile of anchors and candidates is multiplied in int64 by
Strassen's recursion: sides are padded with zeros to even sizes, seven
products of half the size are added up exactly, and below ``LEAF`` the product
is taken directly.  Sums wrap modulo 2 ** 64, which leaves results exact, as
they fit by the bound below.

Defined cases: rows with a null label, null vector, or a null or non-finite
component take no part, nor do rows with null ``vec_id`` or with an integer
vector of squared norm 2 ** 55 or more, whose scores need not fit; vectors of
different lengths, empty ones too, are filled up with zeros; repeated rows are
rows of their own, each an anchor if its id is, and never its own positive;
of rows equal in score and id the first written counts first; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusgraph.session import cut_lineage

EVERY, SCALE, LOW = 100, 256, 80
POSITIVES, NEGATIVES = 5, 5
#: Anchors of a group, rows of a part, rows multiplied at once.
GROUP, PART, TILE = 2048, 1024, 1024
#: Side below which a product is taken directly.
LEAF = 16
NONE = np.iinfo(np.int64).min


# ------------------------------------------------------------------ products
def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """``a @ b`` of int64 matrices."""
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= leaf:
        return a @ b
    if m % 2 or k % 2 or n % 2:
        even_a = np.zeros((m + m % 2, k + k % 2), np.int64)
        even_b = np.zeros((k + k % 2, n + n % 2), np.int64)
        even_a[:m, :k], even_b[:k, :n] = a, b
        return strassen(even_a, even_b, leaf)[:m, :n]
    m, k, n = m // 2, k // 2, n // 2
    a11, a12, a21, a22 = a[:m, :k], a[:m, k:], a[m:, :k], a[m:, k:]
    b11, b12, b21, b22 = b[:k, :n], b[:k, n:], b[k:, :n], b[k:, n:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * m, 2 * n), np.int64)
    out[:m, :n], out[:m, n:] = p1 + p4 - p5 + p7, p3 + p5
    out[m:, :n], out[m:, n:] = p2 + p4, p1 - p2 + p3 + p6
    return out


def matrix(column: pa.Array) -> np.ndarray:
    """A column of integer lists as rows, short ones filled with zeros."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out


def wide(x: np.ndarray, k: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, k - x.shape[1]))) if x.shape[1] < k else x


# --------------------------------------------------------------------- heaps
class Heaps:
    """The ``size`` best (score, id, rid) of each of ``n`` queries: high scores
    first, then small ids, then small rids."""

    def __init__(self, n: int, size: int) -> None:
        self.score = np.full((n, size), NONE)
        self.id = np.zeros((n, size), np.int64)
        self.rid = np.zeros((n, size), np.int64)

    def add(self, rows: np.ndarray, scores: np.ndarray, allowed: np.ndarray,
            ids: np.ndarray, rids: np.ndarray) -> None:
        """Offer the candidates (columns, in order of (id, rid)) to some queries."""
        size = self.score.shape[1]
        some = allowed.any(1)
        rows, left = rows[some], np.where(allowed[some], scores[some], NONE)
        if not len(rows):
            return
        n = np.arange(len(rows))
        new = []
        for _ in range(min(size, left.shape[1])):
            best = left.argmax(1)  # the first of equals
            new.append((left[n, best], ids[best], rids[best]))
            left[n, best] = NONE
        score, id_, rid = (np.concatenate([own[rows], np.stack(x, 1)], 1) for own, x in
                           zip((self.score, self.id, self.rid), zip(*new)))
        by = np.lexsort((rid, id_, ~score), axis=1)[:, :size]
        for own, x in ((self.score, score), (self.id, id_), (self.rid, rid)):
            own[rows] = np.take_along_axis(x, by, 1)

    def rows(self) -> tuple[np.ndarray, ...]:
        """``query, score, id, rid`` of what they hold."""
        at, slot = np.nonzero(self.score != NONE)
        return at, self.score[at, slot], self.id[at, slot], self.rid[at, slot]


# -------------------------------------------------------------------- tasks
class Cells:
    """Reads sorted rows ``group, part, kind, rid, vec_id, label, v, wanted``:
    a group's anchors (kind 0) before each of its parts' rows (kind 1)."""

    def __init__(self) -> None:
        self.group = self.part = None
        self.rids = np.zeros(0, np.int64)

    def _anchors(self, b: pa.RecordBatch) -> None:
        rids = b.column("rid").to_numpy(zero_copy_only=False)
        v, wanted = matrix(b.column("v")), self.wanted_of(b)
        labels = b.column("label").to_numpy(zero_copy_only=False)
        if len(self.rids):
            k = max(v.shape[1], self.v.shape[1])
            self.rids = np.concatenate([self.rids, rids])
            self.v = np.concatenate([wide(self.v, k), wide(v, k)])
            self.labels = np.concatenate([self.labels, labels])
            self.wanted = np.concatenate([self.wanted, wanted])
        else:
            self.rids, self.v, self.labels, self.wanted = rids, v, labels, wanted

    def _candidates(self, b: pa.RecordBatch) -> None:
        if self.heaps is None:
            self.heaps = self.start(len(self.rids))
        for at in range(0, b.num_rows, TILE):
            t = b.slice(at, TILE)
            ids, rids, labels = (t.column(c).to_numpy(zero_copy_only=False)
                                 for c in ("vec_id", "rid", "label"))
            by = np.lexsort((rids, ids))
            v = matrix(t.column("v"))[by]
            k = max(v.shape[1], self.v.shape[1])
            scores = strassen(wide(self.v, k), np.ascontiguousarray(wide(v, k).T))
            self.offer(scores, ids[by], rids[by], labels[by])

    def run(self, batches):
        for b in batches:
            group, part, kind = (b.column(c).to_numpy(zero_copy_only=False)
                                 for c in ("group", "part", "kind"))
            new = (np.diff(group) != 0) | (np.diff(part) != 0) | (np.diff(kind) != 0)
            cuts = [0, *(np.flatnonzero(new) + 1).tolist(), b.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                if group[lo] != self.group:
                    yield from self.results()
                    self.group, self.part, self.first = group[lo], part[lo], part[lo]
                    self.rids, self.heaps = np.zeros(0, np.int64), None
                if kind[lo] == 1:
                    if len(self.rids):
                        self._candidates(b.slice(lo, hi - lo))
                elif part[lo] == self.first:  # the group's anchors come again with each part
                    self._anchors(b.slice(lo, hi - lo))
        yield from self.results()

    def results(self):
        if self.group is not None and len(self.rids) and self.heaps is not None:
            yield self.batch()


class Positives(Cells):
    """The best rows of the anchor's own label, itself excluded."""

    SCHEMA = "anchor long, score long, vec_id long, rid long"

    def wanted_of(self, b):
        return np.zeros((b.num_rows, 0), np.int64)

    def start(self, n):
        return Heaps(n, POSITIVES)

    def offer(self, scores, ids, rids, labels):
        allowed = (self.labels[:, None] == labels) & (self.rids[:, None] != rids)
        self.heaps.add(np.arange(len(self.rids)), scores, allowed, ids, rids)

    def batch(self):
        at, score, id_, rid = self.heaps.rows()
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (self.rids[at], score, id_, rid)],
                                          ["anchor", "score", "vec_id", "rid"])


class Negatives(Cells):
    """For each positive of an anchor, the best rows of other labels in its window."""

    SCHEMA = "anchor long, place int, score long, vec_id long, rid long"

    def wanted_of(self, b):
        scores = matrix(b.column("wanted"))
        sizes = b.column("wanted").value_lengths().to_numpy(zero_copy_only=False)
        out = np.full((b.num_rows, POSITIVES), NONE)
        out[:, :scores.shape[1]] = np.where(np.arange(scores.shape[1]) < sizes[:, None], scores, NONE)
        return out

    def start(self, n):
        return [Heaps(n, NEGATIVES) for _ in range(POSITIVES)]

    def offer(self, scores, ids, rids, labels):
        other = self.labels[:, None] != labels
        for place, heaps in enumerate(self.heaps):
            positive = self.wanted[:, place]
            rows = np.flatnonzero(positive != NONE)
            if len(rows):
                s, p = scores[rows], positive[rows, None]
                heaps.add(rows, s, other[rows] & (LOW * p <= 100 * s) & (s <= p), ids, rids)

    def batch(self):
        found = [h.rows() for h in self.heaps]
        place = np.repeat(np.arange(POSITIVES), [len(f[0]) for f in found])
        at, score, id_, rid = (np.concatenate(x) for x in zip(*found))
        return pa.RecordBatch.from_arrays(
            [pa.array(self.rids[at]), pa.array(place, pa.int32()), pa.array(score), pa.array(id_),
             pa.array(rid)], ["anchor", "place", "score", "vec_id", "rid"])


# -------------------------------------------------------------------- spark
def taking_part(embeddings: DataFrame) -> DataFrame:
    """``vec_id, label, v`` with integer components, of the rows that take part."""
    x = F.col("embedding").cast("array<double>")
    rows = (embeddings.select(F.col("vec_id").cast("long").alias("vec_id"),
                              F.col("label").cast("long").alias("label"), x.alias("x"))
            .where("vec_id is not null and label is not null and x is not null")
            .where(~F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
            .where(F.aggregate("x", F.lit(0.0), lambda s, c: s + F.pow(F.floor(c * SCALE).cast("double"), 2))
                   < float(1 << 55)))
    return rows.select(
        "vec_id", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(
            F.col("label")).alias("label"),
        F.transform("x", lambda c: F.floor(c * SCALE)).alias("v"))


def _numbers(rid: str, n) -> Column:
    """Every row's number below n, spread by a hash."""
    return F.pmod(F.xxhash64(F.lit("cell"), rid), F.greatest(n, F.lit(1))).cast("long")


def _all(n) -> Column:
    """0 to n - 1 as rows; none for 0."""
    return F.explode(F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)))


def _meet(anchors: DataFrame, rows: DataFrame, key: str, cells: type[Cells]) -> DataFrame:
    """Anchors and rows ``(rid, vec_id, label, v, wanted, groups, parts)`` that
    share ``key`` meet in cells; ``groups`` and ``parts`` count the key's."""
    cols = ["rid", "vec_id", "label", "v", "wanted"]
    a = anchors.select(F.lit(0).alias("kind"), F.col(key).alias("k"),
                       _numbers("rid", F.col("groups")).alias("g"), "parts", *cols).select(
        "kind", "k", "g", _all(F.col("parts")).alias("part"), *cols)
    r = rows.select(F.lit(1).alias("kind"), F.col(key).alias("k"),
                    _numbers("rid", F.col("parts")).alias("part"), "groups", *cols).select(
        "kind", "k", _all(F.col("groups")).alias("g"), "part", *cols)
    both = a.unionByName(r).select(F.xxhash64("k", "g").alias("group"), "k", "g", "part", "kind", *cols)
    dealt = both.repartition("k", "g", "part").sortWithinPartitions("group", "part", "kind", "rid")
    return dealt.select("group", "part", "kind", *cols).mapInArrow(
        lambda batches: cells().run(batches), cells.SCHEMA)


def _first(found: DataFrame, by: list[str], n: int) -> DataFrame:
    """Merge the heaps: the first n rows of each ``by``."""
    w = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id", "rid")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def mine(embeddings: DataFrame) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score`` of ``embeddings(vec_id, embedding, label)``."""
    rows = cut_lineage(taking_part(embeddings).withColumn("rid", F.monotonically_increasing_id()))
    is_anchor = F.col("vec_id") % EVERY == 0
    size = lambda n, of: F.ceil(n / of).cast("long")

    # the label's rows against its anchors
    labels = rows.groupBy("label").agg(
        size(F.count_if(is_anchor), GROUP).alias("groups"), size(F.count("*"), PART).alias("parts"))
    own = rows.withColumn("wanted", F.array().cast("array<long>")).join(
        labels.where("groups > 0"), "label")
    best = _meet(own.where(is_anchor), own, "label", Positives)
    positives = cut_lineage(_first(best, ["anchor"], POSITIVES).select(
        "anchor", F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"),
        F.col("score").alias("positive_score")))

    # all rows against the anchors that have positives
    wanted = positives.groupBy("anchor").agg(F.transform(
        F.sort_array(F.collect_list(F.struct("place", "positive_score"))),
        lambda x: x["positive_score"]).alias("wanted"))
    n = rows.agg(F.count("*").alias("rows"), F.count_if(is_anchor).alias("anchors")).first()
    grid = {"key": F.lit(0), "groups": F.lit(-(-n["anchors"] // GROUP)).cast("long"),
            "parts": F.lit(-(-n["rows"] // PART)).cast("long")}
    anchors = rows.where(is_anchor).join(wanted, F.col("rid") == F.col("anchor")).drop("anchor")
    others = rows.withColumn("wanted", F.array().cast("array<long>"))
    found = _meet(anchors.withColumns(grid), others.withColumns(grid), "key", Negatives)
    negatives = _first(found, ["anchor", "place"], NEGATIVES).select(
        "anchor", (F.col("place") + 1).alias("place"), "rank", F.col("vec_id").alias("negative_id"),
        F.col("score").alias("negative_score"))
    ids = rows.where(is_anchor).select(F.col("rid").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return negatives.join(positives, ["anchor", "place"]).join(ids, "anchor").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
