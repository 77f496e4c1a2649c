"""Near-duplicate embeddings: sign hashing, exact cosines, components.

Vectors with equal components are one class with a multiplicity.  Random
hyperplanes through the origin give each class, in each of ``L`` tables, a
key of ``k`` signs; classes that share a key in some table are compared by
cosine in double precision.  With angle a between two vectors a sign agrees
with probability 1 - a / pi, so a pair at the threshold is missed by all
tables with probability (1 - (1 - a / pi) ** k) ** L.  ``k`` follows the
number of classes, so that a key is shared by about ``KEY_ROWS`` of them when
they are spread evenly, and ``L`` follows from ``k`` and the recall asked for.

A pair that meets in several tables counts in the first one only: each row
carries its keys of all tables, so no pair is ever sent on to be made
distinct.  A task returns, per class, the number of links it counted and one
edge of a spanning forest.  Keys that more than ``BUCKET_ROWS`` classes share
are dealt out as pairs of hashed parts.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components link with nothing and are their own component; vectors of different length link with
nothing; every input row gives one row, and rows that repeat a vec_id count
as vectors of their own; ``kept`` is true for every row whose id is its
component's; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpusgraph.llm.simhash import _hook
from corpusgraph.operators.components import star_forest
from corpusgraph.session import cut_lineage

THRESHOLD, RECALL, SEED = 0.95, 0.9999, 11
KEY_ROWS, BUCKET_ROWS, MAX_BITS = 128, 2048, 40
#: Rows of a bucket that are multiplied with the others at once.
STRIPE = 512


def table_shape(classes: int, threshold: float = THRESHOLD, recall: float = RECALL,
                key_rows: int = KEY_ROWS) -> tuple[int, int]:
    """Signs per key and number of tables."""
    k = min(MAX_BITS, max(1, round(math.log2(max(2.0, classes / key_rows)))))
    agree = (1 - math.acos(threshold) / math.pi) ** k
    return k, max(1, math.ceil(math.log(1 - recall) / math.log(1 - agree)))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _matrix(column, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)


def _keys(classes: DataFrame, k: int, tables: int, seed: int) -> DataFrame:
    """Adds ``keys``, one long per table."""
    weight = 1 << np.arange(k, dtype=np.int64)

    def run(batches):
        for b in batches:
            dims = b.column("dim").to_numpy()
            keys = np.zeros((b.num_rows, tables), np.int64)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                planes = np.random.default_rng([seed, dim]).normal(size=(dim, tables * k))
                x = _unit(_matrix(b.column("embedding").take(pa.array(at)), dim))
                for s in range(0, len(at), 4096):
                    sign = (x[s:s + 4096] @ planes > 0).reshape(-1, tables, k)
                    keys[at[s:s + 4096]] = sign @ weight
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(list(keys), pa.list_(pa.int64()))], [*b.schema.names, "keys"])

    kind = dict(classes.dtypes)
    return classes.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in kind.items())
                              + ", keys array<long>")


def _pairs(x: np.ndarray, y: np.ndarray | None, threshold: float):
    """Index pairs with cosine at least the threshold, in stripes: of rows of
    ``x`` (unit vectors) with later ones, or with rows of ``y``."""
    for s in range(0, len(x), STRIPE):
        other = x[s:] if y is None else y
        dots = x[s:s + STRIPE] @ other.T
        i, j = np.nonzero(dots >= threshold - 1e-9)
        if y is None:
            later = j > i
            i, j = i[later], j[later]
        if len(i):
            edge = np.flatnonzero(np.abs(dots[i, j] - threshold) <= 1e-9)
            if len(edge):  # the product's rounding decides nothing
                exact = np.array([math.fsum(a * b) for a, b in
                                  zip(x[s + i[edge]], other[j[edge]])])
                drop = edge[exact < threshold]
                i, j = np.delete(i, drop), np.delete(j, drop)
            yield s + i, j + (s if y is None else 0)


def _compare(t: int, part: np.ndarray, i_part: int, j_part: int, x: np.ndarray,
             keys: np.ndarray, n: np.ndarray, threshold: float):
    """Links counted per row, and each row's forest root, of one bucket."""
    a = np.flatnonzero(part == i_part)
    b = a if i_part == j_part else np.flatnonzero(part == j_part)
    links, root = np.zeros(len(x), np.int64), np.arange(len(x))
    for i, j in _pairs(x[a], None if b is a else x[b], threshold):
        i, j = a[i], b[j]
        for at in range(0, len(i), 1 << 18):
            p, q = i[at:at + (1 << 18)], j[at:at + (1 << 18)]
            if t:
                first = ~(keys[p, :t] == keys[q, :t]).any(1)
                p, q = p[first], q[first]
            links += np.bincount(p, n[q], len(x)).astype(np.int64)
            links += np.bincount(q, n[p], len(x)).astype(np.int64)
            _hook(root, p, q)
    return links, root


def _bucketed(keyed: DataFrame, bucket_rows: int) -> DataFrame:
    rows = keyed.select("*", F.posexplode("keys").alias("t", "key"))
    large = (rows.groupBy("dim", "t", "key").agg(F.count("*").alias("rows"))
             .where(F.col("rows") > bucket_rows)
             .select("dim", "t", "key", F.ceil(F.col("rows") / bucket_rows).cast("int").alias("parts")))
    part = F.coalesce(F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int"), F.lit(0))
    others = F.transform(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1),
                         lambda o: F.struct(F.least(F.col("part"), o).alias("i"),
                                            F.greatest(F.col("part"), o).alias("j")))
    return (rows.join(large, ["dim", "t", "key"], "left").withColumn("part", part)
            .withColumn("p", F.explode(others))
            .select("dim", "t", "key", "p.i", "p.j", "part", "cid", "n", "keys", "embedding"))


def _links(keyed: DataFrame, threshold: float, bucket_rows: int) -> DataFrame:
    """``cid, links, root``: links counted in each bucket and forest edges."""
    group = ["dim", "t", "key", "i", "j"]

    def run(batches):
        held = None
        for b in batches:
            held = b if held is None else pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
            cols = [held.column(c).to_numpy() for c in group]
            change = np.zeros(held.num_rows - 1, bool)
            for c in cols:
                change |= c[1:] != c[:-1]
            cuts = np.concatenate([[0], np.flatnonzero(change) + 1])
            for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if e - s > 1:
                    yield from one(held.slice(s, e - s))
            held = held.slice(int(cuts[-1]))
        if held is not None and held.num_rows > 1:
            yield from one(held)

    def one(b):
        dim, t, _, i, j = (b.column(c)[0].as_py() for c in group)
        cid, n = b.column("cid").to_numpy(), b.column("n").to_numpy()
        keys = b.column("keys").flatten().to_numpy().reshape(len(cid), -1)
        links, root = _compare(t, b.column("part").to_numpy(), i, j,
                               _unit(_matrix(b.column("embedding"), dim)), keys, n, threshold)
        found = np.flatnonzero(links)
        if len(found):
            yield pa.RecordBatch.from_arrays(
                [pa.array(c) for c in (cid[found], links[found], cid[root[found]])],
                ["cid", "links", "root"])

    return (_bucketed(keyed, bucket_rows).repartition(*group).sortWithinPartitions(*group)
            .mapInArrow(run, "cid long, links long, root long"))


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL,
                 bucket_rows: int = BUCKET_ROWS, seed: int = SEED) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of ``vectors(vec_id,
    embedding)``, one row per vector."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    good, bad = rows.where(usable), rows.where(~usable)
    classes = cut_lineage(
        good.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
        .select(F.monotonically_increasing_id().alias("cid"), "embedding",
                F.size("embedding").alias("dim"), "rep", "n"))
    k, tables = table_shape(classes.count(), threshold, recall)
    keyed = _keys(classes.select("cid", "embedding", "dim", "n"), k, tables, seed)
    found = cut_lineage(_links(keyed, threshold, bucket_rows))
    stars = star_forest(found.select(F.col("cid").alias("src"), F.col("root").alias("dst")))
    counted = found.groupBy("cid").agg(F.sum("links").alias("links"))
    placed = (classes.select("cid", "rep", "n").join(counted, "cid", "left")
              .join(stars.select(F.col("hi").alias("cid"), "lo"), "cid", "left")
              .select("cid", "rep", F.coalesce("lo", "cid").alias("root"),
                      (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    lowest = placed.groupBy("root").agg(F.min("rep").alias("component_id"))
    of_class = placed.join(lowest, "root").select("cid", "n_links", "component_id")
    linked = (good.join(classes.select("cid", "embedding"), "embedding").join(of_class, "cid")
              .select("vec_id", "n_links", "component_id"))
    alone = bad.select("vec_id", F.lit(0).cast("long").alias("n_links"),
                       F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).select(
        "*", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
