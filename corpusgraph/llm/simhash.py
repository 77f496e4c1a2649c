"""SimHash near-duplicates with bit-sliced comparison.

Fingerprints: words of the lower-cased text, shingles of ``shingle`` words
(repeats count), XXH64 of each shingle, and a 64-bit majority vote.  Two
documents are linked when their fingerprints differ in at most ``radius``
bits; components are the groups.

Search.  Equal fingerprints are collapsed first (partial aggregate), so copies
cost nothing further.  The 64 bits are cut into ``blocks`` ranges; two
fingerprints within ``radius`` agree on at least ``blocks - radius`` of them,
so each fingerprint is dealt to one bucket for every choice of that many
ranges, and every link meets in some bucket: the search is exact.  With six
ranges and radius two a bucket fixes at least 42 bits, so at most 2**22
distinct fingerprints can share one; buckets over ``bucket_rows`` are dealt
out as pairs of hashed parts, so none is compared in one task.

Comparison.  A bucket's fingerprints are stored vertically: 64 members make
one block of 64 bit planes.  One member is compared with all 64 of a block at
once: planes differing from it are added to carry-save counters two planes at
a time, and the block is abandoned as soon as all its members exceed the
radius.  A task emits a spanning forest of the links it finds, never all
pairs.  Forests from all buckets are joined by distributed connected
components.

Defined cases: null text counts as empty; a text without words has
fingerprint zero and is linked like any other; fewer words than a shingle give
one shingle; every input row gives one row, repeated rows included; extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpusgraph.llm.batches import values
from corpusgraph.operators.components import star_forest
from corpusgraph.session import cut_lineage

SHINGLE, RADIUS, SEED = 3, 2, 42
BLOCKS = 6
BUCKET_ROWS = 4096
#: Size up to which ids are broadcast in place of a shuffle of the texts.
BROADCAST_BYTES = 48 << 20
#: Rows that a task compares at once, and member-block comparisons per step.
CHUNK_ROWS, STEP = 65_536, 1 << 19


# ------------------------------------------------------------- fingerprints
def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned 64-bit fingerprint.  ``bytes.split`` cuts at exactly the six
    ASCII white-space bytes and ``bytes.lower`` changes A-Z only."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(joined, seed)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - shingle + 1
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in
                          zip(starts[:n].tolist(), ends[shingle - 1:].tolist())), "<u8", n)
    votes = np.zeros(64, np.int64)
    for at in range(0, n, 65_536):
        part = hashes[at:at + 65_536]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1,
                               bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``doc_id, fp`` (the fingerprint's bits as a signed long)."""
    def run(batches):
        for b in batches:
            fps = np.fromiter((fingerprint(t, shingle, seed) for t in values(b, 1)),
                              np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))],
                                             ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, fp long")


# --------------------------------------------------------------- comparison
def _planes(members: np.ndarray) -> np.ndarray:
    """``(blocks, 64)`` bit planes of fingerprints in blocks of 64: plane p of
    a block holds bit p of all its members."""
    bits = np.unpackbits(members.view(np.uint8).reshape(-1, 64, 8), axis=2, bitorder="little")
    return np.packbits(bits.transpose(0, 2, 1), axis=2, bitorder="little").view("<u8")[:, :, 0]


def _over(levels: list[np.ndarray], spilled: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose count (binary, one bit per level) exceeds the radius."""
    more, equal = np.zeros_like(spilled), ~np.zeros_like(spilled)
    for k in reversed(range(len(levels))):
        if radius >> k & 1:
            equal &= levels[k]
        else:
            more |= equal & levels[k]
            equal &= ~levels[k]
    return more | spilled


def within_radius(members: np.ndarray, planes: np.ndarray, valid: np.ndarray,
                  probe: np.ndarray, block: np.ndarray, radius: int):
    """For each job (probe member, block): lanes of the block within
    ``radius``.  Returns the surviving jobs and their lanes."""
    n = len(probe)
    levels = [np.zeros(n, np.uint64) for _ in range(max(1, radius.bit_length()))]
    spilled, mine, at = np.zeros(n, np.uint64), members[probe], np.arange(n)
    zero, one = np.uint64(0), np.uint64(1)
    alive = valid[block]
    for p in range(0, 64, 2):
        x, y = (planes[block, q] ^ (zero - ((mine >> np.uint64(q)) & one)) for q in (p, p + 1))
        half = levels[0] ^ x                      # carry-save: ones + x + y
        carry = (levels[0] & x) | (half & y)
        levels[0] = half ^ y
        for k in range(1, len(levels)):
            levels[k], carry = levels[k] ^ carry, levels[k] & carry
        spilled |= carry
        if p % 8 == 6:
            alive = ~_over(levels, spilled, radius) & valid[block]
            keep = np.flatnonzero(alive)
            if len(keep) < 0.75 * len(alive):     # abandon blocks that are all over
                levels = [v[keep] for v in levels]
                spilled, mine, block, at = spilled[keep], mine[keep], block[keep], at[keep]
                alive = alive[keep]
                if not len(keep):
                    break
    return at, alive


def _hook(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Union the pairs (i, j) into ``label`` (smallest index of the set)."""
    while True:
        a, b = label[i], label[j]
        differ = a != b
        if not differ.any():
            return
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            jump = label[label]
            if (jump == label).all():
                break
            label[:] = jump


def links_in_groups(fp: np.ndarray, group: np.ndarray, radius: int) -> tuple:
    """Spanning forest, as index pairs, of the links inside each group;
    ``group`` is sorted."""
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    sizes = np.diff(np.concatenate([first, [len(group)]]))
    many = sizes > 1
    rows = np.flatnonzero(np.repeat(many, sizes))
    first, sizes = np.cumsum(sizes[many]) - sizes[many], sizes[many]
    if not len(rows):
        return rows, rows
    n_blocks = -(-sizes // 64)
    block_first = np.cumsum(n_blocks) - n_blocks
    of = np.repeat(np.arange(len(sizes)), sizes)
    rank = np.arange(len(rows)) - first[of]
    slot = block_first[of] * 64 + rank
    total = int(n_blocks.sum())
    padded = np.zeros(total * 64, np.uint64)
    padded[slot] = fp[rows]
    filled = np.zeros(total * 64, np.uint8)
    filled[slot] = 1
    row_of = np.zeros(total * 64, np.int64)
    row_of[slot] = np.arange(len(rows))
    valid = np.packbits(filled.reshape(-1, 64), axis=1, bitorder="little").view("<u8")[:, 0]
    planes = _planes(padded)
    # a member meets its own block and the later ones of its group
    own = slot // 64
    jobs = block_first[of] + n_blocks[of] - own
    ends = np.cumsum(jobs)
    label = np.arange(len(rows))
    lane = np.arange(64, dtype=np.uint64)
    at = 0
    while at < len(rows):
        done = ends[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(ends, done + STEP, side="right")))
        probe = np.repeat(np.arange(at, upto), jobs[at:upto])
        start = np.repeat(ends[at:upto] - jobs[at:upto], jobs[at:upto])
        block = own[probe] + (np.arange(done, ends[upto - 1]) - start)
        kept, alive = within_radius(padded, planes, valid, slot[probe], block, radius)
        if len(kept):
            j, lanes = np.nonzero((alive[:, None] >> lane) & np.uint64(1))
            a, b = probe[kept[j]], row_of[block[kept[j]] * 64 + lanes]
            _hook(label, a[a < b], b[a < b])
        at = upto
    linked = np.flatnonzero(label != np.arange(len(rows)))
    return rows[linked], rows[label[linked]]


# ------------------------------------------------------------------- search
def _masks(blocks: int, radius: int) -> list[int]:
    """Bit masks of every choice of ``blocks - radius`` of the ranges."""
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]
    masks = (sum(c) for c in combinations(parts, blocks - radius))
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _bucketed(distinct: DataFrame, radius: int, blocks: int, bucket_rows: int) -> DataFrame:
    """``t, key, i, j, fp``: rows that are compared share the first four.
    Ordinary buckets have i = j = 0; in a large one each fingerprint belongs
    to one hashed part and goes to every pair of parts with it."""
    rows = distinct.select("fp", F.posexplode(F.array(*[
        F.col("fp").bitwiseAND(F.lit(m)) for m in _masks(blocks, radius)])).alias("t", "key"))
    large = (rows.groupBy("t", "key").agg(F.count("*").alias("n"))
             .where(F.col("n") > bucket_rows)
             .select("t", "key", F.ceil(F.col("n") / bucket_rows).cast("int").alias("parts")))
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(
        F.least(part, o).alias("i"), F.greatest(part, o).alias("j")))
    return (rows.join(large, ["t", "key"], "left")
            .select("t", "key", "fp", F.explode(F.when(F.col("parts").isNull(), F.array(
                F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(pairs)).alias("p"))
            .select("t", "key", "p.i", "p.j", "fp"))


def fingerprint_links(distinct: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS,
                      bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``src, dst``: edges among distinct fingerprints that connect exactly
    those joined by chains of links.  ``distinct`` has one row per ``fp``."""
    def run(batches):
        held, found = None, []
        for b in filter(len, batches):
            cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            cols = cols if held is None else [np.concatenate(x) for x in zip(held, cols)]
            new = np.flatnonzero(differs(cols)) + 1
            cut = new[-1] if len(new) else 0
            if len(cols[0]) < CHUNK_ROWS or not cut:
                held = cols
                continue
            found.append(compared([c[:cut] for c in cols]))
            held = [c[cut:] for c in cols]
            if sum(len(x[0]) for x in found) >= CHUNK_ROWS:
                yield forest(found)
                found = []
        if held is not None:
            found.append(compared(held))
        if found:
            yield forest(found)

    def differs(cols):
        return np.logical_or.reduce([c[1:] != c[:-1] for c in cols[:4]])

    def compared(cols):
        fp = cols[4].view(np.uint64)
        i, j = links_in_groups(fp, np.concatenate([[0], np.cumsum(differs(cols))]), radius)
        return cols[4][i], cols[4][j]

    def forest(found):
        """One forest of the links of many buckets."""
        ends = np.concatenate([np.concatenate(x) for x in zip(*found)])
        fps, index = np.unique(ends, return_inverse=True)
        label = np.arange(len(fps))
        _hook(label, *index.reshape(2, -1))
        at = np.flatnonzero(label != np.arange(len(fps)))
        return pa.RecordBatch.from_arrays([pa.array(fps[at]), pa.array(fps[label[at]])], ["src", "dst"])

    keys = ["t", "key", "i", "j"]
    return (_bucketed(distinct, radius, blocks, bucket_rows)
            .repartition(*keys).sortWithinPartitions(*keys, "fp")
            .mapInArrow(run, "src long, dst long"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS,
                    blocks: int = BLOCKS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``doc_id, fingerprint`` (16 hex digits) ``, component_id`` (smallest
    doc_id reachable by links), one row per input row."""
    fps = cut_lineage(fingerprints(docs, shingle))
    reps = fps.groupBy("fp").agg(F.min("doc_id").alias("first_doc"))
    stars = star_forest(fingerprint_links(reps.select("fp"), radius, blocks, bucket_rows))
    placed = (reps.join(stars.select(F.col("hi").alias("fp"), "lo"), "fp", "left")
              .select("fp", F.coalesce("lo", "fp").alias("root"), "first_doc"))
    roots = placed.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    of_fp = placed.join(roots, "root").select("fp", "component_id")
    return (fps.join(of_fp, "fp")
            .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                    "component_id"))


def first_of_each(docs: DataFrame, **options) -> DataFrame:
    """The document with the smallest id of each group; rows that repeat an
    id are one document, of which one row stays.  Rows without an id stay."""
    found = cut_lineage(near_duplicates(docs, **options))
    later = found.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    n = later.count()
    small = F.broadcast(later) if 16 * n <= BROADCAST_BYTES else later
    kept = docs.join(small, "doc_id", "left_anti").select(*docs.columns)
    twice = found.groupBy("doc_id").agg(F.count("*").alias("n")).where(
        (F.col("n") > 1) & F.col("doc_id").isNotNull()).select("doc_id")
    if twice.isEmpty():
        return kept
    again = kept.join(twice, "doc_id", "left_semi").select(*docs.columns)
    return kept.join(twice, "doc_id", "left_anti").select(*docs.columns).unionByName(
        again.dropDuplicates(["doc_id"]))
