"""Exact removal of repeated byte strings by blockwise suffix sorting.

Every byte covered by a string of ``depth`` bytes that starts at two or more
places in the corpus is removed.  Whole copies are collapsed first, so a text
is sorted once however often it occurs.

1. *Buckets.*  Each suffix start is dealt to a bucket by content: among the
   ``gram``-byte hashes inside its ``depth``-byte prefix the smallest (leftmost
   on ties) is its anchor.  Equal prefixes have equal anchors at the same
   distance, so equal suffixes meet.  Starts that share an anchor are
   consecutive and travel as one *context*: the bytes their prefixes cover.  A
   first pass only counts anchors; those that occur once are left out by a bitmap of
   fixed size, which may let some through but never holds one back.
2. *Sorting.*  A task takes buckets until their text fills ``TEXT_BYTES`` and
   sorts its suffixes to ``depth``, one block of suffixes at a time.  First, ranks of
   the suffixes at difference-cover positions (a set of residues mod ``COVER`` whose differences are all
   residues) are computed by prefix doubling.  Then, for each block of the
   order, suffixes are sorted by their first ``COVER`` bytes only; a tie is
   resolved by the ranks at the next cover position and the last ``COVER``
   bytes.  Memory is that of the text, the cover ranks (a quarter of its
   positions) and one block.  Contexts are laid out with their anchors at
   residue zero, so suffixes that can be equal have equal residues and meet
   the same cover position.
3. *Marks.*  Starts with an equal neighbour are repeated; so are all starts of
   a context that occurs in several places.  They return to their texts as runs
   of starts and are cut out.

No bucket is gathered whole if it is hot: a task sends equal contexts once, and a bucket with
more than ``HOT_CONTEXTS`` different contexts is dealt out once more by the
hash of each whole ``depth``-byte prefix, counted by partial aggregates.

Defined cases: null text counts as empty; texts shorter than ``depth`` stay
whole; repeated rows are copies of each other; matches never cross texts; every
input row gives one row; an empty table gives none; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpusgraph.llm.batches import ROWS, values
from corpusgraph.session import cut_lineage

DEPTH = 200
GRAM = 72
COVER = 32
#: Text that a task hashes, and sorts, at once; suffixes sorted at once.
SCAN_BYTES, TEXT_BYTES, BLOCK = 1 << 20, 1 << 22, 1 << 18
#: Contexts of an anchor beyond which its bucket is dealt out by prefix.
HOT_CONTEXTS = 20_000
#: Longs of the anchor bitmap (64 bits each): 16 MB, whatever the input.
BITMAP_LONGS = 1 << 21
#: Size up to which a table is broadcast in place of a shuffle of the texts.
BROADCAST_BYTES = 48 << 20

_U = np.uint64


# ----------------------------------------------------------- difference cover
def difference_cover(v: int) -> list[int]:
    """Residues whose pairwise differences give every residue mod ``v``:
    each step adds the residue that yields most new differences."""
    cover, seen = [0], {0}
    while len(seen) < v:
        def new(c):
            return ({(c - x) % v for x in cover} | {(x - c) % v for x in cover}) - seen

        best = max((c for c in range(v) if c not in cover), key=lambda c: (len(new(c)), -c))
        seen |= new(best)
        cover.append(best)
    return sorted(cover)


_RESIDUES = np.array(difference_cover(COVER))
#: For each residue, the distance to the next cover position and its index.
_NEXT = np.array([min((d - r) % COVER for d in _RESIDUES) for r in range(COVER)])


def _words(text: np.ndarray) -> np.ndarray:
    """The eight bytes at every position, big-endian, zeros past the end."""
    x = np.concatenate([text, np.zeros(8, np.uint8)]).astype(_U)
    for step, bits in ((1, 8), (2, 16), (4, 32)):
        x = (x[:-step] << _U(bits)) | x[step:]
    return x[:len(text)]


def _dense(columns: list[np.ndarray]) -> np.ndarray:
    """Ranks of rows by their columns, equal rows sharing one."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    for c in columns:
        s = c[order]
        new[1:] |= s[1:] != s[:-1]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new)
    return rank


class SuffixBlocks:
    """Suffixes of ``text`` ordered by their first ``depth`` bytes, block by
    block.  ``text`` must be followed by at least ``depth`` bytes of padding."""

    def __init__(self, text: np.ndarray, depth: int = DEPTH) -> None:
        self.depth, self.words = depth, _words(text)
        k = len(_RESIDUES)
        blocks = len(text) // COVER
        at = (np.arange(blocks)[:, None] * COVER + _RESIDUES).ravel()
        self.index = np.full(COVER, -1)
        self.index[_RESIDUES] = np.arange(k)
        self.cover_rank = self._cover_ranks(at, k)

    def _read(self, at: np.ndarray) -> np.ndarray:
        return self.words[np.minimum(at, len(self.words) - 1)]

    def _cover_ranks(self, at: np.ndarray, k: int) -> np.ndarray:
        """Ranks by ``depth - COVER`` bytes: COVER bytes, doubled while that
        fits, then the rest from ranks of COVER bytes and single words."""
        def later(rank, n_bytes):
            shifted = np.zeros_like(rank)
            step = k * (n_bytes // COVER)
            shifted[:len(rank) - step] = rank[step:]
            return shifted

        need, have = self.depth - COVER, COVER
        first = rank = _dense([self._read(at + o) for o in range(0, COVER, 8)])
        while have * 2 <= need:
            rank, have = _dense([rank, later(rank, have)]), have * 2
        parts = [rank]
        while have + COVER <= need:
            parts.append(later(first, have))
            have += COVER
        parts += [self._head(at + o, need - o) for o in range(have, need, 8)]
        return _dense(parts) if len(parts) > 1 else rank

    def _head(self, at: np.ndarray, n: int) -> np.ndarray:
        """The first ``n`` (at most eight) bytes there."""
        w = self._read(at)
        return w if n >= 8 else w >> _U(8 * (8 - n))

    def blocks(self, starts: np.ndarray, size: int = BLOCK):
        """Arrays of starts, in ascending order of their blocks."""
        head = self._read(starts)
        n = -(-len(starts) // size)
        if n == 1:
            yield starts
            return
        some = np.sort(head[::max(1, len(head) // (64 * n))])
        block = np.searchsorted(np.unique(some[::max(1, len(some) // n)]), head, side="right")
        order = np.argsort(block, kind="stable")
        yield from np.split(starts[order], np.flatnonzero(np.diff(block[order])) + 1)

    def repeated(self, starts: np.ndarray) -> np.ndarray:
        """The starts, among those of one block, whose ``depth``-byte prefix
        equals that of another one with the same residue."""
        prefix = [self._read(starts + o) for o in range(0, COVER, 8)]
        run = _dense(prefix)
        tied = np.flatnonzero(np.bincount(run)[run] > 1)
        if not len(tied):
            return starts[:0]
        s, run = starts[tied], run[tied]
        residue = s % COVER
        cover_at = s + _NEXT[residue]
        rank = self.cover_rank[cover_at // COVER * len(_RESIDUES) + self.index[cover_at % COVER]]
        tail = [self._read(s + self.depth - COVER + o) for o in range(0, COVER, 8)]
        same = _dense([run, residue, rank, *tail])
        return s[np.bincount(same)[same] > 1]


# ---------------------------------------------------------------- anchors
def _hash_tables(n: int):
    rng = np.random.default_rng(20)
    byte = rng.integers(0, 1 << 63, 256, dtype=_U) << _U(1) | _U(1)
    base = 0x9E3779B97F4A7C15
    up = np.cumprod(np.full(n, base, _U), dtype=_U)
    down = np.cumprod(np.full(n, pow(base, -1, 1 << 64), _U), dtype=_U)
    return byte, up, down


class Anchors:
    """Anchors of all ``depth``-byte prefixes of a buffer of texts."""

    POSITION_BITS = 24

    def __init__(self, depth: int = DEPTH, gram: int = GRAM) -> None:
        self.depth, self.gram, self.size = depth, gram, 0

    def _tables(self, n: int):
        if n > self.size:
            self.size = max(n, SCAN_BYTES * 2)
            self.byte, self.up, self.down = _hash_tables(self.size)
        return self.byte, self.up[:n], self.down[:n]

    def of(self, buffer: np.ndarray, ends: np.ndarray, text_of: np.ndarray):
        """``text, hash, anchor, first, last`` of each run of starts that share
        an anchor; positions are in the buffer, in which text i ends at
        ``ends[i]``; ``text_of`` gives each byte's text."""
        n, k = len(buffer), self.gram
        if n < self.depth:
            return [np.zeros(0, np.int64)] * 5
        byte, up, down = self._tables(n)
        total = np.zeros(n + 1, _U)
        np.cumsum(byte[buffer] * up, dtype=_U, out=total[1:])
        h = (total[k:] - total[:-k]) * down[:n - k + 1]
        h ^= h >> _U(31)
        h *= _U(0xBF58476D1CE4E5B9)
        h ^= h >> _U(27)
        bits = _U(self.POSITION_BITS)
        low = (h >> bits << bits) | np.arange(len(h), dtype=_U)
        width, have = self.depth - k + 1, 1
        while have * 2 <= width:
            low, have = np.minimum(low[:-have], low[have:]), have * 2
        if have < width:
            low = np.minimum(low[:-(width - have)], low[width - have:])
        anchor = (low & ((_U(1) << bits) - _U(1))).astype(np.int64)
        starts = np.arange(len(anchor))
        inside = starts + self.depth <= ends[text_of[:len(anchor)]]
        starts, anchor = starts[inside], anchor[inside]
        if not len(starts):
            return [np.zeros(0, np.int64)] * 5
        new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)])
        first = starts[new]
        last = np.concatenate([starts[np.flatnonzero(new)[1:] - 1], starts[-1:]])
        anchor = anchor[new]
        return text_of[first], h[anchor].view(np.int64), anchor, first, last


def _buffers(texts, depth: int):
    """Texts as ``(buffer, ends, text_of, index, base)`` pieces of about SCAN_BYTES; a
    long text is cut so that each of its prefixes lies in one piece."""
    limit = (1 << Anchors.POSITION_BITS) - 1
    held, size = [], 0

    def piece():
        lens = np.array([len(r) for _, _, r in held])
        ends = np.cumsum(lens)
        return (np.frombuffer(b"".join(r for _, _, r in held), np.uint8), ends,
                np.repeat(np.arange(len(held)), lens),
                np.array([i for i, _, _ in held]), np.array([b for _, b, _ in held]), ends - lens)

    for i, raw in enumerate(texts):
        if len(raw) < depth:
            continue
        step = min(limit, 4 * SCAN_BYTES)
        for base in range(0, len(raw) - depth + 1, step - depth + 1):
            part = raw[base:base + step]
            if size + len(part) > SCAN_BYTES and held:
                yield piece()
                held, size = [], 0
            held.append((i, base, part))
            size += len(part)
    if held:
        yield piece()


# -------------------------------------------------------------------- passes
def _anchor_counts(texts: DataFrame, depth: int, gram: int) -> DataFrame:
    """``h, n``: anchors with their number in one stretch of a task's texts."""
    def run(batches):
        anchors = Anchors(depth, gram)
        for b in batches:
            for buffer, ends, text_of, *_ in _buffers(_raw(b, 1), depth):
                h, n = np.unique(anchors.of(buffer, ends, text_of)[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n)], ["h", "n"])

    return texts.mapInArrow(run, "h long, n long")


def _raw(batch: pa.RecordBatch, column: int):
    """The texts of a column as UTF-8 bytes, a few at a time."""
    for at in range(0, batch.num_rows, ROWS):
        yield from batch.column(column).slice(at, ROWS).cast(pa.binary()).to_pylist()


_BIT_LONGS = BITMAP_LONGS - 1


def _bitmap(repeated: DataFrame) -> np.ndarray:
    """One bit per anchor in a bitmap of fixed size, merged by the cluster."""
    bits = (repeated.select(F.col("h").bitwiseAND(F.lit(_BIT_LONGS)).alias("at"),
                            F.expr("shiftleft(1L, cast(shiftrightunsigned(h, 40) & 63 as int))").alias("bit"))
            .groupBy("at").agg(F.bit_or("bit").alias("bits")).toPandas())
    out = np.zeros(BITMAP_LONGS, np.int64)
    out[bits["at"].to_numpy()] = bits["bits"].to_numpy()
    return out.view(_U)


def _in_bitmap(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    u = h.view(_U)
    return (bitmap[u & _U(_BIT_LONGS)] >> ((u >> _U(40)) & _U(63))) & _U(1) > 0


_CONTEXT = "h long, d1 long, d2 long, cid binary, first long, n_starts int, ahead int, context binary"


def _contexts(texts: DataFrame, bitmap, depth: int, gram: int) -> DataFrame:
    """One row per run of starts whose anchor is in the bitmap.  ``d1, d2``
    identify the context; its bytes come with the first such row of a
    stretch of the task, else null."""
    def run(batches):
        import xxhash

        anchors, sent, bits = Anchors(depth, gram), set(), bitmap.value
        for b in batches:
            cids = b.column(0).to_pylist()
            for buffer, ends, text_of, index, base, begin in _buffers(_raw(b, 1), depth):
                text, h, anchor, first, last = anchors.of(buffer, ends, text_of)
                keep = np.flatnonzero(_in_bitmap(bits, h)) if len(h) else h
                if not len(keep):
                    continue
                raw, rows = buffer.tobytes(), []
                if len(sent) > 200_000:
                    sent.clear()
                for t, x, a, f, z in zip(*(c[keep].tolist() for c in (text, h, anchor, first, last))):
                    context = raw[f:z + depth]
                    digest = xxhash.xxh3_128_digest(context, a - f)
                    d1, d2 = np.frombuffer(digest, "<i8").tolist()
                    new = digest not in sent
                    if new:
                        sent.add(digest)
                    rows.append((x, d1, d2, cids[index[t]], f - int(begin[t]) + int(base[t]),
                                 z - f + 1, a - f, context if new else None))
                yield pa.RecordBatch.from_pylist([dict(zip(_NAMES, r)) for r in rows], _SCHEMA)

    return texts.mapInArrow(run, _CONTEXT)


_NAMES = [c.split()[0] for c in _CONTEXT.split(", ")]
_SCHEMA = pa.schema(list(zip(_NAMES, [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(),
                                      pa.int32(), pa.int32(), pa.binary()])))
_MARKS = "d1 long, d2 long, runs array<struct<a:int,b:int>>"


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """First and last index of each stretch of true flags."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist()))


def sort_contexts(contexts: list[tuple[bytes, int]], depth: int = DEPTH) -> list[np.ndarray]:
    """For each ``(bytes, distance of the anchor)`` a flag per start: whether
    its prefix equals another one's among all contexts."""
    size, places, parts = 0, [], []
    for raw, ahead in contexts:
        pad = -(size + ahead) % COVER
        parts += [b"\0" * pad, raw]
        places.append(size + pad)
        size += pad + len(raw)
    text = np.frombuffer(b"".join(parts) + b"\0" * (depth + COVER + -(size + depth) % COVER), np.uint8)
    counts = np.array([len(r) - depth + 1 for r, _ in contexts])
    order = SuffixBlocks(text, depth)
    starts = np.concatenate([np.arange(p, p + n) for p, n in zip(places, counts)])
    flag = np.zeros(len(text), bool)
    for block in order.blocks(starts):
        flag[order.repeated(block)] = True
    return [flag[p:p + n] for p, n in zip(places, counts)]


def _sorted_marks(contexts: DataFrame, depth: int) -> DataFrame:
    """``d1, d2, runs``: runs of repeated starts of each context, by sorting
    the suffixes of each bucket (anchor ``h``)."""
    def run(batches):
        held, size, last, bucket = [], 0, None, []

        def done():
            flags = sort_contexts([(c, a) for _, _, c, a in held], depth)
            rows = [(d1, d2, [{"a": a, "b": b} for a, b in _runs(f)])
                    for (d1, d2, _, _), f in zip(held, flags) if f.any()]
            return pa.RecordBatch.from_pylist(
                [dict(zip(("d1", "d2", "runs"), r)) for r in rows], _MARK_SCHEMA)

        for b in batches:
            for h, d1, d2, ahead, context in zip(*(c.to_pylist() for c in b.columns)):
                if h != last:
                    if len(bucket) > 1:
                        held += bucket
                        size += sum(len(c[2]) for c in bucket)
                    if size >= TEXT_BYTES:
                        yield done()
                        held, size = [], 0
                    bucket, last = [], h
                if not bucket or bucket[-1][:2] != (d1, d2):
                    bucket.append((d1, d2, context, ahead))
        if len(bucket) > 1:
            held += bucket
        if held:
            yield done()

    return (contexts.select("h", "d1", "d2", "ahead", "context").repartition("h")
            .sortWithinPartitions("h", "d1", "d2").mapInArrow(run, _MARKS))


_MARK_SCHEMA = pa.schema([("d1", pa.int64()), ("d2", pa.int64()),
                          ("runs", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))])


def _hot_marks(contexts: DataFrame, depth: int) -> DataFrame:
    """The same for buckets too large for a task: one bucket per whole
    prefix (by a 128-bit hash), counted by partial aggregates."""
    def run(batches):
        import xxhash

        for b in batches:
            for d1, d2, context in zip(*(c.to_pylist() for c in b.columns)):
                n = len(context) - depth + 1
                p = np.frombuffer(b"".join(xxhash.xxh3_128_digest(context[s:s + depth])
                                           for s in range(n)), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.ascontiguousarray(p[:, 0])), pa.array(np.ascontiguousarray(p[:, 1])),
                     pa.array(np.full(n, d1)), pa.array(np.full(n, d2)),
                     pa.array(np.arange(n, dtype=np.int32))], ["p1", "p2", "d1", "d2", "a"])

    each = contexts.select("d1", "d2", "context").dropDuplicates(["d1", "d2"]).mapInArrow(
        run, "p1 long, p2 long, d1 long, d2 long, a int")
    twice = (each.groupBy("p1", "p2").agg(F.count("*").alias("n")).where("n > 1").select("p1", "p2"))
    return (each.join(twice, ["p1", "p2"], "left_semi").groupBy("d1", "d2")
            .agg(F.collect_list(F.struct("a", F.col("a").alias("b"))).alias("runs")))


def _join_texts(docs: DataFrame, small: DataFrame, bytes_: int, how: str) -> DataFrame:
    """Join on ``cid``; the texts stay in place if ``small`` is small."""
    return docs.join(F.broadcast(small) if bytes_ <= BROADCAST_BYTES else small, "cid", how)


def repeated_spans(docs: DataFrame, depth: int = DEPTH, gram: int = GRAM,
                  hot_contexts: int = HOT_CONTEXTS) -> DataFrame:
    """``cid, spans``: for each different text (by the first 16 bytes of its
    SHA-256) the byte ranges covered by ``depth``-byte strings that also start
    elsewhere in the corpus.  ``docs`` has ``cid, doc_id, text``."""
    spark = docs.sparkSession
    copies = cut_lineage(docs.groupBy("cid").agg(
        F.count("*").alias("n"), F.min("doc_id").alias("rep"),
        F.max(F.octet_length("text")).alias("n_bytes")).where("n > 1"))
    n_copies = copies.count()
    once = _join_texts(docs, copies.select("cid", "rep"), 64 * n_copies, "left").where(
        F.col("rep").isNull() | F.col("doc_id").isNull() | (F.col("doc_id") == F.col("rep"))
    ).select("cid", "text")
    bits = _bitmap(_anchor_counts(once.select("cid", "text"), depth, gram)
                   .groupBy("h").agg(F.sum("n").alias("n")).where("n > 1"))
    found = cut_lineage(_contexts(once, spark.sparkContext.broadcast(bits), depth, gram))
    counts = found.groupBy("h", "d1", "d2").agg(
        F.count("*").alias("n"), F.max("n_starts").alias("n_starts"))
    buckets = counts.groupBy("h").agg(F.count("*").alias("n_contexts"))
    hot = cut_lineage(buckets.where(F.col("n_contexts") > hot_contexts).select("h"))
    first_sent = found.where(F.col("context").isNotNull())
    marks = _sorted_marks(first_sent.join(hot, "h", "left_anti"), depth)
    if not hot.isEmpty():
        marks = marks.unionByName(_hot_marks(first_sent.join(hot, "h", "left_semi"), depth))
    whole = counts.where("n > 1").select("d1", "d2", F.array(F.struct(
        F.lit(0).alias("a"), (F.col("n_starts") - 1).alias("b"))).alias("runs"))
    marks = marks.select("d1", "d2", "runs").unionByName(whole)
    spans = (found.select("d1", "d2", "cid", "first").join(marks, ["d1", "d2"])
             .select("cid", F.transform("runs", lambda r: F.struct(
                 (F.col("first") + r["a"]).alias("a"), (F.col("first") + r["b"]).alias("b"))).alias("runs")))
    per_text = spans.groupBy("cid").agg(F.flatten(F.collect_list("runs")).alias("runs"))
    whole_copies = copies.where(F.col("n_bytes") >= depth).select("cid", F.array(F.struct(
        F.lit(0).cast("long").alias("a"), F.col("n_bytes").cast("long").alias("b"))).alias("spans"))
    return _merged(per_text.join(whole_copies.select("cid"), "cid", "left_anti"), depth).unionByName(
        whole_copies)


def merged_spans(runs, depth: int = DEPTH) -> list[tuple[int, int]]:
    """Maximal byte ranges ``[begin, end)`` that runs of starts cover."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((r["a"], r["b"] + depth) for r in runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _merged(per_text: DataFrame, depth: int) -> DataFrame:
    """Runs of a text (one per anchor) as its few spans."""
    def run(batches):
        for b in batches:
            spans = [[{"a": x, "b": y} for x, y in merged_spans(r, depth)]
                     for r in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, _SPANS)], ["cid", "spans"])

    return per_text.mapInArrow(run, "cid binary, spans array<struct<a:bigint,b:bigint>>")


_SPANS = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))


def _with_cid(docs: DataFrame) -> DataFrame:
    return docs.withColumn("cid", F.unhex(F.substring(F.sha2(F.col("text"), 256), 1, 32)))


def _cut(raw: bytes, spans) -> bytes:
    """The bytes outside the spans."""
    at, parts = 0, []
    for span in spans or ():
        parts.append(raw[at:span["a"]])
        at = span["b"]
    return b"".join([*parts, raw[at:]]) if spans else raw


def _with_spans(docs: DataFrame, depth: int, gram: int, hot_contexts: int) -> DataFrame:
    """``docs`` (null text as empty) with the spans of each row's text."""
    docs = docs.withColumn("text", F.coalesce("text", F.lit("")))
    keyed = _with_cid(docs)
    spans = cut_lineage(repeated_spans(keyed.select(
        "cid", F.col("doc_id").cast("long").alias("doc_id"), "text"), depth, gram, hot_contexts))
    n, size = spans.agg(F.count("*"), F.coalesce(F.sum(F.size("spans")), F.lit(0))).first()
    return _join_texts(keyed, spans, 64 * n + 32 * size, "left").select(*docs.columns, "spans")


def remove_repeats(docs: DataFrame, depth: int = DEPTH, gram: int = GRAM,
                   hot_contexts: int = HOT_CONTEXTS) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` per row."""
    def run(batches):
        for b in batches:
            rows = []
            for doc_id, raw, spans in zip(values(b, 0), _raw(b, 1), values(b, 2)):
                kept = _cut(raw, spans)
                rows.append((doc_id, len(raw), len(raw) - len(kept), len(spans or ()),
                             hashlib.sha256(kept).hexdigest()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 5, _RESULT.types)],
                schema=_RESULT)

    pair = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _with_spans(pair, depth, gram, hot_contexts).mapInArrow(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()),
                     ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def cut_texts(docs: DataFrame, depth: int = DEPTH, gram: int = GRAM,
              hot_contexts: int = HOT_CONTEXTS) -> DataFrame:
    """The rows of ``docs(doc_id, text, lang, source, n_chars)`` with repeats
    cut out of the text.  A character of which some bytes are removed goes
    whole; ``n_chars`` counts what is left."""
    columns = ["doc_id", "text", "lang", "source", "n_chars"]

    def run(batches):
        for b in batches:
            texts = [_cut(raw, spans).decode("utf-8", "ignore")
                     for raw, spans in zip(_raw(b, 1), values(b, 5))]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(texts, pa.string()), b.column(2), b.column(3),
                 pa.array([len(t) for t in texts], pa.int64())], columns)

    docs = docs.select(*columns[:4], F.col("n_chars").cast("long").alias("n_chars"))
    return _with_spans(docs, depth, gram, hot_contexts).mapInArrow(run, docs.schema)
