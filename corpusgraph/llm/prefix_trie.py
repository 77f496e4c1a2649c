"""Conversation prefix trie by ternary search trees over range shards.

Turns are dictionary-encoded: (role, text) is known by 128 bits of its SHA-256
and gets a long id in a written table, so texts are never shuffled.  Rebuilt
conversations, sequences of turn ids, are dealt out by range, so a shard holds
a run of the sorted order.  A shard inserts its distinct sequences into a
ternary search tree, the median first, then the medians of the halves, which
keeps each level's search tree balanced; a traversal with an explicit stack
then sums members, leaves and saved tokens from the leaves up.

Only nodes on the way to a shard's first or last sequence can have members in
other shards.  All others are complete and are returned; these boundary nodes
go on, as two paths a shard with what their completed children hold, to the
next level, where the paths are sequences themselves.  Each level has at most
half the rows of the one before, and the last is one small shard.  Children of
boundary nodes learn their parent's smallest member by a join on the parent's
key.  The ids of the conversations that end at one node are hashed as they
come in sorted order; where they span shards, by shards' chunks in order.

Defined cases: turns are ordered by number, null first, ties by the digest of
role and text; null role or text is empty; rows with null conv_id belong to no
conversation and are left out; repeated rows are turns of their own; the base
of conversation c is c - c % 100, with the sign of c; an empty table has no
nodes; other columns are ignored.  One conversation's ids and one shard are
held in a task at a time (eight bytes a turn, about ``SHARD`` turns).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpusgraph.session import cut_lineage

BASE, HEAD = 100, 6
#: Turns (and rows) of a shard at most about, and at least when there are few.
SHARD, LEAST = 1 << 18, 1 << 12
#: Bytes of conversation ids sent on in one row.
CHUNK = 1 << 20
NO_ID = np.iinfo(np.int64).max
EMPTY = hashlib.sha256(b"").hexdigest()

_STATS = ["members", "smallest", "leaves", "saved", "children"]
PATH = ", ".join(["ids array<long>", "sizes array<int>", *(f"{x} array<long>" for x in _STATS),
                  "ends array<string>"])
NODE = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
        "n_leaves long, saved_tokens long, ends_sha256 string")
#: kind: 0 a node, 1 a boundary path, 2 a chunk of ids ending at a boundary node.
SCHEMA = f"kind int, key binary, parent_key binary, {NODE}, {PATH}, first long, chunk binary"
_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
_TYPES = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(),
          "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()),
          "array<string>": pa.list_(pa.string())}
_ARROW = pa.schema([(x.split()[0], _TYPES[x.split()[1]]) for x in SCHEMA.split(", ")])


# --------------------------------------------------------------------- tree
class Tree:
    """Ternary search tree.  Node 0 is the root; a node's ``eq`` is the search
    tree of its children, whose nodes hang on ``lo`` and ``hi``."""

    def __init__(self) -> None:
        self.id, self.lo, self.hi, self.eq = [0], [-1], [-1], [-1]
        self.parent, self.size, self.depth = [-1], [0], [0]

    def _new(self, turn: int, parent: int, size: int) -> int:
        for column, x in ((self.id, turn), (self.lo, -1), (self.hi, -1), (self.eq, -1),
                          (self.parent, parent), (self.size, size),
                          (self.depth, self.depth[parent] + 1)):
            column.append(x)
        return len(self.id) - 1

    def insert(self, ids: list[int], sizes: list[int]) -> int:
        """The node of a sequence."""
        at = 0
        for turn, size in zip(ids, sizes):
            x, side, last = self.eq[at], self.eq, at
            while x >= 0 and self.id[x] != turn:
                side, last = (self.lo if turn < self.id[x] else self.hi), x
                x = side[x]
            if x < 0:
                x = side[last] = self._new(turn, at, size)
            at = x
        return at

    def preorder(self) -> list[int]:
        """All nodes, parents first."""
        out, stack = [], [0]
        while stack:
            x = stack.pop()
            out.append(x)
            stack += [y for y in (self.hi[x], self.eq[x], self.lo[x]) if y >= 0]
        return out

    def path(self, x: int) -> list[int]:
        """The nodes from the root to x."""
        out = []
        while x >= 0:
            out.append(x)
            x = self.parent[x]
        return out[::-1]


def medians(n: int) -> list[int]:
    """0 to n - 1, the median first, then those of both halves, and so on."""
    out, queue = [], [(0, n)]
    for lo, hi in queue:
        if lo < hi:
            mid = (lo + hi) // 2
            out.append(mid)
            queue += [(lo, mid), (mid + 1, hi)]
    return out


def _key(parent: bytes, turn: int) -> bytes:
    return hashlib.sha256(parent + int(turn).to_bytes(8, "little", signed=True)).digest()[:16]


# -------------------------------------------------------------------- shard
class Shard:
    """One shard's tree and the sums at its nodes.  ``paths``: its rows come
    from the level below; ``last``: it holds all rows of its level."""

    def __init__(self, paths: bool, last: bool) -> None:
        self.paths, self.last = paths, last
        #: distinct sequences, sorted: ids, sizes, and what they bring
        self.rows: list[tuple[list[int], list[int], list]] = []
        self.chunks: list[tuple[int, int, bytes]] = []

    # a conversation: (number, smallest id, hash of all ids) at the end of its ids
    def _close(self, final: bool) -> None:
        if not self.rows or self.paths:
            return
        if not self.last and (final or len(self.rows) == 1):
            self.chunks += [(len(self.rows) - 1, *c) for c in self._parts]
            self.rows[-1][2].append(None)
        else:
            self.rows[-1][2].append(self._hash.hexdigest())

    def _conversation(self, conv: int, ids: np.ndarray, sizes: np.ndarray) -> None:
        raw, text = ids.tobytes(), str(conv).encode()
        if not self.rows or raw != self._raw:
            self._close(False)
            self._raw, self._hash, self._parts = raw, hashlib.sha256(text), [(conv, bytearray(text))]
            self.rows.append((ids.tolist(), sizes.tolist(), [1, conv]))
            return
        self.rows[-1][2][0] += 1
        self._hash.update(b"," + text)
        if len(self._parts[-1][1]) < CHUNK:
            self._parts[-1][1].extend(b"," + text)
        else:
            self._parts.append((conv, bytearray(text)))

    def add(self, b: pa.RecordBatch) -> None:
        def lists(name):
            column = b.column(name)
            at = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))])
            return column.flatten().to_numpy(zero_copy_only=False), at.astype(np.int64)

        (ids, at), (sizes, _) = lists("ids"), lists("sizes")
        if not self.paths:
            convs = b.column("conv_id").to_pylist()
            for i, conv in enumerate(convs):
                self._conversation(conv, ids[at[i]:at[i + 1]], sizes[at[i]:at[i + 1]])
            return
        stats = [b.column(x).to_pylist() for x in (*_STATS, "ends")]
        for i, own in enumerate(zip(*stats)):
            self.rows.append((ids[at[i]:at[i + 1]].tolist(), sizes[at[i]:at[i + 1]].tolist(), own))

    def _grow(self) -> None:
        self.tree = t = Tree()
        order = medians(len(self.rows))
        ends = [0] * len(order)
        for i in order:
            ends[i] = t.insert(self.rows[i][0], self.rows[i][1])
        n = len(t.id)
        self.members, self.leaves, self.saved, self.children = ([0] * n for _ in range(4))
        self.smallest, self.ends = [NO_ID] * n, [None] * n
        for x, (_, _, own) in zip(ends, self.rows):
            if not self.paths:
                self.members[x], self.smallest[x], self.ends[x] = own
                continue
            for y, members, smallest, leaves, saved, children, hashed in zip(t.path(x), *own):
                self.members[y] += members
                self.smallest[y] = min(self.smallest[y], smallest)
                self.leaves[y] += leaves
                self.saved[y] += saved
                self.children[y] += children
                self.ends[y] = hashed or self.ends[y]
        self.at = ends

    def results(self):
        """Batches of complete nodes, boundary paths and chunks."""
        self._close(True)
        if not self.rows:
            return
        self._grow()
        t, order = self.tree, self.tree.preorder()
        edge = [] if self.last else [t.path(self.at[0]), t.path(self.at[-1])]
        open_ = {x for path in edge for x in path}
        for x in reversed(order):
            if x in open_:
                continue
            if not self.children[x]:
                self.leaves[x] = 1
            self.saved[x] += (self.members[x] - 1) * t.size[x]
            p = t.parent[x]
            if p >= 0:
                self.members[p] += self.members[x]
                self.smallest[p] = min(self.smallest[p], self.smallest[x])
                self.leaves[p] += self.leaves[x]
                self.saved[p] += self.saved[x]
                self.children[p] += 1
        keys: dict[int, bytes] = {0: b""}
        for x in order if self.paths else [y for path in edge for y in path]:
            if x:
                keys[x] = _key(keys[t.parent[x]], t.id[x])
        done = [x for x in order if x not in open_]
        for lo in range(0, len(done), 8192):
            yield self._nodes(done[lo:lo + 8192], open_, keys)
        if edge:
            yield self._edges(edge)
        for row, first, text in self.chunks:
            yield _batch(1, kind=[2], key=[keys[self.at[row]]], first=[first], chunk=[bytes(text)])

    def _nodes(self, xs: list[int], open_: set[int], keys: dict[int, bytes]) -> pa.RecordBatch:
        t = self.tree
        parents = [t.parent[x] for x in xs]
        return _batch(
            len(xs), kind=[0] * len(xs), key=[keys[x] if self.paths else None for x in xs],
            parent_key=[keys[p] if p in open_ else None for p in parents],
            conv_id=[self.smallest[x] for x in xs], depth=[t.depth[x] for x in xs],
            parent_conv_id=[None if p < 0 or p in open_ else self.smallest[p] for p in parents],
            n_convs=[self.members[x] for x in xs], n_children=[self.children[x] for x in xs],
            n_leaves=[self.leaves[x] for x in xs], saved_tokens=[self.saved[x] for x in xs],
            ends_sha256=[self.ends[x] for x in xs])

    def _edges(self, edge: list[list[int]]) -> pa.RecordBatch:
        """Both paths; what a node on both holds goes with the first."""
        t, seen, cols = self.tree, set(), {x: [] for x in ("ids", "sizes", *_STATS, "ends")}
        for path in edge:
            new = [x not in seen for x in path]
            seen.update(path)
            cols["ids"].append([t.id[x] for x in path[1:]])
            cols["sizes"].append([t.size[x] for x in path[1:]])
            for name in _STATS:
                none, own = (NO_ID if name == "smallest" else 0), getattr(self, name)
                cols[name].append([own[x] if first else none for x, first in zip(path, new)])
            cols["ends"].append([self.ends[x] if first else None for x, first in zip(path, new)])
        return _batch(len(edge), kind=[1] * len(edge), **cols)


def _batch(n: int, **cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(cols.get(f.name, [None] * n), f.type) for f in _ARROW], schema=_ARROW)


# -------------------------------------------------------------------- spark
def rebuilt(conversations: DataFrame) -> DataFrame:
    """``conv_id, ids, sizes``: every rebuilt conversation's turn ids and the
    code points of their texts, and the dictionary behind them written."""
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "role"))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"),
        F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
                                   .cast("binary"), 256)), 1, 16).alias("turn_key"),
        F.length(text).alias("size"))
    ids = cut_lineage(turns.groupBy("turn_key").agg(F.max("size").alias("size"))
                      .withColumn("id", F.monotonically_increasing_id()))
    own = (turns.drop("size").join(ids, "turn_key").groupBy("conv_id")
           .agg(F.sort_array(F.collect_list(F.struct("turn", "turn_key", "id", "size"))).alias("turns"))
           .select("conv_id", F.transform("turns", lambda x: F.struct(x["id"], x["size"])).alias("turns")))
    own = cut_lineage(own)
    heads = own.where(F.col("conv_id") % BASE == 0).select(
        F.col("conv_id").alias("base"), F.slice("turns", 1, HEAD - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEAD).cast("int")
    none = F.slice("turns", 1, 0)
    both = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % BASE).join(heads, "base", "left").select(
        "conv_id", F.concat(F.slice(F.coalesce("head", none), F.lit(1), h),
                            F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))).alias("turns"))
    return both.select("conv_id", F.transform("turns", lambda x: x["id"]).alias("ids"),
                       F.transform("turns", lambda x: x["size"]).alias("sizes"))


def _level(rows: DataFrame, paths: bool) -> tuple[DataFrame, bool]:
    """One level over its sorted rows; whether it was the last."""
    spark = rows.sparkSession
    count, total = rows.agg(F.count("*"), F.coalesce(F.sum(F.size("ids") + 1), F.lit(0))).first()
    few = min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // LEAST))
    n = max(1, min(max(few, -(-total // SHARD)), count // 4))
    order = ["ids"] if paths else ["ids", "conv_id"]
    dealt = rows.repartitionByRange(n, *order) if n > 1 else rows.repartition(1)

    def run(batches):
        shard = Shard(paths, n == 1)
        for b in batches:
            shard.add(b)
        yield from shard.results()

    return cut_lineage(dealt.sortWithinPartitions(*order).mapInArrow(run, SCHEMA)), n == 1


def _hashes(chunks: DataFrame) -> DataFrame:
    """``key, hashed`` of ``key, first, chunk``, read in order."""
    def run(batches):
        key, h = None, None
        for b in batches:
            for k, chunk in zip(b.column(0).to_pylist(), b.column(2)):
                if k != key:
                    if h:
                        yield _hashed(key, h)
                    key, h = k, hashlib.sha256(chunk.as_buffer())
                else:
                    h.update(b",")
                    h.update(chunk.as_buffer())
        if h:
            yield _hashed(key, h)

    return (chunks.select("key", "first", "chunk").repartition("key").sortWithinPartitions("key", "first")
            .mapInArrow(run, "key binary, hashed string"))


def _hashed(key: bytes, h) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([key]), pa.array([h.hexdigest()])], ["key", "hashed"])


def trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the rebuilt conversations' prefix trie."""
    rows, paths, levels, last = cut_lineage(rebuilt(conversations)), False, [], False
    while not last:
        out, last = _level(rows, paths)
        levels.append(out)
        rows, paths = out.where("kind = 1").select([x.split()[0] for x in PATH.split(", ")]), True
    names = [x.split()[0] for x in NODE.split(", ")]
    below, above = levels[0], levels[1:]
    if not above:
        return _told(below.where("kind = 0"), names)
    for x in above[1:]:
        above[0] = above[0].unionByName(x)
    # nodes without a key are complete, but for parents on a boundary
    inner = below.where("kind = 0").select("parent_key", *names)
    keyed = above[0].where("kind = 0").select("key", "parent_key", *names).join(
        _hashes(below.where("kind = 2")), "key", "left").withColumn(
        "ends_sha256", F.coalesce("hashed", "ends_sha256")).drop("hashed")
    parents = above[0].where("kind = 0").select(F.col("key").alias("parent_key"),
                                                F.col("conv_id").alias("parent"))
    nodes = inner.unionByName(keyed.drop("key"))
    known = nodes.where("parent_key is null")
    told = nodes.where("parent_key is not null").join(parents, "parent_key", "left").withColumn(
        "parent_conv_id", F.col("parent"))
    return _told(known.select(*names).unionByName(told.select(*names)), names)


def _told(nodes: DataFrame, names: list[str]) -> DataFrame:
    return nodes.select(*names).withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY)))
