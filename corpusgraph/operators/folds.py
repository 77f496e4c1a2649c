"""Sequential folds and carries over sorted keys, spread over tasks (I7, I8,
I14, I15).

Rows are range-partitioned by (key, order), so a key with a third of all rows
covers many partitions, and cut into *blocks*: at most ``ROWS``
rows of one key, in order.  A fold then needs two things: what a block does as a
whole, and the state each block starts in.

* Transitions (I8): a block is a map from every state to (state, accepted,
  rejected); maps are composed along a key, one small row per block.
* Stock (I7): while the stock lies in (2^(k-1), 2^k], lines up to 2^(k-1) all
  fit and at most one larger line can.  A block's sum of small lines and the
  least stock with which a larger one fits tell, for every k, whether the
  block can be passed without looking into it.  A key's chain stops at blocks
  where the stock leaves its power of two, which happens once per power.
* Rate limit (I14): a task carries the state along a key's blocks in one range
  partition; all partitions run at once from the state their predecessor last
  ended in, those whose start changed again, until no start changes.  So the
  steps are as many as the partitions a key spans at most, whatever its rows; a
  start is the accepted times still inside the window, so ends agree as soon
  as a window passes in which the limit was not reached.  At the limit a block
  is passed from one accepted request to the next by binary search.
* As-of (I15): the last write is carried forward inside a partition, and one
  row per partition end carries it on.

Each step's state is a written table; the driver reads one count per step.
Null keys are a key of their own; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from corpusgraph.session import cut_lineage

ROWS = 1024


def _starts(*columns: pa.Array) -> np.ndarray:
    """True where a row differs from the one before; nulls are equal."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for c in columns:
        a, b = c.slice(1), c.slice(0, max(0, n - 1))
        same = pc.fill_null(pc.equal(a, b), False).to_numpy(zero_copy_only=False)
        both = np.logical_and(a.is_null().to_numpy(zero_copy_only=False), b.is_null().to_numpy(zero_copy_only=False))
        new[1:] |= ~(same | both)
    return new


def blocks(df: DataFrame, key: str, order: list[str], cols: list[str]) -> DataFrame:
    """``key, block, cols...``: the rows of ``df`` by (key, order), as one
    array per column and block; block numbers rise along the order.  Written."""
    names = list(dict.fromkeys([key, *order, *cols]))
    types = {c: df.schema[c].dataType.simpleString() for c in names}

    def pack(batches):
        from pyspark import TaskContext
        number = TaskContext.get().partitionId() << 33
        for b in batches:
            if not b.num_rows:
                continue
            new = _starts(b.column(key))
            row = np.arange(b.num_rows)
            new |= (row - np.maximum.accumulate(np.where(new, row, 0))) % ROWS == 0
            cuts = np.append(np.flatnonzero(new), b.num_rows)
            at = pa.array(cuts, pa.int32())
            lists = [pa.ListArray.from_arrays(at, b.column(c)) for c in cols]
            yield pa.RecordBatch.from_arrays(
                [b.column(key).take(at.slice(0, len(cuts) - 1)),
                 pa.array(np.arange(number, number + len(cuts) - 1)), *lists], ["key", "block", *cols])
            number += len(cuts) - 1

    dealt = df.select(*names).repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    return cut_lineage(dealt.mapInArrow(pack, ", ".join(
        [f"key {types[key]}", "block long", *(f"`{c}` array<{types[c]}>" for c in cols)])))


def _per_block(df: DataFrame, reads: list[str], step, out: dict[str, str]) -> DataFrame:
    """``df`` with the columns ``out`` that ``step`` gives for the columns
    ``reads`` of each row."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields),
                        *(f"{n} {t}" for n, t in out.items())])

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 16):  # a few blocks at a time
                part = b.slice(i, 16)
                made = [step(*r) for r in zip(*(part.column(c).to_pylist() for c in reads))]
                if made:
                    yield pa.RecordBatch.from_arrays(
                        [*part.columns, *(pa.array([m[n] for m in made], _arrow(t)) for n, t in out.items())],
                        [*part.schema.names, *out])

    return df.mapInArrow(run, schema)


def _arrow(kind: str) -> pa.DataType:
    plain = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}
    return pa.list_(plain[kind[6:-1]]) if kind.startswith("array<") else plain[kind]


def _streamed(df: DataFrame, step, out: str) -> DataFrame:
    """``step(rows)`` over all rows of a task, which holds whole keys in order
    of their blocks; ``step`` yields tuples.  Rows are read one Arrow batch at
    a time and never held."""
    schema = to_arrow_schema(StructType.fromDDL(out))

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema.names)

    def run(batches):
        def rows():
            for b in batches:
                for i in range(0, b.num_rows, 256):
                    yield from b.slice(i, 256).to_pylist()

        held = []
        for made in step(rows()):
            held.append(made)
            if len(held) == 4096:
                yield table(held)
                held = []
        if held:
            yield table(held)

    return df.repartition("key").sortWithinPartitions("key", "block").mapInArrow(run, out)


# ------------------------------------------------------------------- I8
def transitions(events: DataFrame, key: str, order: str, status: str, allowed: dict[str, list[str]],
                initial: str) -> DataFrame:
    """``key, final_status, accepted, rejected``: status requests by (order,
    status); an illegal one is rejected and the state stays."""
    states = list(dict.fromkeys([initial, *allowed, *(s for v in allowed.values() for s in v)]))
    number = {s: i for i, s in enumerate(states)}
    legal = {s: [s in allowed.get(a, []) for a in states] for s in states}

    def compose(requests):
        at, ok = list(range(len(states))), [0] * len(states)
        for s in requests:
            if s in number:
                goes = legal[s]
                for i, a in enumerate(at):
                    if goes[a]:
                        at[i], ok[i] = number[s], ok[i] + 1
        return {"to": at, "ok": ok}

    b = blocks(events.withColumnsRenamed({status: "status"} if status != "status" else {}),
               key, [order, "status"], ["status"])
    maps = _per_block(b, ["status"], compose, {"to": "array<long>", "ok": "array<long>"}).select(
        "key", "block", F.size("status").cast("long").alias("n"), "to", "ok")
    key_type = events.schema[key].dataType.simpleString()

    def fold(rows):
        cur, state, ok, n = None, 0, 0, 0
        for r in rows:
            if n and r["key"] != cur:
                yield cur, states[state], ok, n - ok
                state, ok, n = 0, 0, 0
            cur = r["key"]
            state, ok, n = r["to"][state], ok + r["ok"][state], n + r["n"]
        if n:
            yield cur, states[state], ok, n - ok

    done = _streamed(maps, fold, f"key {key_type}, final_status string, accepted long, rejected long")
    return done.withColumnRenamed("key", key)


# ------------------------------------------------------------------- I7
def _class(stock: int) -> int:
    """k with stock in (2^(k-1), 2^k]; 0 for 0 and 1."""
    return max(0, stock - 1).bit_length()


def _summary(q: np.ndarray) -> tuple[list[int], list[int]]:
    """Per class k: the sum of the lines up to 2^(k-1), and the least stock
    before the block with which a larger line of the class fits (-1: none).
    In the last class, and in those beyond it, all lines are small."""
    q = q[q >= 0]
    small, large = [], []
    for k in range(_class(int(q.max(initial=0))) + 2):
        half = (1 << k) // 2
        is_small = q <= half
        before = np.cumsum(np.where(is_small, q, 0))
        big = ~is_small & (q <= 1 << k)
        small.append(int(before[-1]) if len(q) else 0)
        large.append(int((before[big] + q[big]).min()) if big.any() else -1)
    return small, large


def allocate(lines: DataFrame, stock: DataFrame, product: str, order: str, qty: str,
             initial: str) -> DataFrame:
    """``product, order, qty, allocated, stock_left, is_available`` per line:
    by (order, qty), a line takes its quantity while enough is left; a rejected
    line takes nothing.  Whole quantities; a null or negative one is rejected.
    Lines of products without a stock row are left out."""
    s0 = stock.select(F.col(product).alias("key"), F.greatest(F.col(initial).cast("long"), F.lit(0)).alias("s"))
    b = blocks(lines.withColumn("_q", F.coalesce(F.col(qty).cast("long"), F.lit(-1))),
               product, [order, qty], [order, qty, "_q"])
    sums = cut_lineage(_per_block(b, ["_q"], lambda q: dict(zip(("small", "large"), _summary(np.array(q)))),
                                  {"small": "array<long>", "large": "array<long>"})
                       .select("key", "block", "small", "large"))

    def fold(lines, left):
        ok = []
        for q in lines:
            ok.append(0 <= q <= left)
            left -= q if ok[-1] else 0
        return {"ok": ok, "left": left}

    key_type = b.schema["key"].dataType.simpleString()

    def chain(rows):
        """Passes blocks from the known stock on; the last row of a key may be
        the block to look into (``stops``)."""
        cur, s, open_ = object(), None, False
        for r in rows:
            if r["key"] != cur:
                cur, s, open_ = r["key"], r["s"], True
            if not open_:
                continue
            k = _class(s)
            at = min(k, len(r["small"]) - 1)
            takes, fits = r["small"][at], 0 <= r["large"][at] <= s
            stops = fits or (takes > 0 and s - takes <= (1 << k) // 2)
            yield r["key"], r["block"], s, stops
            s, open_ = s - takes, not stops

    # every key's first block is looked into; then its chain runs to the next
    first = sums.groupBy("key").agg(F.min("block").alias("block")).join(s0, "key")
    found, cur = [], cut_lineage(first.select("key", "block", "s"))
    while not cur.isEmpty():
        found.append(cur)
        after = _per_block(b.select("key", "block", "_q").join(cur.select("block", "s"), "block"), ["_q", "s"], fold,
                           {"ok": "array<boolean>", "left": "long"}).select(
            "key", F.col("block").alias("at"), F.col("left").alias("s"))
        passed = cut_lineage(_streamed(
            sums.join(after, "key").where(F.col("block") > F.col("at")), chain,
            f"key {key_type}, block long, s long, stops boolean"))
        found.append(passed.where("not stops").drop("stops"))
        cur = passed.where("stops").drop("stops")
    starts = found[0]
    for x in found[1:]:
        starts = starts.unionByName(x)
    out = cut_lineage(_per_block(b.join(starts.select("block", "s"), "block"), ["_q", "s"], fold,
                                 {"ok": "array<boolean>", "left": "long"}))
    left = out.groupBy("key").agg(F.min("left").alias("stock_left"))
    return (out.select("key", F.explode(F.arrays_zip(F.col(order), F.col(qty), "ok")).alias("z"))
            .select("key", F.col(f"z.{order}").alias(order), F.col(f"z.{qty}").alias(qty),
                    F.col("z.ok").alias("allocated"))
            .join(left, "key").withColumnRenamed("key", product)
            .withColumn("is_available", F.col("stock_left") > 0))


# ------------------------------------------------------------------- I14
def rate_limit(requests: DataFrame, client: str, ts: str, max_requests: int, window_seconds: int) -> DataFrame:
    """``client, ts, accepted``: a request is accepted while fewer than
    ``max_requests`` accepted ones lie in (t - W, t]; rejected ones do not
    count.  A request without a time is not decided (null)."""
    w = window_seconds * 1_000_000
    b = blocks(requests.where(F.col(ts).isNotNull()).withColumn("_t", F.unix_micros(F.col(ts).cast("timestamp"))), client, ["_t"], ["_t", ts])

    b = b.withColumn("part", F.shiftright("block", 33))  # the range partition a block was cut in
    key_type = b.schema["key"].dataType.simpleString()

    def fold(times, start):
        live, ok, i = list(start), [False] * len(times), 0
        while max_requests > 0 and i < len(times):
            if len(live) >= max_requests:  # none is accepted before the oldest that counts has left
                i = bisect_left(times, live[-max_requests] + w, i)
                if i == len(times):
                    break
            ok[i] = True
            live.append(times[i])
            i += 1
        return {"ok": ok, "end": live[bisect_right(live, times[-1] - w):]}

    def carry(rows):
        """Every block with the start it has once ``start`` of its key's first
        block in the partition is carried on to it."""
        part = key = live = None
        for r in rows:
            if part != r["part"] or not (key == r["key"] or key != key and r["key"] != r["key"]):
                part, key, live = r["part"], r["key"], r["start"]
            end = fold(r["_t"], live)["end"]
            yield key, part, r["block"], r["_t"][0], live, end
            live = end

    def carried_on(starts):
        """(every block's start, one row for each key and partition)"""
        whole = starts.repartition("part").sortWithinPartitions("block")
        each = _streamed(whole.select("key", "part", "block", "_t", "start"), carry,
                         f"key {key_type}, part long, block long, t0 long, start array<long>, end array<long>")
        return each, each.groupBy("key", "part").agg(
            F.min("t0").alias("t0"), F.min_by("start", "block").alias("start"), F.max_by("end", "block").alias("end"))

    along = Window.partitionBy("key").orderBy("part")
    none = F.array().cast("array<long>")
    #: what of the predecessor's end still counts at a partition's first request
    came = F.filter(F.coalesce(F.lag("end").over(along), none), lambda a: a > F.col("t0") - w)
    cols = ["key", "part", "t0", "start", "end"]
    runs = cut_lineage(carried_on(b.withColumn("start", none))[1].select(*cols))
    started = lambda s: b.join(
        s.select(F.col("key").alias("_k"), F.col("part").alias("_p"), "start"),
        F.col("key").eqNullSafe(F.col("_k")) & (F.col("part") == F.col("_p")))
    while True:
        now = runs.withColumn("new", came)
        changed = F.col("new") != F.col("start")
        starts = now.where(changed).select("key", "part", F.col("new").alias("start"))
        if starts.isEmpty():
            break
        again = carried_on(started(starts))[1]
        runs = cut_lineage(now.where(~changed).select(*cols).unionByName(again.select(*cols)))
    runs = cut_lineage(carried_on(started(runs))[0].select("block", "start"))
    out = {"ok": "array<boolean>", "end": "array<long>"}
    done = _per_block(b.join(runs.select("block", "start"), "block"), ["_t", "start"], fold, out)
    unknown = requests.where(F.col(ts).isNull()).select(client, ts, F.lit(None).cast("boolean").alias("accepted"))
    return done.select("key", F.explode(F.arrays_zip(F.col(ts).alias("ts"), "ok")).alias("z")).select(
        F.col("key").alias(client), F.col("z.ts").alias(ts), F.col("z.ok").alias("accepted")).unionByName(unknown)


# ------------------------------------------------------------------- I15
def carried(reads: DataFrame, writes: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """Every read with the last write at or before it for the same key:
    ``key, ts, <other columns of reads>, written_at, value``.  Writes of one
    time are ordered by value, the largest counts; rows with a null key or time meet
    nothing."""
    extra = [c for c in reads.columns if c not in (key, ts)]
    t = {c: writes.schema[c].dataType.simpleString() for c in (ts, value)}
    payload = F.struct(*[F.col(c) for c in extra]) if extra else F.lit(None).cast("string")
    r = reads.select(F.col(key).alias("key"), F.col(ts).alias("t"), F.lit(True).alias("reads"), payload.alias("row"),
                     F.lit(None).cast(t[value]).alias("v"))
    w = writes.select(F.col(key).alias("key"), F.col(ts).alias("t"), F.lit(False).alias("reads"),
                      F.lit(None).cast(r.schema["row"].dataType).alias("row"), F.col(value).alias("v"))
    order = ["key", "t", "reads", "v"]
    key_type, row_type = (r.schema[c].dataType.simpleString() for c in ("key", "row"))

    def run(batches):
        """Reads with the write found here, and one row (kind 1) with the last
        write of the partition's last key."""
        from pyspark import TaskContext
        pid, last_key, last = TaskContext.get().partitionId(), None, None
        schema = None
        for b in batches:
            if not b.num_rows:
                continue
            keys, n = b.column("key"), b.num_rows
            new = _starts(keys)
            run_of = np.maximum.accumulate(np.where(new, np.arange(n), 0))
            is_write = ~b.column("reads").to_numpy(zero_copy_only=False).astype(bool)
            at = np.maximum.accumulate(np.where(is_write, np.arange(n), -1))
            here = at >= run_of
            goes_on = last_key is not None and last_key[0].as_py() == keys[0].as_py()
            pool_t, pool_v = b.column("t"), b.column("v")
            take = pa.array(np.where(here, at, 0), mask=~here)
            wt, wv = pool_t.take(take), pool_v.take(take)
            if goes_on and last is not None:  # the first key's write of an earlier batch
                early = pa.array((run_of == 0) & ~here)
                wt, wv = pc.if_else(early, last[0][0], wt), pc.if_else(early, last[1][0], wv)
            keep = pa.array(~is_write)
            cols = [pa.array(np.zeros(n, np.int32)), pa.array(np.full(n, pid, np.int64)), keys, pool_t,
                    b.column("row"), wt, wv]
            schema = ["kind", "pid", "key", "t", "row", "wt", "wv"]
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in cols], schema)
            types = [c.type for c in cols]
            if wt[n - 1].is_valid:
                last = wt.slice(n - 1, 1), wv.slice(n - 1, 1)
            elif not (goes_on and run_of[-1] == 0):
                last = None
            last_key = keys.slice(n - 1, 1)
        if schema and last is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([1], pa.int32()), pa.array([pid], pa.int64()), last_key, pa.nulls(1, types[3]),
                 pa.nulls(1, types[4]), *last], schema)

    # a key's first rows in a partition look to its last write in earlier ones
    dealt = r.unionByName(w).where("key is not null and t is not null").repartitionByRange(*order).sortWithinPartitions(*order)
    out = cut_lineage(dealt.mapInArrow(run, f"kind int, pid long, key {key_type}, t {t[ts]}, row {row_type}, "
                                            f"wt {t[ts]}, wv {t[value]}"))
    ends = out.where("kind = 1").select("key", "pid", "wt", "wv")
    open_ = out.where("kind = 0 and wt is null")
    carry = (open_.select("key", "pid").distinct().select("key", "pid", F.lit(True).alias("asks"),
                                                          F.lit(None).cast(t[ts]).alias("wt"),
                                                          F.lit(None).cast(t[value]).alias("wv"))
             .unionByName(ends.withColumn("asks", F.lit(False)))
             .withColumn("w", F.last(F.when(~F.col("asks"), F.struct("wt", "wv")), ignorenulls=True).over(
                 Window.partitionBy("key").orderBy("pid", F.desc("asks")).rowsBetween(Window.unboundedPreceding, -1)))
             .where(F.col("asks") & F.col("w").isNotNull()).select("key", "pid", "w"))
    late = open_.drop("wt", "wv").join(carry, ["key", "pid"], "left").select(
        "key", "t", "row", F.col("w.wt").alias("wt"), F.col("w.wv").alias("wv"))
    lost = reads.where(F.col(key).isNull() | F.col(ts).isNull()).select(
        F.col(key).alias("key"), F.col(ts).alias("t"), payload.alias("row"), F.lit(None).cast(t[ts]).alias("wt"),
        F.lit(None).cast(t[value]).alias("wv"))
    found = out.where("kind = 0 and wt is not null").select("key", "t", "row", "wt", "wv")
    return found.unionByName(late).unionByName(lost).select(
        F.col("key").alias(key), F.col("t").alias(ts), *[F.col(f"row.{c}").alias(c) for c in extra],
        F.col("wt").alias("written_at"), F.col("wv").alias(value))
