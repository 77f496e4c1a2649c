"""Structured Streaming forms of the time-based operators (K1–K4).

* K1 ``rate_limit_stream`` — per-client sliding-window limiter as a
  ``transformWithStateInPandas`` processor.  The state is the accepted
  times still inside the window (at most ``max_requests`` per client) and the
  newest time decided; with ``expire`` (for streams that run on; a run over
  a table would wait for the clock) it goes after a window without requests.
  Within a micro-batch requests are decided in time order; one that comes after a later
  one was decided gets no decision (null) and belongs in a side table.
* K2 ``resample_stream`` — tumbling event-time windows with a watermark;
  append mode emits closed windows, update mode also open ones.
* K3 ``latest_value_stream`` — keyed latest value; with ``expire`` its state
  goes with it.  ``lifetimes_stream`` — every value's life until it is replaced
  or expires, by event-time timers.
* K4 ``expiry_sweep_stream`` — rows already expired at the sweep time.
  ``expiry_timer_stream`` — rows that expire as the watermark passes them.
* ``split_late`` — rows behind the watermark go to a side table.

Sources are file streams over tables, each a file or a folder of files.  By
default one run takes all new files as one micro-batch, so the order in which
files are listed cannot make rows late.  Sinks are parquet tables in the
session's (shared) checkpoint folder, read back as batch DataFrames.  Runs whose
micro-batches may be out of order pass ``split_late`` first, which keeps late
rows; a run that dropped any fails with their number, so none vanish silently.
Streams belong to a session of their own that has the caller's settings and the
state store the processors need; the caller's session is not changed.
``withWatermark`` needs ``timestamp`` (not ``timestamp_ntz``), so event times
are cast with the session time zone.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from corpusgraph.session import ensure_checkpoint_dir

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_session(spark: SparkSession) -> SparkSession:
    """A session beside ``spark`` with its settings and the RocksDB state store."""
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if own.conf.isModifiable(key):
            own.conf.set(key, value)
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    own.conf.set("spark.sql.streaming.numRecentProgressUpdates", "1000000")  # run_to_table reads all of them
    own.home = spark  # tables are read back here
    return own


def table_stream(spark: SparkSession, sf_dir: str, name: str,
                 max_files_per_trigger: int | None = None) -> DataFrame:
    """A table as a file stream (schema taken from the files)."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()
    reader = stream_session(spark).readStream.schema(spark.read.parquet(path).schema)
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    if folder:
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def _folder(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex}"


def split_late(stream: DataFrame, ts: str, delay: str, name: str) -> tuple[DataFrame, DataFrame]:
    """(stream of the rows on time, batch table of the late ones).

    A row is late if a row of an earlier micro-batch lies more than ``delay``
    after it.  Each micro-batch writes its rows of both kinds and the newest
    event time it saw, one row; the next ones read that.  A repeated batch
    replaces its own folders.  The returned stream takes up the micro-batches
    in order, so none of its rows is behind the same watermark again.  Rows
    without a time are on time.
    """
    spark = stream.sparkSession
    base, schema = _folder(spark, name), stream.schema
    t = F.col(ts).cast("timestamp")

    def write(rows: DataFrame, batch: int) -> None:
        own = rows.sparkSession
        before = own.createDataFrame([], "newest timestamp, part long") if batch == 0 else \
            own.read.schema("newest timestamp, part long").parquet(f"{base}/newest")
        newest = before.where(F.col("part") < batch).agg(F.max("newest")).first()[0]
        late = F.coalesce(t < F.lit(newest).cast("timestamp") - F.expr(f"INTERVAL {delay}"), F.lit(False))
        rows.where(~late).write.mode("overwrite").parquet(f"{base}/on_time/part={batch}")
        rows.where(late).write.mode("overwrite").parquet(f"{base}/late/part={batch}")
        rows.agg(F.max(t).alias("newest")).write.mode("overwrite").parquet(f"{base}/newest/part={batch}")

    query = (stream.writeStream.option("checkpointLocation", f"{base}/ckpt").foreachBatch(write)
             .trigger(availableNow=True).start())
    query.awaitTermination()
    home = getattr(spark, "home", spark)
    flat = lambda r: r.schema(schema).option("recursiveFileLookup", "true")
    return flat(spark.readStream).parquet(f"{base}/on_time"), flat(home.read).parquet(f"{base}/late")


def run_to_table(stream: DataFrame, name: str, output_mode: str = "append") -> DataFrame:
    """Run ``stream`` with ``availableNow`` into a parquet table under the
    checkpoint folder; return that table as a batch DataFrame.  In update
    mode a column ``_batch`` tells the micro-batch that wrote a row."""
    spark = stream.sparkSession
    base = _folder(spark, name)
    writer = stream.writeStream.option("checkpointLocation", f"{base}/ckpt").outputMode(output_mode)
    if output_mode == "append":
        writer = writer.format("parquet").option("path", f"{base}/out")
        written = stream.schema
    else:
        written = StructType([*stream.schema.fields, StructField("_batch", LongType())])

        def write(rows: DataFrame, batch: int) -> None:
            # a repeated batch replaces its own folder
            rows.withColumn("_batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(
                f"{base}/out/part={batch}")

        writer = writer.foreachBatch(write)
    q = writer.trigger(availableNow=True).start()
    q.awaitTermination()
    late = sum(op["numRowsDroppedByWatermark"] for p in q.recentProgress for op in p["stateOperators"])
    if late:
        raise RuntimeError(f"{late} rows came after their watermark")
    return getattr(spark, "home", spark).read.schema(written).option("recursiveFileLookup", "true").parquet(f"{base}/out")


def _ship() -> None:
    """The processors travel to the Python workers by value, so the workers
    need not have this package installed."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])


# ------------------------------------------------------------------ K1
class RateLimiter(StatefulProcessor):
    """Accept a request while fewer than ``max_requests`` accepted requests
    lie in (t − W, t]; rejected requests do not count.  Only the times of a
    client's micro-batch are held, eight bytes each."""

    def __init__(self, max_requests: int, window_seconds: int, expire: bool = False) -> None:
        self.max_requests = max_requests
        self.window_us = window_seconds * 1_000_000
        self.ttl_ms = self.window_us // 1000 if expire else None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("accepted", "ts ARRAY<BIGINT>, decided BIGINT",
                                          ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times = np.sort(np.concatenate([part["t_us"].to_numpy(np.int64) for part in rows]))
        live, decided = self.state.get() if self.state.exists() else ([], -1 << 62)
        live, verdicts = list(live), []
        for t in times.tolist():
            if t < decided:
                verdicts.append(None)
                continue
            live = [a for a in live if a > t - self.window_us]
            verdicts.append(len(live) < self.max_requests)
            if verdicts[-1]:
                live.append(t)
        self.state.update((live, max(decided, int(times[-1]))))
        for at in range(0, len(times), 10_000):
            part = slice(at, at + 10_000)
            yield pd.DataFrame({"client": key[0], "ts": pd.to_datetime(times[part], unit="us", utc=True),
                                "accepted": pd.Series(verdicts[part], dtype="boolean")})

    def close(self) -> None:
        pass


def rate_limit_stream(requests: DataFrame, client: str, ts: str, max_requests: int,
                      window_seconds: int, expire: bool = False) -> DataFrame:
    """K1: streaming ``(client, ts, accepted)``; ``accepted`` is null for a
    request that came after a later one was decided."""
    _ship()
    src = requests.select(F.col(client).alias("client"),
                          F.unix_micros(F.col(ts).cast("timestamp")).alias("t_us"))
    return (src.groupBy("client").transformWithStateInPandas(
        RateLimiter(max_requests, window_seconds, expire),
        outputStructType=f"client {requests.schema[client].dataType.simpleString()}, "
                         "ts timestamp, accepted boolean",
        outputMode="Append", timeMode="ProcessingTime" if expire else "None"))


# ------------------------------------------------------------------ K2
def resample_stream(stream: DataFrame, ts: str, value: str, window: str = "1 day",
                    delay: str = "1 hour") -> DataFrame:
    """K2: tumbling-window mean/sum/count with a watermark (append mode)."""
    s = stream.withColumn("_et", F.col(ts).cast("timestamp")).withWatermark("_et", delay)
    return (s.groupBy(F.window("_et", window).alias("w"))
            .agg(F.avg(value).alias("mean"), F.sum(value).alias("sum"),
                 F.count("*").alias("n"))
            .select(F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                    F.col("w.end").cast("timestamp_ntz").alias("window_end"),
                    "mean", "sum", "n"))


# ------------------------------------------------------------------ K3, K4
class LatestValue(StatefulProcessor):
    """Newest value per key; emits it with its expiry (written + ttl)."""

    def __init__(self, ttl_seconds: int, expire: bool = False) -> None:
        self.ttl_us = ttl_seconds * 1_000_000
        self.ttl_ms = self.ttl_us // 1000 if expire else None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.latest = handle.getValueState("latest", "t_us BIGINT, value DOUBLE",
                                           ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        cur = self.latest.get() if self.latest.exists() else None
        for part in rows:  # one Arrow batch at a time
            top = part.sort_values(["t_us", "value"], kind="stable").iloc[-1]
            top = (int(top["t_us"]), float(top["value"]))
            cur = top if cur is None or top >= tuple(cur) else cur
        self.latest.update(tuple(cur))
        yield pd.DataFrame({"key": [key[0]],
                            "written_us": [cur[0]], "value": [cur[1]],
                            "expires_us": [cur[0] + self.ttl_us]})

    def close(self) -> None:
        pass


def latest_value_stream(changes: DataFrame, key: str, ts: str, value: str,
                        ttl_seconds: int, expire: bool = False) -> DataFrame:
    """K3: per key the newest value and its expiry time; one appended row
    per key and micro-batch (the newest row per key is the current view)."""
    _ship()
    src = changes.select(F.col(key).alias("key"),
                         F.unix_micros(F.col(ts).cast("timestamp")).alias("t_us"),
                         F.col(value).cast("double").alias("value"))
    return src.groupBy("key").transformWithStateInPandas(
        LatestValue(ttl_seconds, expire),
        outputStructType=f"key {changes.schema[key].dataType.simpleString()}, written_us bigint, "
                         "value double, expires_us bigint",
        outputMode="Append", timeMode="ProcessingTime" if expire else "None")


class Lifetimes(StatefulProcessor):
    """The lives of a key's values, in order of event time.

    A write ends the value before it, as ``replaced`` at its own time, or as
    ``expired`` a time-to-live after it was written if that is earlier.  Writes
    wait in the state (16 bytes each) until the watermark has passed them, so
    the outcome does not depend on the micro-batches; the value that lives then
    ends by a timer."""

    def __init__(self, ttl_seconds: int) -> None:
        self.ttl_us = ttl_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", "t ARRAY<BIGINT>, v ARRAY<DOUBLE>")
        self.live = handle.getValueState("live", "t BIGINT, v DOUBLE")

    def _advance(self, key, t: list, v: list, watermark_ms: int) -> Iterator[pd.DataFrame]:
        """Process the waiting writes that the watermark has passed."""
        now = watermark_ms * 1000
        order = sorted(range(len(t)), key=lambda i: (t[i], v[i] is not None, v[i] or 0.0))
        due = [i for i in order if t[i] <= now]
        rest = [i for i in order if t[i] > now]
        live = tuple(self.live.get()) if self.live.exists() else None
        ended = []
        for i in due:
            if live is not None:
                end = min(t[i], live[0] + self.ttl_us)
                ended.append((*live, end, t[i] <= live[0] + self.ttl_us))
            live = (t[i], v[i])
        if live is not None and live[0] + self.ttl_us < now:
            ended.append((*live, live[0] + self.ttl_us, False))
            live = None
        self.waiting.clear()
        if rest:
            self.waiting.update(([t[i] for i in rest], [v[i] for i in rest]))
        self.live.clear()
        if live is not None:
            self.live.update(live)
        wake = [t[rest[0]]] if rest else []
        wake += [live[0] + self.ttl_us + 1] if live is not None else []
        for us in wake:  # the first whole millisecond from then on
            self.handle.registerTimer(-(-us // 1000))
        if ended:
            yield pd.DataFrame({"key": [key[0]] * len(ended), "written_us": [e[0] for e in ended],
                                "value": pd.Series([e[1] for e in ended], dtype="float64"),
                                "ended_us": [e[2] for e in ended], "replaced": [e[3] for e in ended]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        t, v = (list(x) for x in self.waiting.get()) if self.waiting.exists() else ([], [])
        for part in rows:
            t += part["t_us"].astype("int64").tolist()
            v += [None if pd.isna(x) else float(x) for x in part["value"]]
        yield from self._advance(key, t, v, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        t, v = (list(x) for x in self.waiting.get()) if self.waiting.exists() else ([], [])
        yield from self._advance(key, t, v, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def lifetimes_stream(changes: DataFrame, key: str, ts: str, value: str, ttl_seconds: int,
                     delay: str = "1 hour") -> DataFrame:
    """K3: ``key, written_us, value, ended_us, reason`` of every value whose end
    the watermark has passed; writes of one time are ordered by value.  Writes
    without a time are left out."""
    _ship()
    src = (changes.where(F.col(ts).isNotNull())
           .select(F.col(key).alias("key"), F.col(ts).cast("timestamp").alias("_et"),
                   F.unix_micros(F.col(ts).cast("timestamp")).alias("t_us"), F.col(value).cast("double").alias("value"))
           .withWatermark("_et", delay))
    out = src.groupBy("key").transformWithStateInPandas(
        Lifetimes(ttl_seconds),
        outputStructType=f"key {changes.schema[key].dataType.simpleString()}, written_us bigint, "
                         "value double, ended_us bigint, replaced boolean",
        outputMode="Append", timeMode="EventTime")
    return out.select("key", "written_us", "value", "ended_us",
                      F.when(F.col("replaced"), "replaced").otherwise("expired").alias("reason"))


def lifetimes(changes: DataFrame, key: str, ts: str, value: str, ttl_seconds: int,
              delay: str = "1 hour") -> DataFrame:
    """K3 as a batch: the same rows from a finished table, whose newest time
    less ``delay`` (to the millisecond) is the watermark."""
    w = changes.where(F.col(ts).isNotNull()).select(
        F.col(key).alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("written_us"),
        F.col(value).cast("double").alias("value"))
    newest = changes.agg(F.max(F.col(ts).cast("timestamp")).alias("t")).select(
        F.unix_millis(F.col("t") - F.expr(f"INTERVAL {delay}")) * 1000).scalar()
    along = Window.partitionBy("key").orderBy("written_us", "value")
    ttl = ttl_seconds * 1_000_000
    ended = F.col("written_us") + ttl
    return (w.withColumn("mark", newest).where(F.col("written_us") <= F.col("mark"))
            .withColumn("next", F.lead("written_us").over(along))
            .select("key", "written_us", "value", F.coalesce(F.least("next", ended), ended).alias("ended_us"),
                    F.when(F.col("next") <= ended, "replaced").otherwise("expired").alias("reason"),
                    "mark", "next")
            .where(F.col("next").isNotNull() | (F.col("ended_us") < F.col("mark"))).drop("mark", "next"))


class Expiring(StatefulProcessor):
    """Holds the rows of a bucket until the watermark has passed their expiry.
    The state is a list of chunks of rows and how often each came, so a
    micro-batch costs a bucket a few calls and not some for each row."""

    CHUNK = 4096

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "expires_us ARRAY<BIGINT>, rows ARRAY<STRING>, n ARRAY<BIGINT>")
        self.next = handle.getValueState("next", "ms BIGINT")

    def _wake(self, ms: int) -> None:
        """A timer at the earliest expiry that is held."""
        self.next.update((ms,))
        self.handle.registerTimer(ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            came: dict = {}
            for x in zip(part["expires_us"].astype("int64").tolist(), part["row_key"].tolist()):
                came[x] = came.get(x, 0) + 1
            held = [(us, x, n) for (us, x), n in came.items()]
            for at in range(0, len(held), self.CHUNK):
                self.held.appendValue(tuple(map(list, zip(*held[at:at + self.CHUNK]))))
            low = min(us for us, _, _ in held)
            first = low if first is None else min(first, low)
        ms = first // 1000 + 1
        if self.next.exists():
            was = self.next.get()[0]
            if was <= ms:
                return iter(())
            self.handle.deleteTimer(was)
        self._wake(ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        rest, first = [], None
        for chunk in self.held.get():
            chunk = list(zip(*chunk))
            out = [x for x in chunk if x[0] // 1000 + 1 <= now]
            left = [x for x in chunk if x[0] // 1000 + 1 > now]
            if out:
                yield pd.DataFrame({"row_key": [x for _, x, _ in out], "n": [n for _, _, n in out]})
            if left:
                rest.append(tuple(map(list, zip(*left))))
                low = min(rest[-1][0])
                first = low if first is None else min(first, low)
        self.next.clear()
        if rest:
            self.held.put(rest)
            self._wake(first // 1000 + 1)
        else:
            self.held.clear()

    def close(self) -> None:
        pass


#: Buckets that rows of one day of expiry are dealt into.
EXPIRY_BUCKETS = 8


def expiry_timer_stream(stream: DataFrame, ts: str, expires_col: str, delay: str = "1 hour") -> DataFrame:
    """K4: the rows whose expiry the watermark has passed, each one time for
    each time it came.  Rows are kept by day of expiry and hash of the row, so
    neither a recipient nor a day is a hot key.  Rows without an expiry never
    expire."""
    _ship()
    cols = list(stream.columns)
    src = (stream.where(F.col(expires_col).isNotNull())
           .select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("row_key"),
                   F.col(ts).cast("timestamp").alias("_et"),
                   F.unix_micros(F.col(expires_col).cast("timestamp")).alias("expires_us"))
           .withColumn("day", F.floor(F.col("expires_us") / 86_400_000_000))
           .withColumn("bucket", F.pmod(F.xxhash64("row_key"), F.lit(EXPIRY_BUCKETS)))
           .withWatermark("_et", delay))
    out = src.groupBy("day", "bucket").transformWithStateInPandas(
        Expiring(), outputStructType="row_key string, n bigint", outputMode="Append", timeMode="EventTime")
    return out.select(F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("_i"),
                      F.from_json("row_key", stream.schema.simpleString()).alias("r")).select("r.*")


def expiry_sweep_stream(stream: DataFrame, expires_col: str, as_of) -> DataFrame:
    """K4: rows already expired at ``as_of`` (null expiry never expires),
    marked with the sweep time; a stateless streaming filter."""
    expired = F.coalesce(F.lit(as_of).cast("timestamp_ntz") > F.col(expires_col), F.lit(False))
    return stream.where(expired).withColumn("swept_at", F.lit(as_of).cast("timestamp_ntz"))
