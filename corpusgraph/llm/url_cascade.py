"""URL verdicts: longest-match rules, then a Bloom filter cascade.

A url that no rule fits is judged by membership of its host in a block list.
Membership is exact and needs no join: the hosts of the whole corpus are the
key universe, and a cascade of Bloom filters is built over it.  Level 0
encodes the listed hosts of the universe; level 1 encodes the unlisted hosts
that level 0 lets through by mistake; level 2 the listed hosts that level 1
lets through; and so on until a level makes no mistake on the keys that it
may be asked about.  The parity of the first level that rejects a key tells
its side, for every key of the universe.

Sizes.  With r listed and s unlisted keys level 0 has a false positive rate
of about r / (s * sqrt 2) and the others 1/2, so a cascade takes about
1.44 r (log2(s / r) + 4) bits: it grows with the list, by the logarithm of
the corpus.  Filters are built in tasks, merged by ``bit_or`` and broadcast
while they take at most ``MAX_BYTES``; a larger list is joined instead.

Defined cases: a null url and one without ``://`` have empty host and path,
which no rule fits; an empty block list allows all; every input row gives one row, repeated rows
included; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from corpusgraph.session import cut_lineage

#: (verdict, host, path)
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Registered names whose hosts, and all their subdomains, are block-listed.
BLOCKED = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
MAX_BYTES, MAX_LEVELS = 64 << 20, 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


# ------------------------------------------------------------- urls and rules
def _rest(url: Column) -> Column:
    """What follows the first ``://``; null without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    host = F.regexp_extract(_rest(url), r"\A[^/?#]*", 0)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"\A[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(host: Column, path: Column, rules=RULES) -> Column:
    """``struct(rule, verdict)`` of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(name + start).alias("rule"),
                                    F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


# ------------------------------------------------------------------- cascade
def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Level:
    """A Bloom filter of ``bits`` bits and ``hashes`` positions per key."""

    number: int
    bits: int
    hashes: int
    words: np.ndarray | None = None

    @classmethod
    def sized(cls, number: int, keys: int, rate: float) -> Level:
        bits = max(64, math.ceil(1.4427 * math.log2(1 / rate) * keys))
        return cls(number, -(-bits // 64) * 64, max(1, round(math.log2(1 / rate))))

    def positions(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        salt = np.uint64(0x9E3779B97F4A7C15 * (2 * self.number + 1) % (1 << 64))
        a, b = _mix(h1.view(np.uint64) ^ salt), _mix(h2.view(np.uint64) ^ salt) | np.uint64(1)
        j = np.arange(self.hashes, dtype=np.uint64)
        return (a[:, None] + j * b[:, None]) % np.uint64(self.bits)

    def has(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        at = self.positions(h1, h2)
        return ((self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) > 0).all(1)


def _hashed(keys: DataFrame) -> DataFrame:
    return keys.select(F.xxhash64("key", F.lit("a")).alias("h1"), F.xxhash64("key", F.lit("b")).alias("h2"))


def _encode(level: Level, hashed: DataFrame) -> Level:
    """Fill a level: each task merges its keys, ``bit_or`` merges the tasks."""
    def run(batches):
        for b in batches:
            at = level.positions(b.column(0).to_numpy(), b.column(1).to_numpy()).ravel()
            word, where = np.unique(at >> np.uint64(6), return_inverse=True)
            bits = np.zeros(len(word), np.uint64)
            np.bitwise_or.at(bits, where, np.uint64(1) << (at & np.uint64(63)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(word.view(np.int64)), pa.array(bits.view(np.int64))], ["word", "bits"])

    merged = (hashed.mapInArrow(run, "word long, bits long").groupBy("word")
              .agg(F.bit_or("bits").alias("bits")).toPandas())
    words = np.zeros(level.bits // 64, np.int64)
    words[merged["word"].to_numpy()] = merged["bits"].to_numpy()
    return Level(level.number, level.bits, level.hashes, words.view(np.uint64))


def _let_through(level: Level, hashed: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            yield b.filter(pa.array(level.has(b.column(0).to_numpy(), b.column(1).to_numpy())))

    return hashed.mapInArrow(run, "h1 long, h2 long")


def build_cascade(listed: DataFrame, unlisted: DataFrame,
                  max_bytes: int = MAX_BYTES) -> list[Level] | None:
    """Levels over the two sides of the universe (each ``key``, distinct), or
    None where they would take more than ``max_bytes``."""
    inside, outside = cut_lineage(_hashed(listed)), cut_lineage(_hashed(unlisted))
    levels: list[Level] = []
    r, s = inside.count(), outside.count()
    rate = min(0.5, r / (max(1, s) * math.sqrt(2)))
    while r:
        if len(levels) == MAX_LEVELS:
            raise ValueError("keys of both sides share a hash")
        level = Level.sized(len(levels), r, rate)
        if level.bits // 8 + sum(x.bits // 8 for x in levels) > max_bytes:
            return None
        level = _encode(level, inside)
        levels.append(level)
        mistaken = cut_lineage(_let_through(level, outside))
        inside, outside, rate = mistaken, inside, 0.5
        r = inside.count()
    return levels


def is_listed(levels: list[Level], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Exact for keys of the universe: the first level that rejects a key
    has an odd number if the key is listed."""
    out = np.full(len(h1), len(levels) % 2 == 1)
    open_ = np.arange(len(h1))
    for level in levels:
        has = level.has(h1[open_], h2[open_])
        out[open_[~has]] = level.number % 2 == 1
        open_ = open_[has]
    return out


# -------------------------------------------------------------------- verdicts
def judge_urls(pages: DataFrame, rules: Iterable = RULES, blocked: Iterable[str] = BLOCKED,
               max_bytes: int = MAX_BYTES) -> DataFrame:
    """``page_id, host, path, rule, verdict``.  A host is on the block list if
    one of its labels before the last is a blocked name."""
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"),
                        host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    universe = cut_lineage(rows.select(F.col("host").alias("key")).distinct())
    labels = F.split("key", r"\.")
    named = F.arrays_overlap(F.slice(labels, 1, F.greatest(F.size(labels) - 1, F.lit(0))),
                             F.array(*map(F.lit, blocked)).cast("array<string>"))
    listed, unlisted = universe.where(named), universe.where(~named)
    found = matched_rule(F.col("host"), F.col("path"), tuple(rules))
    rows = rows.withColumn("_rule", found)
    levels = build_cascade(listed, unlisted, max_bytes)
    if levels is None:
        marked = rows.join(listed.select(F.col("key").alias("host"), F.lit(True).alias("listed")),
                           "host", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    else:
        shared = spark.sparkContext.broadcast(levels)

        def run(batches):
            for b in batches:
                hit = is_listed(shared.value, b.column("h1").to_numpy(), b.column("h2").to_numpy())
                yield pa.RecordBatch.from_arrays(
                    [*b.columns[:5], pa.array(hit)], [*b.schema.names[:5], "listed"])

        marked = rows.select(
            "page_id", "host", "path", F.col("_rule.rule").alias("rule"),
            F.col("_rule.verdict").alias("rule_verdict"),
            F.xxhash64("host", F.lit("a")).alias("h1"), F.xxhash64("host", F.lit("b")).alias("h2")
        ).mapInArrow(run, "page_id long, host string, path string, rule string, "
                          "rule_verdict string, listed boolean")
        return marked.select("page_id", "host", "path", "rule", _verdict(F.col("rule_verdict")))
    return marked.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"),
                         _verdict(F.col("_rule.verdict")))


def _verdict(by_rule: Column) -> Column:
    return F.coalesce(by_rule, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict")
