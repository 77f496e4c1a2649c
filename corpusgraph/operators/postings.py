"""Trigram postings: searches that read only texts that can match.

An index is four written tables in one folder: the texts, partitioned by a
hash of the id and numbered in blocks of ``BLOCK``; ``postings(gram, block,
part)``, one row per different three-byte string of a block, sorted by gram, so
that a lookup reads the row groups of its grams alone; the number of blocks of
each gram; and the texts and bytes of each partition.  A search takes the
literal strings that any match must hold, looks up the rarest of their grams
and scans the partitions and blocks that hold all of them.  A pattern without such a string scans everything; the rows are those
of the plain scan in any case.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusgraph.operators.graph import text_lines
from corpusgraph.session import write_table

#: Grams of a search that are looked up, the rarest ones; texts of a block.
LOOKED_UP, BLOCK = 6, 64


@dataclass
class Index:
    spark: SparkSession
    path: str
    id_col: str
    text_col: str
    schemas: dict[str, str]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(self.schemas[name]).parquet(f"{self.path}/{name}")


def grams_of(data: bytes) -> np.ndarray:
    """The different three-byte strings, as numbers."""
    a = np.frombuffer(data, np.uint8).astype(np.int32)
    return np.unique(a[:-2] << 16 | a[1:-1] << 8 | a[2:]) if len(a) > 2 else np.zeros(0, np.int32)


def build_index(corpus: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
                parts: int = 64) -> Index:
    """Write the index of ``corpus`` below ``path`` (in the checkpoint folder
    without one).  Texts that are null hold nothing; other columns stay out."""
    spark = corpus.sparkSession
    path = path or f"{write_table(spark.range(0), 'postings')}-index"
    part = F.pmod(F.xxhash64(id_col), F.lit(parts)).cast("int")
    kind = corpus.schema[id_col].dataType.simpleString()
    index = Index(spark, path, id_col, text_col, {
        "texts": f"`{id_col}` {kind}, `{text_col}` string, block long, part int",
        "postings": "gram int, block long, part int",
        "counts": "gram int, n long", "parts": "part int, texts long, bytes long"})
    dealt = corpus.select(id_col, F.col(text_col).cast("string").alias(text_col), part.alias("part")).repartition(
        "part", F.pmod(F.xxhash64(id_col, F.lit(1)), F.lit(8))).sortWithinPartitions("part")
    dealt.withColumn("block", F.floor(F.monotonically_increasing_id() / BLOCK)).write.mode("overwrite").partitionBy(
        "part").parquet(f"{path}/texts")
    texts = index.table("texts")

    def run(batches):
        for b in batches:
            block, part = (b.column(c).to_numpy(zero_copy_only=False) for c in (1, 2))
            new = np.flatnonzero((np.diff(block) != 0) | (np.diff(part) != 0)) + 1
            cuts = [0, *new.tolist(), b.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo < hi:
                    found = np.unique(np.concatenate([grams_of(t or b"") for t in b.column(0).slice(lo, hi - lo).to_pylist()]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(found, pa.int32()), pa.array(np.full(len(found), block[lo], np.int64)),
                         pa.array(np.full(len(found), part[lo], np.int32))], ["gram", "block", "part"])

    rows = texts.select(F.col(text_col).cast("binary"), "block", "part").mapInArrow(run, index.schemas["postings"])
    rows.repartitionByRange("gram", "block").sortWithinPartitions("gram", "block").write.mode("overwrite").option(
        "parquet.block.size", 8 << 20).parquet(f"{path}/postings")
    index.table("postings").groupBy("gram").agg(F.count("*").alias("n")).sort("gram").write.mode(
        "overwrite").parquet(f"{path}/counts")
    texts.groupBy("part").agg(F.count("*").alias("texts"), F.sum(F.coalesce(F.octet_length(text_col), F.lit(0))).alias(
        "bytes")).coalesce(1).write.mode("overwrite").parquet(f"{path}/parts")
    return index


def needles(pattern: str) -> list[str]:
    """Strings of three bytes and more that every match of a regular expression
    holds; none if that cannot be told."""
    if re.search(r"\(\?[a-zA-Z-]*[ix]|\\[QEGRXhHvVkpPzZ]|&&|[*+?}]\+", pattern):
        return []  # flags and forms that the parser here reads differently
    try:
        parsed = re._parser.parse(pattern)
    except re.error:
        return []
    found, run = [], []

    def walk(items) -> None:
        for op, arg in items:
            name = str(op)
            if name == "LITERAL" and arg > 31:
                run.append(chr(arg))
                continue
            if name == "SUBPATTERN" and not arg[1] and not arg[2]:
                walk(arg[3])
                continue
            found.append("".join(run))
            run.clear()
            if name in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] > 0:
                walk(arg[2])
                found.append("".join(run))
                run.clear()

    walk(parsed)
    found.append("".join(run))
    return [x for x in dict.fromkeys(found) if len(x.encode()) > 2]


def candidates(index: Index, strings: list[str]) -> DataFrame | None:
    """``block, part`` of the blocks that hold the rarest grams of the strings;
    None if the strings have no grams."""
    grams = sorted({int(g) for s in strings for g in grams_of(s.encode())})
    if not grams:
        return None
    counts = {r["gram"]: r["n"] for r in index.table("counts").where(F.col("gram").isin(grams)).collect()}
    rare = sorted(grams, key=lambda g: (counts.get(g, 0), g))[:LOOKED_UP]
    if any(g not in counts for g in rare):
        return index.table("postings").limit(0).select("block", "part")
    return (index.table("postings").where(F.col("gram").isin(rare)).groupBy("block", "part")
            .agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(rare)).select("block", "part"))


def _texts(index: Index, strings: list[str]) -> DataFrame:
    """The texts to scan; partitions without a candidate are not read."""
    found, texts = candidates(index, strings), index.table("texts")
    if found is None:
        return texts
    parts = [r["part"] for r in found.select("part").distinct().collect()]  # at most the index's partitions
    return texts.where(F.col("part").isin(parts)).join(found, ["block", "part"], "left_semi")


def search_pattern(index: Index, pattern: str) -> DataFrame:
    """``(id, line_no, line)`` of every line matching ``pattern`` (Java regex)."""
    return text_lines(_texts(index, needles(pattern)), index.id_col, index.text_col).where(F.col("line").rlike(pattern))


def find_lines(index: Index, needle: str) -> DataFrame:
    """``(id, line_no, line)`` of lines that hold ``needle``, as ``def name``."""
    return text_lines(_texts(index, [needle]), index.id_col, index.text_col).where(F.col("line").contains(needle))


def find_texts(index: Index, needle: str) -> DataFrame:
    """The ids of texts (names) that hold ``needle``."""
    return _texts(index, [needle]).where(F.col(index.text_col).contains(needle)).select(index.id_col)


def reading(index: Index, strings: list[str]) -> DataFrame:
    """One row: texts and bytes of the whole index, of the partitions a search
    reads and of the texts it scans."""
    parts, found = index.table("parts"), candidates(index, strings)
    if found is None:
        found = index.table("texts").select("block", "part").distinct()
    used = parts.join(found.select("part").distinct(), "part", "left_semi")
    scanned = index.table("texts").join(found, ["block", "part"], "left_semi")
    size = F.coalesce(F.sum(F.coalesce(F.octet_length(index.text_col), F.lit(0))), F.lit(0))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return index.spark.range(1).select(
        parts.agg(zero("texts")).scalar().alias("texts"), parts.agg(zero("bytes")).scalar().alias("bytes"),
        used.agg(zero("bytes")).scalar().alias("bytes_in_read_partitions"),
        scanned.agg(F.count("*")).scalar().alias("texts_scanned"), scanned.agg(size).scalar().alias("bytes_scanned"))
