"""Source trees as corpus tables.

``scan_tree`` lists files with the ``binaryFile`` source — recursive,
extension glob, size filter (pushed into the file listing) — and prunes
excluded directory *names* at any depth below the root.  ``decode_text``
keeps strictly valid UTF-8 files and routes the rest to a reject table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# ---- fixed values: directory names never descended into, size bound ----
EXCLUDED_DIRS = ("__pycache__", ".git", ".venv", "venv", "node_modules", ".pytest_cache")
MAX_FILE_BYTES = 1_000_000  # inclusive
INCLUDED_EXTENSIONS = (".py",)
# -------------------------------------------------------------------------


def scan_tree(spark: SparkSession, root: str, extensions=INCLUDED_EXTENSIONS,
              excluded_dirs=EXCLUDED_DIRS, max_bytes: int = MAX_FILE_BYTES,
              with_content: bool = True) -> DataFrame:
    """A1: ``path`` (relative to root), ``length`` [, ``content`` binary]."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if len(extensions) == 1:
        reader = reader.option("pathGlobFilter", f"*{extensions[0]}")
    df = reader.load(root)
    prefix = root.rstrip("/") + "/"
    rel = F.regexp_replace(F.col("path"), r"^(file:)?(//)?", "")
    rel = F.when(rel.startswith(prefix), F.substring(rel, len(prefix) + 1, 1 << 30)).otherwise(rel)
    dirs = F.slice(F.split(rel, "/"), 1, F.greatest(F.size(F.split(rel, "/")) - 1, F.lit(0)))
    excluded = F.exists(dirs, lambda d: d.isin(*excluded_dirs))
    ext_ok = None
    for e in extensions:
        c = rel.endswith(e)
        ext_ok = c if ext_ok is None else ext_ok | c
    cols = [rel.alias("path"), F.col("length")]
    if with_content:
        cols.append(F.col("content"))
    return (df.where(F.col("length") <= max_bytes)
            .select(*cols, excluded.alias("_x"), ext_ok.alias("_e"))
            .where(~F.col("_x") & F.col("_e")).drop("_x", "_e"))


def decode_text(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A2: (corpus(path, content string), rejects(path, reason)) — strict
    UTF-8; an undecodable file is a reject, not an error."""
    s = F.col("content").cast("string")
    valid = F.is_valid_utf8(s)
    corpus = files.where(valid).select("path", s.alias("content"))
    rejects = files.where(~valid).select("path", F.lit("invalid_utf8").alias("reason"))
    return corpus, rejects


def corpus_from_table(df: DataFrame, path_col: str, text_col: str) -> DataFrame:
    """Any table with a key and a text column as a corpus ``(path, content)``."""
    return df.select(F.col(path_col).cast("string").alias("path"),
                     F.col(text_col).alias("content"))
