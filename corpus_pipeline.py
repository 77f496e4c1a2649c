"""Corpus pipeline: raw ``documents`` to packed training windows.

Each stage is one operator of ``corpusgraph.llm`` over all that its
predecessor kept.  Every stage's result is written as Parquet in the shared
checkpoint folder and read again as the next one's documents, so a lost
executor costs at most one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusgraph.llm import quality_pu, rules, simhash, suffixes
from corpusgraph.llm.packing import pack
from corpusgraph.session import cut_lineage
from corpusgraph.sources.tables import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """10: documents that a quality rule rejects go."""
    return rules.kept_documents(docs.select(*COLUMNS))


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """2: documents that the classifier scores below its threshold go.  It is
    trained on the raw corpus as unlabelled text (what is left here is mostly
    good) and on the labels outside the held-out fold."""
    model = quality_pu.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality_pu.kept_documents(docs.select(*COLUMNS), model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """9: of each group of near copies the document with the smallest id stays."""
    return simhash.first_of_each(docs.select(*COLUMNS))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """4: byte strings of 200 that repeat are cut out; documents stay, if empty."""
    return suffixes.cut_texts(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """1: every kept document's ids in windows of 2048."""
    return pack(docs)


STAGES = [
    ("quality_rules", apply_rules),
    ("quality_classifier", classify),
    ("simhash_near_dedup", drop_near_duplicates),
    ("suffix_dedup", cut_repeats),
    ("packing", pack_windows),
]

#: Not expressible in SQL: a trained classifier, XXH64 votes, tokenised windows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
