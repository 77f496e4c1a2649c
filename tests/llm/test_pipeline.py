import zlib

import numpy as np

import corpus_pipeline as P
from corpusgraph.llm import quality_pu, rules, simhash, suffixes
from corpusgraph.llm.packing import VocabularyIds
from corpusgraph.session import cut_lineage

SF = "/root/testdata/sf0.001"


def test_stages_in_order():
    assert [n for n, _ in P.STAGES] == ["quality_rules", "quality_classifier", "simhash_near_dedup",
                                        "suffix_dedup", "packing"]


def test_run_equals_its_operators(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    judged = {r.doc_id for r in rules.judge(docs).where("kept").collect()}
    model = quality_pu.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id in judged}
    texts = {d: t for d, t in texts.items() if model.score(np.array([quality_pu.features(t)]))[0] >= 0.3}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    first = {r.doc_id for r in simhash.near_duplicates(frame).where("doc_id = component_id").collect()}
    texts = {d: t for d, t in texts.items() if d in first}
    cut = suffixes.cut_texts(cut_lineage(spark.createDataFrame(
        [(d, t, None, None, 0) for d, t in texts.items()],
        "doc_id long, text string, lang string, source string, n_chars long")))
    encode = VocabularyIds().ids
    want = {r.doc_id: encode(r.text) + b"\1\0\0\0" for r in cut.collect()}
    pieces = {}
    for r in P.run(spark, SF).collect():
        pieces.setdefault(r.doc_id, []).append(r)
    assert pieces.keys() == want.keys() and len(want) > 50
    for d, rows in pieces.items():
        at = 0
        for r in sorted(rows, key=lambda r: r.start):
            assert r.start == at and r.ids_crc32 == zlib.crc32(want[d][4 * at:4 * (at + r.length)])
            at += r.length
        assert 4 * at == len(want[d])


def test_empty_and_null_documents(spark):
    docs = spark.createDataFrame([(1, None, None, None, None), (1, None, None, None, None),
                                  (None, "x " * 60, "en", "s", 120)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    for frame in (docs, docs.limit(0)):
        for _, stage in P.STAGES[:-1]:
            assert stage(spark, frame, SF).columns == P.COLUMNS
        assert P.STAGES[-1][1](spark, frame, SF).count() == frame.count()
