import zlib

import numpy as np
import pytest

from corpusgraph.llm import quality_pu as Q

SF = "/root/testdata/sf0.01"


def test_features_are_finite_for_any_text():
    for t in (None, "", " ", "\n\n", "a", "é" * 10, "x " * 100_000, "😀%%%"):
        x = Q.features(t)
        assert len(x) == Q.N_FEATURES and np.isfinite(x).all()


def test_prior_and_risk_on_two_known_classes():
    rng = np.random.default_rng(0)
    pos = rng.normal(1.5, 1, (3000, 4))
    unl = np.concatenate([rng.normal(1.5, 1, (2800, 4)), rng.normal(-1.5, 1, (1200, 4))])
    prior = Q.estimate_prior(pos, unl)
    assert 0.6 < prior < 0.8
    model = Q.fit_risk(pos, unl, prior, epochs=20)
    truth = np.arange(len(unl)) < 2800
    assert ((model.score(unl) >= 0.5) == truth).mean() > 0.97


def test_held_out_accuracy_and_folds(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = Q.quality(docs, labels).toPandas()
    assert sorted(got.doc_id) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    joined = got.merge(labels.toPandas(), on="doc_id")
    held = joined[joined.held_out]
    assert (held.predicted == held.quality).mean() > 0.97
    assert (held.predicted[held.quality == 1] == 1).mean() > 0.98


def test_held_out_labels_are_never_read(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.selectExpr(
        "doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 5 = 0, 1 - quality, quality) quality", "toxic")
    a, b = Q.train(docs, labels), Q.train(docs, flipped)
    assert (a.w1 == b.w1).all() and a.b2 == b.b2


@pytest.mark.parametrize("label_rows", [[], [(1, None)], [(1, 1), (1, 0)]])
def test_odd_tables(spark, label_rows):
    docs = spark.createDataFrame([(1, None, 0.0), (1, None, 0.0), (None, "a", 0.0)],
                                 "doc_id long, text string, score double")
    labels = spark.createDataFrame(label_rows, "doc_id long, quality int")
    got = Q.quality(docs, labels).collect()
    assert len(got) == 3 and all(0 <= r.score <= 1 for r in got)
    assert Q.quality(docs.limit(0), labels).count() == 0
    assert Q.kept_documents(docs, None).count() == 3


def test_labels_of_every_document_leave_unlabelled_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where("doc_id < 400")
    labels = docs.selectExpr("doc_id", "cast(length(text) > 300 as int) as quality")
    got = Q.quality(docs, labels).toPandas()
    assert got.score.nunique() > 100 and set(got.predicted) == {0, 1}


def test_prior_counts_every_document(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    x = Q.features("one")
    model = Q.Network(np.zeros_like(x), np.ones_like(x), np.eye(len(x)), np.zeros(len(x)), np.ones(len(x)), 0.0)
    logits = np.array([model.logit(Q.features(r.text)[None])[0] for r in docs.collect()])
    u = np.unique(logits)
    cuts = ((u[1:] + u[:-1]) / 2)[np.diff(u) > 1e-6][::50]
    counts, n = Q._counter(docs)(model, cuts)
    assert n == len(logits) and (counts == [(logits >= c).sum() for c in cuts]).all()
