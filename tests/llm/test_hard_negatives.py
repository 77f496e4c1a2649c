import math

import numpy as np
import pytest

from corpusgraph.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int, score double, rank int"


def test_strassen_is_the_product():
    rng = np.random.default_rng(1)
    for m, k, n in ((1, 1, 1), (0, 5, 3), (4, 0, 4), (37, 65, 101), (128, 64, 96), (2, 300, 70)):
        a, b = rng.integers(-1 << 20, 1 << 20, (m, k)), rng.integers(-1 << 20, 1 << 20, (k, n))
        for leaf in (1, 3, 16):
            assert (H.strassen(a, b, leaf) == a @ b).all()
    a, b = np.full((40, 40), 1 << 25), np.full((40, 40), -(1 << 25))
    assert (H.strassen(a, b, 2) == -40 * (1 << 50)).all()


def test_heaps_keep_the_first_of_equals_and_merge():
    rng = np.random.default_rng(2)
    scores, ids, rids = rng.integers(0, 4, (6, 90)), np.sort(rng.integers(0, 30, 90)), np.arange(90)
    allowed = rng.random((6, 90)) < 0.6
    allowed[2] = False
    h = H.Heaps(6, 5)
    for lo in range(0, 90, 7):
        cut = slice(lo, lo + 7)
        h.add(np.arange(6), scores[:, cut], allowed[:, cut], ids[cut], rids[cut])
    for q in range(6):
        want = sorted((-scores[q, j], ids[j], rids[j]) for j in range(90) if allowed[q, j])[:5]
        got = [(-s, i, r) for s, i, r in zip(h.score[q], h.id[q], h.rid[q]) if s != H.NONE]
        assert got == want


def brute(rows):
    """By definition, over Python integers."""
    part = []
    for n, (i, e, label, *_) in enumerate(rows):
        if i is None or e is None or label is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        e = np.array(e, np.float32).astype(float)
        part.append((n, i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in e]))
    out = []
    for n, i, label, v in part:
        if i % 100:
            continue
        s = [(-sum(x * y for x, y in zip(v, w)), j, m, k) for m, j, k, w in part if m != n]
        for neg, j, m, _ in sorted(x for x in s if x[3] == label)[:5]:
            p = -neg
            near = sorted(x for x in s if x[3] != label and 80 * p <= -100 * x[0] <= 100 * p)[:5]
            out += [(i, j, r, x[1], p, -x[0]) for r, x in enumerate(near, 1)]
    return sorted(out)


def result(df):
    assert df.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("group,part,tile", [(2048, 1024, 1024), (3, 5, 2)])
def test_matches_brute_force_with_ties_and_odd_rows(spark, monkeypatch, group, part, tile):
    for name, x in (("GROUP", group), ("PART", part), ("TILE", tile)):
        monkeypatch.setattr(H, name, x)
    rng = np.random.default_rng(3)
    rows = [(int(i) * 20, [float(x) / 4 for x in rng.integers(-3, 4, 6)], int(rng.integers(0, 3)), 0.0, 0)
            for i in range(140)]
    rows += rows[:12]  # repeated rows, anchors among them
    rows += [(100, [1.0, float("nan")], 1, 0.0, 0), (200, None, 1, 0.0, 0), (300, [1.0, None], 1, 0.0, 0),
             (400, [1.0], None, 0.0, 0), (None, [1.0], 1, 0.0, 0), (500, [], 1, 0.0, 0),
             (600, [0.5, 0.5], 1, 0.0, 0), (700, [0.5] * 9, 2, 0.0, 0), (1, [float("inf")], 1, 0.0, 0)]
    got = result(H.mine(spark.createDataFrame(rows, SCHEMA).repartition(4)))
    assert got == brute(rows) and len(got) > 100


def test_no_rows_no_positives_no_negatives(spark):
    df = spark.createDataFrame([(100, [1.0], 1, 0.0, 0), (101, [1.0], 2, 0.0, 0)], SCHEMA)
    assert result(H.mine(df.limit(0))) == []
    assert result(H.mine(df)) == []  # the anchor has no positive
    assert result(H.mine(df.where("vec_id = 101"))) == []


def test_a_label_with_most_rows_has_many_cells(spark, monkeypatch):
    monkeypatch.setattr(H, "PART", 50)
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(0, 1, 5)], 0 if i % 3 else 1 + i % 4, 0.0, 0)
            for i in range(1, 1200)]
    assert result(H.mine(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
