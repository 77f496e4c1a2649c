import itertools
import random
import time

import numpy as np
import pytest

from corpusgraph.llm import nbest as N

WORDS = ["▁the", "▁thanedble,", "▁è", "\n", "▁▁▁x", "▁aaaaaa", "中文", "▁une", "a", "▁"]
TEXTS = ["the cat", "a a a", "The é.\nxx", "  two  spaces ", "aa aa", "a", "", "x\n\ny", "😀 ok"]


@pytest.fixture(scope="module")
def lattice():
    return N.Lattice()


def all_paths(lattice, word):
    def back(e):
        if not e:
            yield 0.0, ()
        for s, w, ids in lattice._into(word, e) if e else ():
            for score, path in back(s):
                yield score + w, path + ids

    return sorted(back(len(word)), key=lambda p: (-p[0], p[1][::-1]))


def test_words_against_all_paths(lattice):
    for w in WORDS:
        paths = all_paths(lattice, w)
        assert lattice.n_best(w, 6) == paths[:6]
        best, loss = lattice._best_and_loss(w)
        assert best == paths[0]
        assert loss == (paths[0][0] - paths[1][0] if len(paths) > 1 else np.inf)


def test_ties_and_near_ties_against_all_paths(lattice):
    rng = random.Random(2)
    for _ in range(60):
        w = "".join(rng.choice("aabé中") for _ in range(rng.randrange(1, 11)))
        paths = all_paths(lattice, w)
        for n in (1, 2, 5, 40):
            assert lattice.n_best(w, n) == paths[:n], (w, n)


def test_edges_into_and_ahead_agree(lattice):
    w = "▁thanedble,中éaaa"
    ahead = lattice._ahead(w)
    for e in range(1, len(w) + 1):
        assert ahead[e] == max(ahead[s] + x for s, x, _ in lattice._into(w, e))


def test_very_long_words_in_time_and_whole(lattice):
    rng = random.Random(3)
    for w in ("a" * 300_000, "".join(rng.choice("ABCDabcdefgh0123+/") for _ in range(1_000_000))):
        began = time.time()
        got = lattice.segment(w, 4)
        assert time.time() - began < 60
        assert len(got) == 4 and len({x[2] for x in got}) == 4
        assert [x[0] for x in got] == sorted((x[0] for x in got), reverse=True)
        assert all(lattice.decode(x[2]) == w for x in got)


def test_texts_against_all_combinations(lattice):
    for t in TEXTS:
        words = [all_paths(lattice, w)[:4] for w in lattice.words(t)]
        every = sorted((-sum(p[r][0] for p, r in zip(words, ranks)), ranks[::-1])
                       for ranks in itertools.product(*(range(len(p)) for p in words)))[:4]
        want = [(-s, sum((p[r][1] for p, r in zip(words, back[::-1])), ())) for s, back in every]
        got = lattice.segment(t, 4)
        assert [(s, tuple(np.frombuffer(raw, "<u4").tolist())) for s, _, raw, _ in got] == want
        assert all(n == len(raw) // 4 and lattice.decode(raw) == t for _, n, raw, _ in got)


def test_a_small_cache_changes_nothing(lattice):
    small = N.Lattice(cache_words=4)
    for t in TEXTS + ["many different words that do not fit the cache at all"]:
        assert [x[:3] for x in small.segment(t, 3)] == [x[:3] for x in lattice.segment(t, 3)]


def test_words_found_once_a_text_and_paths_held_within_bounds(lattice, monkeypatch):
    monkeypatch.setattr(N, "HELD_WORDS", 3)
    calls, one = [], N.Lattice()
    monkeypatch.setattr(one, "n_best", lambda w, n: calls.append(w) or lattice.n_best(w, n))
    want = [x[:3] for x in lattice.segment("the thanedble", 3)]
    for _ in range(2):
        assert [x[:3] for x in one.segment("the thanedble", 3, one.words("the thanedble"))] == want
    assert len(calls) == len(set(calls)) > 0
    for t in TEXTS + ["x" * 40]:
        assert [x[:3] for x in one.segment(t, 3)] == [x[:3] for x in lattice.segment(t, 3)]
        assert len(one.paths) <= 3


def test_rows(spark):
    rows = [(1, "the cat", "c"), (1, "the cat", "c"), (2, None, "c"), (3, "", "c"), (4, "x ▁ y", "c"),
            (5, "word " * 20_000, "c"), (6, "q" * 3000, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rank string")
    got = N.segmentations(docs).collect()
    count = {}
    for r in got:
        count[r.doc_id] = count.get(r.doc_id, 0) + 1
        assert r.round_trip == (r.doc_id != 4)
    assert count == {1: 8, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4}
    assert N.segmentations(docs.limit(0)).count() == 0
