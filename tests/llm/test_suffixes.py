import collections
import hashlib
import random

import numpy as np

from corpusgraph.llm import suffixes as X


def brute(texts, depth):
    raws = [(t or "").encode() for t in texts]
    seen = collections.Counter(r[i:i + depth] for r in raws for i in range(len(r) - depth + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - depth + 1):
            if seen[r[i:i + depth]] > 1:
                gone[i:i + depth] = b"\1" * depth
        kept = bytes(b for b, g in zip(r, gone) if not g)
        spans = sum(1 for i in range(len(r)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(r), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus():
    rnd = random.Random(1)
    word = lambda n: "".join(rnd.choice("abé d") for _ in range(n))
    base = [word(900) for _ in range(5)]
    texts = [None, "", "", "x" * 199, "x" * 200, "y" * 201, "ab" * 300, "ab" * 300, "The " * 900,
             "z" * 400]
    for _ in range(40):
        b, at = rnd.choice(base), rnd.randrange(600)
        texts.append(word(rnd.randrange(250)) + b[at:at + rnd.randrange(150, 400)] + word(rnd.randrange(250)))
    return texts


def test_cover_differences_give_every_residue():
    for v in (4, 8, 32, 64):
        cover = X.difference_cover(v)
        assert {(a - b) % v for a in cover for b in cover} == set(range(v))
        assert len(cover) < v


def test_sorted_contexts_mark_equal_prefixes():
    rng = np.random.default_rng(2)
    depth, shared = 200, rng.integers(97, 100, 260, dtype=np.uint8).tobytes()
    rows = [(rng.integers(97, 100, 30, dtype=np.uint8).tobytes()[:k] + shared[:250]
             + rng.integers(97, 100, 9, dtype=np.uint8).tobytes(), k + 10) for k in (0, 5, 30)]
    flags = X.sort_contexts(rows, depth)
    seen = collections.Counter(r[i:i + depth] for r, _ in rows for i in range(len(r) - depth + 1))
    for (raw, _), flag in zip(rows, flags):
        assert flag.tolist() == [seen[raw[i:i + depth]] > 1 for i in range(len(raw) - depth + 1)]


def test_blocks_change_nothing():
    rng = np.random.default_rng(3)
    text = np.concatenate([rng.integers(97, 99, 3000, dtype=np.uint8), np.zeros(264, np.uint8)])
    text[1504:1804] = text[32:332]
    order, starts = X.SuffixBlocks(text), np.arange(2800)
    whole = set(order.repeated(starts).tolist())
    parts = list(order.blocks(starts, 100))
    assert len(parts) > 5 and sum(map(len, parts)) == len(starts)
    assert {x for p in parts for x in order.repeated(p).tolist()} == whole == {
        *range(32, 133), *range(1504, 1605)}


def test_removal_against_brute_force(spark):
    texts = corpus()
    docs = spark.createDataFrame([(i, t, b"clash") for i, t in enumerate(texts)],
                                 "doc_id long, text string, cid binary").repartition(5)
    want = brute(texts, 200)
    for hot in (X.HOT_CONTEXTS, 1):
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
               for r in X.remove_repeats(docs, hot_contexts=hot).collect()}
        assert [got[i] for i in range(len(texts))] == want


def test_long_texts_are_cut_into_pieces(spark, monkeypatch):
    rnd = random.Random(4)
    long = "".join(rnd.choice("abcdefgh ") for _ in range(60_000))
    texts = [long + "tail" + long[20_000:20_400], long[30_000:30_300], "none"]
    monkeypatch.setattr(X, "SCAN_BYTES", 4096)
    pieces = list(X._buffers([t.encode() for t in texts], 200))
    assert len(pieces) > 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
           for r in X.remove_repeats(docs).collect()}
    assert [got[i] for i in range(3)] == brute(texts, 200)


def test_cut_texts_keep_columns_and_repeated_rows(spark):
    text = "é" * 150 + "x"
    rows = [(1, text, "fr", "s", 151), (1, text, "fr", "s", 151), (2, "short", "en", "t", 5), (3, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(map(tuple, X.cut_texts(docs).collect()), key=str)
    assert got == sorted([(1, "", "fr", "s", 0), (1, "", "fr", "s", 0), (2, "short", "en", "t", 5),
                          (3, "", None, None, 0)], key=str)


def test_empty_table(spark):
    assert X.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
