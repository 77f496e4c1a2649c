import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from corpusgraph.llm import ppm_lang as P

SF = "/root/testdata/sf0.01"


def strings_of(texts):
    return Counter(t[i - k:i + 1] for t in texts for i in range(len(t)) for k in range(min(i, P.ORDER) + 1))


def code_of(s):
    return int.from_bytes(b"\x01" + s, "big")


def tree_of(texts):
    c = strings_of(texts)
    return P.grow(np.array([code_of(s) for s in c], np.int64), np.array(list(c.values()), np.int64))


def by_definition(count, text, i):
    """PPM with escape method C and exclusion, one byte at a time."""
    bits, excluded = 0.0, set()
    for k in range(min(i, P.ORDER), -1, -1):
        context = text[i - k:i]
        seen = {b: n for b in range(256) if (n := count.get(context + bytes([b]), 0))}
        if not seen:
            continue
        left = {b: n for b, n in seen.items() if b not in excluded}
        if left:
            all_ = sum(left.values()) + len(left)
            if text[i] in left:
                return bits + math.log2(all_ / left[text[i]])
            bits += math.log2(all_ / len(left))
        excluded |= set(seen)
    return bits + math.log2(max(1, 256 - len(excluded)))


@pytest.mark.parametrize("train,text", [
    ([b"abracadabra", b"abba", b"cab"], b"abracadabra abcabz\x00\xff"),
    (["déjà vu ü ".encode() * 3, bytes(range(256))], "déjà ü vu\n".encode()),
    ([b"aaaaaaaaaa"], b"aaaaaaab"),
])
def test_code_lengths_are_those_of_the_definition(train, text):
    tree, count = tree_of(train), strings_of(train)
    want = [by_definition(count, text, i) for i in range(len(text))]
    data = np.concatenate([np.zeros(P.ORDER, np.uint8), np.frombuffer(text, np.uint8)])
    got = P.costs(tree, P.windows(data, np.arange(len(text))))
    assert np.allclose(got, want)


def test_next_bytes_share_one(spark):
    """The code is complete: over all 256 bytes, 2 ** -cost sums to one."""
    tree = tree_of([b"the cat sat on the mat", b"the hat"])
    for context in (b"", b"t", b"the ", b"zz", b"cat "):
        codes = np.array([code_of(context[-4:] + bytes([b])) for b in range(256)], np.int64)
        assert abs(np.exp2(-P.costs(tree, codes)).sum() - 1) < 1e-9


def test_sums_do_not_depend_on_blocks_or_the_table(monkeypatch):
    rng = np.random.default_rng(0)
    texts = [bytes(rng.integers(97, 103, n).astype(np.uint8)) for n in (0, 1, 3, 50, 0, 700, 2, 0)]
    trees = [tree_of([b"abcabcabd" * 9, b"fade"]), tree_of([b"deaf bead" * 7])]
    model = P.Model(["x", "y"], np.array([1.0, 1.0]), trees)
    column = pa.array([t.decode() for t in texts])
    want = np.array([[sum(int(round(by_definition(c, t, i) * P.UNIT)) for i in range(len(t)))
                      for c in (strings_of([b"abcabcabd" * 9, b"fade"]), strings_of([b"deaf bead" * 7]))]
                     for t in texts])
    for block, cells in ((1 << 19, 1 << 22), (64, 2), (7, 2)):
        monkeypatch.setattr(P, "BLOCK", block)
        monkeypatch.setattr(P, "TABLE_CELLS", cells)
        s = P.Scorer(model)
        for _ in range(2):
            assert (s.texts(*P._buffers(column)) == want).all()
        sliced = column.slice(3, 3)
        assert (s.texts(*P._buffers(sliced)) == want[3:6]).all()


def test_held_out_accuracy_and_folds(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = P.identify(docs).toPandas()
    assert sorted(got.doc_id) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    held = got.merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    held = held[held.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.99 and got.score.between(0, 1).all()


def test_held_out_languages_are_never_read(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 400")
    other = docs.selectExpr(
        "doc_id", "text", "if(crc32(cast(cast(doc_id as string) as binary)) % 5 = 0, 'xx', lang) lang")
    a, b = P.train(docs), P.train(other)
    assert a.names == b.names and (a.share_bits == b.share_bits).all()
    assert all((x.strings == y.strings).all() and (x.log_count == y.log_count).all()
               for x, y in zip(a.trees, b.trees))


def test_odd_rows_and_tables(spark):
    rows = [(1, None, "en", 1), (2, "", "en", 1), (3, "123 ...", "en", 1), (4, "é", "fr", 1),
            (None, "the cat", "en", 1), (6, "the cat sat", "en", 1), (6, "the cat sat", "en", 1),
            (7, "le chat é", "fr", 1), (8, "no name", None, 1), (9, "x" * 300_000, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = P.identify(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i in (1, 2, 3):
        assert by[i].lang_pred == "und" and by[i].score == 0
    assert by[None].held_out is False and by[None].lang_pred in ("en", "fr")
    assert by[9].lang_pred in ("en", "fr") and 0 <= by[9].score <= 1
    assert P.identify(docs.limit(0)).count() == 0
    nothing = P.identify(docs.selectExpr("doc_id", "text", "cast(null as string) lang")).collect()
    assert {r.lang_pred for r in nothing} == {"und"} and len(nothing) == len(rows)
    empty = P.identify(docs.selectExpr("doc_id", "if(doc_id = 4, text, '') text", "lang"))
    assert empty.count() == len(rows)
