import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from corpusgraph.llm.packing import SumOfSquares, VocabularyIds, _merged, pack

TEXTS = ["", None, " ", "a  b \n c", "don't it's I'LL 123 4", "x" * 9000, "word " * 5000,
         "é  z 中文 字 <|endoftext|> a", "   x", "same text", "same text"]


@pytest.fixture(scope="module")
def full():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def expected_ids(full, text):
    return full.encode(text or "", add_special_tokens=False).ids + [1]


def test_fast_ids_equal_the_vocabulary_file(full):
    ids = VocabularyIds().ids
    for t in TEXTS:
        assert np.frombuffer(ids(t or ""), "<u4").tolist() == expected_ids(full, t)[:-1]


def test_every_id_in_one_piece_and_windows_gapless(spark, full):
    rows = [(i, t, 1) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int").coalesce(1)
    got = pack(docs).collect()
    by_doc, by_window = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_window.setdefault(r.sequence_id, []).append(r)
    for i, t, _ in rows:
        ids, at = expected_ids(full, t), 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.length > 0
            piece = np.asarray(ids[at:at + r.length], "<u4").tobytes()
            assert r.ids_crc32 == zlib.crc32(piece)
            at += r.length
        assert at == len(ids)
    short = 0
    for pieces in by_window.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
        short += at < 2048
    assert short <= 1


def test_level_choice_is_the_least_sum_of_squares():
    rng = np.random.default_rng(0)
    ss = SumOfSquares(32)
    for size in rng.integers(1, 32, 400).tolist():
        counts = ss.counts.copy()

        def total(h):
            n = counts.copy()
            if h:
                n[h] -= 1
            if h + size < 32:
                n[h + size] += 1
            return int((n ** 2).sum())

        options = [h for h in range(32 - size + 1) if h == 0 or counts[h]]
        assert total(ss.level_for(size)) == min(map(total, options))
        ss.place(("d", 0, b"\0" * 4 * size, size), size)


def test_merged_windows_keep_every_id():
    bins = [[("a", 0, b"\1\0\0\0" * 7, 7)], [("b", 0, b"\2\0\0\0" * 5, 5)],
            [("c", 0, b"\3\0\0\0" * 4, 4), ("d", 0, b"\4\0\0\0" * 1, 1)]]
    out = list(_merged(bins, 8))
    assert [sum(len(p[2]) for p in b) // 4 for b in out] == [8, 8, 1]
    assert sorted(b"".join(p[2] for b in out for p in b)) == sorted(
        b"".join(bytes([k, 0, 0, 0]) * n for k, n in ((1, 7), (2, 5), (3, 4), (4, 1))))


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
