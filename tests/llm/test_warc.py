import base64
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from corpusgraph.llm import warc as W

PAGES = [(1, "http://a/", "<p>same</p>"), (2, "http://b/", "<p>same</p>"), (3, None, None),
         (4, "u\r\nx", ""), (5, "http://c/é", "é" * 5000), (5, "http://c/é", "é" * 5000),
         (6, "x", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 0\r\n\r\n\r\n\r\n"), (None, "n", "lone"),
         (8, "q", "line\r\n\r\n"), (None, "m", "<p>same</p>")]


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def frame(spark):
    return spark.createDataFrame([(*p, "clash") for p in PAGES],
                                 "page_id long, url string, html string, value string").repartition(3)


def test_round_trip(spark, tmp_path):
    best = {}
    for i, _, h in PAGES:
        if i is not None:
            best[h or ""] = max(best.get(h or "", i), i)
    want = sorted(((i, len((h or "").encode()), digest(h),
                    "response" if best.get(h or "") in (i, None) else "revisit",
                    None if best.get(h or "") in (i, None) else best[h or ""]) for i, _, h in PAGES), key=str)
    got = W.round_trip(frame(spark), str(tmp_path / "warc"))
    assert sorted(map(tuple, got.collect()), key=str) == want


def archive(spark):
    rows = W.records(W.with_revisits(frame(spark))).collect()
    return [(r.value + "\n").encode() for r in rows]


def test_salvage_covers_every_byte_and_recovers_later_records(spark):
    parts = archive(spark)
    for members in (parts, [W.gzip_members([p]) for p in parts]):
        raw = b"".join(members)
        assert all(isinstance(x, W.Record) for x in W.salvage(raw))
        hurt = bytearray(raw)
        at = len(members[0]) + len(members[1]) // 2
        hurt[at:at + 3] = b"\0\1\2"
        found = list(W.salvage(bytes(hurt)))
        gaps = [x for x in found if isinstance(x, W.Gap)]
        assert len(gaps) == 1 and gaps[0].offset == len(members[0])
        assert gaps[0].length == len(members[1])
        assert len(found) - 1 == len(parts) - 1
        assert sum(x.length for x in found) == len(raw)


def test_junk_between_and_cut_off_ends(spark):
    parts = archive(spark)
    raw = b"junk" + parts[0] + b"\x1f\x8b\x08bad" + W.gzip_members(parts[1:3]) + parts[3][:-9]
    found = list(W.salvage(raw))
    assert [type(x).__name__ for x in found] == ["Gap", "Record", "Gap", "Record", "Record", "Gap"]
    assert list(W.salvage(b"")) == [] and len(list(W.salvage(b"no archive"))) == 1


def test_quarantine_log(spark, tmp_path):
    parts = archive(spark)
    (tmp_path / "a.warc").write_bytes(parts[0] + parts[1][:40] + parts[2])
    read = W.read_archives(spark, str(tmp_path), payloads=True)
    assert read.where(F.col("reason").isNull()).count() == 2
    gap = W.quarantine(read).collect()
    assert [(g.offset, g.length) for g in gap] == [(len(parts[0]), 40)]


def test_records_of_one_member_survive_its_damage(spark):
    parts = archive(spark)
    want = [r.block for p in parts for r in W.salvage(p)]

    def blocks(raw):
        return [x.block for x in W.salvage(raw) if isinstance(x, W.Record)]

    def gaps(raw):
        return [x for x in W.salvage(raw) if isinstance(x, W.Gap)]

    whole = W.gzip_members([b"".join(parts)])
    assert blocks(whole) == want and not gaps(whole)
    bad = bytearray(b"".join(parts))
    bad[len(parts[0]) + len(parts[1]) - 6] ^= 1  # one byte of the second record, checksum of the member as written
    one = W.gzip_members([bytes(bad)])
    assert blocks(one) == want[:1] + want[2:]
    assert [g.reason for g in gaps(one)] == [
        f"{'block digest differs'}: inflated bytes {len(parts[0])} to {len(parts[0]) + len(parts[1])}"]
    for level in (0, 9):  # stored blocks hold plain version lines
        deflated = gzip.compress(b"".join(parts), level, mtime=0)
        wrong_sum = deflated[:-8] + b"\0\0\0\0" + deflated[-4:]
        assert blocks(wrong_sum + parts[0]) == want + want[:1] and len(gaps(wrong_sum)) == 1
        cut = deflated[:-20]
        kept = blocks(cut)
        assert len(kept) >= len(want) - 1 and kept == want[:len(kept)]
        assert len(gaps(cut)) == 1 and "does not end" in gaps(cut)[0].reason
        both = cut + W.gzip_members([b"".join(parts[:3])])  # the cut member's stream runs into the next one
        assert blocks(both) == kept + want[:3]
    random_ = bytearray(whole)
    at = len(whole) // 2
    random_[at:at + 4] = b"\xff\xff\xff\xff"
    got = blocks(bytes(random_) + W.gzip_members([parts[0]]))
    assert got[-1] == want[0] and got[0] == want[0] and gaps(bytes(random_))


def test_archives_are_bounded_by_bytes(spark, tmp_path):
    pages = spark.range(40).selectExpr("id as page_id", "'u' as url", "repeat(concat('x', id), if(id = 7, 90000, 400)) as html")
    W.write_archives(pages.coalesce(1), str(tmp_path), file_bytes=40_000)
    files = [f for f in tmp_path.rglob("part-*")]
    sizes = sorted(f.stat().st_size for f in files)
    assert sizes[-1] > 150_000 and sizes[-2] <= 42_000 and len(sizes) > 2
    assert W.read_archives(spark, str(tmp_path)).where("reason is null").count() == 40


def test_round_trip_fails_on_a_gap(spark, tmp_path, monkeypatch):
    (tmp_path / "a.warc").write_bytes(archive(spark)[0][:-9])
    monkeypatch.setattr(W, "write_archives", lambda *a, **k: None)
    with pytest.raises(Exception, match="quarantined"):
        W.round_trip(frame(spark), str(tmp_path)).collect()


def test_empty_table(spark, tmp_path):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert W.round_trip(empty, str(tmp_path / "w")).count() == 0
