"""WARC archives: writing, and a reader that salvages damaged ones.

Writing.  Pages become WARC/1.1 records; of those with equal payloads of at
least ``min_bytes`` bytes one (the largest page_id) is a ``response`` and the
others are ``revisit`` records that refer to it.  Records are built by
DataFrame functions and written by Spark's own text writer, whose line
separator supplies each record's last byte, so archives are plain files of
concatenated records on any file system that Spark can write, committed per
task.  Which payloads repeat is found by a partial aggregate over digests;
only the digests that do are joined back, broadcast when small.

Reading.  ``salvage`` walks the bytes of an archive.  At each position it
expects a gzip member or a version line and checks what follows: headers,
block length, block and payload digest, record end.  After a failed check it searches
for the next gzip magic or version line from which a whole record passes all
checks, logs the bytes between as a quarantined gap with the reason, and goes
on.  A gzip member that is damaged, cut off or holds a bad record is inflated
as far as it goes, and what came out is walked in the same way, so its other
records are kept; its gaps name the inflated bytes.  Later records are never
lost to an earlier fault, unless the fault keeps them from being inflated.

Defined cases: null html counts as empty (its payload is empty and takes part
in revisits like any other); line breaks in a url become spaces; a null url leaves the
header out; several rows with the largest page_id of a payload are all
responses; rows without a page_id are responses unless another row with the
same payload has one; every input row gives one record, an
empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpusgraph.session import _scratch_table_path

MIN_REVISIT_BYTES = 0
#: Bounds of an archive; records are dealt to files by size class, so that no
#: file passes the bytes by more than its last record.
RECORDS_PER_FILE, FILE_BYTES = 10_000, 256 << 20
DATE = "2024-01-01T00:00:00Z"
BROADCAST_BYTES = 48 << 20
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_CONV32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
_ID = "urn:x-page:"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# ------------------------------------------------------------------- writing
def sha1_base32(content: Column) -> Column:
    """Bare upper-case base32 SHA-1: ten hex digits are eight base32 digits."""
    digest = F.sha1(content)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), _CONV32, _BASE32)


def with_revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """``page_id, url, payload, payload_bytes, payload_digest, refers_to``
    (null for responses)."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url",
        F.coalesce("html", F.lit("")).alias("payload"))
    rows = rows.select("*", F.octet_length("payload").cast("long").alias("payload_bytes"),
                       sha1_base32(F.col("payload").cast("binary")).alias("payload_digest"))
    repeated = (rows.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest")
                .agg(F.max("page_id").alias("largest"), F.count("*").alias("n"))
                .where("n > 1").select("payload_digest", "largest"))
    path = _scratch_table_path(pages.sparkSession, "digests")
    repeated.write.parquet(path)
    repeated = pages.sparkSession.read.schema(repeated.schema).parquet(path)
    if 64 * repeated.count() <= BROADCAST_BYTES:
        repeated = F.broadcast(repeated)
    revisit = F.col("largest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("largest"))
    return rows.join(repeated, "payload_digest", "left").select(
        *rows.columns, F.when(revisit, F.col("largest")).alias("refers_to"))


def records(marked: DataFrame, date: str = DATE) -> DataFrame:
    """``value``: each row's record without its last byte (a line feed)."""
    crlf = "\r\n"
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{crlf}Content-Type: text/html; charset=utf-8{crlf}"
                          "Content-Length: "), F.col("payload_bytes").cast("string"),
                    F.lit(crlf + crlf))
    revisit = F.col("refers_to").isNotNull()
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(crlf))
    head = F.concat(
        F.lit("WARC/1.1" + crlf),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", F.concat(F.lit(f"<{_ID}"), page, F.lit(">"))),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]+", " ")), F.lit("")),
        F.when(revisit, F.concat(
            line("WARC-Profile", F.lit(_PROFILE)),
            line("WARC-Refers-To", F.concat(F.lit(f"<{_ID}"), F.col("refers_to").cast("string"),
                                            F.lit(">"))))).otherwise(F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        line("WARC-Block-Digest", F.concat(F.lit("sha1:"), sha1_base32(F.col("_block").cast("binary")))),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", F.octet_length("_block").cast("string")))
    return marked.withColumn("_block", block).select(
        F.concat(head, F.lit(crlf), F.col("_block"), F.lit(crlf + "\r")).alias("value"))


def _size_class(payload_bytes: Column) -> Column:
    """k where the payload has less than 16 ** k KiB."""
    return F.ceil(F.log2(payload_bytes / 1024 + 1) / 4).cast("int")


def write_archives(pages: DataFrame, path: str, min_bytes: int = MIN_REVISIT_BYTES,
                   records_per_file: int = RECORDS_PER_FILE, date: str = DATE,
                   file_bytes: int = FILE_BYTES) -> None:
    """Write the pages as WARC files below ``path``, one folder for each size
    class that occurs, of at most ``records_per_file`` records and about
    ``file_bytes`` bytes (or one record)."""
    marked = with_revisits(pages, min_bytes).withColumn("_class", _size_class(F.col("payload_bytes")))
    classes = [r["k"] for r in pages.select(_size_class(F.coalesce(F.octet_length("html"), F.lit(0))).alias("k"))
               .distinct().collect()]  # a handful
    for k in sorted(classes) or [0]:
        most = max(1, min(records_per_file, file_bytes // (1024 * 16 ** k + 1024)))
        (records(marked.where(F.col("_class") == k), date).write
         .option("lineSep", "\n").option("maxRecordsPerFile", most).text(f"{path}/size-{k}"))


def gzip_members(raw_records: list[bytes]) -> bytes:
    """The compressed form of an archive: one gzip member per record."""
    return b"".join(gzip.compress(r, mtime=0) for r in raw_records)


# ------------------------------------------------------------------- reading
@dataclass
class Record:
    offset: int
    length: int
    headers: dict[str, str]
    block: bytes

    def payload(self) -> bytes | None:
        """The HTTP body, or None where the block holds none."""
        if self.headers.get("warc-type") == "revisit":
            return None
        if not self.headers.get("content-type", "").startswith("application/http"):
            return self.block
        return self.block.partition(b"\r\n\r\n")[2]


@dataclass
class Gap:
    offset: int
    length: int
    reason: str


class _Bad(Exception):
    """A failed check."""


_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_CANDIDATE = re.compile(rb"WARC/1\.[01]\r\n|\x1f\x8b\x08")
_LENGTH = re.compile(rb"(?im)^content-length:[ \t]*(\d+)[ \t]*\r?$")


def _digest_matches(stated: str, content: bytes) -> bool:
    name, _, value = stated.partition(":")
    if name.lower() != "sha1":
        return True
    return base64.b32encode(hashlib.sha1(content).digest()).decode() == value.strip().upper()


def _plain(raw: bytes, at: int) -> tuple[Record, int]:
    """The record that begins at ``at`` and the position after it."""
    if not _VERSION.match(raw, at):
        raise _Bad("no version line")
    end = raw.find(b"\r\n\r\n", at)
    if end < 0:
        raise _Bad("headers do not end")
    headers: dict[str, str] = {}
    for line in raw[at:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise _Bad("header without a colon")
        headers[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    size = headers.get("content-length", "")
    if not (size.isascii() and size.isdigit()):
        raise _Bad("no content length")
    begin, stop = end + 4, end + 4 + int(size)
    if raw[stop:stop + 4] != b"\r\n\r\n":
        raise _Bad("record does not end where its length says")
    record = Record(at, stop + 4 - at, headers, raw[begin:stop])
    if not _digest_matches(headers.get("warc-block-digest", ""), record.block):
        raise _Bad("block digest differs")
    payload = record.payload()
    if payload is not None and not _digest_matches(headers.get("warc-payload-digest", ""), payload):
        raise _Bad("payload digest differs")
    return record, stop + 4


def _inflated(raw: bytes, at: int) -> tuple[bytes, int, str | None]:
    """What the gzip member at ``at`` gives, the position after what was read
    of it, and what is wrong with it (None: nothing)."""
    inflate, parts, pos, step = zlib.decompressobj(31), [], at, 65_536
    while not inflate.eof and pos < len(raw):
        before = inflate.copy() if step > 1 else None
        try:
            parts.append(inflate.decompress(raw[pos:pos + step]))
        except zlib.error:
            if step == 1:
                return b"".join(parts), pos, "gzip member damaged"
            inflate, step = before, step // 256 or 1  # again in smaller pieces, up to the fault
            continue
        pos += step
    end = min(pos, len(raw)) - len(inflate.unused_data)
    return b"".join(parts), end, None if inflate.eof else "gzip member does not end"


def _member(raw: bytes, at: int) -> tuple[list[Record | Gap], int | None]:
    """What the gzip member at ``at`` holds and the position after it, None if
    it is damaged; raises without a record that passes all checks.  Records and
    gaps have the member's place; a gap's reason names the inflated bytes."""
    content, end, fault = _inflated(raw, at)
    found = []
    for x in salvage(content, inside=True):
        if isinstance(x, Record):
            found.append(Record(at, end - at, x.headers, x.block))
        else:
            found.append(Gap(at, end - at, f"{fault or x.reason}: inflated bytes {x.offset} to {x.offset + x.length}"))
    if fault and not any(isinstance(x, Gap) for x in found):
        found.append(Gap(at, end - at, f"{fault}: after inflated byte {len(content)}"))
    if not any(isinstance(x, Record) for x in found) and (fault or found):
        raise _Bad(fault or "no record in a gzip member")
    return found, None if fault else end


def _at(raw: bytes, at: int, inside: bool = False) -> tuple[list[Record | Gap], int | None]:
    if not inside and raw.startswith(b"\x1f\x8b\x08", at):
        return _member(raw, at)
    record, end = _plain(raw, at)
    return [record], end


def salvage(raw: bytes, inside: bool = False) -> Iterator[Record | Gap]:
    """Records of an archive's bytes, and the gaps between them, in order;
    together they cover every byte.  ``inside`` a member there are no members."""
    at, pattern = 0, _VERSION if inside else _CANDIDATE
    ready = None  # what the search found at ``at``
    while at < len(raw):
        found, reason, good = [], "", at
        try:
            found, end = ready or _at(raw, at, inside)
        except _Bad as e:
            reason, end = str(e), None
        if found and end is None:  # a damaged member: inflated up to here
            good = found[0].offset + found[0].length
        ready = None
        if end is None:
            end = len(raw)
            for m in pattern.finditer(raw, at + 1):
                if m.start() < good and raw[m.start()] != 0x1F:
                    continue  # in a stored block, found by inflating it
                try:
                    ready = _at(raw, m.start(), inside)
                except _Bad:
                    continue
                end = m.start()
                break
            found = found or [Gap(at, 0, reason)]
            for x in found:
                x.length = end - at
        yield from found
        at = end


_READ = ("file string, offset long, length long, reason string, page_id long, url string, "
         "record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary")
_TYPES = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
_READ_SCHEMA = pa.schema([(c.split()[0], _TYPES[c.split()[1]]) for c in _READ.split(", ")])


def _page(urn: str | None) -> int | None:
    value = (urn or "").strip("<>").removeprefix(_ID)
    return int(value) if value.lstrip("-").isdigit() else None


def _rows(file: str, raw: bytes, payloads: bool) -> Iterator[tuple]:
    for x in salvage(raw):
        if isinstance(x, Gap):
            yield (file, x.offset, x.length, x.reason, *[None] * 7)
            continue
        h, payload = x.headers, x.payload()
        if payload is None:
            stated = _LENGTH.search(x.block)
            digest = h.get("warc-payload-digest", "").partition(":")[2]
            size = int(stated[1]) if stated else None
        else:
            digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            size = len(payload)
        yield (file, x.offset, x.length, None, _page(h.get("warc-record-id")),
               h.get("warc-target-uri"), h.get("warc-type"), _page(h.get("warc-refers-to")),
               digest, size, payload if payloads else None)


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """One row per record (``reason`` null) and per quarantined gap (``reason``
    set) of all archives under ``path``.  A file is salvaged in one task; the
    writer bounds its records and bytes."""
    def run(batches):
        for b in batches:
            for file, raw in zip(b.column(0).to_pylist(), b.column(1)):
                out = []
                for row in _rows(file, raw.as_py(), payloads):
                    out.append(row)
                    if len(out) == 2000:
                        yield _batch(out)
                        out = []
                if out:
                    yield _batch(out)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.where(F.col("length") > 0).select("path", "content").mapInArrow(run, _READ)


def _batch(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(zip(*rows), _READ_SCHEMA)], schema=_READ_SCHEMA)


def quarantine(read: DataFrame) -> DataFrame:
    """The gaps of ``read_archives``: ``file, offset, length, reason``."""
    return read.where(F.col("reason").isNotNull()).select("file", "offset", "length", "reason")


def round_trip(pages: DataFrame, path: str | None = None,
               min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Write the pages to archives (in the shared checkpoint folder by
    default) and read them back: ``page_id, payload_bytes, payload_digest,
    record_type, refers_to``.  A gap in what was just written is an error."""
    spark = pages.sparkSession
    path = path or _scratch_table_path(spark, "warc")
    write_archives(pages, path, min_bytes)
    lost = F.raise_error(F.concat(F.lit("quarantined in "), "file", F.lit(": "), "reason"))
    return read_archives(spark, path).select(
        F.when(F.col("reason").isNull(), F.col("page_id")).otherwise(lost.cast("long")).alias("page_id"),
        "payload_bytes", "payload_digest", "record_type", "refers_to")
