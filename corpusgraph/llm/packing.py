"""Packing documents into fixed token windows by online sum of squares.

Each document becomes the ids of a public byte-level vocabulary plus one end
id.  Whole windows of a long document are cut off first and are full at once;
what is left is an *item* shorter than a window, placed online: for an item
of ``s`` ids every fill level ``h`` with an open window, and the empty level,
is a candidate, and the one that makes the sum of the squared counts of
partially filled windows smallest is taken.  The counts live in one level
array, so a choice is one vector expression over at most ``window`` levels.

When a task has seen its rows, the windows still open are merged: pieces of
the emptiest are cut to fill the fullest, so at most one window of a task is
not full.

The job is map-only.  A task holds the level array and the ids of open windows; nothing is shuffled, no key exists
that could be hot, and a lost task is repeated with the same result, because
sequence numbers come from the partition number and the order of its rows.

Defined cases: null text counts as empty and yields one piece with only the
end id; an empty table yields no rows; repeated rows are packed once each; extra
columns are ignored, whatever their names; a text that contains the literal
string of a special token gets that token's id, as the vocabulary file says.
"""

from __future__ import annotations

import base64
import functools
import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpusgraph.llm.batches import values

WINDOW = 2048
END_ID = 1

SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long")
_FIELDS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


class VocabularyIds:
    """Ids of a byte-level vocabulary file of the ``tokenizers`` library.

    Texts of the common scripts go through the rank form of the same
    vocabulary, which gives the same ids about five times as fast.  All
    others (where the two libraries' tables of letters might differ), and
    texts with a special token's string, go through the file itself.
    """

    _COMMON = re.compile(r"[\t\n\r\x20-\x7e\u00a1-\u024f\u2013-\u2026]*\Z")

    def __init__(self, json_name: str = "byte_bpe_50k.json",
                 ranks_name: str = "byte_bpe_50k.tiktoken",
                 folder: str | None = None) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        path = (lambda n: os.path.join(folder, n)) if folder else public_tokenizers.path
        self.full = Tokenizer.from_file(path(json_name))
        self.specials = [t.content for t in self.full.get_added_tokens_decoder().values()]
        with open(path(ranks_name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN,
                                      mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of ``text``."""
        if self._COMMON.match(text) and not any(s in text for s in self.specials):
            ids = self.fast.encode_ordinary(text)
        else:
            ids = self.full.encode(text, add_special_tokens=False).ids
        return np.asarray(ids, "<u4").tobytes()


@functools.lru_cache(maxsize=2)
def _tokenizer(options: tuple) -> VocabularyIds:
    """One tokenizer for each worker process and set of options."""
    return VocabularyIds(**dict(options))


class SumOfSquares:
    """Online sum-of-squares placement into windows of ``window`` ids.

    ``counts[h]`` is the number of open windows filled to level ``h``;
    ``open[h]`` holds them.  ``place`` returns the window (a list of pieces)
    if that item closed it.
    """

    def __init__(self, window: int) -> None:
        self.window = window
        self.counts = np.zeros(window + 1, np.int64)
        self.open: list[list[list]] = [[] for _ in range(window + 1)]

    def level_for(self, size: int) -> int:
        """The level whose choice adds least to the sum of squares.

        Taking a window from level h changes the sum by 1 - 2 N(h), adding
        one to level h + size by 1 + 2 N(h + size); the empty level and the
        full one do not count.  Ties go to the fullest level.
        """
        top = self.window - size
        n = self.counts
        change = 2 * (n[size:size + top + 1] - n[:top + 1]) + 2
        change[top] = 1 - 2 * n[top]
        change[0] = 1 + 2 * n[size] if top else 0
        possible = n[:top + 1] > 0
        possible[0] = True
        change[~possible] = np.iinfo(np.int64).max
        return top - int(np.argmin(change[::-1]))

    def place(self, piece, size: int):
        h = self.level_for(size)
        bin_ = self.open[h].pop() if h else []
        if h:
            self.counts[h] -= 1
        bin_.append(piece)
        level = h + size
        if level == self.window:
            return bin_
        self.open[level].append(bin_)
        self.counts[level] += 1
        return None

    def rest(self):
        """Open windows, fullest first."""
        for h in range(self.window - 1, 0, -1):
            yield from self.open[h]


def _merged(windows, window: int):
    """Fill windows (fullest first) with pieces cut from the emptiest; at
    most the last one stays below ``window``."""
    bins = [(sum(len(p[2]) for p in b) // 4, b) for b in windows]
    i, j = 0, len(bins) - 1
    while i < j:
        fill, host = bins[i]
        while fill < window and i < j:
            left, guest = bins[j]
            doc, start, ids, total = guest.pop()
            take = min(window - fill, len(ids) // 4)
            host.append((doc, start, ids[:4 * take], total))
            fill, left = fill + take, left - take
            if 4 * take < len(ids):
                guest.append((doc, start + take, ids[4 * take:], total))
            if guest:
                bins[j] = (left, guest)
            else:
                j -= 1
        yield host
        i += 1
    if i == j:
        yield bins[i][1]


def _pack_rows(rows, encode, window: int, end_id: int, first_sequence: int):
    """Rows of ``SCHEMA`` for ``(doc_id, text)`` rows, in order."""
    packer, sequence = SumOfSquares(window), first_sequence
    end = np.asarray([end_id], "<u4").tobytes()

    def closed(pieces):
        nonlocal sequence
        offset = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            yield (doc, start, n, zlib.crc32(ids), total, sequence, offset)
            offset += n
        sequence += 1

    for doc, text in rows:
        ids = encode(text or "") + end
        total = len(ids) // 4
        whole = total - total % window
        for start in range(0, whole, window):
            yield from closed([(doc, start, ids[4 * start:4 * (start + window)], total)])
        if whole < total:
            full = packer.place((doc, whole, ids[4 * whole:], total), total - whole)
            if full is not None:
                yield from closed(full)
    for pieces in _merged(packer.rest(), window):
        yield from closed(pieces)


def pack(docs: DataFrame, window: int = WINDOW, end_id: int = END_ID,
         tokenizer: dict | None = None) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset``.  ``tokenizer`` holds ``VocabularyIds`` arguments
    (file names and folder of the vocabulary)."""
    options = tuple(sorted((tokenizer or {}).items()))

    def run(batches):
        from pyspark import TaskContext

        encode = _tokenizer(options).ids
        rows = (row for b in batches for row in zip(values(b, 0), values(b, 1)))
        first = TaskContext.get().partitionId() << 33
        out = []
        for row in _pack_rows(rows, encode, window, end_id, first):
            out.append(row)
            if len(out) >= 8192:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def _batch(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], _FIELDS)
