"""N-best segmentation over a SentencePiece vocabulary, and decoding.

The lattice of a text has an edge for every piece that matches, weighted by
the piece's score; a character that is no piece becomes its byte pieces, at
``UNKNOWN_PENALTY`` below the lowest score.  No piece holds white space after
other characters, so the lattice falls apart at white space and line feeds
into words: the text's best segmentations are combinations of its words'.

Per word: the forward Viterbi pass gives the best score from the start to each position.  The N
best paths are found by A-star from the end backward; the forward score of the position
reached is its exact remaining cost, so paths leave the queue best first and nothing else is
expanded.  Per text only the words that can take part in the N best are
searched: those with the smallest loss from best to second best, which a
forward pass that keeps two scores per position gives for every word.  Words are cached in a bounded table.

Order.  Paths of a word: by score, then by ids read from the end.
Segmentations of a text: by score, then by the ranks of their words' paths
read from the last word to the first.

Defined cases: null text counts as empty and has one segmentation without
pieces; a text with fewer than N segmentations gives as many rows as it has; repeated rows give rows each; other
columns are ignored; an empty table gives no rows; ``round_trip`` is false only
for texts that hold the vocabulary's own space mark.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import operator
import os
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpusgraph.llm.batches import values

N_BEST = 4
UNKNOWN_PENALTY = 10.0
CACHE_WORDS, CACHE_BYTES = 1_200_000, 128 << 20
#: Words whose N best paths are held, and the letters of such a word.
HELD_WORDS, HELD_LETTERS = 1 << 14, 32
MARK = "▁"

Path = tuple[float, tuple[int, ...]]


class Lattice:
    """The piece lattice of a vocabulary file."""

    def __init__(self, model: str = "piece_bpe_32k.model", folder: str | None = None,
                 cache_words: int = CACHE_WORDS) -> None:
        import public_tokenizers
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(
            model_file=os.path.join(folder, model) if folder else public_tokenizers.path(model))
        self.bytes_of: list[bytes] = []
        self.byte_id = [0] * 256
        scores: dict[str, tuple[float, tuple[int, ...]]] = {}
        for i in range(sp.vocab_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_id[value] = i
                self.bytes_of.append(bytes([value]))
            elif sp.is_control(i) or sp.is_unknown(i):
                self.bytes_of.append(b"")
            else:
                scores[piece] = (sp.get_score(i), (i,))
                self.bytes_of.append(piece.replace(MARK, " ").encode())
        self.unknown = min(w for w, _ in scores.values()) - UNKNOWN_PENALTY
        #: Trie of the pieces: a node is its children and its score and ids.
        self.root: tuple[dict, tuple | None] = _trie(scores)
        self.scores, self.longest = scores, max(map(len, scores))
        inside = any(MARK in p.lstrip(MARK) or "\n" in p for p in scores)
        self.cut = re.compile(r".+" if inside else f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n", re.S)
        #: Neighbours inside some piece: between all others every path is cut.
        self.joined = {p[k:k + 2] for p in scores for k in range(len(p) - 1)}
        self.cache_words = cache_words
        self.paths: dict[tuple[str, int], list[Path]] = {}
        self._reset()

    def _options(self, word: str, n: int) -> list[Path]:
        """``n_best``, held for the last short words."""
        if len(word) > HELD_LETTERS:
            return self.n_best(word, n)
        if (known := self.paths.get((word, n))) is None:
            if len(self.paths) >= HELD_WORDS:
                self.paths.clear()
            known = self.paths[word, n] = self.n_best(word, n)
        return known

    def _reset(self) -> None:
        self.index: dict[str, int] = {}
        self.raw_ids: list[bytes] = []
        self.held = 0
        self.score = np.zeros(self.cache_words)
        self.loss = np.zeros(self.cache_words)
        self.pieces = np.zeros(self.cache_words, np.int64)

    # ------------------------------------------------------------- one word
    def _into(self, word: str, e: int) -> list[tuple[int, float, tuple[int, ...]]]:
        """The edges ``(start, score, ids)`` into an end position."""
        edges = [(e - 1, *self._single(word[e - 1]))]
        for s in range(max(0, e - self.longest), e - 1):
            if (known := self.scores.get(word[s:e])) is not None:
                edges.append((s, *known))
        return edges

    def _ahead(self, word: str) -> list[float]:
        """The best score from the start to each position."""
        n, children = len(word), self.root[0]
        best = [-np.inf] * (n + 1)
        best[0] = 0.0
        for s in range(n):
            e, node = s, children.get(word[s])
            edge = node and node[1] or self._single(word[s])
            while True:
                e += 1
                if edge and best[s] + edge[0] > best[e]:
                    best[e] = best[s] + edge[0]
                if node is None or e == n or (node := node[0].get(word[e])) is None:
                    break
                edge = node[1]
        return best

    def _single(self, char: str) -> tuple[float, tuple[int, ...]]:
        """Score and ids of one character: its piece, or its bytes."""
        node = self.root[0].get(char)
        return node and node[1] or (
            self.unknown, tuple(self.byte_id[b] for b in char.encode()))

    def n_best(self, word: str, n: int) -> list[Path]:
        """The N best paths, best first, by backward A-star.

        A state is its score as a whole, what lies behind it, its position, its
        back-pointer ``(state, ids from the end, depth)`` and whether it comes
        before the state expanded last where scores tie.  As the forward scores
        are exact, every waiting state is good for a path of its score, so no
        more states wait than paths are still sought."""
        ahead = self._ahead(word)
        waiting, out, last = [[ahead[-1], 0.0, len(word), None, False]], [], None
        while waiting and len(out) < n:
            state = waiting.pop(0)
            if state[3] is not None and state[3][0] is last:
                for other in waiting:
                    if other[3][0] is last:
                        other[4] = other[3][1] < state[3][1]
            else:
                for other in waiting:
                    other[4] = _before(other, state)
            last = state
            whole, behind, at = state[:3]
            if not at:
                out.append((whole, _ids(state)))
                del waiting[n - len(out):]
                continue
            depth = state[3][2] + 1 if state[3] else 1
            for s, w, ids in self._into(word, at):
                made = [ahead[s] + w + behind, w + behind, s, (state, ids[::-1], depth), False]
                place = len(waiting)
                while place and _after(waiting[place - 1], made, state):
                    place -= 1
                if place < n - len(out):
                    waiting.insert(place, made)
                    del waiting[n - len(out):]
        return out

    def _best_and_loss(self, word: str) -> tuple[Path, float]:
        """The best path and how much the second best loses, by a forward
        pass that keeps the two best scores at each position."""
        n, low, children = len(word), -np.inf, self.root[0]
        first, second, via = [low] * (n + 1), [low] * (n + 1), [(0, ())] * (n + 1)
        first[0] = 0.0
        for s, char in enumerate(word):
            a, a2, e = first[s], second[s], s + 1
            node = children.get(char)
            edge = node and node[1] or self._single(char)
            while True:
                if edge:
                    score, best = a + edge[0], first[e]
                    if score > best:
                        other = a2 + edge[0]
                        second[e] = other if other > best else best
                        first[e], via[e] = score, (s, edge[1])
                    elif score > second[e]:
                        second[e] = score
                if node is None or e == n or (node := node[0].get(word[e])) is None:
                    break
                edge = node[1]
                e += 1
        if second[n] == first[n]:      # ties: the search orders them
            return self.n_best(word, 1)[0], 0.0
        ids, at = [], n
        while at:
            at, piece = via[at]
            ids.extend(reversed(piece))
        return (first[n], tuple(reversed(ids))), first[n] - second[n]

    def _learn(self, word: str) -> int:
        """Cache a word.  One that some boundary cuts, because no piece
        reaches across it, is put together from its parts, which are words of
        the same table."""
        inside = list(map(self.joined.__contains__, map(operator.add, word, word[1:])))
        if all(inside):
            (score, ids), loss = self._best_and_loss(word)
            raw = _packed(len(ids))(*ids)
        else:
            cuts = [0, *(k for k, whole in enumerate(inside, 1) if not whole), len(word)]
            parts = [word[i:j] for i, j in itertools.pairwise(cuts)]
            at = [self._learn(p) if (k := self.index.get(p)) is None else k for p in parts]
            score, loss = sum(map(self.score.item, at)), min(map(self.loss.item, at))
            raw = b"".join([self.raw_ids[k] for k in at])
        if len(self.raw_ids) == len(self.score):
            self.score, self.loss, self.pieces = (
                np.concatenate([x, np.zeros(1 + len(x) // 8, x.dtype)])
                for x in (self.score, self.loss, self.pieces))
        k = len(self.raw_ids)
        self.index[word] = k
        self.raw_ids.append(raw)
        self.held += len(raw) + 4 * len(word)
        self.score[k], self.loss[k], self.pieces[k] = score, loss, len(raw) // 4
        return k

    # ------------------------------------------------------------- one text
    def words(self, text: str) -> list[str]:
        return self.cut.findall(MARK + text.replace(" ", MARK)) if text else []

    def segment(self, text: str, n: int, words: list[str] | None = None,
                ) -> list[tuple[float, int, bytes, dict[int, Path]]]:
        """The N best segmentations of a text (whose ``words`` may be given):
        score, number of pieces, ids (little-endian unsigned 32-bit) and, by
        position, the words that differ from the best."""
        words = self.words(text) if words is None else words
        if len(self.raw_ids) + len(words) > self.cache_words or self.held > CACHE_BYTES:
            self._reset()
        known, learn = self.index.get, self._learn
        at = np.fromiter((learn(w) if (k := known(w)) is None else k for w in words),
                         np.int64, len(words))
        total, count = float(self.score[at].sum()), int(self.pieces[at].sum())
        raw = list(map(self.raw_ids.__getitem__, at.tolist()))
        out = [(total, count, b"".join(raw), {})]
        loss = self.loss[at]
        near = np.argsort(loss, kind="stable")[:n - 1]
        near = sorted(near[loss[near] < np.inf].tolist())
        options = [self._options(words[i], n) for i in near]
        found = []
        for ranks in itertools.product(*(range(len(o)) for o in options)):
            if 0 < sum(ranks) < n:
                change = sum(o[r][0] - o[0][0] for o, r in zip(options, ranks))
                found.append((-change, ranks[::-1]))
        for change, back in heapq.nsmallest(n - 1, found):
            swapped = {i: o[r] for i, o, r in zip(near, options, back[::-1]) if r}
            now, pieces = list(raw), count
            for i, (_, ids) in swapped.items():
                now[i] = np.asarray(ids, "<u4").tobytes()
                pieces += len(ids) - int(self.pieces[at[i]])
            out.append((total - change, pieces, b"".join(now), swapped))
        return out

    def decode(self, raw_ids: bytes) -> str:
        """The text of ids; the first piece's leading space is the encoder's."""
        text = b"".join(map(self.bytes_of.__getitem__, np.frombuffer(raw_ids, "<u4").tolist()))
        return text.removeprefix(b" ").decode("utf-8", "replace")


def _ids(state: list) -> tuple[int, ...]:
    """A whole path's ids, from the start: the back-pointers lead to the end."""
    out: list[int] = []
    while state[3] is not None:
        out.extend(reversed(state[3][1]))
        state = state[3][0]
    return tuple(out)


def _before(x: list, y: list) -> bool:
    """Whether x's ids, read from the end, come before y's."""
    a = b = ()
    while x is not y:
        deeper = (x[3][2] if x[3] else 0) - (y[3][2] if y[3] else 0)
        if deeper >= 0:
            a, x = x[3][1], x[3][0]
        if deeper <= 0:
            b, y = y[3][1], y[3][0]
    return a < b


def _after(x: list, new: list, parent: list) -> bool:
    """Whether a waiting state comes after one that its parent has just made."""
    if x[0] != new[0]:
        return x[0] < new[0]
    return x[3][1] > new[3][1] if x[3][0] is parent else not x[4]


@functools.lru_cache(maxsize=256)
def _packed(n: int):
    """Packs ``n`` ids, little-endian unsigned 32-bit."""
    return struct.Struct(f"<{n}I").pack


def _trie(scores: dict) -> tuple[dict, None]:
    root: dict = {}
    for piece in sorted(scores):          # a prefix comes before its longer pieces
        children = root
        for k, char in enumerate(piece):
            if char not in children:
                children[char] = ({}, scores.get(piece[:k + 1]))
            children = children[char][0]
    return root, None


@functools.lru_cache(maxsize=2)
def _lattice(options: tuple) -> Lattice:
    """One lattice for each worker process and set of options."""
    return Lattice(**dict(options))


def segmentations(docs: DataFrame, n: int = N_BEST, vocabulary: dict | None = None) -> DataFrame:
    """``doc_id, rank`` (from 1) ``, score, n_pieces, ids_crc32, round_trip``.
    ``vocabulary`` holds ``Lattice`` arguments (file name and folder)."""
    options = tuple(sorted((vocabulary or {}).items()))

    def run(batches):
        lattice = _lattice(options)
        for b in batches:
            rows = []
            for doc_id, text in zip(values(b, 0), values(b, 1)):
                text = text or ""
                words, first_ok = lattice.words(text), True
                for rank, (score, pieces, raw, swapped) in enumerate(lattice.segment(text, n, words), 1):
                    if rank == 1:
                        ok = first_ok = lattice.decode(raw) == text
                    else:  # the words that differ must decode to the same text
                        ok = first_ok and all(
                            lattice.decode(np.asarray((0, *ids), "<u4").tobytes()).removeprefix(" ")
                            == words[i].replace(MARK, " ").removeprefix(" ")
                            for i, (_, ids) in swapped.items())
                    rows.append((doc_id, rank, score, pieces, zlib.crc32(raw), ok))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [[]] * 6, _SCHEMA)],
                schema=_SCHEMA)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, rank int, score double, n_pieces long, ids_crc32 long, "
             "round_trip boolean")


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("rank", pa.int32()), ("score", pa.float64()),
                     ("n_pieces", pa.int64()), ("ids_crc32", pa.int64()), ("round_trip", pa.bool_())])
