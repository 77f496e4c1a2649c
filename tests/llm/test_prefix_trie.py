import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest

from corpusgraph.llm import prefix_trie as P

SCHEMA = "conv_id long, turn long, role string, text string, n_convs int, depth string"


def brute(rows):
    """By definition, with whole prefixes as keys."""
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is None:
            continue
        role, text = role or "", text or ""
        digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
        own[c].append((turn is not None, turn or 0, digest, role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    convs = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        convs[c] = tuple(own.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, s in convs.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = sum(saved[k] for k in kids[p]) + (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p],
         hashlib.sha256(",".join(map(str, sorted(c for c in m if convs[c] == p))).encode()).hexdigest())
        for p, m in members.items())


def result(df):
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
                          "saved_tokens", "ends_sha256"]
    return sorted(tuple(r) for r in df.collect())


def some_rows(seed, n, words, most):
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(0, 5 * n), n):
        hot = r.random() < 0.4  # a third and more are copies of one conversation
        for t in range(4 if hot else r.randrange(1, most)):
            text = f"hot {t}" if hot else "é" * r.randrange(words)
            rows.append((c, t, r.choice(["user", None]) if not hot else "user", text, 7, "x"))
    return rows


@pytest.mark.parametrize("shard,least,chunk", [(1 << 18, 1 << 12, 1 << 20), (16, 8, 9), (40, 20, 1)])
def test_matches_brute_force_over_shards_and_levels(spark, monkeypatch, shard, least, chunk):
    for name, x in (("SHARD", shard), ("LEAST", least), ("CHUNK", chunk)):
        monkeypatch.setattr(P, name, x)
    rows = some_rows(5, 300, 3, 9)
    assert result(P.trie(spark.createDataFrame(rows, SCHEMA).repartition(5))) == brute(rows)


def test_long_conversations_and_levels(spark, monkeypatch):
    monkeypatch.setattr(P, "SHARD", 64)
    monkeypatch.setattr(P, "LEAST", 32)
    rows = [(c, t, "user", str(t if t < 2000 - c else c), 0, "") for c in (1, 2, 3, 105, 200, 201)
            for t in range(2000)] + [(c, 0, "user", str(c % 50), 0, "") for c in range(1000, 1200)]
    assert result(P.trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_odd_rows(spark):
    rows = [(100, None, "user", "a", 0, ""), (100, 1, None, None, 0, ""), (100, 1, None, None, 0, ""),
            (100, 2, "u", "b", 0, ""), (100, 2, "u", "c", 0, ""), (None, 1, "u", "c", 0, ""),
            (101, 5, "user", "a", 0, ""), (102, 5, "", "", 0, ""), (305, 1, "u", "x", 0, ""),
            (-7, 1, "u", "x", 0, ""), (-100, 3, "u", "y", 0, ""), (7, 1, "u", "x" * 100_000, 0, "")]
    rows += rows[:2]
    df = spark.createDataFrame(rows, SCHEMA)
    assert result(P.trie(df)) == brute(rows)
    assert result(P.trie(df.limit(0))) == []
    lone = [(3, 1, "u", "one turn", 0, "")]  # its only turn is among those the absent base gives
    assert result(P.trie(spark.createDataFrame(lone, SCHEMA))) == brute(lone)


def test_search_trees_are_balanced():
    t = P.Tree()
    for i in P.medians(1 << 12):
        t.insert([i], [1])
    depth, stack = 0, [(t.eq[0], 1)]
    while stack:
        x, d = stack.pop()
        depth = max(depth, d)
        stack += [(y, d + 1) for y in (t.lo[x], t.hi[x]) if y >= 0]
    assert depth <= 13 and sorted(P.medians(100)) == list(range(100))
