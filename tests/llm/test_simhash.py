import numpy as np
import xxhash

from corpusgraph.llm import simhash as S


def brute(rows, radius=2):
    fps = [S.fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                label[find(i)] = find(j)
    best = {}
    for k, (d, _) in enumerate(rows):
        best[find(k)] = min(best.get(find(k), d), d)
    return sorted((d, f"{fps[k]:016x}", best[find(k)]) for k, (d, _) in enumerate(rows))


def test_fingerprint_is_the_majority_of_shingle_bits():
    text = "The quick\tbrown Fox jumps over the quick brown fox É"
    words = text.encode().lower().split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i:i + 3]), 42) for i in range(len(words) - 2)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert S.fingerprint(text) == want
    assert S.fingerprint("a B") == xxhash.xxh64_intdigest(b"a b", 42)
    assert S.fingerprint("") == S.fingerprint(None) == S.fingerprint(" \n") == 0


def test_links_match_brute_force_in_groups():
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 1 << 63, 5, dtype=np.uint64)
    fp = np.concatenate([c ^ np.concatenate([
        np.zeros(1, np.uint64), (np.uint64(1) << rng.integers(0, 64, 150, dtype=np.uint64))
        | (np.uint64(1) << rng.integers(0, 64, 150, dtype=np.uint64))]) for c in centres]).astype(np.uint64)
    group = np.sort(rng.integers(0, 3, len(fp)))
    for radius in (0, 1, 2, 3):
        label = np.arange(len(fp))
        S._hook(label, *map(np.asarray, S.links_in_groups(fp, group, radius)))
        want = np.arange(len(fp))
        near = (np.bitwise_count(fp[:, None] ^ fp) <= radius) & (group[:, None] == group)
        S._hook(want, *np.nonzero(near))
        assert (label == want).all(), radius


def test_masks_meet_every_pair_within_the_radius():
    masks = [m % (1 << 64) for m in S._masks(6, 2)]
    assert len(masks) == 15
    for i in range(0, 64, 3):
        for j in range(64):
            assert any(((1 << i) | (1 << j)) & m == 0 for m in masks)


def test_components_against_brute_force(spark):
    base = "one two three four five six seven eight nine ten eleven twelve " * 40
    rows = [(i, base + " ".join(["extra"] * (i % 3)) + ("x" if i % 5 == 0 else "")) for i in range(40)]
    rows += [(100 + i, f"quite different words number {i} and {i * i} so no link") for i in range(30)]
    rows += [(200, ""), (201, None), (202, "   "), (203, "word"), (204, "word"), (205, "w " * 50_000)]
    rows += [rows[0]]
    docs = spark.createDataFrame([(d, t, "clash") for d, t in rows], "doc_id long, text string, fp string")
    for bucket in (S.BUCKET_ROWS, 4):
        got = S.near_duplicates(docs, bucket_rows=bucket).collect()
        assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == brute(rows)


def test_first_of_each_keeps_one_row_per_group(spark):
    rows = [(3, "a b c d"), (1, "a b c d"), (1, "a b c d"), (7, "other text here now"), (None, "a b c d")]
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    got = S.first_of_each(docs).collect()
    assert sorted((r.doc_id for r in got), key=str) == [1, 7, None]


def test_empty_table(spark):
    assert S.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
