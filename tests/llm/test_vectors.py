import numpy as np

from corpusgraph.llm import vectors as V


def brute(rows, threshold=0.95):
    n = len(rows)
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v)
          and any(v) for _, v in rows]
    links, label = [0] * n, list(range(n))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and len(rows[i][1]) == len(rows[j][1]):
                a, b = (np.array(rows[k][1], float) for k in (i, j))
                a, b = a / np.abs(a).max(), b / np.abs(b).max()
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    label[find(i)] = find(j)
    low = {}
    for k in range(n):
        low[find(k)] = min(low.get(find(k), rows[k][0]), rows[k][0])
    return sorted((rows[k][0], links[k], low[find(k)], rows[k][0] == low[find(k)]) for k in range(n))


def corpus():
    rng = np.random.default_rng(5)
    rows, at = [], 0
    for _ in range(6):
        centre = rng.normal(size=16)
        for _ in range(25):
            rows.append((at, (centre + rng.normal(size=16) * rng.choice([0.02, 0.12, 0.3])).tolist()))
            at += 1
    rows += [(at + k, rng.normal(size=16).tolist()) for k in range(60)]
    at += 60
    rows += [(at + k, rows[0][1]) for k in range(5)]
    rows += [(at + 10, [2 * x for x in rows[1][1]]), (at + 11, [1e200 * x for x in rows[1][1]]),
             (at + 12, None), (at + 13, []), (at + 14, [0.0] * 16), (at + 15, [float("nan")] * 16),
             (at + 16, [float("inf")] + [0.0] * 15), (at + 17, [None] + [1.0] * 15),
             (at + 18, [1.0, 2.0]), (at + 19, [1.0, 2.0]), (at + 19, [1.0, 2.0])]
    return rows


def test_against_brute_force(spark):
    rows = corpus()
    table = spark.createDataFrame([(i, v, 0) for i, v in rows],
                                  "vec_id long, embedding array<double>, n int").repartition(4)
    for bucket in (V.BUCKET_ROWS, 8):
        got = sorted(map(tuple, V.near_vectors(table, bucket_rows=bucket).collect()))
        assert got == brute(rows)


def test_recall_follows_from_the_shape():
    for classes in (10, 10_000, 10_000_000):
        k, tables = V.table_shape(classes)
        agree = (1 - np.arccos(V.THRESHOLD) / np.pi) ** k
        assert 1 - (1 - agree) ** tables >= V.RECALL


def test_no_pair_is_counted_in_two_tables():
    rng = np.random.default_rng(6)
    x = V._unit(rng.normal(size=(40, 3)))
    keys = (rng.integers(0, 3, (40, 4))).astype(np.int64)
    n, part = np.ones(40, np.int64), np.zeros(40, np.int64)
    total = np.zeros(40, np.int64)
    for t in range(4):
        for key in range(3):
            at = np.flatnonzero(keys[:, t] == key)
            total[at] += V._compare(t, part[at], 0, 0, x[at], keys[at], n[at], 0.5)[0]
    meet = (keys[:, None] == keys[None]).any(2) & (x @ x.T >= 0.5)
    np.fill_diagonal(meet, False)
    assert (total == meet.sum(1)).all()


def test_empty_table(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert V.near_vectors(empty).count() == 0
