import pyarrow as pa

from corpusgraph.llm import batches as B


def test_values_are_all_there_in_bounded_slices(monkeypatch):
    monkeypatch.setattr(B, "ROWS", 5)
    monkeypatch.setattr(B, "BYTES", 100)
    for xs in ([], [None] * 12, ["a"] * 12, ["x" * 1000, None, "y" * 99, "z", "", "w" * 300, "v"] * 3,
               ["é" * 40] * 7, ["q" * 101]):
        column = pa.array(xs, pa.string())
        assert list(B.values(pa.RecordBatch.from_arrays([column], ["t"]), 0)) == xs
        cuts = B._cuts(column)
        for lo, hi in zip(cuts, cuts[1:]):
            size = sum(len((x or "").encode()) for x in xs[lo:hi])
            assert 0 < hi - lo <= 5 and (size <= 100 or hi - lo == 1)
    sliced = pa.array(["a" * 90, "b" * 90, "c" * 90]).slice(1)
    assert list(B.values(pa.RecordBatch.from_arrays([sliced], ["t"]), 0)) == ["b" * 90, "c" * 90]
    ids = pa.array(range(12))
    assert list(B.values(pa.RecordBatch.from_arrays([ids], ["i"]), 0)) == list(range(12))
