"""Bounded neighbour searches on small integers: the same neighbours as by distances in full."""

import numpy as np
import pytest

from weftgraph.operators import knn


@pytest.mark.parametrize(("similarity", "dims", "high"), [("hamming", 64, 1), ("hamming", 7, 3), ("hamming", 130, 255), ("manhattan", 64, 1), ("manhattan", 5, 1000), ("manhattan", 127, 1)])
def test_codes_leave_no_pair_out(similarity, dims, high):
    rng = np.random.default_rng(dims)
    x = rng.integers(0, high + 1, (300, dims)).astype(float) - 2 if similarity == "hamming" else rng.normal(size=(300, dims)) * high
    x[40:80] = x[40]  # ties at nothing
    x[80:120, 1:] = x[7, 1:]
    ids = np.arange(300) * 2
    full = knn.nearest(ids[:90], x[:90], ids, x, 6, similarity)
    kth = full.groupby("src")["dist"].max().to_numpy().astype(float)
    coded = knn._Coded.of(x[:90], x, similarity)
    src, dst = coded.within(kth)
    gap = x[:90, None] - x[None]
    d = (gap != 0).sum(2) if similarity == "hamming" else np.abs(gap).sum(2)
    want, got = set(map(tuple, np.argwhere(d <= kth[:, None]).tolist())), set(zip(src.tolist(), dst.tolist(), strict=True))
    assert want <= got and (got == want if similarity == "hamming" else len(got) <= 4 * len(want) + 300)
    assert knn.nearest(ids[:90], x[:90], ids, x, 6, similarity, kth, coded).equals(full)
    some = np.arange(20, 200)
    assert knn.nearest(ids[10:50], x[10:50], ids[some], x[some], 6, similarity, kth[10:50], coded.some(slice(10, 50), some)).equals(knn.nearest(ids[10:50], x[10:50], ids[some], x[some], 6, similarity, kth[10:50]))


def test_other_numbers_are_not_coded():
    x = np.random.default_rng(0).normal(size=(20, 4))
    assert knn._Coded.of(x, x, "hamming") is None and knn._Coded.of(np.round(x) * 300, x * 0, "hamming") is None
    assert knn._Coded.of(np.ones((2, 200)), np.zeros((2, 200)), "manhattan") is None  # units too long for so many coordinates
    assert knn._Coded.of(np.where(x > 1, np.nan, x), x, "manhattan") is None and knn._Coded.of(x * 0, x * 0, "manhattan") is None and knn._Coded.of(x, x, "euclidean") is None


def test_blocks_are_searched_by_codes(monkeypatch):
    """The search of a block makes codes once for all who ask."""
    made, real = [], knn._Coded.of.__func__
    monkeypatch.setattr(knn._Coded, "of", classmethod(lambda cls, *a: made.append(1) or real(cls, *a)))
    x, ids, n = np.random.default_rng(1).normal(size=(1200, 8)), np.arange(1200), np.ones(1)
    cells = knn._Cells(x[:1], n * 1200, n * 0, n * 100, n * 0, n)
    found = knn._search(cells, ids, x, np.full(1200, 9.0), ids, x, np.zeros(1200, np.int32), 4, "manhattan", 0.0)[0]
    assert len(made) == 1 and sum(map(len, found)) == len(knn.nearest(ids, x, ids, x, 4, "manhattan", np.full(1200, 9.0)))
