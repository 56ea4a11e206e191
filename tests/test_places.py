"""Products of a block: rows of all lengths, none and beyond the places."""

import time

import numpy as np
import pytest

from weftgraph.operators import blocks


def block(counts, n, seed=0):
    rng, none = np.random.default_rng(seed), np.zeros(0, np.int64)
    starts = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    return blocks.Block(0, np.arange(len(counts)), starts, rng.integers(0, n, starts[-1]).astype(np.int32), rng.normal(size=starts[-1]), none.reshape(-1, 2), none, none, none)


@pytest.mark.parametrize("places", [0, 1, 3, 64])
@pytest.mark.parametrize("width", [1, 5])
def test_product_is_the_dense_one(monkeypatch, places, width):
    monkeypatch.setattr(blocks, "PLACES", places)
    counts = np.array([0, 3, 200, 1, 0, 64, 65, 2, 2, 0])
    b, rng = block(counts, 14), np.random.default_rng(1)
    own, halo = rng.normal(size=(10, width)), rng.normal(size=(4, width))
    m = np.zeros((10, 14))
    np.add.at(m, (np.repeat(np.arange(10), counts), b.cols), b.w)
    assert np.allclose(b.times(own, halo), m @ np.concatenate([own, halo]), atol=1e-12)
    assert block(np.zeros(3, int), 3).times(np.ones((3, width)), np.zeros((0, width))).tolist() == np.zeros((3, width)).tolist()


def test_product_of_many_columns_is_not_summed_row_by_row(monkeypatch):
    b, x = block(np.full(40_000, 12), 40_000), np.ones((40_000, 24))
    took = []
    for places in (0, 64, 0, 64):
        monkeypatch.setattr(blocks, "PLACES", places)
        b.__dict__.pop("places", None)
        b.places  # made once
        t = time.perf_counter()
        b.times(x, np.zeros((0, 24)))
        took.append(time.perf_counter() - t)
    assert min(took[1::2]) < 0.7 * min(took[::2])
