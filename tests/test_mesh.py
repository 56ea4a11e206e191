"""Triangulations cut into cells, against one made in one place."""

import numpy as np
import pytest

from weftgraph.operators import geometry
from weftgraph.session import prepare


def made(spark, xy, **more):
    prepare(spark)
    p = spark.createDataFrame([(i, v) for i, v in enumerate(xy.tolist())], "id long, x array<double>")
    return sorted(tuple(r) for r in geometry.mesh(p, **more).collect())


@pytest.mark.parametrize("kind", ["even", "clusters", "grid"])
def test_cells_make_the_same_triangles(spark, kind):
    r = np.random.default_rng(5)
    xy = {"even": r.random((700, 2)), "clusters": r.normal(0, 1, (700, 2)) ** 5, "grid": np.stack(np.divmod(np.arange(400), 20), 1).astype(float)}[kind]
    whole = sorted(tuple(sorted(t)) for t in geometry.delaunay(xy).tolist())
    hull = geometry._hull(xy, np.lexsort((xy[:, 1], xy[:, 0])))
    assert len(whole) == 2 * len(xy) - 2 - len(hull)  # Euler: to the hull, and nothing twice
    assert made(spark, xy, cell=60) == whole and made(spark, xy) == whole


def test_more_points_than_one_place_takes_and_copies(spark):
    xy = np.random.default_rng(1).random((21_000, 2))
    got = np.array(made(spark, np.concatenate([xy, xy[:500]])))
    assert len(np.unique(got, axis=0)) == len(got) and got.max() < 21_000
    hull = geometry._hull(xy, np.lexsort((xy[:, 1], xy[:, 0])))
    assert len(got) == 2 * len(xy) - 2 - len(hull)
    assert abs(np.abs(geometry._cross(xy[got[:, 0]], xy[got[:, 1]], xy[got[:, 2]])).sum() - sum(xy[a, 0] * xy[b, 1] - xy[a, 1] * xy[b, 0] for a, b in hull)) < 1e-9
