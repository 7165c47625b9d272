"""Sums within discs without pairs, against all pairs."""

import numpy as np
import pytest

from streetloom.functions import kernels as K
from streetloom.operators import clean, spatial_join


@pytest.mark.parametrize("whole", [False, True])
def test_kernel(whole):
    rng = np.random.default_rng(5)
    at, others = rng.uniform(-60, 460, (300, 2)), rng.uniform(0, 400, (4000, 2))
    if whole:  # places on the circle itself, such as 60 and 80 away
        at, others = np.round(at), np.round(others)
    values = rng.integers(0, 9, (4000, 2)).astype(float)
    d = at[:, None] - others
    near = (d * d).sum(2) <= 100.0 * 100.0
    assert (K.disc_sums(at, others, values, 100.0) == near @ values).all()
    values[7, 1] = np.nan
    assert np.array_equal(K.disc_sums(at, others, values, 100.0)[:, 1], np.where(near[:, 7], np.nan, near @ np.nan_to_num(values[:, 1])), equal_nan=True)


def test_tiles_in_parts(spark, monkeypatch):
    """Tiles of more rows than a task may hold, places of several points, a target without neighbours and one without a place."""
    monkeypatch.setattr(spatial_join, "TILE_ROWS", 50)
    rng = np.random.default_rng(6)
    t, o = np.vstack([rng.integers(-90, 90, (200, 2)), [[900, 900]]]), rng.integers(-90, 90, (1500, 2))
    targets = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(t)] + [(999, None, 1.0)], "k long, x double, y double")
    others = spark.createDataFrame([(float(x), float(y), "ab"[k % 2]) for k, (x, y) in enumerate(o)] + [(float("nan"), 0.0, "a")], "x double, y double, c string")
    got = {r.k: (r._n, r.a, r.b) for r in spatial_join.disc_sums(targets, others, "k", 20.0, clean.class_marks("c", ["a", "b"])).collect()}
    near = ((t[:, None] - o) ** 2).sum(2) <= 400
    want = {k: (near[k].sum(), near[k, ::2].sum(), near[k, 1::2].sum()) for k in range(len(t)) if near[k].any()}
    assert got == want and 200 not in want
