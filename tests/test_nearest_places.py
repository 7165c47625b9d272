"""Nearest rows, looked up in tiles, against the join of all pairs."""

import numpy as np
import pytest

from streetloom.operators import spatial_join


@pytest.mark.parametrize("rows", [30, 200_000])
def test_as_the_join(spark, monkeypatch, rows):
    monkeypatch.setattr(spatial_join, "TILE_ROWS", rows)
    rng = np.random.default_rng(6)
    left = spark.createDataFrame([(k, *map(float, a)) for k, a in enumerate(rng.integers(0, 300, (400, 2)))] + [(999, None, 1.0)], "b long, x double, y double")
    # Some places twice, and a corner that is far from all.
    places = rng.integers(0, 200, (250, 2)).tolist()
    right = spark.createDataFrame([(k, *map(float, a)) for k, a in enumerate(places + places[:40])] + [(998, 1.0, None)], "n long, rx double, ry double")
    got = lambda df: sorted((r.b, r.n, round(r.distance, 9)) for r in df.select("b", "n", "distance").collect())
    want = got(spatial_join.nearest(left, right, "b", "n", 40.0))
    assert got(spatial_join.nearest_in_tiles(left, right, "b", "n", 40.0)) == want and 200 < len({b for b, _, _ in want}) < min(400, len(want))
    assert not got(spatial_join.nearest_in_tiles(left, right.limit(0), "b", "n", 40.0))


def test_query_joins_no_cells(spark, monkeypatch):
    from streetloom.plans import queries

    def never(*a, **k):
        raise AssertionError("all pairs are made and ranked")

    monkeypatch.setattr(spatial_join, "within_distance", never)
    assert queries.nearest_intersection(spark, "/root/testdata/sf0.001").count()
