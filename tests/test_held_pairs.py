"""Points in polygons, looked up in tiles, against the join."""

import numpy as np
import pytest

from streetloom.functions import geometry as G
from streetloom.operators import polygons, spatial_join

RINGS = "id long, ring array<struct<x:double,y:double>>"


def _rings(rng, n):
    out = []
    for k in range(n):
        at, m = rng.integers(0, 300, 2), int(rng.integers(3, 9))
        p = [tuple(map(float, at + rng.integers(-30, 31, 2))) for _ in range(m)]
        out.append((k, [*p, p[0]]))
    return [*out, (900, None), (901, [(1.0, 1.0), (None, 2.0), (3.0, 3.0), (1.0, 1.0)]), (902, [(5.0, 5.0), (6.0, 6.0)])]


@pytest.mark.parametrize("rows", [30, 200_000])
def test_as_the_join(spark, monkeypatch, rows):
    monkeypatch.setattr(spatial_join, "TILE_ROWS", rows)
    rng = np.random.default_rng(5)
    p = spark.createDataFrame([(k, *map(float, a)) for k, a in enumerate(rng.integers(-20, 320, (900, 2)))] + [(999, None, 1.0)], "p long, x double, y double")
    r = spark.createDataFrame(_rings(rng, 150), RINGS)
    pairs = lambda df: sorted((x.p, x.id) for x in df.collect())
    want = pairs(polygons.points_in(p, r, 50.0))
    assert pairs(polygons.points_in_tiles(p, r, 50.0)) == want and len(want) > 500
    assert not pairs(polygons.points_in_tiles(p.limit(0), r, 50.0)) and not pairs(polygons.points_in_tiles(p, r.limit(0), 50.0))


def test_query_makes_no_pairs_of_whole_cells(spark, monkeypatch):
    from streetloom.plans import area_queries

    def never(*a):
        raise AssertionError("every pair of a cell is tested")

    monkeypatch.setattr(G, "inside", never)
    assert area_queries.points_beside_yards(spark, "/root/testdata/sf0.001").count()
