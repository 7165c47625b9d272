"""Searches among points that lie much denser than the test data's."""

import numpy as np

from streetloom.operators import spatial_join


def _dense(spark, n=900):
    """Points of whole coordinates a metre apart, by (i, x, y)."""
    return spark.range(n).selectExpr("id AS i", "CAST(id % 30 AS double) AS x", "CAST(id DIV 30 AS double) AS y")


def test_spread_rows_are_not_broadcast(spark):
    p = _dense(spark)
    plan = spatial_join.within_distance(p, p.selectExpr("i AS j", "x AS rx", "y AS ry"), 5.0)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def _radii(monkeypatch):
    seen, real = [], spatial_join.within_distance
    monkeypatch.setattr(spatial_join, "within_distance", lambda left, right, radius, **names: (seen.append(radius), real(left, right, radius, **names))[1])
    return seen


def test_knn_looks_no_farther_than_dense_points_need(spark, monkeypatch):
    seen = _radii(monkeypatch)
    got = {(r.i, r["rank"]): (r.neighbour, r.distance) for r in spatial_join.knn(_dense(spark), "i", 5, 200.0).collect()}
    assert seen[0] < 5 and len(got) == 900 * 5
    at = np.array([(k % 30, k // 30) for k in range(900)], float)
    for k in range(900):
        d = np.hypot(*(at - at[k]).T)
        assert [got[k, r + 1] for r in range(5)] == [(j, d[j]) for j in np.lexsort((np.arange(900), d))[:5]]


def test_nearest_any_looks_no_farther_than_dense_points_need(spark, monkeypatch):
    seen = _radii(monkeypatch)
    far = spark.createDataFrame([(0, 3.2, 4.1), (1, 500.0, 0.0)], "k long, x double, y double")
    got = {r.k: (r.i, round(r.distance, 6)) for r in spatial_join.nearest_any(far, _dense(spark).selectExpr("i", "x AS rx", "y AS ry"), "k", "i", 100.0).collect()}
    assert seen[0] < 5 and got == {0: (123, 0.223607), 1: (29, 471.0)}
