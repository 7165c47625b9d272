"""Points among streets that lie much denser than the test data's."""

import numpy as np

from streetloom.operators import segments


def test_nearest_segment_looks_no_farther_than_a_dense_network_needs(spark, monkeypatch):
    """Long streets all over, some of them twice; a point far from all but one, one on a street, one out of reach."""
    seen, real = [], segments.near_segments
    monkeypatch.setattr(segments, "near_segments", lambda *a, **b: (seen.append(a[4]), real(*a, **b))[1])
    rng = np.random.default_rng(3)
    ends = rng.integers(0, 1000, (2000, 4)).astype(float)
    ends = np.vstack([ends, ends[:50], [(0, 5000, 100, 5000)]])
    at = np.vstack([rng.uniform(0, 1000, (200, 2)), ends[:1, :2], [(50, 5045)], [(50, 5051)]])
    s = spark.createDataFrame([(k, *map(float, e)) for k, e in enumerate(ends)], "s long, ux double, uy double, vx double, vy double")
    p = spark.createDataFrame([(k, *map(float, a)) for k, a in enumerate(at)], "p long, x double, y double")
    u, way = ends[:, :2], ends[:, 2:] - ends[:, :2]
    t = np.clip(((at[:, None] - u) * way).sum(2) / np.maximum((way * way).sum(1), 1e-12), 0, 1)
    d = np.hypot(*np.moveaxis(at[:, None] - u - t[..., None] * way, 2, 0)).round(9)
    want = {k: {j for j in range(len(ends)) if d[k, j] == d[k].min()} for k in range(len(at)) if d[k].min() <= 50}
    one = {r.p: (r.s, r.distance) for r in segments.nearest_segment(p, s, "p", "s", 50.0).collect()}
    assert {k: v[0] for k, v in one.items()} == {k: min(v) for k, v in want.items()} and seen[0] < 50
    assert all(abs(v[1] - d[k].min()) < 1e-8 for k, v in one.items())
    many = {}
    for r in segments.nearest_segment(p, s, "p", "s", 50.0, ties=True).collect():
        many.setdefault(r.p, set()).add(r.s)
    assert many == want


def test_clipped_length_meets_streets_of_the_same_ends_once(spark, monkeypatch):
    met, real = [], segments.near_segments
    monkeypatch.setattr(segments, "near_segments", lambda points, lines, *a, **b: (met.append(lines.count()), real(points, lines, *a, **b))[1])
    s = spark.createDataFrame([(1, 0.0, 0.0, 4.0, 0.0), (2, 4.0, 0.0, 0.0, 0.0), (3, 0.0, 0.0, 4.0, 0.0), (4, 0.0, 1.0, 0.0, 3.0)], "s long, ux double, uy double, vx double, vy double")
    p = spark.createDataFrame([(0, 0.0, 0.0), (1, 90.0, 0.0)], "p long, x double, y double")
    got = {r.p: r.length for r in segments.clipped_length(p, s, "p", "s", 2.0).collect()}
    assert got == {0: 7.0, 1: 0.0} and met == [2]
