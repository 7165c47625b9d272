"""Batched searches of a graph, and polygons in discs, against plain forms."""

from collections import deque

import numpy as np
import pytest

from streetloom.functions import kernels as K
from streetloom.operators.centrality import searched
from streetloom.operators.overlay import clip_convex, disc


def _plain(after, n):
    near, through = [], np.zeros(n)
    for s in range(n):
        far, paths, seen, queue = {s: 0}, {s: 1.0}, [], deque([s])
        while queue:
            x = queue.popleft()
            seen.append(x)
            for y in after[x]:
                if y not in far:
                    far[y], paths[y] = far[x] + 1, 0.0
                    queue.append(y)
                if far[y] == far[x] + 1:
                    paths[y] += paths[x]
        share = dict.fromkeys(seen, 0.0)
        for x in reversed(seen):
            share[x] = sum(paths[x] / paths[y] * (1 + share[y]) for y in after[x] if far[y] == far[x] + 1)
            through[x] += share[x] if x != s else 0.0
        total = sum(far.values())
        near.append((len(far) - 1) / total if total else 0.0)
    return near, through


@pytest.mark.parametrize(("n", "m"), [(1, 0), (5, 4), (40, 70), (60, 300), (120, 150)])
def test_searches(n, m):
    e = np.unique(np.random.default_rng(n).integers(0, n, (m, 2)), axis=0)
    e = e[e[:, 0] != e[:, 1]]
    start = np.searchsorted(e[:, 0], np.arange(n + 1))
    near, through = _plain([e[start[k] : start[k + 1], 1].tolist() for k in range(n)], n)
    for once in (n, 7):  # all sources together, and a few at once
        got = [searched(np.arange(k, min(n, k + once)), n, start, e[:, 1]) for k in range(0, n, once)]
        assert np.concatenate([a for a, _ in got]) == pytest.approx(near) and sum(b for _, b in got) == pytest.approx(through)


@pytest.mark.parametrize("corners", [3, 4, 7])
def test_disc_areas(corners):
    rng = np.random.default_rng(corners)
    turn = np.sort(rng.random((400, corners)), axis=1) * 2 * np.pi
    rings = rng.uniform(-150, 150, (400, 1, 2)) + rng.uniform(5, 300, (400, corners, 1)) * np.stack([np.cos(turn), np.sin(turn)], -1)
    rings = np.array([r for r in rings if K.is_simple(r)])
    rings[::2] = rings[::2, ::-1]  # rings run either way
    rings[:40] = np.round(rings[:40] / 50) * 50  # corners at the centre, on axes and on the circle
    rings = np.array([r for r in rings if K.is_simple(r)])
    got = K.disc_areas(rings + 1000, np.full((len(rings), 2), 1000.0), 100.0, 64)
    want = [abs(float(K.signed_areas(c[None])[0])) if len(c := clip_convex(r, disc(0.0, 0.0, 100.0))) > 2 else 0.0 for r in rings]
    assert got == pytest.approx(want, abs=1e-6)


def test_centrality_group_of_a_network(spark):
    from streetloom.plans import city as C

    nodes = spark.createDataFrame([(k, float(k), 0.0) for k in range(6)], "intersection_id long, x double, y double")
    ends = [(0, 1), (1, 0), (1, 2), (2, 1), (2, 3), (3, 2), (1, 3), (3, 1), (4, 4)]
    streets = spark.createDataFrame([(k, u, v, float(u), 0.0, float(v), 0.0, 1.0) for k, (u, v) in enumerate(ends)], "street_id long, u long, v long, ux double, uy double, vx double, vy double, length double")
    got, _ = C.street_network(C.City(intersections=nodes, streets=streets), attributes=("topology", "centrality"))
    rows = {r.intersection_id: r for r in got.collect()}
    assert set(rows) == set(range(6))
    near, through = _plain([[1], [0, 2, 3], [1, 3], [1, 2], [], []], 6)
    for k in range(4):
        assert rows[k].closeness == pytest.approx(near[k], abs=1e-6) and rows[k].betweenness == pytest.approx(through[k] / 6, abs=1e-6)
    # A triangle with a tail: the value of its middle node is the largest.
    assert rows[1].eigenvector > rows[2].eigenvector > rows[0].eigenvector > 0 and rows[2].eigenvector == pytest.approx(rows[3].eigenvector)
    assert rows[2].weighted_clustering == pytest.approx(1.0) and rows[0].weighted_clustering == 0 == rows[5].closeness == rows[5].betweenness
