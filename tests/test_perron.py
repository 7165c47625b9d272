"""Eigenvectors of long, narrow graphs by elimination, against dense eigenvectors."""

import numpy as np
import pytest

from streetloom.operators import graph
from streetloom.operators.perron import perron


def _ring(n, seed, ways=7):
    rng = np.random.default_rng(seed)
    u = np.concatenate([np.arange(n), rng.integers(0, n, 4 * n)])
    v = (u + 1 + np.concatenate([np.zeros(n, int), rng.integers(0, ways, 4 * n)])) % n
    pairs, w = np.unique(np.column_stack([u, v]), axis=0, return_counts=True)
    return pairs[:, 0], pairs[:, 1], w.astype(float)


def _dense(n, u, v, w):
    a = np.zeros((n, n))
    np.add.at(a, (v, u), w)
    values, vectors = np.linalg.eig(a)
    k = values.real.argmax()
    x = np.abs(vectors[:, k].real)
    return values[k].real, x / np.linalg.norm(x)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_ring(seed):
    n = 400
    u, v, w = _ring(n, seed)
    # A node that only receives, one that only sends and one alone.
    u, v, w = np.append(u, [5, n + 1]), np.append(v, [n, 9]), np.append(w, [2.0, 1.0])
    value, x = perron(n + 3, u, v, w, np.ones(n + 3))
    want, y = _dense(n + 3, u, v, w)
    assert value == pytest.approx(want, rel=1e-9) and x == pytest.approx(y, abs=1e-7) and x[n] > 0 == x[n + 1] == x[n + 2]


def test_no_answer_where_the_eigenvalue_is_not_single():
    u, v, w = _ring(60, 4)
    assert perron(120, np.append(u, u + 60), np.append(v, v + 60), np.append(w, w), np.ones(120)) is None


def test_query_step_ends_on_a_long_ring(spark):
    """A ring of 5000 whose power iteration still changes after thousands of rounds; a group each of two such."""
    n = 5000
    parts = [_ring(n, k) for k in (5, 6)]
    edges = [(a + k * n, b + k * n) for k, (u, v, w) in enumerate(parts) for a, b, c in zip(u.tolist(), v.tolist(), w.tolist()) for _ in range(int(c))]
    nodes = spark.createDataFrame([(k, k // n) for k in range(2 * n)], "id long, g long")
    got = {r.id: r.eigenvector for r in graph.eigenvector(nodes, spark.createDataFrame(edges, "u long, v long"), "id", group="g").collect()}
    for k, (u, v, w) in enumerate(parts):
        x = np.array([got[k * n + i] for i in range(n)])
        y = np.bincount(v, w * x[u], n)
        value = x @ y
        assert np.linalg.norm(x) == pytest.approx(1.0) and (x > 0).all() and np.abs(y - value * x).max() < 1e-10
