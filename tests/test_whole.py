"""Queries over every street, and loops that run to their end, against brute force on small tables."""

import math

import numpy as np
import pandas as pd
import pytest

from streetloom.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def _streets():
    o, n = pd.read_parquet(f"{SF}/orders.parquet"), len(pd.read_parquet(f"{SF}/customer.parquet"))
    return [(int(k), int(c), (int(c) + 1 + int(k) % 7) % n) for k, c in zip(o.o_orderkey, o.o_custkey)]


def _place(k):
    return k * 7919 % 4999, k * 6007 % 4993


def _components():
    root = {x: x for _, u, v in _streets() for x in (u, v)}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for _, u, v in _streets():
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def test_components_of_all_streets(spark):
    want = _components()
    assert {r.node: r.component for r in QUERIES["wcc"](spark, SF).collect()} == want
    sizes = pd.Series(want).value_counts()
    best = min(sizes.index[sizes == sizes.max()])
    assert {r.node for r in QUERIES["wcc_largest"](spark, SF).collect()} == {k for k, c in want.items() if c == best}


def test_centralities_of_all_streets(spark):
    after = {x: set() for _, u, v in _streets() for x in (u, v)}
    for _, u, v in _streets():
        after[u] |= {v} - {u}
    got = {r.id: r.closeness for r in QUERIES["centralities"](spark, SF).collect()}
    assert set(got) == set(after)
    for s in after:
        far, front = {s: 0}, [s]
        while front:
            front = [y for x in front for y in after[x] if y not in far and not far.update({y: far[x] + 1})]
        assert got[s] == pytest.approx((len(far) - 1) / sum(far.values()) if len(far) > 1 else 0.0)


def test_nearest_of_all_streets(spark):
    got = {r.bid: r.distance for r in QUERIES["nearest_street_50m"](spark, SF).collect()}
    ends = [(*_place(u), *_place(v)) for _, u, v in _streets()]
    for bid in pd.read_parquet(f"{SF}/part.parquet").p_partkey.tolist():
        x, y = bid * 4649 % 4999, bid * 3571 % 4993
        a = np.array(ends, float)
        d = a[:, 2:] - a[:, :2]
        t = np.clip(((np.array([x, y]) - a[:, :2]) * d).sum(axis=1) / (d * d).sum(axis=1), 0, 1)
        least = np.hypot(*(a[:, :2] + t[:, None] * d - [x, y]).T).min()
        assert got.get(bid, math.inf) == pytest.approx(least, abs=1e-5) if least <= 50 else bid not in got


def test_pagerank_converges(spark):
    got = {r.intersection_id: r.pagerank for r in QUERIES["pagerank"](spark, SF).collect()}
    n, links = len(got), [(u, v) for _, u, v in _streets()]
    step = np.zeros((n, n))
    for u, v in links:
        step[v, u] += 1
    step /= np.maximum(step.sum(axis=0), 1)
    want = np.linalg.solve(np.eye(n) - 0.85 * step, np.full(n, 0.15 / n))
    assert np.abs(want - [got[k] for k in range(n)]).sum() < 1e-5


def test_fill_goes_to_the_end_of_a_chain(spark, tmp_path):
    """Nodes 0 to 14 in a row; only node 0 and node 20, which no street meets, have a value."""
    pd.DataFrame({"c_custkey": range(40), "c_acctbal": [float(k) + 1 for k in range(40)]}).to_parquet(f"{tmp_path}/customer.parquet")
    pd.DataFrame({"o_orderkey": [203 * k for k in range(14)], "o_custkey": range(14)}).to_parquet(f"{tmp_path}/orders.parquet")
    got = {r.id: r.value for r in QUERIES["graph_fill"](spark, str(tmp_path)).collect()}
    assert [got[k] for k in range(16)] == [1.0] * 15 + [None]
