"""Cycles walked tile by tile against one walk over all."""

import numpy as np
import pytest

from streetloom.operators import plots, rings


@pytest.mark.parametrize(("few", "items"), [(10_000, 8), (10, 8), (0, 8), (0, 10_000)])
def test_cycles_in_tiles(spark, monkeypatch, few, items):
    """Cycles of 1 to 150 items whose places wander over many tiles, and a chain that ends."""
    rng, rows, want = np.random.default_rng(4), [], {}
    for size in (1, 2, 3, 7, 40, 150):
        ids = rng.permutation(10**6)[:size] * 1000 + size
        x, y = np.cumsum(rng.normal(0, 3, (2, size)), axis=1) + rng.uniform(0, 100, (2, 1))
        rows += [(int(a), int(b), float(c), float(d)) for a, b, c, d in zip(ids, np.roll(ids, -1), x, y, strict=True)]
        low = int(np.argmin(ids))
        want |= {int(k): (int(ids[low]), (low - j - 1) % size + 1) for j, k in enumerate(ids)}
    rows += [(-k, -k - 1, float(k), 5.0) for k in range(1, 30)]
    monkeypatch.setattr(rings, "FEW", few)
    monkeypatch.setattr(rings, "TILE_ITEMS", items)
    got = rings.placed_cycles(spark.createDataFrame(rows, "item long, next long, x double, y double")).collect()
    assert len(got) == len(want) and {r.item: (r.face, r.ahead) for r in got} == want


def test_plots_of_a_large_town_take_few_jobs(spark, monkeypatch):
    """A block's border is walked where it lies: rounds of joins over all sides would be made for it with FEW at 0."""
    monkeypatch.setattr(rings, "FEW", 0)
    monkeypatch.setattr(rings, "TILE_ITEMS", 200)
    monkeypatch.setattr(rings, "cycles", lambda *a: pytest.fail("rounds over all sides"))
    at = "struct(double({0}) as x, double({1}) as y)"
    k = spark.range(900).selectExpr("id % 30 as x", "id div 30 as y")
    edges = k.selectExpr(f"{at.format('x', 'y')} as a", f"{at.format('x + 1', 'y')} as b").union(k.selectExpr(at.format("x", "y"), at.format("x", "y + 1")))
    got = plots.plots(edges).selectExpr("count(*) as n", "sum(area) as a").first()
    assert (got.n, got.a) == (29 * 29, 29 * 29.0)
