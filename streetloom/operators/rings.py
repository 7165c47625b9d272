"""Rings traced from directed sides: cycles of a successor table, in order, by doubling; polygons with holes as one ring."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import _held
from .spatial_join import extent


#: Items that one task walks through; more take rounds of joins.
FEW = 200_000


def _walked(batches):
    """(item, face, ahead) of the cycles among the (item, next) that come."""
    after: dict[int, int] = {}
    for batch in batches:
        after.update(zip(batch.column("item").to_pylist(), batch.column("next").to_pylist(), strict=True))
    out: list[tuple[int, int, int]] = []
    while after:
        first, to = after.popitem()
        way = [first]
        while to != first and to in after:
            way.append(to)
            to = after.pop(to)
        if to == first:
            face = min(way)
            at = way.index(face)
            out += [(item, face, (at - k - 1) % len(way) + 1) for k, item in enumerate(way)]
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(3)], names=["item", "face", "ahead"])


def cycles(links: DataFrame) -> DataFrame:
    """(item, face, ahead) of the cycles of (item, next): the least item of each and the steps to it, from the cycle's length at itself to 1.

    Every item knows the least of its next 2^k successors. A cycle is known once its least item meets itself, after
    log2(length) rounds, and leaves: later rounds hold only the items of longer cycles, which are few in most maps, and
    once no more than FEW are left one task walks through them. Items on chains that end are not returned.
    """
    links = _held(links.select("item", "next"))
    now, out, step = links.select("item", F.col("next").alias("at"), F.col("next").alias("face"), F.lit(1).cast("long").alias("ahead")), None, 1
    while (left := now.count()) > FEW:
        closed = now.where("item = face").select("face")
        part = now.join(closed, "face", "left_semi").select("item", "face", "ahead")
        out = part if out is None else out.unionByName(part)
        now = now.join(closed, "face", "left_anti")
        far = now.select(F.col("item").alias("at"), F.col("at").alias("_at"), F.col("face").alias("_face"), F.col("ahead").alias("_ahead"))
        nearer = F.col("face") <= F.col("_face")
        now = _held(now.join(far, "at").select("item", F.col("_at").alias("at"), F.least("face", "_face").alias("face"), F.when(nearer, F.col("ahead")).otherwise(F.col("_ahead") + step).alias("ahead")))
        step *= 2
    rest = links if out is None else links.join(now.select("item"), "item", "left_semi")
    last = rest.coalesce(1).mapInArrow(_walked, "item long, face long, ahead long") if left else now.select("item", "face", "ahead")
    return last if out is None else out.unionByName(last)


#: Items that a tile has on average, and how many tiles a side of the next ones has.
TILE_ITEMS, COARSER = 10_000, 8
_LINK = "item long, next long, n long, low long, low_at long, tx long, ty long"
_WALKED = f"{_LINK}, head long, off long, face long, ahead long, around long"


def _walked_tile(table: pa.Table) -> pa.Table:
    """The chains of one tile: where they close, (face, ahead, around) of each link; else its chain's first link and the steps from there.

    A link leads from `item` to `next` in n steps and passes the item `low`, the least on its way, after low_at of them. The
    first link of a chain that leaves the tile takes on the whole chain's next, n, low and low_at; other open ones lose theirs.
    """
    names = table.column_names
    rows = dict(zip(table.column("item").to_pylist(), zip(*(table.column(c).to_pylist() for c in names), strict=True), strict=True))
    into = {r[1] for r in rows.values()}
    out: list[tuple] = []

    def walk(item: int) -> None:
        way, off, steps, low, low_at, first = [], [], 0, None, 0, item
        while (r := rows.pop(item, None)) is not None:
            way.append(r)
            off.append(steps)
            if low is None or r[3] < low:
                low, low_at = r[3], steps + r[4]
            steps += r[2]
            item = r[1]
        if item == first:
            out.extend((*r[:2], *r[2:], None, None, low, (low_at - o - 1) % steps + 1, steps) for r, o in zip(way, off, strict=True))
        else:
            out.append((first, item, steps, low, low_at, *way[0][5:], first, 0, None, None, None))
            out.extend((r[0], None, None, None, None, *r[5:], first, o, None, None, None) for r, o in zip(way[1:], off[1:], strict=True))

    for item in [k for k in rows if k not in into]:
        walk(item)
    while rows:  # what no chain began is closed
        walk(next(iter(rows)))
    fields = [*names, "head", "off", "face", "ahead", "around"]
    return pa.table({c: pa.array([r[k] for r in out], pa.int64()) for k, c in enumerate(fields)})


def placed_cycles(links: DataFrame) -> DataFrame:
    """cycles() of (item, next, x, y) with the items' places, in which no two items have the same next.

    A tile's task walks the chains in it: most cycles lie within one and are done. What leaves a tile is one link of the
    next round, in tiles COARSER times as wide, until FEW are left for one task. So no item is moved once a round, as in
    cycles(), which only takes what has not become much less in a round.
    """
    links = _held(links.select("item", "next", "x", "y"))
    n, area = extent(links)
    size = max((TILE_ITEMS * area / n) ** 0.5 if n and area and area == area else 1.0, 1e-9)
    at = lambda c: F.coalesce(F.floor(F.col(c) / size), F.lit(0)).cast("long").alias(f"t{c}")
    now = links.select("item", "next", F.lit(1).cast("long").alias("n"), F.col("item").alias("low"), F.lit(0).cast("long").alias("low_at"), at("x"), at("y"))
    levels, left = [], None
    while True:
        walked = _held(now.groupBy("tx", "ty").applyInArrow(_walked_tile, _WALKED))
        levels.append(walked)
        before, left = left, walked.where("off = 0").count()
        if not left or (before and (before <= FEW or left > before / 2)):
            break
        wide = lambda c: F.lit(0).cast("long").alias(c) if left <= FEW else F.floor(F.col(c) / COARSER).cast("long").alias(c)  # noqa: B023, E731
        now = walked.where("off = 0").select("item", "next", "n", "low", "low_at", wide("tx"), wide("ty"))
    closed = lambda df: df.where("face IS NOT NULL").select("item", "face", "ahead", "around")
    done = closed(levels[-1])
    for walked in levels[-2::-1]:
        of = done.select(F.col("item").alias("head"), "face", F.col("ahead").alias("_ahead"), "around")
        part = walked.where("head IS NOT NULL").select("item", "head", "off").join(of, "head")
        done = _held(closed(walked).unionByName(part.select("item", "face", (F.pmod(F.col("_ahead") - F.col("off") - 1, F.col("around")) + 1).alias("ahead"), "around")))
    done = done.select("item", "face", "ahead")
    if left > FEW:
        return done.unionByName(cycles(links.join(done.select("item"), "item", "left_anti").select("item", "next")))
    return done


def as_rings(sides: DataFrame, keys: list[str], start: str = "a") -> DataFrame:
    """(keys, face, ring) of sides (keys, item, next, start): closed rings, each from its least vertex on."""
    at = cycles(sides.select("item", "next"))
    got = at.hint("merge").join(sides.select("item", *keys, start), "item").groupBy(*keys, "face").agg(F.array_sort(F.collect_list(F.struct((-F.col("ahead")).alias("k"), F.col(start).alias("p")))).alias("_p"))
    return got.select(*keys, "face", closed(F.transform("_p", lambda q: q["p"])).alias("ring"))


def closed(path: Column) -> Column:
    """An open path as a closed ring that begins at its least vertex."""
    at = F.array_position(path, F.array_min(path)).cast("int")
    return F.concat(F.slice(path, at, F.size(path)), F.slice(path, F.lit(1), at))


def keyhole(rings: Column) -> Column:
    """A polygon's outer ring and holes as one closed ring, its holes reached by cuts that are walked both ways.

    Cuts cancel: areas, the even-odd rule and the overlays of this package see the polygon with its holes. The outer ring
    is turned counter-clockwise and holes clockwise, whatever way they came. Lengths count cuts twice: take them of the
    single rings. Rings of fewer than three sides are left out; null if the outer one is.
    """
    from ..functions.geometry import signed_area

    good = F.filter(rings, lambda r: F.size(r) >= 4)
    turned = F.transform(good, lambda r, i: F.when((signed_area(r) < 0) == (i == 0), F.reverse(r)).otherwise(r))
    first = F.get(turned, F.lit(0))
    holes = F.flatten(F.transform(F.slice(turned, F.lit(2), F.greatest(F.size(turned) - 1, F.lit(0))), lambda r: F.concat(r, F.slice(first, 1, 1))))
    return F.when(F.size(F.get(rings, F.lit(0))) >= 4, F.concat(first, holes))
