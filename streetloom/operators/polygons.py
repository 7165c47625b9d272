"""Joins and overlays of arbitrary polygons (closed `ring` arrays of {x, y}) on grid cells; dissolving; shared walls.

Every join spreads polygons over the cells that their bounds touch and puts the other side into cells too. A pair of two
extended shapes is accepted in one cell alone, that of the larger of their lower bounds, so no pair is made twice and
nothing has to be made distinct. Sides ask for a merge join, as in spatial_join; few polygons, such as zones, are broadcast if
the caller passes them as F.broadcast(). Rows whose shape has no area or a null coordinate take part in no pair. A polygon with
holes is one ring too: see rings.keyhole().
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as G
from ..functions import kernels as K
from .crossings import _passed, cut_at_crossings, undirected
from .graph import _held
from .overlay import bounds
from .rings import as_rings
from .spatial_join import PART, extent, in_parts


def _cells(df: DataFrame, box: dict[str, Column], size: float, tag: str, reach: float = 0.0) -> DataFrame:
    """A row for each cell that the box touches; the box's lower corner stays in columns named by the tag."""
    x0, y0 = box["_x0"], box["_y0"]
    span = lambda a, b: F.sequence(F.floor((a - reach) / size), F.floor((b + reach) / size))
    known = x0.isNotNull() & y0.isNotNull() & ~F.isnan(x0) & ~F.isnan(y0)
    df = df.where(known).withColumns({f"_{tag}x": x0 - reach, f"_{tag}y": y0 - reach, "_cxs": span(x0, box["_x1"]), "_cys": span(y0, box["_y1"])})
    return df.withColumn("_cx", F.explode("_cxs")).withColumn("_cy", F.explode("_cys")).drop("_cxs", "_cys")


def _owned(size: float) -> Column:
    return (F.col("_cx") == F.floor(F.greatest("_lx", "_rx") / size)) & (F.col("_cy") == F.floor(F.greatest("_ly", "_ry") / size))


_SCRATCH = ("_cx", "_cy", "_lx", "_ly", "_rx", "_ry")


def points_in(points: DataFrame, polygons: DataFrame, size: float, x: str = "x", y: str = "y", ring: str = "ring", same: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of points and polygons that hold them (even-odd rule) and have equal `same` columns; columns of both sides, the ring dropped."""
    at = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumns({"_cx": F.floor(F.col(x) / size), "_cy": F.floor(F.col(y) / size)})
    spread = _cells(polygons, bounds(ring), size, "r")
    return at.hint("merge").join(spread, [*same, "_cx", "_cy"]).where(G.inside(F.col(x), F.col(y), F.col(ring))).drop(ring, "_cx", "_cy", "_rx", "_ry")


#: Points of a tile of points_in_tiles, about.
TILE_POINTS = 2000


def points_in_tiles(points: DataFrame, polygons: DataFrame, size: float, ring: str = "ring") -> DataFrame:
    """As points_in for many polygons of which each holds few points: pairs within a tile are looked up (kernels.held_pairs).

    Tiles hold some 2000 points and are `size` wide at least; those of many rows are cut into parts.
    """
    known = points.where("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")
    n, area = extent(known)
    tile = max(size, math.sqrt(TILE_POINTS * area / n)) if n else size
    at = known.withColumns({"_cx": F.floor(F.col("x") / tile), "_cy": F.floor(F.col("y") / tile)})
    one = _held(polygons)  # otherwise every mention of a ring would make it anew
    left, right = in_parts(at, _cells(one, bounds(ring), tile, "r").drop("_rx", "_ry"), F.xxhash64("x", "y"), F.xxhash64(ring))
    own, other = points.columns, [c for c in polygons.columns if c != ring]
    schema = T.StructType([left.schema[c] for c in own] + [right.schema[c] for c in other])

    def held(p: pa.Table, r: pa.Table) -> pa.Table:
        i, j = (pa.array(k) for k in K.held_pairs(np.column_stack([p.column(c).to_numpy() for c in ("x", "y")]).astype(float), K.flat_rings(r.column(ring))))
        return pa.table({**{c: p.column(c).take(i) for c in own}, **{c: r.column(c).take(j) for c in other}})

    return left.groupBy(*PART).cogroup(right.groupBy(*PART)).applyInArrow(held, schema)


def overlaps(left: DataFrame, right: DataFrame, size: float, left_ring: str, right_ring: str, least: float = 1e-9) -> DataFrame:
    """Pairs of polygons that share an area above `least`, with `overlap` (that area); both rings are dropped.

    Polygons of metres that only touch come to less than 1e-12 by rounding; corners that overlap by 0.1 mm to 1e-8.
    """
    a, b = _cells(left, bounds(left_ring), size, "l"), _cells(right, bounds(right_ring), size, "r")
    pairs = a.hint("merge").join(b, ["_cx", "_cy"]).where(_owned(size)).drop(*_SCRATCH)
    p, q = bounds(left_ring), bounds(right_ring)
    pairs = pairs.where((p["_x0"] < q["_x1"]) & (q["_x0"] < p["_x1"]) & (p["_y0"] < q["_y1"]) & (q["_y0"] < p["_y1"]))
    return K.pair_column(pairs, "overlap", left_ring, right_ring, K.overlap_areas).where(F.col("overlap") > least).drop(left_ring, right_ring)


def _segment(df: DataFrame) -> DataFrame:
    at = lambda p: F.struct(F.col(f"{p}x").alias("x"), F.col(f"{p}y").alias("y"))
    return df.withColumn("_segment", F.array(at("u"), at("v")))


def _segment_pairs(segments: DataFrame, polygons: DataFrame, size: float, ring: str, reach: float = 0.0) -> DataFrame:
    box = {"_x0": F.least("ux", "vx"), "_x1": F.greatest("ux", "vx"), "_y0": F.least("uy", "vy"), "_y1": F.greatest("uy", "vy")}
    a, b = _cells(segments, box, size, "l"), _cells(polygons, bounds(ring), size, "r", reach)
    pairs = a.hint("merge").join(b, ["_cx", "_cy"]).where(_owned(size)).drop(*_SCRATCH)
    q = bounds(ring)
    return pairs.where((box["_x0"] <= q["_x1"] + reach) & (box["_x1"] >= q["_x0"] - reach) & (box["_y0"] <= q["_y1"] + reach) & (box["_y1"] >= q["_y0"] - reach))


def segments_in(segments: DataFrame, polygons: DataFrame, size: float, ring: str = "ring") -> DataFrame:
    """Pairs of segments (ux, uy, vx, vy) and polygons that a part of positive length lies in, with `share` and `inside_length`."""
    pairs = _segment(_segment_pairs(segments, polygons, size, ring))
    got = K.pair_column(pairs, "share", "_segment", ring, K.inside_shares, closed=False).where("share > 1e-9")
    return got.withColumn("inside_length", F.col("share") * F.hypot(F.col("vx") - F.col("ux"), F.col("vy") - F.col("uy"))).drop("_segment", ring)


def outside_length(segments: DataFrame, polygons: DataFrame, key: str, size: float, ring: str = "ring") -> DataFrame:
    """(key, outside_length): what polygons that do not overlap one another leave of each segment; a whole segment where none meets it."""
    length = F.hypot(F.col("vx") - F.col("ux"), F.col("vy") - F.col("uy"))
    taken = segments_in(segments.select(key, "ux", "uy", "vx", "vy"), polygons.select(ring), size, ring).groupBy(key).agg(F.sum("share").alias("_s"))
    return segments.join(taken, key, "left").select(key, (length * F.greatest(F.lit(0.0), 1 - F.coalesce("_s", F.lit(0.0)))).alias("outside_length"))


def outside_parts(segments: DataFrame, polygons: DataFrame, key: str, size: float, ring: str = "ring") -> DataFrame:
    """(key, ux, uy, vx, vy) of the pieces of segments that lie in no polygon.

    A segment's stays inside polygons are intervals of its way; what is left between them is found by the running end of
    the intervals in order, so polygons may overlap.
    """
    pairs = _segment(_segment_pairs(segments.select(key, "ux", "uy", "vx", "vy"), polygons.select(ring), size, ring))
    stays = _stays(pairs, key, ring)
    both = stays.unionByName(segments.select(key, F.lit(1.0).alias("low"), F.lit(1.0).alias("high")))
    so_far = F.max("high").over(Window.partitionBy(key).orderBy("low", "high").rowsBetween(Window.unboundedPreceding, -1))
    gaps = both.withColumn("from", F.coalesce(so_far, F.lit(0.0))).where(F.col("low") - F.col("from") > 1e-9).select(key, "from", F.col("low").alias("to"))
    on = lambda a, b, t: F.col(a) + (F.col(b) - F.col(a)) * F.col(t)
    return gaps.join(segments.select(key, "ux", "uy", "vx", "vy"), key).select(key, on("ux", "vx", "from").alias("ux"), on("uy", "vy", "from").alias("uy"), on("ux", "vx", "to").alias("vx"), on("uy", "vy", "to").alias("vy"))


def _stays(pairs: DataFrame, key: str, ring: str) -> DataFrame:
    """(key, low, high): the intervals of each pair's segment's way that lie inside the ring."""
    held = pairs.select(key, "_segment", ring)
    schema = T.StructType([held.schema[key], T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType())])

    def run(batches):
        for batch in batches:
            for part, segments, rings in K.pair_stacks(batch, "_segment", ring, closed=False):
                row, low, high = K.inside_stays(segments, rings)
                yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(part[row])), pa.array(low), pa.array(high)], names=[key, "low", "high"])

    return held.mapInArrow(run, schema)


def edges_of(polygons: DataFrame, keys: list[str], ring: str = "ring") -> DataFrame:
    """(keys, a, b): the sides of each ring in their order's direction, without those of no length."""
    n = F.size(ring)
    pairs = F.arrays_zip(F.slice(ring, F.lit(1), n - 1).alias("a"), F.slice(ring, F.lit(2), n - 1).alias("b"))
    return polygons.where(n > 1).select(*keys, F.explode(pairs).alias("e")).select(*keys, F.col("e.a").alias("a"), F.col("e.b").alias("b")).where("a <> b")


def shared_walls(polygons: DataFrame, key: str, size: float, ring: str = "ring") -> DataFrame:
    """(key, shared_length, shared_ratio): how much of each polygon's border runs along other polygons' borders.

    Where two others run along the same piece of border it counts once for each.
    """
    e = edges_of(polygons, [key], ring).select(F.col(key).alias("_own"), F.col("a.x").alias("ux"), F.col("a.y").alias("uy"), F.col("b.x").alias("vx"), F.col("b.y").alias("vy"))
    pairs = _segment_pairs(e, polygons.select(F.col(key).alias("_other"), ring), size, ring, 1e-6).where("_own <> _other")
    got = K.pair_column(_segment(pairs), "share", "_segment", ring, K.border_shares, closed=False).where("share > 0")
    shared = got.groupBy("_own").agg(F.sum(F.col("share") * F.hypot(F.col("vx") - F.col("ux"), F.col("vy") - F.col("uy"))).alias("shared_length"))
    out = polygons.select(key, G.length(F.col(ring)).alias("_p")).join(shared, F.col(key) == F.col("_own"), "left")
    s = F.coalesce("shared_length", F.lit(0.0))
    return out.select(key, s.alias("shared_length"), F.coalesce(F.try_divide(s, F.col("_p")), F.lit(0.0)).alias("shared_ratio"))


def _outline(border: DataFrame, group: str) -> DataFrame:
    """(group, rings, area, perimeter) of the border sides (group, a, b), the inside on their left.

    Each side goes on at the side that turns most to the right, so parts that touch at a vertex are rings of their own.
    """
    border = _held(border.withColumn("item", F.xxhash64(F.col(group).cast("string"), "a", "b")))
    after = border.select(group, F.col("a").alias("b"), F.col("b").alias("_c"), F.col("item").alias("_next"))
    turn = F.pmod(F.atan2(F.col("_c.y") - F.col("b.y"), F.col("_c.x") - F.col("b.x")) - F.atan2(F.col("a.y") - F.col("b.y"), F.col("a.x") - F.col("b.x")), F.lit(2 * math.pi))
    # Most to the right of the way in: the largest turn counter-clockwise from the way back is that of the outer ring's neighbour.
    links = border.join(after, [group, "b"]).groupBy("item").agg(F.max_by("_next", turn).alias("next"))
    rings = as_rings(border.join(links, "item"), [group])
    return rings.groupBy(group).agg(F.sum(G.signed_area(F.col("ring"))).alias("area"), F.sum(G.length(F.col("ring"))).alias("perimeter"), F.sort_array(F.collect_list("ring")).alias("rings"))


def dissolve(polygons: DataFrame, group: str, ring: str = "ring") -> DataFrame:
    """(group, rings, area, perimeter): the outline of each group's union, outer rings counter-clockwise, holes clockwise.

    Polygons of a group must not overlap and must share borders vertex by vertex, as zones of a plan do; union() takes any.
    Sides met in both directions vanish, and what is left is traced by pointer doubling, so no group is gathered before
    its outline is known.
    """
    turned = polygons.withColumn(ring, F.when(G.signed_area(F.col(ring)) < 0, F.reverse(ring)).otherwise(F.col(ring)))
    e = edges_of(turned, [group], ring)
    back = e.select(group, F.col("b").alias("a"), F.col("a").alias("b")).groupBy(group, "a", "b").agg(F.count(F.lit(1)).alias("_m"))
    once = e.groupBy(group, "a", "b").agg(F.count(F.lit(1)).alias("_n")).join(back, [group, "a", "b"], "left").where("_m IS NULL").select(group, "a", "b")
    return _outline(once, group)


#: Rings that a tile's task holds at once; of more each side meets a part, and the rest of the work is left to exact cuts.
TILE_RINGS = 20_000
#: Rings that a tile begins with on average, where it may be wider than a cell for it.
FULL = 300


def _outer(sides: DataFrame, polygons: DataFrame, group: str, size: float, snap: float, ring: str) -> DataFrame:
    """sides (_side, group, ux, uy, vx, vy) without what a single polygon of their group covers on both hands.

    Sides and polygons meet in tiles (kernels.uncovered). A side that keeps several stretches comes as several; stretches go
    on past the border that they meet, so where sides cross on the outline both are left with their crossing. Nothing here
    is on an outline, so what is missed costs time alone.
    """
    first = polygons.select(F.get(ring, F.lit(0)).alias("_at")).select("_at.x", "_at.y").where("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")
    n, area = extent(first)
    size = max(size, math.sqrt(FULL * area / n)) if n else size
    tile = ["_g", "_cx", "_cy"]
    # Named anew: sides come from the polygons.
    spread = _cells(polygons.select(F.col(group).alias("_g"), ring), bounds(ring), size, "r").select(*tile, ring)
    parts = spread.groupBy(*tile).agg(F.ceil(F.count(F.lit(1)) / TILE_RINGS).alias("_n"))
    dealt = lambda df, by: df.hint("merge").join(parts, tile, "left").withColumn("_p", F.pmod(F.xxhash64(by), F.coalesce("_n", F.lit(1)))).drop("_n")
    walk, spread = dealt(_passed(sides.withColumnRenamed(group, "_g"), size), "_side"), dealt(spread, ring)

    def left(key, a: pa.Table, b: pa.Table) -> pa.Table:
        s = np.column_stack([a.column(c).to_numpy() for c in ("ux", "uy", "vx", "vy")]).reshape(-1, 4)
        low, high = np.zeros(len(s)), np.ones(len(s))
        for k, at in ((0, key[1].as_py()), (1, key[2].as_py())):
            d = s[:, k + 2] - s[:, k]
            with np.errstate(divide="ignore", invalid="ignore"):
                t0, t1 = (at * size - s[:, k]) / d, ((at + 1) * size - s[:, k]) / d
            low = np.maximum(low, np.where(d == 0, 0.0, np.minimum(t0, t1)))
            high = np.where((d == 0) & (np.floor(s[:, k] / size) != at), 0.0, np.minimum(high, np.where(d == 0, 1.0, np.maximum(t0, t1))))
        row, low, high = K.uncovered(s, low, high, K.flat_rings(b.column(ring)), 10 * snap, 1e4 * snap)
        return pa.table({"_side": a.column("_side").take(pa.array(row)), "low": low, "high": high})

    by = [*tile, "_p"]
    kept = walk.groupBy(*by).cogroup(spread.groupBy(*by)).applyInArrow(left, "_side long, low double, high double")
    # Stretches that meet at a tile's edge are one again.
    way = Window.partitionBy("_side").orderBy("low")
    begun = kept.withColumn("_new", (F.col("low") > F.max("high").over(way.rowsBetween(Window.unboundedPreceding, -1)) + 1e-9).cast("int"))
    runs = begun.withColumn("_run", F.sum(F.coalesce("_new", F.lit(0))).over(way)).groupBy("_side", "_run").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    on = lambda a, b, t: F.when(t <= 1e-12, F.col(a)).when(t >= 1 - 1e-12, F.col(b)).otherwise(F.col(a) + (F.col(b) - F.col(a)) * t)
    ends = [on(f"u{c}", f"v{c}", F.col(t)).alias(f"{e}{c}") for e, t in (("u", "low"), ("v", "high")) for c in ("x", "y")]
    return sides.hint("merge").join(runs, "_side").select(F.monotonically_increasing_id().alias("_side"), group, *ends)


def union(polygons: DataFrame, group: str, size: float, ring: str = "ring", snap: float = 1e-6) -> DataFrame:
    """(group, rings, area, perimeter): the outline of each group's union, of polygons that may overlap in any way.

    Of sides only what no single polygon covers is looked at. It is cut where it crosses or touches other sides of its
    group, in grid cells; a piece is on the outline if the place
    just beside it is in a polygon of the group on one hand and in none on the other. Pieces of several polygons count
    once. Places are snapped to `snap`; gaps and overlaps narrower than 20 of it may be closed. Polygons are closed rings
    that run either way, holes by keyhole(); one that crosses itself covers what the even-odd rule gives it.
    """
    one = _held(polygons.select(group, ring))  # otherwise every mention below would make the rings anew
    sides = edges_of(one, [group], ring).select(F.monotonically_increasing_id().alias("_side"), group, F.col("a.x").alias("ux"), F.col("a.y").alias("uy"), F.col("b.x").alias("vx"), F.col("b.y").alias("vy"))
    sides = _held(_outer(_held(sides), one, group, size, snap, ring))
    pieces = undirected(cut_at_crossings(sides, "_side", size, snap, (group,))).select(group, "a", "b").distinct()
    pieces = _held(pieces.withColumn("_piece", F.monotonically_increasing_id()))
    dx, dy = F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y")
    hand = F.explode(F.array(F.lit(-1), F.lit(1))).alias("_hand")
    off = 10 * snap / F.hypot(dx, dy) * F.col("_hand")
    beside = pieces.select("_piece", group, "a", "b", hand).select("_piece", group, "_hand", ((F.col("a.x") + F.col("b.x")) / 2 - dy * off).alias("x"), ((F.col("a.y") + F.col("b.y")) / 2 + dx * off).alias("y"))
    filled = points_in(beside, one, size, ring=ring, same=(group,)).groupBy("_piece").agg(F.min("_hand").alias("_low"), F.max("_hand").alias("_high"))
    border = pieces.join(filled.where("_low = _high"), "_piece")  # the inside is on one hand: it is to be the left one
    return _outline(border.select(group, F.when(F.col("_low") > 0, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(F.col("_low") > 0, F.col("b")).otherwise(F.col("a")).alias("b")), group)


def drop_covered(polygons: DataFrame, key: str, size: float, ring: str = "ring", share: float = 0.5) -> DataFrame:
    """polygons without those of which another, larger one (the lesser key of equals) covers at least `share`."""
    a = polygons.select(F.col(key).alias("_a"), G.area(F.col(ring)).alias("_sa"), F.col(ring).alias("_ra"))
    b = polygons.select(F.col(key).alias("_b"), G.area(F.col(ring)).alias("_sb"), F.col(ring).alias("_rb"))
    pairs = overlaps(a, b, size, "_ra", "_rb").where((F.col("_a") != F.col("_b")) & ((F.col("_sb") > F.col("_sa")) | ((F.col("_sb") == F.col("_sa")) & (F.col("_b") < F.col("_a")))))
    gone = pairs.where(F.col("overlap") >= share * F.col("_sa")).select(F.col("_a").alias(key)).distinct()
    return polygons.join(gone, key, "left_anti")


def cells_in(raster: DataFrame, polygons: DataFrame, size: float, ring: str = "ring") -> DataFrame:
    """Pairs of raster cells (x, y of the centre) and the polygons their centres are in: rasterised polygons."""
    return points_in(raster, polygons, size, ring=ring)


def total_bounds(df: DataFrame, ring: str = "ring") -> DataFrame:
    """One row: minx, miny, maxx, maxy over all rings."""
    b = bounds(ring)
    return df.agg(F.min(b["_x0"]).alias("minx"), F.min(b["_y0"]).alias("miny"), F.max(b["_x1"]).alias("maxx"), F.max(b["_y1"]).alias("maxy"))


def disc_footprints(points: DataFrame, polygons: DataFrame, key: str, radius: float, attributes: list[str], sides: int = 64, ring: str = "ring") -> DataFrame:
    """(key, building_count, clipped_area, and of each attribute <a>_sum, <a>_mean, <a>_std) of the polygons that the regular
    polygon around each point (x, y) overlaps; points that meet none have no row.

    No pair leaves a task: points and polygons meet in tiles of four radii (kernels.footprints), which are cut into parts if
    they have many rows. Sums are of what lies above the attributes' means in whole numbers, so that squares do not cancel.
    """
    tile = 4.0 * radius
    one = _held(polygons.select(ring, *[F.col(a).cast("double").alias(a) for a in attributes]))  # rings are made once
    base = one.agg(F.lit(0), *[F.round(F.avg(F.when(~F.isnan(a), F.col(a)))) for a in attributes]).first()[1:]
    base = [m if m is not None and math.isfinite(m) else 0.0 for m in base]
    at = points.select(F.col(key).alias("_key"), "x", "y").where("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")
    at = at.withColumns({"_cx": F.floor(F.col("x") / tile), "_cy": F.floor(F.col("y") / tile)})
    left, right = in_parts(at, _cells(one, bounds(ring), tile, "r", radius).drop("_rx", "_ry"), F.xxhash64("_key"), F.xxhash64(ring))
    names = ["_c", "_a", *[f"_{f}{k}" for k in range(len(attributes)) for f in "nsq"]]

    def summed(p: pa.Table, r: pa.Table) -> pa.Table:
        values = []
        for a, m in zip(attributes, base, strict=True):
            c = r.column(a)
            there = c.is_valid().to_numpy()
            v = np.where(there, c.to_numpy() - m, 0.0)
            values += [there.astype(float), v, v * v]
        flat = np.column_stack(values) if values else np.zeros((r.num_rows, 0))
        got = K.footprints(np.column_stack([p.column(c).to_numpy() for c in ("x", "y")]).astype(float), K.flat_rings(r.column(ring)), flat, radius, sides)
        some = got[:, 0] > 0
        return pa.table({"_key": p.column("_key").filter(pa.array(some)), **{n: got[some, k] for k, n in enumerate(names)}})

    schema = f"_key {at.schema['_key'].dataType.simpleString()}, " + ", ".join(f"{n} double" for n in names)
    got = left.groupBy(*PART).cogroup(right.groupBy(*PART)).applyInArrow(summed, schema).groupBy(F.col("_key").alias(key)).agg(*[F.sum(n).alias(n) for n in names])
    out = [F.col("_c").cast("long").alias("building_count"), F.col("_a").alias("clipped_area")]
    for k, (a, m) in enumerate(zip(attributes, base, strict=True)):
        n, s, q = (F.col(f"_{f}{k}") for f in "nsq")
        spread = F.when(n > 1, F.sqrt(F.greatest(F.lit(0.0), q - s * s / n) / (n - 1)))
        out += [F.when(n > 0, s + n * m).alias(f"{a}_sum"), F.try_divide(s + n * m, n).alias(f"{a}_mean"), spread.alias(f"{a}_std")]
    return got.select(key, *out)
