"""Joins of points with line segments (columns ux, uy, vx, vy) through the grid cells that segments pass."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import kernels as K
from .graph import _held
from .spatial_join import PART, extent, in_parts


def near_segments(points: DataFrame, segments: DataFrame, key: str, segment_key: str, radius: float, also: tuple[str, ...] = (), tile: float | None = None, nearest: bool = False) -> DataFrame:
    """Pairs of points (x, y) and segments at most radius apart, with `distance` and the place `t` (0 to 1) of the foot.

    `also` names columns of the segments that pairs keep. `nearest`, with a `tile`: of each point's pairs in a task only the
    nearest leave it, with those less than 1e-8 farther.

    Cells are two radii wide, or as wide as `tile` says: then the pairs within a cell are looked up (kernels.near_pairs) instead of
    joined, which pays where a cell holds many more pairs than are near. A point stands in its own cell alone; a segment stands in every cell that it comes within a
    radius of: column by column, the rows between its heights at the column's two sides, all widened by the radius. So each
    pair arises once. Rows without a place give no pairs.
    """
    size = max(2.0 * radius, tile or 0.0)
    dx, dy = F.col("vx") - F.col("ux"), F.col("vy") - F.col("uy")
    x0, x1, y0, y1 = F.least("ux", "vx"), F.greatest("ux", "vx"), F.least("uy", "vy"), F.greatest("uy", "vy")
    span = lambda a, b: F.sequence(F.floor((a - radius) / size), F.floor((b + radius) / size))
    known = segments.where(F.col("ux").isNotNull() & F.col("uy").isNotNull() & F.col("vx").isNotNull() & F.col("vy").isNotNull())
    walk = known.select(segment_key, *also, "ux", "uy", "vx", "vy", F.explode(span(x0, x1)).alias("_cx"))
    # The part of the segment within a radius of the column, and the heights between which it runs there.
    left, right = F.greatest(x0, F.col("_cx") * size - radius), F.least(x1, (F.col("_cx") + 1) * size + radius)
    height = lambda x: F.coalesce(F.col("uy") + (x - F.col("ux")) * F.try_divide(dy, dx), F.col("uy"))
    steep = F.abs(dx) < 1e-9
    low = F.when(steep, y0).otherwise(F.least(height(left), height(right)))
    high = F.when(steep, y1).otherwise(F.greatest(height(left), height(right)))
    cells = walk.withColumn("_cy", F.explode(span(F.greatest(y0, low - 1e-6), F.least(y1, high + 1e-6))))
    at = points.select(key, "x", "y").where("x IS NOT NULL AND y IS NOT NULL").withColumns({"_cx": F.floor(F.col("x") / size), "_cy": F.floor(F.col("y") / size)})
    # See spatial_join: cells are more than the segments' files let expect, so they are not to be broadcast.
    pairs = _looked_up(at, cells, key, segment_key, also, radius, nearest) if tile else at.join(cells.hint("merge"), ["_cx", "_cy"]).drop("_cx", "_cy")
    along = ((F.col("x") - F.col("ux")) * dx + (F.col("y") - F.col("uy")) * dy) / F.greatest(dx * dx + dy * dy, F.lit(1e-12))
    pairs = pairs.withColumn("t", F.greatest(F.lit(0.0), F.least(F.lit(1.0), along)))
    return pairs.withColumn("distance", F.hypot(F.col("x") - F.col("ux") - F.col("t") * dx, F.col("y") - F.col("uy") - F.col("t") * dy)).where(F.col("distance") <= radius)


def _looked_up(at: DataFrame, cells: DataFrame, key: str, segment_key: str, also: tuple[str, ...], radius: float, nearest: bool = False) -> DataFrame:
    points, ends = [key, "x", "y"], [segment_key, *also, "ux", "uy", "vx", "vy"]
    left, right = in_parts(at, cells, F.xxhash64(key), F.xxhash64(segment_key))
    schema = T.StructType([at.schema[c] for c in points] + [cells.schema[c] for c in ends])

    def pairs(p: pa.Table, s: pa.Table) -> pa.Table:
        flat = lambda table, cs: np.column_stack([table.column(c).to_numpy() for c in cs]).astype(float)
        xy, lines = flat(p, ("x", "y")), flat(s, ("ux", "uy", "vx", "vy"))
        i, j = K.near_pairs(xy, lines, radius)
        if nearest:
            some = K.nearest_of(xy, lines, i, j, 1e-8)
            i, j = i[some], j[some]
        i, j = pa.array(i), pa.array(j)
        return pa.table({**{c: p.column(c).take(i) for c in points}, **{c: s.column(c).take(j) for c in ends}})

    return left.groupBy(*PART).cogroup(right.groupBy(*PART)).applyInArrow(pairs, schema)


#: Points of a tile of nearest_segment, about.
TILE_POINTS = 2000


def nearest_segment(points: DataFrame, segments: DataFrame, key: str, segment_key: str, radius: float, ties: bool = False) -> DataFrame:
    """Each point's nearest segment within radius; of equal distances the least id, or all of them with `ties`.

    The first round looks as far as it takes to meet eight segments on average; the reach grows eightfold, up to the radius,
    for points without a hit. So dense networks don't make all pairs within the radius. Tiles hold some 2000 points, whatever
    the reach. Segments of the same ends count as one with the least id, but with `ties`.
    """
    ends = ["ux", "uy", "vx", "vy"]
    known = segments.where(" AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in ends))
    lines = _held(known.select(segment_key, *ends) if ties else known.groupBy(*ends).agg(F.min(segment_key).alias(segment_key)))
    open_ = points.select(key, "x", "y").where("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")
    left, area = extent(open_)
    x0, x1, y0, y1 = F.min(F.least("ux", "vx")), F.max(F.greatest("ux", "vx")), F.min(F.least("uy", "vy")), F.max(F.greatest("uy", "vy"))
    total, wide, high, n = lines.agg(F.sum(F.hypot(F.col("vx") - F.col("ux"), F.col("vy") - F.col("uy"))), x1 - x0, y1 - y0, F.count(F.lit(1))).first()
    reach = min(radius, 4.0 * wide * high / total) if n and total > 0 and wide * high > 0 else radius
    tile = max(math.sqrt(TILE_POINTS * area / left), radius) if n and left else radius
    out, tie = None, F.col("_d")
    while True:
        near = near_segments(open_, lines, key, segment_key, reach, tile=tile, nearest=True).withColumn("_d", F.round("distance", 9))
        whole = Window.partitionBy(key)
        best = near.withColumn("_k", F.rank().over(whole.orderBy(tie)) if ties else F.row_number().over(whole.orderBy(tie, segment_key))).where("_k = 1").drop("_k")
        if reach >= radius:
            best = best.drop("_d")
            return best if out is None else out.unionByName(best)
        # At the edge of the reach another segment of the same rounded distance may lie just beyond it: those go on.
        best = _held(best.where(tie < reach - 1e-8).drop("_d"))
        out = best if out is None else out.unionByName(best)
        open_ = _held(open_.join(best.select(key).distinct(), key, "left_anti"))
        left = open_.count()
        if not left:
            return out
        reach = min(radius, 8.0 * reach)


def clipped_length(points: DataFrame, segments: DataFrame, key: str, segment_key: str, radius: float) -> DataFrame:
    """(key, length): length of segments inside the disc around each point; 0 where there is none.

    Segments between the same two places, either way, are met once and count as often as they are.
    """
    first = F.struct("ux", "uy") <= F.struct("vx", "vy")
    turned = {c: F.when(first, F.col(c)).otherwise(F.col(d)).alias(c) for c, d in (("ux", "vx"), ("uy", "vy"), ("vx", "ux"), ("vy", "uy"))}
    lines = segments.select(segment_key, *turned.values()).groupBy(*turned).agg(F.min(segment_key).alias(segment_key), F.count(F.lit(1)).alias("_times"))
    pairs = near_segments(points, lines, key, segment_key, radius, ("_times",))
    dx, dy, fx, fy = F.col("vx") - F.col("ux"), F.col("vy") - F.col("uy"), F.col("ux") - F.col("x"), F.col("uy") - F.col("y")
    a, b, c = dx * dx + dy * dy, 2 * (fx * dx + fy * dy), fx * fx + fy * fy - radius * radius
    root = F.sqrt(F.greatest(F.lit(0.0), b * b - 4 * a * c))
    low, high = F.greatest(F.lit(0.0), (-b - root) / (2 * a)), F.least(F.lit(1.0), (-b + root) / (2 * a))
    inside = F.when(a > 0, F.greatest(F.lit(0.0), high - low) * F.sqrt(a)).otherwise(0.0)
    got = pairs.groupBy(key).agg(F.sum(inside * F.col("_times")).alias("length"))
    return points.select(key).join(got, key, "left").na.fill(0.0, ["length"])


def by_square(segments: DataFrame, key: str, size: float) -> DataFrame:
    """(key, _cx, _cy, length): length of each segment inside each grid square that it passes, where above 0.

    A segment on the border of two squares counts in both.
    """
    span = lambda a, b: F.explode(F.sequence(F.floor(F.least(a, b) / size), F.floor(F.greatest(a, b) / size)))
    cells = segments.select(key, "ux", "uy", "vx", "vy").withColumn("_cx", span("ux", "vx")).withColumn("_cy", span("uy", "vy"))

    def within(u: str, v: str, cell: str):
        """Share of the way at which the segment enters and leaves the strip of the cell."""
        d, low = F.col(v) - F.col(u), F.col(cell) * size
        a, b = F.try_divide(low - F.col(u), d), F.try_divide(low + size - F.col(u), d)
        return F.when(d == 0, F.lit(0.0)).otherwise(F.least(a, b)), F.when(d == 0, F.lit(1.0)).otherwise(F.greatest(a, b))

    (x0, x1), (y0, y1) = within("ux", "vx", "_cx"), within("uy", "vy", "_cy")
    share = F.least(F.lit(1.0), x1, y1) - F.greatest(F.lit(0.0), x0, y0)
    return cells.withColumn("length", share * F.hypot(F.col("vx") - F.col("ux"), F.col("vy") - F.col("uy"))).where("length > 1e-9").select(key, "_cx", "_cy", "length")
