"""Overlays of polygons (closed arrays of {x, y}) with convex windows, through grid cells and an exact clip."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as G

#: Sides of the polygon that stands for a disc.
SIDES = 64


def clip_convex(ring: np.ndarray, window: np.ndarray) -> np.ndarray:
    """The part of a polygon inside a convex counter-clockwise window; rings are open. A concave polygon may come back
    with parts joined along the window's border, which leaves its area right."""
    out = ring
    ends = np.roll(window, -1, axis=0)
    d = ends - window
    far = d[:, :1] * (ring[None, :, 1] - window[:, 1:]) - d[:, 1:] * (ring[None, :, 0] - window[:, :1])
    # Sides that have the whole polygon on their inner hand cut nothing.
    for k in np.flatnonzero((far < 0).any(axis=1)):
        a, b = window[k], ends[k]
        if len(out) == 0:
            break
        side = (b[0] - a[0]) * (out[:, 1] - a[1]) - (b[1] - a[1]) * (out[:, 0] - a[0])
        kept = []
        for i in range(len(out)):
            p, q, sp, sq = out[i - 1], out[i], side[i - 1], side[i]
            if (sp < 0) != (sq < 0):
                kept.append(p + (q - p) * (sp / (sp - sq)))
            if sq >= 0:
                kept.append(q)
        out = np.array(kept)
    return out


def disc(x: float, y: float, radius: float, sides: int = SIDES) -> np.ndarray:
    t = np.arange(sides) * (2 * math.pi / sides)
    return np.column_stack([x + radius * np.cos(t), y + radius * np.sin(t)])


def _area(p: np.ndarray) -> float:
    if len(p) < 3:
        return 0.0
    q = p - p[0]
    return abs(float(np.dot(q[:, 0], np.roll(q[:, 1], -1)) - np.dot(q[:, 1], np.roll(q[:, 0], -1)))) / 2


def _clipped(df: DataFrame, ring: str, window) -> DataFrame:
    """df with `clipped_area`: row by row, the area of `ring` inside window(row)."""
    columns = df.columns
    schema = T.StructType([*[T.StructField(f.name, f.dataType, True) for f in df.schema], T.StructField("clipped_area", T.DoubleType())])

    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            areas = []
            for row in rows:
                pts = np.array([(p["x"], p["y"]) for p in row[ring][:-1]], dtype=float).reshape(-1, 2)
                areas.append(_area(clip_convex(pts, window(row))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(areas, pa.float64())], names=[*columns, "clipped_area"])

    return df.mapInArrow(run, schema)


def bounds(ring: str) -> dict[str, Column]:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return {"_x0": F.array_min(xs), "_x1": F.array_max(xs), "_y0": F.array_min(ys), "_y1": F.array_max(ys)}


def _spread(df: DataFrame, ring: str, size: float, reach: float) -> DataFrame:
    """A row for each cell that the ring's bounds, widened by reach, touch."""
    span = lambda a, b: F.sequence(F.floor((F.col(a) - reach) / size), F.floor((F.col(b) + reach) / size))
    return df.withColumns(bounds(ring)).withColumn("_cx", F.explode(span("_x0", "_x1"))).withColumn("_cy", F.explode(span("_y0", "_y1"))).drop("_x0", "_x1", "_y0", "_y1")


def with_squares(polygons: DataFrame, size: float, ring: str = "ring") -> DataFrame:
    """Polygons cut by the squares of a grid: a row for each square of positive overlap, with _cx, _cy and `clipped_area`."""

    def window(row):
        x, y = row["_cx"] * size, row["_cy"] * size
        return np.array([(x, y), (x + size, y), (x + size, y + size), (x, y + size)])

    return _clipped(_spread(polygons, ring, size, 0.0), ring, window).where("clipped_area > 1e-9")


def with_discs(points: DataFrame, polygons: DataFrame, radius: float, ring: str = "ring") -> DataFrame:
    """Pairs of a point (x, y) and a polygon that its disc of 64 sides overlaps, with `clipped_area`.

    A point stands in one cell of two radii, a polygon in all that its widened bounds touch, so each pair arises once.
    """
    size = 2.0 * radius
    at = points.withColumns({"_cx": F.floor(F.col("x") / size), "_cy": F.floor(F.col("y") / size)})
    pairs = at.join(_spread(polygons, ring, size, radius), ["_cx", "_cy"]).drop("_cx", "_cy")
    # Farthest vertex from the centre: within the circle inside all sides, the polygon is whole. Nearest point of the
    # bounds: beyond the radius, it is out. Only the others are clipped.
    away = F.array_max(F.transform(ring, lambda p: F.hypot(p["x"] - F.col("x"), p["y"] - F.col("y"))))
    box = bounds(ring)
    gap = lambda c, low, high: F.greatest(F.lit(0.0), low - F.col(c), F.col(c) - high)
    near = F.hypot(gap("x", box["_x0"], box["_x1"]), gap("y", box["_y0"], box["_y1"]))
    pairs = pairs.where(near <= radius).withColumn("_whole", away <= radius * math.cos(math.pi / SIDES))
    inside = pairs.where("_whole").drop("_whole").withColumn("clipped_area", G.area(F.col(ring)))
    cut = _clipped(pairs.where("NOT _whole").drop("_whole"), ring, lambda row: disc(row["x"], row["y"], radius))
    return inside.unionByName(cut).where("clipped_area > 1e-9")


def drop_overlapped(polygons: DataFrame, key: str, area: str) -> DataFrame:
    """Of rows with the same id the one of largest area."""
    best = polygons.groupBy(key).agg(F.max(area).alias("_a"))
    return polygons.join(best, key).where(F.col(area) == F.col("_a")).drop("_a").dropDuplicates([key])


def merge_zones(zones: DataFrame, group: str, ring: str = "ring") -> DataFrame:
    """Zones of a group as one multipolygon: the list of their rings, without edges that two zones share counted in `perimeter`.

    Zones must not overlap; an edge is shared if the same two vertices bound both.
    """
    edge = zones.select(group, F.explode(F.arrays_zip(F.slice(ring, F.lit(1), F.size(ring) - 1).alias("a"), F.slice(ring, F.lit(2), F.size(ring) - 1).alias("b"))).alias("e"))
    a, b = F.col("e.a"), F.col("e.b")
    outer = edge.groupBy(group, F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).agg(F.count(F.lit(1)).alias("n")).where("n = 1").groupBy(group).agg(F.sum(F.hypot(F.col("a.x") - F.col("b.x"), F.col("a.y") - F.col("b.y"))).alias("perimeter"))
    return zones.groupBy(group).agg(F.collect_list(ring).alias("rings"), F.count(F.lit(1)).alias("n_zones")).join(outer, group, "left")
