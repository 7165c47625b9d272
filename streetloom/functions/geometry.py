"""Geometry as column expressions over rings (closed arrays of {x, y}) and coordinates; Arrow kernels where those fall short."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH = 6371009.0


def _pairs(ring: Column) -> Column:
    n = F.greatest(F.size(ring) - 1, F.lit(0))
    return F.zip_with(F.slice(ring, F.lit(1), n), F.slice(ring, F.lit(2), n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def signed_area(ring: Column) -> Column:
    cross = F.transform(_pairs(ring), lambda p: p["a"]["x"] * p["b"]["y"] - p["b"]["x"] * p["a"]["y"])
    return F.aggregate(cross, F.lit(0.0), lambda s, c: s + c) / 2


def area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def length(ring: Column) -> Column:
    return F.aggregate(F.transform(_pairs(ring), lambda p: F.hypot(p["a"]["x"] - p["b"]["x"], p["a"]["y"] - p["b"]["y"])), F.lit(0.0), lambda s, c: s + c)


def complexity(a: Column, p: Column) -> Column:
    return p / F.sqrt(F.sqrt(a))


def fractal_dimension(a: Column, p: Column) -> Column:
    return 2 * F.log(p / 4) / F.log(a)


def square_compactness(a: Column, p: Column) -> Column:
    return F.pow(4 * F.sqrt(a) / p, 2)


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value made once a row: named in f several times it would be made as often."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def turns(ring: Column) -> Column:
    """Interior angles in degrees (0 to 180) at each vertex of a closed ring; null at a vertex that repeats a neighbour."""

    def angle(p: Column, q: Column, r: Column) -> Column:
        ax, ay, bx, by = p["x"] - q["x"], p["y"] - q["y"], r["x"] - q["x"], r["y"] - q["y"]
        cos = F.try_divide(ax * bx + ay * by, F.hypot(ax, ay) * F.hypot(bx, by))
        return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos))))

    def of(ring: Column) -> Column:
        n = F.size(ring) - 1
        return F.transform(F.sequence(F.lit(0), n - 1), lambda i: angle(F.get(ring, F.pmod(i - 1 + n, n)), F.get(ring, i), F.get(ring, i + 1)))

    return once(ring, of)


def corners(ring: Column) -> Column:
    return F.size(F.filter(turns(ring), lambda a: a <= 170)).cast("long")


def squareness(ring: Column) -> Column:
    """Mean deviation from a right angle over the vertices that turn; null where none does."""
    kept = F.transform(F.filter(turns(ring), lambda a: (a <= 175) | (a >= 185)), lambda a: F.abs(90 - a))
    return once(kept, lambda k: F.try_divide(F.aggregate(k, F.lit(0.0), lambda s, c: s + c), F.size(k)))


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def bearing(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    d = F.radians(lon2 - lon1)
    y = F.sin(d) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0))


def web_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    r = 6378137.0
    return F.radians(lon) * r, F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * r


def utm_zone(mean_lon: Column) -> Column:
    return F.floor((mean_lon + 180) / 6) + 1


def tile_id(lon: Column, lat: Column, zoom: int) -> Column:
    """Slippy-map tile as z/x/y."""
    n = float(1 << zoom)
    x = F.floor((lon + 180) / 360 * n)
    y = F.floor((1 - F.log(F.tan(F.radians(lat)) + 1 / F.cos(F.radians(lat))) / math.pi) / 2 * n)
    return F.concat_ws("/", F.lit(str(zoom)), x.cast("string"), y.cast("string"))


def inside(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd rule."""
    crossed = F.filter(_pairs(ring), lambda p: ((p["a"]["y"] > y) != (p["b"]["y"] > y)) & (x < F.try_divide((p["b"]["x"] - p["a"]["x"]) * (y - p["a"]["y"]), p["b"]["y"] - p["a"]["y"]) + p["a"]["x"]))
    return F.size(crossed) % 2 == 1


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull, counter-clockwise, without the closing point."""
    pts = np.unique(points, axis=0)
    if len(pts) < 3:
        return pts

    def half(order):
        out: list = []
        for p in order:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(pts) + half(pts[::-1]))


def _ring_area(p: np.ndarray) -> float:
    return abs(float(np.dot(p[:, 0], np.roll(p[:, 1], -1)) - np.dot(p[:, 1], np.roll(p[:, 0], -1)))) / 2


def bounding_rectangle(h: np.ndarray) -> tuple[float, float, float]:
    """Sides (long, short) and azimuth of the long side of the rectangle of least area around a hull."""
    edges = np.roll(h, -1, axis=0) - h
    best = None
    for t in np.unique(np.round(np.arctan2(edges[:, 1], edges[:, 0]) % (math.pi / 2), 12)):
        c, s = math.cos(t), math.sin(t)
        a, b = h @ np.array([c, s]), h @ np.array([-s, c])
        w, d = float(np.ptp(a)), float(np.ptp(b))
        if best is None or w * d < best[0] - 1e-12:
            az = math.degrees(t) if w >= d else math.degrees(t) + 90
            best = w * d, max(w, d), min(w, d), az % 180
    return best[1:]


def enclosing_radius(h: np.ndarray) -> float:
    """Radius of the least circle around a hull, by Welzl's steps in a fixed order."""

    def of(*p):
        if len(p) == 2:
            c = (p[0] + p[1]) / 2
            return c, float(np.hypot(*(p[0] - c)))
        (ax, ay), (bx, by), (cx, cy) = p
        d = 2 * (ax * (by - cy) + bx * (cy - ay) + cx * (ay - by))
        if abs(d) < 1e-12:
            return max((of(a, b) for a in p for b in p), key=lambda x: x[1])
        u = np.array([((ax * ax + ay * ay) * (by - cy) + (bx * bx + by * by) * (cy - ay) + (cx * cx + cy * cy) * (ay - by)) / d, ((ax * ax + ay * ay) * (cx - bx) + (bx * bx + by * by) * (ax - cx) + (cx * cx + cy * cy) * (bx - ax)) / d])
        return u, float(np.hypot(*(p[0] - u)))

    c, r = h[0], 0.0
    out = lambda p: np.hypot(*(p - c)) > r * (1 + 1e-12) + 1e-12
    for i in range(len(h)):
        if out(h[i]):
            c, r = h[i], 0.0
            for j in range(i):
                if out(h[j]):
                    c, r = of(h[i], h[j])
                    for k in range(j):
                        if out(h[k]):
                            c, r = of(h[i], h[j], h[k])
    return r


MORPHOLOGY = "convexity double, rectangularity double, eri double, elongation double, orientation double, longest_axis double, circular_compactness double, shape_index double"
#: Rings of at most so many vertices are worked on in stacks, all their pairs and triples at once.
FEW = 12


def morphology(df: DataFrame, ring: str = "ring") -> DataFrame:
    """df with the metrics that need hull, least rectangle and least circle, all from one Arrow pass.

    Null rings, rings with null coordinates, of fewer than three vertices, or without an area have null metrics.
    """
    from . import kernels as K

    def measured(pts: np.ndarray) -> tuple:
        h = hull(pts)
        if len(h) < 3:
            return (0.0,) * 7
        per = float(np.hypot(*(np.roll(pts, -1, axis=0) - pts).T).sum())
        return (_ring_area(pts), per, _ring_area(h), *bounding_rectangle(h), enclosing_radius(h))

    def make(batch):
        first, n, xy = K.flat_rings(batch.column(ring))
        found = np.full((batch.num_rows, 7), np.nan)
        for k, at in K.by_size(np.where(n >= 3, n, 0), lambda k: k**4 if k <= FEW else 1):
            if k:
                stack = K.stack(first[at], k, xy)
                good = np.isfinite(stack).all(axis=(1, 2))
                at, stack = at[good], stack[good]
                if len(at):
                    found[at] = K.bounding_metrics(stack) if k <= FEW else np.array([measured(p - p[0]) for p in stack])
        area, per, around, long, short, azimuth, r = np.where((found[:, 2:3] > 0) & (found[:, 4:5] > 0), found, np.nan).T
        folded = np.abs((azimuth + 45) % 90 - 45)
        share = area / (long * short)
        return [area / around, share, np.sqrt(share) * 2 * (long + short) / per, short / long, folded, 2 * r, area / (np.pi * r * r), np.sqrt(area / np.pi) / r]

    return K.with_columns(df, MORPHOLOGY, make)
