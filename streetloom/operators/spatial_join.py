"""Spatial joins as equi-joins of grid cells with an exact predicate after them.

Rows that are spread over cells ask for a merge join: Spark judges a side by the bytes of its files, which know nothing of
the rows that explode() makes of them, and would gather and broadcast it from the driver.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from .graph import _held


def _cells(df: DataFrame, x: str, y: str, size: float, reach: int) -> DataFrame:
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    cx, cy = F.floor(F.col(x) / size), F.floor(F.col(y) / size)
    if not reach:
        return df.withColumns({"_cx": cx, "_cy": cy})
    return df.withColumn("_dx", F.explode(steps)).withColumn("_dy", F.explode(steps)).withColumns({"_cx": cx + F.col("_dx"), "_cy": cy + F.col("_dy")}).drop("_dx", "_dy")


def within_distance(left: DataFrame, right: DataFrame, radius: float, lx: str = "x", ly: str = "y", rx: str = "rx", ry: str = "ry") -> DataFrame:
    """Pairs at most radius apart, with `distance`. Cells are as wide as the radius; the right side stands in its neighbours too."""
    pairs = _cells(left, lx, ly, radius, 0).hint("merge").join(_cells(right, rx, ry, radius, 1), ["_cx", "_cy"]).drop("_cx", "_cy")
    dx, dy = F.col(lx) - F.col(rx), F.col(ly) - F.col(ry)
    return pairs.where(dx * dx + dy * dy <= radius * radius).withColumn("distance", F.sqrt(dx * dx + dy * dy))


#: Rows of a side that a tile's task holds at once; more are cut into parts.
TILE_ROWS = 200_000


PART = ("_cx", "_cy", "_p", "_q")


def in_parts(left: DataFrame, right: DataFrame, left_hash: Column, right_hash: Column) -> tuple[DataFrame, DataFrame]:
    """Both sides' rows of the tiles (_cx, _cy) that both have, with the parts (_p, _q) in which each pair meets once.

    Tiles of more than TILE_ROWS rows of a side are cut by the hash of its rows.
    """
    at = ["_cx", "_cy"]
    many = lambda df, name: df.groupBy(*at).agg(F.ceil(F.count(F.lit(1)) / TILE_ROWS).alias(name))
    parts = many(left, "_lp").join(many(right, "_rp"), at)
    all_of = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    a = left.hint("merge").join(parts, at).withColumns({"_p": F.pmod(left_hash, "_lp"), "_q": all_of("_rp")})
    b = right.hint("merge").join(parts, at).withColumns({"_q": F.pmod(right_hash, "_rp"), "_p": all_of("_lp")})
    return a.drop("_lp", "_rp"), b.drop("_lp", "_rp")


def disc_sums(targets: DataFrame, others: DataFrame, key: str, radius: float, sums: dict[str, Column], x: str = "x", y: str = "y") -> DataFrame:
    """(key, and of all others (x, y) at most radius away the sums of the columns named, as doubles); targets without any have no row.

    No pair is made: targets and the others around them meet in tiles of four radii, where running sums are taken
    (kernels.disc_sums). Others of one place count as one with their sums, and tiles of many rows are cut into parts, so that
    a task's rows are bounded whatever the density.
    """
    tile, names = 4.0 * radius, ["_n", *sums]
    placed = lambda df: df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y))
    t = placed(targets.select(F.col(key).alias("_key"), x, y)).withColumns({"_cx": F.floor(F.col(x) / tile), "_cy": F.floor(F.col(y) / tile)})
    each = {"_n": F.lit(1.0), **sums}
    o = placed(others.select(x, y, *[c.cast("double").alias(f"_s{k}") for k, c in enumerate(each.values())]))
    # Named anew: the others may be the very table that the targets come from.
    o = o.groupBy(F.col(x).alias("_x"), F.col(y).alias("_y")).agg(*[F.sum(f"_s{k}").alias(f"_s{k}") for k in range(len(names))])
    span = lambda c: F.explode(F.sequence(F.floor((F.col(c) - radius) / tile), F.floor((F.col(c) + radius) / tile)))
    o = o.withColumn("_cx", span("_x")).withColumn("_cy", span("_y"))
    t, o = in_parts(t, o, F.xxhash64("_key"), F.xxhash64("_x", "_y"))

    def summed(left: pa.Table, right: pa.Table) -> pa.Table:
        columns = lambda table, cs: np.column_stack([table.column(c).to_numpy() for c in cs]).astype(float).reshape(-1, len(cs))
        got = K.disc_sums(columns(left, (x, y)), columns(right, ("_x", "_y")), columns(right, [f"_s{k}" for k in range(len(names))]), radius)
        some = got[:, 0] > 0
        return pa.table({"_key": left.column("_key").filter(pa.array(some)), **{f"_s{k}": got[some, k] for k in range(len(names))}})

    schema = f"_key {t.schema['_key'].dataType.simpleString()}, " + ", ".join(f"_s{k} double" for k in range(len(names)))
    got = t.groupBy(*PART).cogroup(o.groupBy(*PART)).applyInArrow(summed, schema)
    return got.groupBy(F.col("_key").alias(key)).agg(*[F.sum(f"_s{k}").alias(n) for k, n in enumerate(names)])


def nearest(left: DataFrame, right: DataFrame, key: str, right_key: str, radius: float, **names: str) -> DataFrame:
    """For each left row its nearest right rows within radius; ties give several rows."""
    order = Window.partitionBy(key).orderBy("distance")
    return within_distance(left, right, radius, **names).withColumn("_rank", F.rank().over(order)).where("_rank = 1").drop("_rank")


def nearest_in_tiles(left: DataFrame, right: DataFrame, key: str, right_key: str, radius: float) -> DataFrame:
    """(key, right_key, distance) of each left row's (x, y) nearest right rows (rx, ry) within radius; ties give several rows.

    As nearest(), but pairs are looked up in tiles of four radii and only the nearest leave a task; right rows of one place
    are looked up as one. `right_key` is to be a whole number.
    """
    tile = 4.0 * radius
    at = left.select(F.col(key).alias("_key"), "x", "y").where("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")
    known = right.select(right_key, "rx", "ry").where("rx IS NOT NULL AND ry IS NOT NULL AND NOT isnan(rx) AND NOT isnan(ry)")
    span = lambda c: F.explode(F.sequence(F.floor((F.col(c) - radius) / tile), F.floor((F.col(c) + radius) / tile)))
    a = at.withColumns({"_cx": F.floor(F.col("x") / tile), "_cy": F.floor(F.col("y") / tile)})
    b = known.select("rx", "ry").distinct().withColumn("_cx", span("rx")).withColumn("_cy", span("ry"))
    a, b = in_parts(a, b, F.xxhash64("_key"), F.xxhash64("rx", "ry"))

    def best(p: pa.Table, q: pa.Table) -> pa.Table:
        flat = lambda t, cs: np.column_stack([t.column(c).to_numpy() for c in cs]).astype(float)
        i, j, d2 = K.nearest_places(flat(p, ("x", "y")), flat(q, ("rx", "ry")), radius)
        return pa.table({"_key": p.column("_key").take(pa.array(i)), "rx": q.column("rx").take(pa.array(j)), "ry": q.column("ry").take(pa.array(j)), "_d2": d2})

    schema = f"_key {at.schema['_key'].dataType.simpleString()}, rx {known.schema['rx'].dataType.simpleString()}, ry {known.schema['ry'].dataType.simpleString()}, _d2 double"
    got = a.groupBy(*PART).cogroup(b.groupBy(*PART)).applyInArrow(best, schema)
    # The parts of a tile have a nearest each.
    got = got.withColumn("_rank", F.rank().over(Window.partitionBy("_key").orderBy("_d2"))).where("_rank = 1").drop("_rank")
    return got.join(known.hint("merge"), ["rx", "ry"]).select(F.col("_key").alias(key), right_key, F.sqrt("_d2").alias("distance"))


def extent(points: DataFrame, x: str = "x", y: str = "y") -> tuple[int, float]:
    """Number of points and the area of the box around them."""
    n, x0, x1, y0, y1 = points.agg(F.count(F.lit(1)), F.min(x), F.max(x), F.min(y), F.max(y)).first()
    return n, (x1 - x0) * (y1 - y0) if n else 0.0


def _radius(n: int, area: float, hits: float, start: float) -> float:
    """The radius of a disc that holds so many points on average, `start` at most."""
    r = math.sqrt(hits * area / (math.pi * n)) if n else 0.0
    return min(start, r) if r > 0 else start


def knn(points: DataFrame, key: str, k: int, start: float) -> DataFrame:
    """(key, neighbour, distance, rank) of each point's k nearest points, itself included; ties by id.

    The first search radius is `start`, or less where points lie so dense that a smaller disc holds three times k of them.
    It doubles for points that have fewer than k hits within it, so no pair farther than needed is made.
    Points without a place (a null or NaN coordinate) neither have neighbours nor are any. With fewer than k places all of
    them are neighbours.
    """
    points = points.where("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")
    n, area = extent(points)
    k = min(k, n)
    right = points.select(F.col(key).alias("neighbour"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    left, radius, parts = points.select(key, "x", "y"), _radius(n, area, 3.0 * k, start), []
    while True:
        order = Window.partitionBy(key).orderBy("distance", "neighbour")
        ranked = within_distance(left, right, radius).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(key, "neighbour", "distance", "rank")
        # Held: the pairs of a round are made once, for its result and for what it leaves open.
        ranked = _held(ranked.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(key))))
        parts.append(ranked.where(F.col("_n") >= k).drop("_n"))
        left = _held(left.join(ranked.where((F.col("rank") == k) & (F.col("_n") >= k)).select(key), key, "left_anti"))
        radius *= 2
        if left.isEmpty():
            break
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def nearest_any(left: DataFrame, right: DataFrame, key: str, right_key: str, start: float, x: str = "rx", y: str = "ry") -> DataFrame:
    """(key, right_key, distance) of each left row's nearest right row however far, ties to the least id.

    The first radius is `start`, or less where the right side's points lie so dense that a smaller disc holds four of them. It
    doubles for rows without a hit; rows without a place and an empty right side give no rows.
    """
    out = None
    open_ = left.select(key, "x", "y").where("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")
    right = right.where(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y))
    n, area = extent(right, x, y)
    radius = _radius(n, area, 4.0, start)
    if not n:
        return within_distance(open_, right.select(right_key, x, y), radius, rx=x, ry=y).select(key, right_key, "distance")
    while True:
        pairs = within_distance(open_, right.select(right_key, x, y), radius, rx=x, ry=y)
        best = pairs.groupBy(key).agg(F.min(F.struct("distance", right_key)).alias("b")).select(key, f"b.{right_key}", "b.distance")
        best = _held(best)
        out = best if out is None else out.unionByName(best)
        open_ = _held(open_.join(best, key, "left_anti"))
        if open_.isEmpty():
            return out
        radius *= 2
