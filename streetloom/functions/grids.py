"""Grids, tiles and projections as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def square(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    at = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return F.array(at(x0, y0), at(x1, y0), at(x1, y1), at(x0, y1), at(x0, y0))


def tile_bounds(tile: Column) -> Column:
    """(west, south, east, north) of a slippy-map tile named z/x/y."""
    part = F.split(tile, "/")
    n = F.pow(F.lit(2.0), F.get(part, F.lit(0)).cast("int"))
    x, y = F.get(part, F.lit(1)).cast("double"), F.get(part, F.lit(2)).cast("double")
    lat = lambda k: F.degrees(F.atan(F.sinh(F.lit(math.pi) * (1 - 2 * k / n))))
    return F.struct((x / n * 360 - 180).alias("west"), lat(y + 1).alias("south"), ((x + 1) / n * 360 - 180).alias("east"), lat(y).alias("north"))


def tile_pixel(tile: Column, px: Column, py: Column, extent: int = 4096) -> tuple[Column, Column]:
    """Longitude and latitude of a pixel inside a tile, counted from its north-west corner."""
    part = F.split(tile, "/")
    n = F.pow(F.lit(2.0), F.get(part, F.lit(0)).cast("int"))
    x, y = F.get(part, F.lit(1)).cast("double") + px / extent, F.get(part, F.lit(2)).cast("double") + py / extent
    return x / n * 360 - 180, F.degrees(F.atan(F.sinh(F.lit(math.pi) * (1 - 2 * y / n))))


def delta_grid(spark: SparkSession, box: tuple[float, float, float, float], delta: float) -> DataFrame:
    """(cell_id, row, col, ring): int(width / delta) evenly spaced grid lines each way, so one cell fewer; row-major."""
    x0, y0, x1, y1 = box
    nx, ny = int((x1 - x0) / delta) - 1, int((y1 - y0) / delta) - 1
    if nx < 1 or ny < 1:
        return spark.createDataFrame([], "cell_id long, row long, col long, ring array<struct<x: double, y: double>>")
    dx, dy = (x1 - x0) / nx, (y1 - y0) / ny
    cells = spark.range(nx * ny).select(F.col("id").alias("cell_id"), F.floor(F.col("id") / nx).alias("row"), (F.col("id") % nx).alias("col"))
    return cells.withColumn("ring", square(x0 + F.col("col") * dx, y0 + F.col("row") * dy, x0 + (F.col("col") + 1) * dx, y0 + (F.col("row") + 1) * dy))


def near_square_split(spark: SparkSession, n: int) -> DataFrame:
    """(part, row, col) of n parts on floor(sqrt n) rows of ceil(n / rows) columns, row-major, without those beyond n."""
    cols = math.ceil(n / math.isqrt(n))
    return spark.range(n).select(F.col("id").alias("part"), F.floor(F.col("id") / cols).alias("row"), (F.col("id") % cols).alias("col"))


def block_of(row: Column, col: Column, height: int, width: int, side: int = 4) -> Column:
    """Block number of a cell when a raster is cut into side x side blocks; the last ones take what is left over."""
    at = lambda k, n: F.least(F.lit(side - 1), F.floor(k / max(1, n // side)))
    return (at(row, height) * side + at(col, width)).cast("long")


def affine(box: tuple[float, float, float, float], height: int, width: int, row: Column, col: Column) -> tuple[Column, Column]:
    """Centre of a raster cell, rows counted from the north."""
    x0, y0, x1, y1 = box
    return x0 + (col + 0.5) * ((x1 - x0) / width), y1 - (row + 0.5) * ((y1 - y0) / height)


def utm(lon: Column, lat: Column, zone: int) -> tuple[Column, Column]:
    """Easting and northing in metres on the WGS 84 ellipsoid, by the Krueger series to the third order.

    Northings south of the equator are negative.
    """
    a, f = 6378137.0, 1 / 298.257223563
    n = f / (2 - f)
    mean = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * math.sqrt(n) / (1 + n)
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for k, c in enumerate(alpha, 1):
        east = east + c * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
        north = north + c * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
    return 500000 + 0.9996 * mean * east, 0.9996 * mean * north


def segments_of(lines: DataFrame, key: str, line: str = "line") -> DataFrame:
    """(key, part, ux, uy, vx, vy): a row for each two consecutive vertices."""
    n = F.size(line)
    pairs = F.arrays_zip(F.slice(line, F.lit(1), n - 1).alias("a"), F.slice(line, F.lit(2), n - 1).alias("b"))
    return lines.where(n > 1).select(key, F.posexplode(pairs).alias("part", "p")).select(key, "part", F.col("p.a.x").alias("ux"), F.col("p.a.y").alias("uy"), F.col("p.b.x").alias("vx"), F.col("p.b.y").alias("vy"))


def parse_wkt(text: Column) -> Column:
    """The vertices of a WKT point, line, or polygon of one ring."""
    inner = F.regexp_replace(F.regexp_extract(text, r"\(+([^()]*)\)", 1), r"^\s+|\s+$", "")
    at = lambda p, k: F.get(F.split(F.trim(p), r"\s+"), F.lit(k)).cast("double")
    return F.transform(F.split(inner, ","), lambda p: F.struct(at(p, 0).alias("x"), at(p, 1).alias("y")))


def wkt_polygon(ring: Column) -> Column:
    return F.concat(F.lit("POLYGON (("), F.array_join(F.transform(ring, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), ", "), F.lit("))"))
