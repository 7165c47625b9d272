"""SQL functions: register(spark) makes the geometry expressions callable from spark.sql as ug_*."""

from __future__ import annotations

import math

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

_RING = "ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>"
_TURN = "aggregate(sequence(1, size(ring) - 1), 0D, (s, i) -> s + {})"

#: Bodies are SQL, so calls are inlined into the plan and stay in generated code.
FUNCTIONS = {
    "ug_area": (f"ring {_RING}", "DOUBLE", "abs(" + _TURN.format("ring[i - 1].x * ring[i].y - ring[i].x * ring[i - 1].y") + ") / 2"),
    "ug_length": (f"ring {_RING}", "DOUBLE", _TURN.format("hypot(ring[i].x - ring[i - 1].x, ring[i].y - ring[i - 1].y)")),
    "ug_haversine": ("lon1 DOUBLE, lat1 DOUBLE, lon2 DOUBLE, lat2 DOUBLE", "DOUBLE", "2 * 6371009D * asin(sqrt(least(1D, pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2))))"),
    "ug_bearing": ("lon1 DOUBLE, lat1 DOUBLE, lon2 DOUBLE, lat2 DOUBLE", "DOUBLE", "pmod(degrees(atan2(sin(radians(lon2 - lon1)) * cos(radians(lat2)), cos(radians(lat1)) * sin(radians(lat2)) - sin(radians(lat1)) * cos(radians(lat2)) * cos(radians(lon2 - lon1)))), 360D)"),
    "ug_tile": ("lon DOUBLE, lat DOUBLE, zoom INT", "STRING", "concat_ws('/', zoom, floor((lon + 180) / 360 * pow(2, zoom)), floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * pow(2, zoom)))"),
    "ug_inside": (f"px DOUBLE, py DOUBLE, ring {_RING}", "BOOLEAN", "size(filter(sequence(1, size(ring) - 1), i -> ((ring[i - 1].y > py) != (ring[i].y > py)) AND px < (ring[i].x - ring[i - 1].x) * try_divide(py - ring[i - 1].y, ring[i].y - ring[i - 1].y) + ring[i - 1].x)) % 2 = 1"),
    "ug_complexity": ("area DOUBLE, perimeter DOUBLE", "DOUBLE", "perimeter / sqrt(sqrt(area))"),
}


class GridTable:
    """Cells of a grid over a box, row by row: int(width / delta) lines each way, so one cell fewer."""

    COLUMNS = "cell_id long, row long, col long, minx double, miny double, maxx double, maxy double"

    def eval(self, x0: float, y0: float, x1: float, y1: float, delta: float):
        nx, ny = int((x1 - x0) / delta) - 1, int((y1 - y0) / delta) - 1
        if nx < 1 or ny < 1:
            return
        dx, dy = (x1 - x0) / nx, (y1 - y0) / ny
        for k in range(nx * ny):
            row, col = divmod(k, nx)
            yield k, row, col, x0 + col * dx, y0 + row * dy, x0 + (col + 1) * dx, y0 + (row + 1) * dy


class TilesTable:
    """Map tiles that a box of longitudes and latitudes touches."""

    COLUMNS = "tile_id string, x long, y long"

    def eval(self, west: float, south: float, east: float, north: float, zoom: int):
        n = 1 << zoom
        row = lambda lat: min(n - 1, max(0, math.floor((1 - math.asinh(math.tan(math.radians(lat))) / math.pi) / 2 * n)))
        column = lambda lon: min(n - 1, max(0, math.floor((lon + 180) / 360 * n)))
        for y in range(row(north), row(south) + 1):
            for x in range(column(west), column(east) + 1):
                yield f"{zoom}/{x}/{y}", x, y


def register(spark: SparkSession) -> list[str]:
    """Register all functions for this session; returns their names."""
    for name, (args, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {result} RETURN {body}")
    for name, table in (("ug_grid", GridTable), ("ug_tiles", TilesTable)):
        spark.udtf.register(name, udtf(table, returnType=table.COLUMNS))
    return [*FUNCTIONS, "ug_grid", "ug_tiles"]
