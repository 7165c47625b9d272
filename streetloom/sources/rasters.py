"""Rasters as tables of cells (row, col, value): windows, masks, new projections, years side by side, files and their pruning."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import polygons


@dataclass
class Grid:
    """Where a raster lies: its box (west, south, east, north), rows from the north, and columns."""

    box: tuple[float, float, float, float]
    height: int
    width: int

    def centre(self, row: Column, col: Column) -> tuple[Column, Column]:
        x0, y0, x1, y1 = self.box
        return x0 + (col + 0.5) * ((x1 - x0) / self.width), y1 - (row + 0.5) * ((y1 - y0) / self.height)

    def cell(self, x: Column, y: Column) -> tuple[Column, Column]:
        x0, y0, x1, y1 = self.box
        return F.floor((y1 - y) * self.height / (y1 - y0)), F.floor((x - x0) * self.width / (x1 - x0))


def located(cells: DataFrame, grid: Grid) -> DataFrame:
    x, y = grid.centre(F.col("row"), F.col("col"))
    return cells.withColumns({"x": x, "y": y})


def window(cells: DataFrame, grid: Grid, box: tuple[float, float, float, float]) -> DataFrame:
    """Cells whose squares meet the box: centres within it or half a cell outside."""
    hx, hy = (grid.box[2] - grid.box[0]) / grid.width / 2, (grid.box[3] - grid.box[1]) / grid.height / 2
    return located(cells, grid).where(F.col("x").between(box[0] - hx, box[2] + hx) & F.col("y").between(box[1] - hy, box[3] + hy))


def mask(cells: DataFrame, grid: Grid, areas: DataFrame, size: float, fill: float | None = None, ring: str = "ring") -> DataFrame:
    """Cells whose centre lies in one of the polygons; the others are dropped, or take the fill value where one is given."""
    inner = polygons.points_in(located(cells, grid), areas.select(ring), size, ring=ring).select("row", "col").distinct()
    if fill is None:
        return cells.join(inner, ["row", "col"], "left_semi")
    kept = cells.join(inner.withColumn("_in", F.lit(True)), ["row", "col"], "left")
    return kept.withColumn("value", F.when(F.col("_in"), F.col("value")).otherwise(F.lit(fill))).drop("_in").select("row", "col", "value")


def warp(cells: DataFrame, source: Grid, target: Grid, back: Callable[[Column, Column], tuple[Column, Column]]) -> DataFrame:
    """The raster on another grid, by nearest cells: `back` takes the target's coordinates to the source's.

    Every target cell computes the source cell it lies in and meets it by an equi-join; those outside have no value.
    """
    n = cells.sparkSession.range(target.height * target.width)
    at = n.select(F.floor(F.col("id") / target.width).cast("long").alias("row"), (F.col("id") % target.width).alias("col"))
    row, col = source.cell(*back(*target.centre(F.col("row"), F.col("col"))))
    at = at.withColumns({"_r": row.cast("long"), "_c": col.cast("long")})
    return at.join(cells.select(F.col("row").alias("_r"), F.col("col").alias("_c"), "value"), ["_r", "_c"], "left").select("row", "col", "value")


def by_year(cells: dict[int, DataFrame], prefix: str) -> DataFrame:
    """Rasters of the same grid side by side: row, col and a column for each year; one shuffle for all of them."""
    long = None
    for year, df in cells.items():
        part = df.select("row", "col", "value", F.lit(year).alias("_y"))
        long = part if long is None else long.unionByName(part)
    years = list(cells)
    out = long.groupBy("row", "col").pivot("_y", years).agg(F.first("value"))
    return out.withColumnsRenamed({str(y): f"{prefix}{y}" for y in years})


def beside(parts: list[tuple[DataFrame, int, int]], fill: float) -> DataFrame:
    """Rasters (cells, height, width) from left to right as one; lower ones are padded at the bottom with the fill value."""
    high, left, out = max(h for _, h, _ in parts), 0, None
    for cells, h, w in parts:
        part = cells.select("row", (F.col("col") + left).cast("long").alias("col"), "value")
        if h < high:
            pad = cells.sparkSession.range((high - h) * w)
            part = part.unionByName(pad.select((F.floor(F.col("id") / w) + h).cast("long").alias("row"), (F.col("id") % w + left).cast("long").alias("col"), F.lit(fill).alias("value")))
        out = part if out is None else out.unionByName(part)
        left += w
    return out


def prune(files: DataFrame, box: tuple[float, float, float, float]) -> list[str]:
    """Paths of the files (path, west, south, east, north) that meet a box: the only ones to be opened."""
    met = files.where((F.col("west") < box[2]) & (F.col("east") > box[0]) & (F.col("south") < box[3]) & (F.col("north") > box[1]))
    return sorted(r.path for r in met.select("path").collect())


def encode_geotiff(band: np.ndarray, box: tuple[float, float, float, float]) -> bytes:
    """A one-band TIFF of doubles in one deflated strip, with its place."""
    height, width = band.shape
    data = zlib.compress(np.ascontiguousarray(band, "<f8").tobytes())
    scale = struct.pack("<3d", (box[2] - box[0]) / width, (box[3] - box[1]) / height, 0.0)
    tie = struct.pack("<6d", 0.0, 0.0, 0.0, box[0], box[3], 0.0)
    at = 8 + len(data)
    at += at % 2
    entries = [(256, 4, 1, width), (257, 4, 1, height), (258, 3, 1, 64), (259, 3, 1, 8), (262, 3, 1, 1), (273, 4, 1, 8), (277, 3, 1, 1), (278, 4, 1, height), (279, 4, 1, len(data)), (339, 3, 1, 3), (33550, 12, 3, at), (33922, 12, 6, at + 24)]
    table = struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHII", *e) if e[1] != 3 else struct.pack("<HHIHH", *e, 0) for e in entries) + struct.pack("<I", 0)
    return b"II*\0" + struct.pack("<I", at + 72) + data + b"\0" * (at - 8 - len(data)) + scale + tie + table


def write_geotiffs(cells: DataFrame, grid: Grid, side: int, folder: str) -> DataFrame:
    """Write a raster as tiles of side x side cells, one file a tile, by the tasks that hold them; returns (path, tile).

    A tile of side squared cells is what one task gathers: the side bounds it. Missing cells are NaN.
    """
    import pandas as pd
    import pyarrow.fs as pafs

    west, south, east, north = grid.box
    wide, high = (east - west) / grid.width, (north - south) / grid.height

    def write(key, df):
        r0, c0 = key[0] * side, key[1] * side
        h, w = min(side, grid.height - r0), min(side, grid.width - c0)
        band = np.full((h, w), np.nan)
        band[df["row"].to_numpy() - r0, df["col"].to_numpy() - c0] = df["value"].to_numpy()
        box = (west + c0 * wide, north - (r0 + h) * high, west + (c0 + w) * wide, north - r0 * high)
        fs, base = pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        fs.create_dir(base, recursive=True)
        name = f"r{key[0]}_c{key[1]}.tif"
        with fs.open_output_stream(f"{base}/{name}") as out:
            out.write(encode_geotiff(band, box))
        return pd.DataFrame({"path": [f"{folder}/{name}"], "west": [box[0]], "south": [box[1]], "east": [box[2]], "north": [box[3]]})

    tiled = cells.select(F.floor(F.col("row") / side).alias("_tr"), F.floor(F.col("col") / side).alias("_tc"), "row", "col", "value")
    made = tiled.groupBy("_tr", "_tc").applyInPandas(write, "path string, west double, south double, east double, north double")
    spark: SparkSession = cells.sparkSession
    rows = [tuple(r) for r in made.collect()]  # a row for each tile
    return spark.createDataFrame(rows, "path string, west double, south double, east double, north double")
