"""Files of layers: GeoJSON, points in CSV, border files for extraction tools, GeoTIFF rasters, points as grid cells."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rings import keyhole

_FEATURE = "struct<type string, properties map<string,string>, geometry struct<type string, coordinates string>>"
_DEPTH = {"Point": 1, "MultiPoint": 2, "LineString": 2, "MultiLineString": 3, "Polygon": 3, "MultiPolygon": 4}


def _points(lists: Column) -> Column:
    return F.transform(lists, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))


def read_geojson(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(properties, gtype, parts): every geometry as a list of parts, a part as a list of rings (or one line), a ring as points.

    `lines`: one feature a line, which splits into tasks; otherwise one FeatureCollection a file. A feature without a
    geometry has null parts.
    """
    if lines:
        f = spark.read.text(path).where("trim(value) <> ''").select(F.from_json("value", _FEATURE).alias("f"))
    else:
        f = spark.read.schema(f"type string, features array<{_FEATURE}>").option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    kind, text = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    deep = lambda n: F.from_json(text, "array<" * n + "double" + ">" * n)
    parts = (
        F.when(kind == "Point", F.array(F.array(_points(F.array(deep(1))))))
        .when(kind == "MultiPoint", F.transform(deep(2), lambda p: F.array(_points(F.array(p)))))
        .when(kind == "LineString", F.array(F.array(_points(deep(2)))))
        .when(kind == "MultiLineString", F.transform(deep(3), lambda p: F.array(_points(p))))
        .when(kind == "Polygon", F.array(F.transform(deep(3), _points)))
        .when(kind == "MultiPolygon", F.transform(deep(4), lambda q: F.transform(q, _points)))
    )
    return f.select(F.col("f.properties").alias("properties"), kind.alias("gtype"), parts.alias("parts"))


def polygons(features: DataFrame, parts: str = "parts") -> DataFrame:
    """A row for each polygon of the features, with `part_no` from 0 and `ring`: the polygon with its holes as one ring.

    Features without a polygon (points, lines, null geometries, outer rings of fewer than three sides) give none.
    """
    rest = [c for c in features.columns if c != parts]
    each = features.where(F.col("gtype").isin("Polygon", "MultiPolygon") if "gtype" in features.columns else F.lit(True))
    each = each.select(*rest, F.posexplode(parts).alias("part_no", "_rings"))
    return each.select(*rest, "part_no", keyhole(F.col("_rings")).alias("ring")).where("ring IS NOT NULL")


def write_geojson(df: DataFrame, path: str, ring: str = "ring", mode: str = "errorifexists") -> None:
    """Polygons as features, one a line: `ring` is one ring, or an outer ring and its holes; the other columns are their properties."""
    rest = [c for c in df.columns if c != ring]
    points = lambda r: F.transform(r, lambda p: F.array(p["x"], p["y"]))
    flat = F.transform(ring, points) if "array<array<" in df.schema[ring].dataType.simpleString() else F.array(points(ring))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(*rest).alias("properties"), F.struct(F.lit("Polygon").alias("type"), flat.alias("coordinates")).alias("geometry"))
    df.select(F.to_json(feature)).write.mode(mode).text(path)


def read_points_csv(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """(lat, lon, value) of a CSV with a header: the first columns with `lat` and `lon` in their names, and the last one.

    `box` is west, south, east, north, closed. Rows without a place are dropped.
    """
    df = spark.read.option("header", True).option("inferSchema", True).csv(path)
    find = lambda part: next(c for c in df.columns if part in c.lower())
    out = df.select(F.col(f"`{find('lat')}`").cast("double").alias("lat"), F.col(f"`{find('lon')}`").cast("double").alias("lon"), F.col(f"`{df.columns[-1]}`").cast("double").alias("value"))
    if box:
        out = out.where(F.col("lon").between(box[0], box[2]) & F.col("lat").between(box[1], box[3]))
    return out.where("lat IS NOT NULL AND lon IS NOT NULL")


def points_to_cells(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """df with the square `ring` around each point, half as wide as the gap between the two least distinct x (and y)."""
    gap = lambda c: df.select(c).distinct().orderBy(c).limit(2)
    half = gap(x).agg(((F.max(x) - F.min(x)) / 2).alias("_hx")).crossJoin(gap(y).agg(((F.max(y) - F.min(y)) / 2).alias("_hy")))
    at = lambda a, b: F.struct((F.col(x) + a * F.col("_hx")).alias("x"), (F.col(y) + b * F.col("_hy")).alias("y"))
    return df.crossJoin(F.broadcast(half)).withColumn("ring", F.array(at(-1, -1), at(1, -1), at(1, 1), at(-1, 1), at(-1, -1))).drop("_hx", "_hy")


def border_lines(zones: DataFrame, key: str, ring: str = "ring") -> DataFrame:
    """(key, line_no, value): the lines of a border file for each zone: name, section, coordinates, END, END."""
    body = F.transform(ring, lambda p: F.format_string("   %.7E   %.7E", p["x"], p["y"]))
    text = F.concat(F.array(F.col(key).cast("string"), F.lit("1")), body, F.array(F.lit("END"), F.lit("END")))
    return zones.select(key, F.posexplode(text).alias("line_no", "value"))


_KINDS = {1: "B", 2: "c", 3: "H", 4: "I", 11: "f", 12: "d", 16: "Q"}


def _tiff_tags(data: bytes) -> tuple[str, dict[int, tuple]]:
    """(byte order, {tag: values}) of a TIFF's first image, classic or big."""
    order = {b"II": "<", b"MM": ">"}[data[:2]]
    big = struct.unpack(order + "H", data[2:4])[0] == 43
    at, count, entry, head, room = (struct.unpack(order + "Q", data[8:16])[0], "Q", 20, "HHQ", 8) if big else (struct.unpack(order + "I", data[4:8])[0], "H", 12, "HHI", 4)
    n = struct.unpack_from(order + count, data, at)[0]
    at += struct.calcsize(count)
    tags = {}
    for k in range(at, at + n * entry, entry):
        tag, kind, n = struct.unpack_from(order + head, data, k)
        if kind in _KINDS:
            values = f"{order}{n}{_KINDS[kind]}"
            here = k + struct.calcsize("=" + head)
            start = here if struct.calcsize(values) <= room else struct.unpack_from(order + ("Q" if big else "I"), data, here)[0]
            tags[tag] = struct.unpack_from(values, data, start)
    return order, tags


def _unlzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, the high bit first; 256 clears the table, 257 ends."""
    out, table, bits, held, width, last = [], [], 0, 0, 9, b""
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes([k]) for k in range(256)] + [b"", b""], 9, b""
            continue
        word = table[code] if code < len(table) else last + last[:1]
        out.append(word)
        if last:
            table.append(last + word[:1])
            # The table is one entry behind: codes grow a step early.
            width = min(12, max(9, (len(table) + 1).bit_length()))
        last = word
    return b"".join(out)


def _unpredicted(raw: bytes, kind: int, rows: int, cols: int, bands: int, dtype: np.dtype) -> np.ndarray:
    """(rows, cols, bands) of a block whose values are differences along its rows (2) or of their bytes, the high ones first (3)."""
    if kind == 3:
        parts = np.frombuffer(raw, np.uint8, rows * cols * bands * dtype.itemsize).reshape(rows, -1, bands)
        whole = np.cumsum(parts, axis=1, dtype=np.uint8).reshape(rows, dtype.itemsize, cols * bands)
        return np.ascontiguousarray(whole.transpose(0, 2, 1)).view(dtype.newbyteorder(">")).reshape(rows, cols, bands)
    block = np.frombuffer(raw, dtype, rows * cols * bands).reshape(rows, cols, bands)
    if kind == 2:
        native = dtype.newbyteorder("=")
        return np.cumsum(block.astype(native), axis=1, dtype=native)
    return block


def decode_geotiff(data: bytes, band: int = 0) -> tuple[np.ndarray, tuple[float, float, float, float]]:
    """(a band, (left, top, cell width, cell height)) of a TIFF, classic or big: in strips or tiles; plain, deflated or LZW;
    with any predictor; bands side by side in a cell or one after another."""
    order, tags = _tiff_tags(data)
    one = lambda tag, default: tags.get(tag, (default,))[0]
    width, height, packing, bands, apart = one(256, 0), one(257, 0), one(259, 1), one(277, 1), one(284, 1) == 2
    unpack = {1: bytes, 8: zlib.decompress, 32946: zlib.decompress, 5: _unlzw}.get(packing)
    if unpack is None:
        raise ValueError(f"TIFF compression {packing} is not read: only plain, deflated and LZW are")
    dtype = np.dtype(f"{order}{ {1: 'u', 2: 'i', 3: 'f'}[one(339, 1)]}{one(258, 8) // 8}")
    tiled = 322 in tags
    wide, high = (one(322, 0), one(323, 0)) if tiled else (width, min(one(278, height), height))
    starts, sizes = tags[324 if tiled else 273], tags[325 if tiled else 279]
    across, down = -(-width // wide), -(-height // high)
    held, first = (1, band * across * down) if apart else (bands, 0)
    out = np.empty((height, width), dtype.newbyteorder("="))
    for k in range(across * down):
        r, c = k // across * high, k % across * wide
        rows = high if tiled else min(high, height - r)  # tiles are whole, the last strip is not
        block = _unpredicted(unpack(data[starts[first + k] : starts[first + k] + sizes[first + k]]), one(317, 1), rows, wide, held, dtype)
        part = out[r : r + high, c : c + wide]
        part[...] = block[: part.shape[0], : part.shape[1], 0 if apart else band]
    sx, sy = tags.get(33550, (1.0, 1.0))[:2]
    tie = tags.get(33922, (0.0, 0.0, 0.0, 0.0, 0.0, 0.0))
    return out, (tie[3] - tie[0] * sx, tie[4] + tie[1] * sy, sx, sy)


def read_geotiff(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None, band: int = 0) -> DataFrame:
    """(path, row, col, x, y, value) of every cell of a band of the rasters at path, x and y its centre; `box` keeps centres within.

    One file is one task's work; large rasters should come as tiles. Cells leave it in batches of a bounded size.
    """

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                cells, (left, top, sx, sy) = decode_geotiff(content.as_py(), band)
                step = max(1, 100_000 // cells.shape[1])
                for r0 in range(0, cells.shape[0], step):
                    part = cells[r0 : r0 + step]
                    rows, cols = np.divmod(np.arange(part.size), cells.shape[1])
                    rows += r0
                    x, y, v = left + (cols + 0.5) * sx, top - (rows + 0.5) * sy, part.reshape(-1).astype(float)
                    if box:
                        kept = (x >= box[0]) & (x <= box[2]) & (y >= box[1]) & (y <= box[3])
                        rows, cols, x, y, v = rows[kept], cols[kept], x[kept], y[kept], v[kept]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(v), pa.string()), pa.array(rows), pa.array(cols), pa.array(x), pa.array(y), pa.array(v)], names=["path", "row", "col", "x", "y", "value"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, row long, col long, x double, y double, value double")
