"""TIFF in every layout that is read, written by plain encoders; polygons of GeoJSON features."""

import itertools
import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from streetloom.functions import geometry as G
from streetloom.sources import files


def lzw(data: bytes) -> bytes:
    bits, table, width, word = [], {}, 9, b""

    def put(code):
        bits.append(format(code, f"0{width}b"))

    def fresh():
        table.clear()
        table.update({bytes([k]): k for k in range(256)})
        return 258, 9

    put(256)
    free, width = fresh()
    for k in data:
        more = word + bytes([k])
        if more in table:
            word = more
            continue
        put(table[word])
        table[more] = free
        free += 1
        width = max(width, (free).bit_length() if free < 4096 else 12)
        if free == 4094:
            put(256)
            free, width = fresh()
        word = bytes([k])
    if word:
        put(table[word])
        free += 1
        width = min(12, max(width, free.bit_length()))
    put(257)
    text = "".join(bits)
    text += "0" * (-len(text) % 8)
    return bytes(int(text[i : i + 8], 2) for i in range(0, len(text), 8))


def predicted(block, kind, order):
    """Bytes of a block (rows, cols, bands)."""
    if kind == 2:
        flat = block.copy()
        flat[:, 1:] = block[:, 1:] - block[:, :-1]
        return flat.astype(flat.dtype.newbyteorder(order)).tobytes()
    if kind == 3:
        rows, cols, bands = block.shape
        size = block.dtype.itemsize
        parts = np.frombuffer(np.ascontiguousarray(block).astype(block.dtype.newbyteorder(">")).tobytes(), np.uint8).reshape(rows, cols * bands, size).transpose(0, 2, 1).reshape(rows, -1, bands)
        flat = parts.copy()
        flat[:, 1:] = parts[:, 1:] - parts[:, :-1]
        return flat.tobytes()
    return block.astype(block.dtype.newbyteorder(order)).tobytes()


def tiff(image, order, big, tile, packing, predictor, apart):
    height, width, bands = image.shape
    pack = {1: bytes, 8: zlib.compress, 5: lzw}[packing]
    planes = [image[..., [k]] for k in range(bands)] if apart else [image]
    wide, high = tile or (width, 7)
    blocks = []
    for plane, r, c in itertools.product(planes, range(0, height, high), range(0, width, wide)):
        part = plane[r : r + high, c : c + wide]
        if tile:
            part = np.pad(part, ((0, high - part.shape[0]), (0, wide - part.shape[1]), (0, 0)))
        blocks.append(pack(predicted(part, predictor, order)))
    letter = {"u": 1, "i": 2, "f": 3}[image.dtype.kind]
    at, starts = 16, []
    for b in blocks:
        starts.append(at)
        at += len(b)
    layout = [(322, "H", [wide]), (323, "H", [high]), (324, "I", starts), (325, "I", [len(b) for b in blocks])] if tile else [(273, "I", starts), (278, "H", [high]), (279, "I", [len(b) for b in blocks])]
    entries = sorted([(256, "H", [width]), (257, "H", [height]), (258, "H", [image.dtype.itemsize * 8] * bands), (259, "H", [packing]), (277, "H", [bands]), (284, "H", [2 if apart else 1]), (317, "H", [predictor]), (339, "H", [letter] * bands), (33550, "d", [2.0, 3.0, 0.0]), (33922, "d", [0.0, 0.0, 0.0, 100.0, 900.0, 0.0]), *layout])
    body, table, kinds = b"".join(blocks), b"", {"H": 3, "I": 4, "d": 12}
    for tag, kind, values in entries:
        data = struct.pack(f"{order}{len(values)}{kind}", *values)
        if len(data) > (8 if big else 4):
            where = 16 + len(body)
            body += data
            data = struct.pack(order + ("Q" if big else "I"), where)
        table += struct.pack(order + ("HHQ" if big else "HHI"), tag, kinds[kind], len(values)) + data.ljust(8 if big else 4, b"\0")
    end = 16 + len(body)
    head = (b"II" if order == "<" else b"MM") + (struct.pack(order + "HHHQ", 43, 8, 0, end) if big else struct.pack(order + "HI", 42, end)).ljust(14, b"\0")
    return head + body + struct.pack(order + ("Q" if big else "H"), len(entries)) + table + b"\0" * 8


@pytest.mark.parametrize("packing", [1, 5, 8])
def test_every_layout_of_a_tiff(packing):
    rng = np.random.default_rng(packing)
    seen = 0
    for kind, order, big, tile, predictor, apart in itertools.product(["u1", "i2", "u4", "f4", "f8"], "<>", [False, True], [None, (16, 16)], [1, 2, 3], [False, True]):
        if predictor == 3 and kind[0] != "f" or predictor == 2 and kind[0] == "f":
            continue
        image = (rng.integers(0, 120, (37, 29, 2)) // 7 * 3).astype(kind)
        data = tiff(image, order, big, tile, packing, predictor, apart)
        for band in (0, 1):
            got, place = files.decode_geotiff(data, band)
            assert (got == image[..., band]).all() and place == (100.0, 900.0, 2.0, 3.0), (kind, order, big, tile, predictor, apart)
            seen += 1
    assert seen > 200


def test_lzw_tables_that_fill_up():
    data = np.random.default_rng(1).integers(0, 200, 40_000).astype(np.uint8).tobytes()
    assert files._unlzw(lzw(data)) == data and files._unlzw(lzw(b"")) == b"" and files._unlzw(lzw(b"a" * 5000)) == b"a" * 5000


def test_unknown_compression_is_refused():
    image = np.zeros((3, 3, 1), "u1")
    data = bytearray(tiff(image, "<", False, None, 1, 1, False))
    at = data.index(struct.pack("<HHIH", 259, 3, 1, 1))
    data[at + 8] = 7
    with pytest.raises(ValueError, match="compression 7"):
        files.decode_geotiff(bytes(data))


def test_polygons_of_features(spark, tmp_path):
    square = lambda x, w: [[x, x], [x + w, x], [x + w, x + w], [x, x + w], [x, x]]
    shapes = [{"type": "Polygon", "coordinates": [square(0, 10), square(2, 3)]}, {"type": "MultiPolygon", "coordinates": [[square(0, 4)], [square(20, 10), square(21, 2), square(25, 2)]]}, {"type": "Point", "coordinates": [1, 2]}, None, {"type": "Polygon", "coordinates": []}]
    (tmp_path / "f.json").write_text("\n".join(json.dumps({"type": "Feature", "properties": {"k": str(k)}, "geometry": g}) for k, g in enumerate(shapes)))
    got = files.polygons(files.read_geojson(spark, str(tmp_path / "f.json"), lines=True))
    assert sorted((r.k, r.part_no, r.a) for r in got.select(F.col("properties")["k"].alias("k"), "part_no", G.area(F.col("ring")).alias("a")).collect()) == [("0", 0, 91.0), ("1", 0, 16.0), ("1", 1, 92.0)]
