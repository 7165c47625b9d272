"""Map-data extracts (nodes, ways and tags) in their packed binary format, and the layers drawn from them.

A packed extract is a row of blobs. One pass over the blob headers, which are a few bytes each, gives every blob's place;
the places are dealt over the cluster and each task reads and unpacks its own blobs. From then on nodes, ways and
relations are tables: (id, lon, lat, tags), (id, nodes, tags) and (id, members, tags).
"""

from __future__ import annotations

import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G

NODES = "id long, lon double, lat double, tags map<string,string>"
WAYS = "id long, nodes array<long>, tags map<string,string>"
RELATIONS = "id long, members array<struct<type:string,ref:long,role:string>>, tags map<string,string>"
#: What members of relations are, by number: fixed values of the format.
MEMBERS = ("node", "way", "relation")
#: Values of `highway` that carry traffic on wheels, and those left out of walking networks: fixed values of the source.
DRIVING = ("motorway", "trunk", "primary", "secondary", "tertiary", "unclassified", "residential", "motorway_link", "trunk_link", "primary_link", "secondary_link", "tertiary_link", "living_street", "service", "road")
NO_WALKING = ("motorway", "motorway_link", "trunk", "trunk_link", "cycleway", "proposed", "construction", "abandoned", "platform", "raceway")


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def _fields(data: bytes):
    """(number, value) of the fields of a message: whole numbers, or bytes."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        else:
            size = {1: 8, 5: 4}[kind]
            value, at = data[at : at + size], at + size
        yield key >> 3, value


def _numbers(data: bytes, signed: bool = False) -> list[int]:
    out, at = [], 0
    while at < len(data):
        value, at = _varint(data, at)
        out.append((value >> 1) ^ -(value & 1) if signed else value)
    return out


def _running(values: list[int]) -> list[int]:
    total, out = 0, []
    for v in values:
        total += v
        out.append(total)
    return out


def blob_places(stream) -> list[tuple[int, int]]:
    """(offset, size) of the data blobs of an open extract; only headers are read."""
    out, at, end = [], 0, stream.size()
    while at < end:
        stream.seek(at)
        size = int.from_bytes(stream.read(4), "big")
        header = dict(_fields(stream.read(size)))
        at += 4 + size
        if header[1] == b"OSMData":
            out.append((at, header[3]))
        at += header[3]
    return out


def decode_block(blob: bytes) -> tuple[list[tuple], list[tuple], list[tuple]]:
    """Nodes (id, lon, lat, tags), ways (id, nodes, tags) and relations (id, members, tags) of one blob."""
    parts = dict(_fields(blob))
    data = parts[1] if 1 in parts else zlib.decompress(parts[3])
    strings: list[str] = []
    groups, scale, lat0, lon0 = [], 100, 0, 0
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    for number, value in _fields(data):
        if number == 1:
            strings = [v.decode("utf-8", "replace") for k, v in _fields(value) if k == 1]
        elif number == 2:
            groups.append(value)
        elif number == 17:
            scale = value
        elif number == 19:
            lat0 = signed(value)
        elif number == 20:
            lon0 = signed(value)
    nodes, ways, relations = [], [], []
    place = lambda lon, lat: ((lon0 + scale * lon) * 1e-9, (lat0 + scale * lat) * 1e-9)
    for group in groups:
        for number, value in _fields(group):
            f = dict(_fields(value))
            if number == 1:
                zig = lambda v: (v >> 1) ^ -(v & 1)
                tags = {strings[k]: strings[v] for k, v in zip(_numbers(f.get(2, b"")), _numbers(f.get(3, b"")), strict=True)}
                nodes.append((zig(f[1]), *place(zig(f[9]), zig(f[8])), tags))
            elif number == 2:
                ids, lats, lons = (_running(_numbers(f[k], True)) for k in (1, 8, 9))
                pairs = iter(_numbers(f.get(10, b"")))
                for node, lat, lon in zip(ids, lats, lons, strict=True):
                    tags = {}
                    for k in pairs:
                        if k == 0:
                            break
                        tags[strings[k]] = strings[next(pairs)]
                    nodes.append((node, *place(lon, lat), tags))
            elif number == 3:
                tags = {strings[k]: strings[v] for k, v in zip(_numbers(f.get(2, b"")), _numbers(f.get(3, b"")), strict=True)}
                ways.append((signed(f[1]), _running(_numbers(f.get(8, b""), True)), tags))
            elif number == 4:
                tags = {strings[k]: strings[v] for k, v in zip(_numbers(f.get(2, b"")), _numbers(f.get(3, b"")), strict=True)}
                found = zip(_numbers(f.get(10, b"")), _running(_numbers(f.get(9, b""), True)), _numbers(f.get(8, b"")), strict=True)
                relations.append((signed(f[1]), [{"type": MEMBERS[kind], "ref": ref, "role": strings[role]} for kind, ref, role in found], tags))
    return nodes, ways, relations


def _open(path: str):
    fs, name = pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    return fs.open_input_file(name)


def _blobs(spark: SparkSession, paths: list[str], blobs_a_task: int) -> DataFrame:
    """(path, at, size) of the blobs of all files, dealt over tasks."""
    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))

    def places(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with _open(path) as stream:
                    found = blob_places(stream)
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(found), pa.string()), pa.array([a for a, _ in found], pa.int64()), pa.array([n for _, n in found], pa.int64())], names=["path", "at", "size"])

    blobs = files.mapInArrow(places, "path string, at long, size long")
    n = blobs.count()
    return blobs.repartition(max(1, -(-n // blobs_a_task)), "path", "at")


def _read(which: int, schema: pa.Schema):
    """Nodes, ways or relations (0, 1, 2) of the blobs that come."""

    def run(batches):
        for batch in batches:
            for path, at, size in zip(*[batch.column(c).to_pylist() for c in ("path", "at", "size")], strict=True):
                with _open(path) as stream:
                    stream.seek(at)
                    rows = decode_block(stream.read(size))[which]
                columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
                yield pa.RecordBatch.from_arrays([pa.array([list(v.items()) for v in c] if pa.types.is_map(f.type) else list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


_TAGS = pa.map_(pa.string(), pa.string())


def read_extract(spark: SparkSession, paths: list[str], blobs_a_task: int = 8) -> tuple[DataFrame, DataFrame]:
    """(nodes, ways) of packed extracts, all of whose files every executor can open."""
    blobs = _blobs(spark, paths, blobs_a_task)
    nodes = blobs.mapInArrow(_read(0, pa.schema([("id", pa.int64()), ("lon", pa.float64()), ("lat", pa.float64()), ("tags", _TAGS)])), NODES)
    ways = blobs.mapInArrow(_read(1, pa.schema([("id", pa.int64()), ("nodes", pa.list_(pa.int64())), ("tags", _TAGS)])), WAYS)
    return nodes, ways


def read_relations(spark: SparkSession, paths: list[str], blobs_a_task: int = 8) -> DataFrame:
    """(id, members, tags) of packed extracts; members are (type, ref, role) in their order."""
    member = pa.struct([("type", pa.string()), ("ref", pa.int64()), ("role", pa.string())])
    return _blobs(spark, paths, blobs_a_task).mapInArrow(_read(2, pa.schema([("id", pa.int64()), ("members", pa.list_(member)), ("tags", _TAGS)])), RELATIONS)


def write_extract(nodes: list[tuple], ways: list[tuple], path: str, relations: list[tuple] = ()) -> None:
    """A small extract of one blob for fixtures: nodes (id, lon, lat, tags), ways (id, nodes, tags), relations (id, [(type, ref, role)], tags)."""

    def varint(v: int) -> bytes:
        out = b""
        while v > 127:
            out, v = out + bytes([v & 127 | 128]), v >> 7
        return out + bytes([v])

    zig = lambda v: varint(-2 * v - 1 if v < 0 else 2 * v)
    field = lambda k, data: varint(k << 3 | 2) + varint(len(data)) + data
    whole = lambda k, v: varint(k << 3) + varint(v & (1 << 64) - 1)
    steps = lambda values: b"".join(zig(b - a) for a, b in zip([0, *values], values))
    words = [""]
    for row in [*nodes, *ways]:
        words += [w for kv in row[-1].items() for w in kv if w not in words]
    for _, members, t in relations:
        words += [w for w in dict.fromkeys([*(m[2] for m in members), *t.keys(), *t.values()]) if w not in words]
    at = {w: k for k, w in enumerate(words)}
    grid = lambda v: round(v * 1e7)
    tags = b"".join(b"".join(varint(at[w]) for kv in t.items() for w in kv) + b"\0" for *_, t in nodes)
    dense = field(1, steps([n[0] for n in nodes])) + field(8, steps([grid(n[2]) for n in nodes])) + field(9, steps([grid(n[1]) for n in nodes])) + field(10, tags)
    groups = field(2, field(2, dense))
    for key, refs, t in ways:
        groups += field(2, field(3, whole(1, key) + field(2, b"".join(varint(at[k]) for k in t)) + field(3, b"".join(varint(at[v]) for v in t.values())) + field(8, steps(refs))))
    for key, members, t in relations:
        kinds, refs, roles = zip(*members, strict=True) if members else ((), (), ())
        held = field(8, b"".join(varint(at[r]) for r in roles)) + field(9, steps(refs)) + field(10, b"".join(varint(MEMBERS.index(k)) for k in kinds))
        groups += field(2, field(4, whole(1, key) + field(2, b"".join(varint(at[k]) for k in t)) + field(3, b"".join(varint(at[v]) for v in t.values())) + held))
    block = field(1, b"".join(field(1, w.encode()) for w in words)) + groups
    with open(path, "wb") as f:
        for kind, data in (("OSMHeader", b""), ("OSMData", block)):
            blob = whole(2, len(data)) + field(3, zlib.compress(data))
            header = field(1, kind.encode()) + whole(3, len(blob))
            f.write(len(header).to_bytes(4, "big") + header + blob)


def inside_box(nodes: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    return nodes.where(F.col("lon").between(box[0], box[2]) & F.col("lat").between(box[1], box[3]))


def extract(nodes: DataFrame, ways: DataFrame, boundary: Column) -> tuple[DataFrame, DataFrame]:
    """What lies within a boundary ring (a constant column): nodes inside, ways that touch one of them, and these ways' other nodes."""
    inner = nodes.where(G.inside(F.col("lon"), F.col("lat"), boundary)).select("id")
    uses = ways.select(F.col("id").alias("way"), F.explode("nodes").alias("id"))
    met = uses.join(inner, "id", "left_semi").select("way").distinct()
    kept = ways.join(met, F.col("id") == F.col("way"), "left_semi")
    every = inner.union(kept.select(F.explode("nodes").alias("id"))).distinct()
    return nodes.join(every, "id", "left_semi"), kept


def street_edges(nodes: DataFrame, ways: DataFrame, network: str = "driving") -> DataFrame:
    """(way, part, u, v, highway, oneway, ux, uy, vx, vy): the directed pieces of streets between consecutive nodes.

    Two-way streets give both directions; a way against its order (oneway -1) gives that alone. Pieces that lack a node are
    dropped, as are areas.
    """
    kind = F.col("tags")["highway"]
    wanted = kind.isin(*DRIVING) if network == "driving" else kind.isNotNull() & ~kind.isin(*NO_WALKING) if network == "walking" else kind.isNotNull()
    roads = ways.where(wanted & ~F.coalesce(F.col("tags")["area"] == "yes", F.lit(False)) & (F.size("nodes") > 1))
    one = F.coalesce(F.col("tags")["oneway"], F.when(F.col("tags")["junction"] == "roundabout", "yes"), F.when(kind == "motorway", "yes"), F.lit("no"))
    steps = F.transform(F.sequence(F.lit(0), F.size("nodes") - 2), lambda k: F.struct(k.alias("part"), F.get("nodes", k).alias("a"), F.get("nodes", k + 1).alias("b")))
    pieces = roads.select(F.col("id").alias("way"), kind.alias("highway"), one.alias("oneway"), F.explode(steps).alias("s")).select("way", "highway", "oneway", "s.*")
    there, back = F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v"))
    ways_out = F.when(F.col("oneway").isin("yes", "true", "1"), F.array(there)).when(F.col("oneway").isin("-1", "reverse"), F.array(back)).otherwise(F.array(there, back))
    directed = pieces.select("way", "part", "highway", "oneway", F.explode(ways_out).alias("e")).select("way", "part", "e.u", "e.v", "highway", "oneway")
    at = lambda end: nodes.select(F.col("id").alias(end), F.col("lon").alias(f"{end}x"), F.col("lat").alias(f"{end}y"))
    return directed.join(at("u"), "u").join(at("v"), "v")


def rings(nodes: DataFrame, ways: DataFrame, key: str = "building") -> DataFrame:
    """(id, tags, ring) of closed ways with the tag `key`; ways that lack a node are dropped."""
    closed = ways.where(F.col("tags")[key].isNotNull() & (F.size("nodes") > 3) & (F.get("nodes", F.lit(0)) == F.element_at("nodes", -1)))
    uses = closed.select("id", F.size("nodes").alias("n"), F.posexplode("nodes").alias("k", "node"))
    at = uses.join(nodes.select(F.col("id").alias("node"), F.col("lon").alias("x"), F.col("lat").alias("y")), "node")
    # One way has a few thousand vertices at most: the source's own bound.
    ring = at.groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("k", "x", "y"))).alias("p")).where(F.size("p") == F.col("n"))
    return closed.select("id", "tags").join(ring.select("id", F.transform("p", lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y"))).alias("ring")), "id")


def points_of_interest(nodes: DataFrame, keys: tuple[str, ...] = ("amenity", "shop", "tourism", "leisure")) -> DataFrame:
    """(id, lon, lat, keys...) of nodes with one of the tags."""
    tags = {k: F.col("tags")[k] for k in keys}
    return nodes.select("id", "lon", "lat", *[c.alias(k) for k, c in tags.items()]).where(F.coalesce(*[F.col(k) for k in keys]).isNotNull())


def box_scan(spark: SparkSession, path: str, box: tuple[float, float, float, float], columns: list[str]) -> DataFrame:
    """Rows of a table with a `bbox` struct (xmin, ymin, xmax, ymax) that meet a box: the bounds are filters of the Parquet scan."""
    b = F.col("bbox")
    near = (b["xmax"] >= box[0]) & (b["xmin"] <= box[2]) & (b["ymax"] >= box[1]) & (b["ymin"] <= box[3])
    return spark.read.parquet(path).where(near).select(*columns)


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """(name, value): a JSON object of names as a table; values that are not texts stay JSON."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("m"))
    return whole.select(F.explode("m").alias("name", "value"))


def find_in_catalog(table: DataFrame, name: str) -> DataFrame:
    """The entry of a name, whatever its case; a lookup for countries, cities and tiled sources."""
    return table.where(F.lower("name") == name.strip().lower())


def tiled(spark: SparkSession, root: str, tiles: DataFrame, key: str = "tile_id", columns: list[str] | None = None) -> DataFrame:
    """Rows of a table partitioned by tile that belong to the tiles given: dynamic partition pruning leaves other files unread."""
    df = spark.read.parquet(root).join(F.broadcast(tiles.select(key).distinct()), key, "left_semi")
    return df.select(*columns) if columns else df
