"""Geometry kernels in numpy over stacks of rings of one size, and the Arrow plumbing that makes such stacks of a column.

A stack is an array (rings, vertices, 2) of open rings. A batch of rings of any sizes is grouped by size, so that a
kernel is called once for each size and not once for each ring.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

EPS = 1e-9
#: Numbers of a kernel's largest temporary array, about.
ROOM = 4_000_000


def flat_rings(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first vertex, number of vertices, coordinates) of a column of closed rings, the closing point not counted.

    A null ring has no vertices; null coordinates are NaN.
    """
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets, points = column.offsets.to_numpy(), column.values
    xy = np.column_stack([points.field(k).cast(pa.float64()).to_numpy(zero_copy_only=False) for k in (0, 1)]) if len(points) else np.zeros((0, 2))
    sizes = np.maximum(np.diff(offsets) - 1, 0)
    if column.null_count:
        sizes = np.where(column.is_valid().to_numpy(zero_copy_only=False), sizes, 0)
    return offsets[:-1].astype(np.int64), sizes.astype(np.int64), xy


def stack(first: np.ndarray, n: int, xy: np.ndarray) -> np.ndarray:
    return xy[first[:, None] + np.arange(n)]


def signed_areas(rings: np.ndarray) -> np.ndarray:
    p = rings - rings[:, :1]
    q = np.roll(p, -1, axis=1)
    return (p[..., 0] * q[..., 1] - p[..., 1] * q[..., 0]).sum(axis=1) / 2


def clean_ring(points: np.ndarray) -> np.ndarray | None:
    """An open ring without vertices that are not numbers or repeat the one before; None if fewer than three are left."""
    p = points[np.isfinite(points).all(axis=1)]
    if len(p) > 1:
        p = p[np.concatenate([[True], (p[1:] != p[:-1]).any(axis=1)])]
    while len(p) > 1 and (p[0] == p[-1]).all():
        p = p[:-1]
    return p if len(p) >= 3 else None


def is_simple(p: np.ndarray) -> bool:
    """Whether no two sides of an open ring cross."""
    q = np.roll(p, -1, axis=0)
    d = q - p
    a, b = cross(d[:, None], p[None] - p[:, None]), cross(d[:, None], q[None] - p[:, None])
    apart = a * b < 0
    return not (apart & apart.T).any()


def counter_clockwise(rings: np.ndarray) -> np.ndarray:
    return np.where((signed_areas(rings) < 0)[:, None, None], rings[:, ::-1], rings)


def cross(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a[..., 0] * b[..., 1] - a[..., 1] * b[..., 0]


def pieces(p: np.ndarray, q: np.ndarray, rings: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segments (m, a) from p to q cut where they meet the borders of rings (m, b): places (m, a, k + 1) of the cuts from 0
    to 1 and, of the k pieces between, whether each is inside its ring and how it runs on the border (1 along it, -1
    against it, 0 not on it)."""
    r = rings
    e = np.roll(r, -1, axis=1) - r
    d = q - p
    to = r[:, None] - p[:, :, None]
    across = cross(d[:, :, None], e[:, None])
    size = np.hypot(d[..., 0], d[..., 1])[:, :, None] + 1e-300
    with np.errstate(divide="ignore", invalid="ignore"):
        t, u = cross(to, e[:, None]) / across, cross(to, d[:, :, None]) / across
    met = (np.abs(across) > EPS * size) & (t > 0) & (t < 1) & (u >= -EPS) & (u <= 1 + EPS)
    # Corners of the ring on the segment: cuts of borders that run along it.
    off = np.abs(cross(d[:, :, None], to)) / size
    place = (d[:, :, None] * to).sum(axis=-1) / (size * size)
    corner = (off <= EPS * (1 + size)) & (place > 0) & (place < 1)
    cuts = np.sort(np.concatenate([np.zeros_like(t[..., :1]), np.where(met, t, 1.0), np.where(corner, place, 1.0), np.ones_like(t[..., :1])], axis=-1), axis=-1)
    middle = (cuts[..., :-1] + cuts[..., 1:]) / 2
    at = p[:, :, None] + d[:, :, None] * middle[..., None]
    a, b = r[:, None, None], (r + e)[:, None, None]
    x, y = at[..., 0, None], at[..., 1, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        over = ((a[..., 1] > y) != (b[..., 1] > y)) & (x < (b[..., 0] - a[..., 0]) * (y - a[..., 1]) / (b[..., 1] - a[..., 1]) + a[..., 0])
    inside = over.sum(axis=-1) % 2 == 1
    edge = e[:, None, None]
    length = np.hypot(edge[..., 0], edge[..., 1]) + 1e-300
    way = ((x - a[..., 0]) * edge[..., 0] + (y - a[..., 1]) * edge[..., 1]) / length
    on = (np.abs((x - a[..., 0]) * edge[..., 1] - (y - a[..., 1]) * edge[..., 0]) / length <= 1e-7) & (way >= 0) & (way <= length)
    # Sides walked both ways (cuts to holes) cancel.
    border = np.sign((np.sign((d[:, :, None, None] * edge).sum(axis=-1)) * on).sum(axis=-1))
    return cuts, inside, border


def overlap_areas(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Area of the intersection of each ring of a with that of b, both simple and of any shape.

    Its border is the parts of each ring inside the other, and once the parts where both run the same way.
    """
    a, b = counter_clockwise(a), counter_clockwise(b)
    base = a[:, :1].copy()
    a, b = a - base, b - base
    total = np.zeros(len(a))
    for own, other, shared in ((a, b, True), (b, a, False)):
        p, q = own, np.roll(own, -1, axis=1)
        cuts, inside, border = pieces(p, q, other)
        kept = np.where(border != 0, shared & (border > 0), inside)
        low, high = (p[:, :, None] + (q - p)[:, :, None] * c[..., None] for c in (cuts[..., :-1], cuts[..., 1:]))
        total += (cross(low, high) * kept).sum(axis=(1, 2)) / 2
    return np.maximum(total, 0.0)


def disc_areas(rings: np.ndarray, centres: np.ndarray, radius: float, sides: int) -> np.ndarray:
    """Area of each ring inside the regular polygon of so many sides around its centre.

    Seen from the centre, a side of the ring sweeps a triangle. Of it the polygon has, where the side runs inside, all, and
    where it runs outside the sector between the two directions; the signed sum of these is the shared area.
    """
    rings = counter_clockwise(rings) - centres[:, None]
    m, k, _ = rings.shape
    turn = 2 * np.pi / sides
    half, reach = (np.arange(sides) + 0.5) * turn, radius * np.cos(turn / 2)
    normal = np.column_stack([np.cos(half), np.sin(half)])
    p, q = rings.reshape(-1, 2), np.roll(rings, -1, axis=1).reshape(-1, 2)
    whole, slice_ = sides * radius * radius * np.sin(turn) / 2, radius * radius * np.sin(turn) / 2

    def swept(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        angles = [np.arctan2(c[..., 1], c[..., 0]) for c in (a, b)]
        full = [np.floor(x / turn) for x in angles]
        upto = [k * slice_ + radius * reach / np.cos(x - (k + 0.5) * turn) * np.sin(x - k * turn) / 2 for x, k in zip(angles, full, strict=True)]
        by = angles[1] - angles[0]
        return upto[1] - upto[0] + np.where(by > np.pi, -whole, np.where(by < -np.pi, whole, 0.0))

    def clipped(p: np.ndarray, q: np.ndarray, out: np.ndarray, back: np.ndarray) -> np.ndarray:
        """What sides sweep that enter through one of the polygon's sides `out` and leave through one of `back`, by their normals."""
        d = q - p
        low, high, good = np.zeros(len(p)), np.ones(len(p)), np.ones(len(p), bool)
        for these in (out, back):
            nx, ny = normal[these, 0], normal[these, 1]
            room, speed = reach - (nx * p[:, 0] + ny * p[:, 1]), nx * d[:, 0] + ny * d[:, 1]
            with np.errstate(divide="ignore", invalid="ignore"):
                t = room / speed
            low = np.maximum(low, np.where(speed < 0, t, 0.0).max(axis=0))
            high = np.minimum(high, np.where(speed > 0, t, 1.0).min(axis=0))
            good &= ~((speed == 0) & (room < 0)).any(axis=0)
        good &= low < high
        enter, leave = p + d * np.where(good, low, 0.0)[:, None], p + d * np.where(good, high, 0.0)[:, None]
        outside = np.where(good & (low == 0), 0.0, swept(p, enter)) + np.where(good & (high == 1), 0.0, swept(leave, q))
        return cross(enter, leave) / 2 + outside

    d = q - p
    dot = lambda a, b: a[:, 0] * b[:, 0] + a[:, 1] * b[:, 1]
    size, along = dot(d, d), dot(p, d)
    t = np.clip(np.divide(-along, size, out=np.zeros(len(p)), where=size > 0), 0.0, 1.0)
    c = p + t[:, None] * d
    total = cross(p, q) / 2
    # Sides between the inner circle and all beyond the outer one meet none of the polygon's sides.
    away = dot(c, c) >= radius * radius * (1 + 1e-9)
    total[away] = swept(p[away], q[away])
    least = reach * reach * (1 - 1e-9)
    some = np.flatnonzero(~away & ((dot(p, p) > least) | (dot(q, q) > least)))
    # Where a line enters and leaves the outer circle it is within a turn of where it does so with the polygon, but for lines that graze it.
    line = np.divide(np.abs(cross(p[some], d[some])), np.sqrt(size[some]), out=np.full(len(some), np.inf), where=size[some] > 0)
    clear = (line < 0.98 * reach) & (np.arccos(np.minimum(line / radius, 1.0)) - np.arccos(np.minimum(line / reach, 1.0)) < 0.9 * turn)
    easy, hard = some[clear], some[~clear]
    root = np.sqrt(np.maximum(radius * radius - line[clear] ** 2, 0.0) / size[easy])
    around = []
    for way in (-root, root):
        at = p[easy] + (way - along[easy] / size[easy])[:, None] * d[easy]
        around.append((np.floor(np.arctan2(at[:, 1], at[:, 0]) / turn).astype(np.int64) + np.arange(-1, 2)[:, None]) % sides)
    total[easy] = clipped(p[easy], q[easy], *around)
    every = np.broadcast_to(np.arange(sides)[:, None], (sides, len(hard)))
    total[hard] = clipped(p[hard], q[hard], every, every)
    return np.maximum(total.reshape(m, k).sum(axis=1), 0.0)


def inside_shares(segments: np.ndarray, rings: np.ndarray) -> np.ndarray:
    """Share of each segment (m, 2, 2) that lies inside its ring or on its border."""
    cuts, inside, border = pieces(segments[:, :1], segments[:, 1:], rings)
    return ((cuts[..., 1:] - cuts[..., :-1]) * (inside | (border != 0))).sum(axis=(1, 2))


def inside_stays(segments: np.ndarray, rings: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, low, high): the intervals of each segment's way that lie inside its ring or on its border."""
    cuts, inside, border = pieces(segments[:, :1], segments[:, 1:], rings)
    low, high = cuts[:, 0, :-1], cuts[:, 0, 1:]
    row, k = np.nonzero((inside | (border != 0))[:, 0] & (low < high))
    return row, low[row, k], high[row, k]


def border_shares(segments: np.ndarray, rings: np.ndarray) -> np.ndarray:
    """Share of each segment that runs along its ring's border."""
    cuts, _, border = pieces(segments[:, :1], segments[:, 1:], rings)
    return ((cuts[..., 1:] - cuts[..., :-1]) * (border != 0)).sum(axis=(1, 2))


def bounding_metrics(rings: np.ndarray) -> np.ndarray:
    """(area, perimeter, hull area, long side, short side, azimuth of the long side, radius of the least circle) of each ring.

    Every pair and triple of vertices is looked at: for rings of few vertices. Degenerate rings (all vertices in one line)
    have hull area 0 and a rectangle without width.
    """
    m, n, _ = rings.shape
    p = rings - rings[:, :1]
    area = np.abs(signed_areas(rings))
    step = np.roll(p, -1, axis=1) - p
    perimeter = np.hypot(step[..., 0], step[..., 1]).sum(axis=1)
    scale = np.abs(p).max(axis=(1, 2)) + 1e-300
    i, j = (k.ravel() for k in np.meshgrid(np.arange(n), np.arange(n), indexing="ij"))
    i, j = i[i != j], j[i != j]
    d = p[:, j] - p[:, i]
    length = np.hypot(d[..., 0], d[..., 1])
    to = p[:, None] - p[:, i][:, :, None]
    side = cross(d[:, :, None], to)
    eps = (1e-10 * scale * scale)[:, None]
    along = (d[:, :, None] * to).sum(axis=-1)
    # Hull edges: all vertices on the left, those in line with it between its ends.
    flat = np.abs(side) <= eps[..., None]
    edge = (length > 1e-12 * scale[:, None]) & ((side >= 0) | flat).all(axis=-1) & (~flat | ((along >= -eps[..., None]) & (along <= (length * length)[..., None] + eps[..., None]))).all(axis=-1)
    where = np.round(p / (1e-12 * scale)[:, None, None]).astype(np.int64)
    # Of repeated vertices only the first of each counts.
    first = np.array([(where[:, :k] == where[:, k : k + 1]).all(axis=-1).any(axis=1) for k in range(n)]).T if n else np.zeros((m, 0), bool)
    edge &= ~first[:, i] & ~first[:, j]
    hull = np.abs((cross(p[:, i], p[:, j]) * edge).sum(axis=1)) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        unit = d / length[..., None]
    wide, deep = along / np.where(length > 0, length, 1)[..., None], side / np.where(length > 0, length, 1)[..., None]
    w, h = wide.max(axis=-1) - wide.min(axis=-1), deep.max(axis=-1) - deep.min(axis=-1)
    turn = np.arctan2(unit[..., 1], unit[..., 0]) % (np.pi / 2)
    turn = np.where(np.round(turn, 12) >= np.round(np.pi / 2, 12), 0.0, np.round(turn, 12))
    box = np.where(edge, w * h, np.inf)
    least = box.min(axis=1, initial=np.inf)
    tied = edge & (box <= (least + 1e-12 * scale * scale)[:, None])
    best = np.where(tied, turn, np.inf).argmin(axis=1) if len(i) else np.zeros(m, np.int64)
    rows = np.arange(m)
    if len(i):
        w, h, at = w[rows, best], h[rows, best], turn[rows, best]
        # The chosen edge may stand on either side of its rectangle: the angle is that of the side nearest to the x axis.
        c, s = np.cos(at), np.sin(at)
        a = p[..., 0] * c[:, None] + p[..., 1] * s[:, None]
        b = p[..., 1] * c[:, None] - p[..., 0] * s[:, None]
        w, h = np.ptp(a, axis=1), np.ptp(b, axis=1)
    else:
        w, h, at = np.zeros(m), np.zeros(m), np.zeros(m)
    azimuth = np.degrees(at) + np.where(w >= h - 1e-12, 0.0, 90.0)
    return np.column_stack([area, perimeter, hull, np.maximum(w, h), np.minimum(w, h), azimuth % 180, least_circles(p)])


def least_circles(p: np.ndarray) -> np.ndarray:
    """Radius of the least circle around the vertices of each ring: the least of those on two or three that holds all."""
    m, n, _ = p.shape
    if n < 2:
        return np.zeros(m)
    i, j = np.triu_indices(n, 1)
    centres = [(p[:, i] + p[:, j]) / 2]
    if n > 2:
        a, b, c = np.array([(x, y, z) for x in range(n) for y in range(x + 1, n) for z in range(y + 1, n)]).T
        pa_, pb, pc = p[:, a], p[:, b] - p[:, a], p[:, c] - p[:, a]
        twice = 2 * cross(pb, pc)
        nb, nc = (pb * pb).sum(axis=-1), (pc * pc).sum(axis=-1)
        with np.errstate(divide="ignore", invalid="ignore"):
            u = np.stack([(pc[..., 1] * nb - pb[..., 1] * nc) / twice, (pb[..., 0] * nc - pc[..., 0] * nb) / twice], axis=-1)
        centres.append(np.where((np.abs(twice) > 1e-12)[..., None], pa_ + u, np.nan))
    at = np.concatenate(centres, axis=1)
    far = np.hypot(p[:, None, :, 0] - at[:, :, None, 0], p[:, None, :, 1] - at[:, :, None, 1]).max(axis=-1)
    return np.nanmin(far, axis=1)


def by_size(sizes: np.ndarray, cost: Callable[[int], int]):
    """(size, places) of equal sizes, in parts whose temporary arrays stay bounded."""
    for n in np.unique(sizes).tolist():
        at, step = np.flatnonzero(sizes == n), max(1, ROOM // max(1, cost(n)))
        for k in range(0, len(at), step):
            yield n, at[k : k + step]


def with_columns(df: DataFrame, fields: str, make: Callable[[pa.RecordBatch], list[np.ndarray]]) -> DataFrame:
    """df with columns of the DDL `fields`, which `make` fills from a batch; NaN is null."""
    new = T._parse_datatype_string(fields)
    schema = T.StructType([*[T.StructField(f.name, f.dataType, True) for f in df.schema], *new.fields])

    def run(batches):
        for batch in batches:
            made = [pa.array(c, pa.float64(), from_pandas=True) for c in make(batch)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, *new.names])

    return df.mapInArrow(run, schema)


def pair_stacks(batch: pa.RecordBatch, left: str, right: str, closed: bool = True):
    """(rows, stack of the left column, stack of the right one) of rows whose rings have enough vertices, in bounded parts.

    `closed` false: the left column holds segments of two points each.
    """
    fa, na, xa = flat_rings(batch.column(left))
    na = na if closed else na + 1
    fb, nb, xb = flat_rings(batch.column(right))
    good = (na >= (3 if closed else 2)) & (nb >= 3)
    code = np.where(good, na * 1_000_003 + nb, -1)
    for c in np.unique(code[code >= 0]).tolist():
        n, k = divmod(c, 1_000_003)
        at, step = np.flatnonzero(code == c), max(1, ROOM // (n * k * (2 * k + 2) + k * n * (2 * n + 2)))
        for start in range(0, len(at), step):
            part = at[start : start + step]
            yield part, stack(fa[part], n, xa), stack(fb[part], k, xb)


def pair_column(df: DataFrame, name: str, left: str, right: str, kernel: Callable[[np.ndarray, np.ndarray], np.ndarray], closed: bool = True) -> DataFrame:
    """df with `name`: the kernel's value of the rings in two columns; 0 where one has fewer vertices than it needs.

    `closed` false: the left column holds segments of two points each.
    """

    def make(batch):
        out = np.zeros(batch.num_rows)
        for part, a, b in pair_stacks(batch, left, right, closed):
            out[part] = kernel(a, b)
        return [out]

    return with_columns(df, f"{name} double", make)


def parse_wkb(data: bytes) -> tuple[str, list[list[list[tuple[float, float]]]]]:
    """(type, parts) of a well-known binary geometry of two dimensions: parts of rings (or one line or point) of points."""
    at = 0

    def take(form: str):
        nonlocal at
        got = struct.unpack_from(form, data, at)
        at += struct.calcsize(form)
        return got

    def points(order: str, n: int, skip: int):
        return [take(f"{order}{2 + skip}d")[:2] for _ in range(n)]

    def one():
        order = "<" if take("B")[0] else ">"
        kind = take(f"{order}I")[0]
        if kind & 0x20000000:
            take(f"{order}I")
        skip = bool(kind & 0x80000000) + bool(kind & 0x40000000) or (0, 1, 1, 2)[kind % 10_000 // 1000]
        kind = kind & 0xFFFF
        kind %= 1000
        count = lambda: take(f"{order}I")[0]
        if kind == 1:
            return "Point", [[points(order, 1, skip)]]
        if kind == 2:
            return "LineString", [[points(order, count(), skip)]]
        if kind == 3:
            return "Polygon", [[points(order, count(), skip) for _ in range(count())]]
        name = {4: "MultiPoint", 5: "MultiLineString", 6: "MultiPolygon", 7: "GeometryCollection"}[kind]
        return name, [part for _ in range(count()) for part in one()[1]]

    return one()


def make_wkb(rings: list[list[tuple[float, float]]]) -> bytes:
    """A polygon as well-known binary."""
    return struct.pack("<BII", 1, 3, len(rings)) + b"".join(struct.pack("<I", len(r)) + b"".join(struct.pack("<2d", *p) for p in r) for r in rings)


#: Points up to which a disc's sums compare all pairs.
PLAIN = 256
#: Bands to a radius.
BANDS = 64


def _compared(at: np.ndarray, others: np.ndarray, values: np.ndarray, radius: float) -> np.ndarray:
    out = np.zeros((len(at), values.shape[1]))
    once = max(1, ROOM // max(1, len(others)))
    for k in range(0, len(at), once):
        d = at[k : k + once, None] - others
        near = d[..., 0] * d[..., 0] + d[..., 1] * d[..., 1] <= radius * radius
        for j in range(values.shape[1]):
            out[k : k + once, j] = np.where(near, values[:, j], 0.0).sum(axis=1)
    return out


def disc_sums(at: np.ndarray, others: np.ndarray, values: np.ndarray, radius: float) -> np.ndarray:
    """For each place of `at` (m, 2) the sums of the values (n, k) of the others (n, 2) at most radius apart.

    Others lie in bands, in each by x with running sums. Of a band the part within the disc whatever the height is a
    difference of two running sums; only what lies where the circle crosses the band is compared. So a disc costs some
    searches a band and its border's points, not all its points.
    """
    wild = ~np.isfinite(values).all(axis=1)
    if len(others) <= PLAIN or not len(at):
        return _compared(at, others, values, radius)
    if wild.any():  # they would spoil running sums
        return disc_sums(at, others[~wild], values[~wild], radius) + _compared(at, others[wild], values[wild], radius)
    high, slack = radius / BANDS, 1e-6 * radius
    (x0, y0), (x1, y1) = others.min(axis=0), others.max(axis=0)
    band = np.floor((others[:, 1] - y0) / high).astype(np.int64)
    last, wide = int(band.max()), x1 - x0 + 2 * radius
    place = band * wide + (others[:, 0] - x0)
    order = np.argsort(place, kind="stable")
    place, others, values = place[order], others[order], values[order]
    so_far = np.vstack([np.zeros(values.shape[1]), np.cumsum(values, axis=0)])
    out = np.zeros((len(at), values.shape[1]))
    steps = np.arange(2 * BANDS + 2)
    once = max(1, ROOM // 8 // len(steps))
    for k in range(0, len(at), once):
        x, y = at[k : k + once, :1], at[k : k + once, 1:]
        b = np.floor((y - radius - y0) / high).astype(np.int64) + steps
        low = y0 + b * high - y
        least = np.maximum(np.maximum(low, -(low + high)) - slack, 0.0)
        most = np.maximum(np.abs(low), np.abs(low + high)) + slack
        met = (least <= radius) & (b >= 0) & (b <= last)
        row, step = np.nonzero(met)
        b, least, most, x = b[met], least[met], most[met], x[row, 0] - x0
        edge = lambda v: np.searchsorted(place, b * wide + np.clip(v, -radius / 2, x1 - x0 + radius / 2))  # noqa: B023, E731
        reach = np.sqrt(radius * radius - least * least) + slack
        sure = np.sqrt(np.maximum(radius * radius - most * most, 0.0)) - slack
        start, end = edge(x - reach), edge(x + reach)
        first, after = np.where(sure > 0, edge(x - sure), start), np.where(sure > 0, edge(x + sure), start)
        inner = so_far[after] - so_far[first]
        a, n = np.concatenate([start, after]), np.concatenate([first - start, end - after])
        owner = np.repeat(np.concatenate([row, row]), n)
        one = np.arange(len(owner)) + np.repeat(a - np.cumsum(n) + n, n)
        d = at[k : k + once][owner] - others[one]
        near = d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] <= radius * radius
        owner, one = owner[near], one[near]
        m = len(at[k : k + once])
        for j in range(values.shape[1]):
            out[k : k + once, j] = np.bincount(row, inner[:, j], m) + np.bincount(owner, values[one, j], m)
    return out


def near_pairs(at: np.ndarray, segments: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """(place in `at`, place in `segments`) of the points (m, 2) and segments (n, 4) at most radius apart.

    Points lie in bands across the way that a segment mostly runs, in each in order along the band; a segment looks up the
    stretch of each band that it passes, so it meets few points beside those near it.
    """
    none = np.zeros(0, np.int64)
    if not len(at) or not len(segments):
        return none, none
    found = [(none, none)]
    steep = np.abs(segments[:, 3] - segments[:, 1]) >= np.abs(segments[:, 2] - segments[:, 0])
    for some, turn in ((np.flatnonzero(steep), [0, 1]), (np.flatnonzero(~steep), [1, 0])):
        if not len(some):
            continue
        p, lines = at[:, turn], segments[some][:, [*turn, turn[0] + 2, turn[1] + 2]]
        (x0, y0), (x1, y1) = p.min(axis=0), p.max(axis=0)
        high = max(2 * radius, math.sqrt(4 * max(x1 - x0, radius) * max(y1 - y0, radius) / len(p)), (y1 - y0) / 100_000)
        wide, last = x1 - x0 + 4 * radius, int((y1 - y0) // high)
        place = np.minimum(np.floor((p[:, 1] - y0) / high), last) * wide + (p[:, 0] - x0)
        order = np.argsort(place, kind="stable")
        place, px, py = place[order], p[order, 0].copy(), p[order, 1].copy()
        ux, uy, dx, dy = (np.ascontiguousarray(c) for c in (lines[:, 0], lines[:, 1], lines[:, 2] - lines[:, 0], lines[:, 3] - lines[:, 1]))
        over = 1.0 / np.maximum(dx * dx + dy * dy, 1e-12)
        low, top = np.minimum(lines[:, 1], lines[:, 3]), np.maximum(lines[:, 1], lines[:, 3])
        slack = radius + 1e-6
        first = np.clip(np.floor((low - slack - y0) / high), 0, last + 1).astype(np.int64)
        bands = np.maximum(np.clip(np.floor((top + slack - y0) / high), -1, last).astype(np.int64) - first + 1, 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            slope = np.nan_to_num(dx / dy)
        once = max(1, ROOM // 8 // max(1, int(bands.mean()) + 1))
        for k in range(0, len(lines), once):
            n = bands[k : k + once]
            s = np.repeat(np.arange(k, k + len(n)), n)
            b = np.arange(len(s)) - np.repeat(np.cumsum(n) - n, n) + first[s]
            y, x, m, l, h, w = y0 + b * high, ux[s], slope[s], low[s], top[s], uy[s]  # noqa: E741
            a, c = (x + m * (np.clip(v, l, h) - w) for v in (y - slack, y + high + slack))
            edge = lambda v: np.searchsorted(place, b * wide + np.clip(v - x0, -radius, x1 - x0 + 2 * radius))  # noqa: B023, E731
            start = edge(np.minimum(a, c) - slack)
            many = np.maximum(edge(np.maximum(a, c) + slack + 1e-6) - start, 0)
            one = np.arange(many.sum()) + np.repeat(start - np.cumsum(many) + many, many)
            s = np.repeat(s, many)
            qx, qy, wx, wy = px[one] - ux[s], py[one] - uy[s], dx[s], dy[s]
            t = np.clip((qx * wx + qy * wy) * over[s], 0.0, 1.0)
            qx -= t * wx
            qy -= t * wy
            near = qx * qx + qy * qy <= (radius + 1e-9) ** 2
            found.append((order[one[near]], some[s[near]]))
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def nearest_of(at: np.ndarray, segments: np.ndarray, i: np.ndarray, j: np.ndarray, slack: float) -> np.ndarray:
    """Which pairs of a point and a segment are at most `slack` farther apart than the nearest of their point."""
    apart = np.zeros(len(i))
    for k in range(0, len(i), ROOM // 8):
        s, p = segments[j[k : k + ROOM // 8]], at[i[k : k + ROOM // 8]]
        dx, dy, x, y = s[:, 2] - s[:, 0], s[:, 3] - s[:, 1], p[:, 0] - s[:, 0], p[:, 1] - s[:, 1]
        t = np.clip((x * dx + y * dy) / np.maximum(dx * dx + dy * dy, 1e-12), 0.0, 1.0)
        apart[k : k + ROOM // 8] = np.hypot(x - t * dx, y - t * dy)
    best = np.full(len(at), np.inf)
    np.minimum.at(best, i, apart)
    return np.flatnonzero(apart <= best[i] + slack)


def boxed_pairs(at: np.ndarray, low: np.ndarray, top: np.ndarray):
    """(place in `at`, box) of the points (m, 2) within boxes from low to top, borders included, in bounded parts.

    Points lie in bands, in each by x; a box looks up its stretch of each band.
    """
    if not len(at) or not len(low):
        return
    (x0, y0), (x1, y1) = at.min(axis=0), at.max(axis=0)
    wide = x1 - x0 + 2.0
    high = max(math.sqrt(4 * max(x1 - x0, 1e-9) * max(y1 - y0, 1e-9) / len(at)), (y1 - y0) / 100_000, 1e-9)
    last = int((y1 - y0) // high)
    place = np.minimum(np.floor((at[:, 1] - y0) / high), last) * wide + (at[:, 0] - x0)
    order = np.argsort(place, kind="stable")
    place, px, py = place[order], at[order, 0].copy(), at[order, 1].copy()
    a = np.clip(np.floor((low[:, 1] - y0) / high), 0, last + 1).astype(np.int64)
    bands = np.maximum(np.clip(np.floor((top[:, 1] - y0) / high), -1, last).astype(np.int64) - a + 1, 0)
    r = np.repeat(np.arange(len(low)), bands)
    b = np.arange(len(r)) - np.repeat(np.cumsum(bands) - bands, bands) + a[r]
    edge = lambda v: np.searchsorted(place, b * wide + np.clip(v - x0, -0.5, x1 - x0 + 0.5))
    start = edge(low[r, 0] - 1e-6)
    many = np.maximum(edge(top[r, 0] + 1e-6) - start, 0)
    total = np.cumsum(many)
    for rows in np.split(np.arange(len(r)), np.searchsorted(total, np.arange(ROOM // 8, many.sum(), ROOM // 8))):
        c = many[rows]
        one = np.arange(c.sum()) + np.repeat(start[rows] - np.cumsum(c) + c, c)
        own = np.repeat(r[rows], c)
        near = (px[one] >= low[own, 0]) & (px[one] <= top[own, 0]) & (py[one] >= low[own, 1]) & (py[one] <= top[own, 1])
        yield order[one[near]], own[near]


def nearest_places(at: np.ndarray, others: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in `at`, place in `others`, squared distance) of the others nearest to each point within radius, all of equal ones.

    The search begins with a reach that holds four others on average and doubles it for points that have found none.
    """
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    open_ = np.arange(len(at)) if len(others) else np.zeros(0, np.int64)
    wide = np.prod(np.maximum(np.ptp(others, axis=0), 1e-9)) if len(others) else 0.0
    reach = min(radius, math.sqrt(4 * wide / (math.pi * max(1, len(others))))) or radius
    while len(open_):
        p, best, pairs = at[open_], np.full(len(open_), np.inf), []
        for j, i in boxed_pairs(others, p - reach, p + reach):
            d = p[i] - others[j]
            d2 = d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1]
            near = d2 <= reach * reach
            i, j, d2 = i[near], j[near], d2[near]
            np.minimum.at(best, i, d2)
            near = d2 <= best[i]
            pairs.append((i[near], j[near], d2[near]))
        for i, j, d2 in pairs:
            near = d2 == best[i]
            found.append((open_[i[near]], j[near], d2[near]))
        if reach >= radius:
            break
        open_ = open_[~np.isfinite(best)]
        reach = min(radius, 2 * reach)
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def held_pairs(at: np.ndarray, rings: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(place in `at`, ring) of the points (m, 2) and the rings that hold them (even-odd rule); rings as flat_rings() gives them."""
    first, n, xy = rings
    none = np.zeros(0, np.int64)
    some = np.flatnonzero(n >= 3)
    if not len(at) or not len(some):
        return none, none
    first, n = first[some], n[some]
    starts = np.cumsum(n) - n
    flat = xy[np.arange(n.sum()) + np.repeat(first - starts, n)]
    low, top = np.fmin.reduceat(flat, starts), np.fmax.reduceat(flat, starts)
    known = np.isfinite(np.add.reduceat(flat, starts)).all(axis=1)
    some, first, n, low, top = some[known], first[known], n[known], low[known], top[known]
    found = [(none, none)]
    for k, part in by_size(n, lambda k: 8 * k):
        for one, own in boxed_pairs(at, low[part], top[part]):
            own = part[own]
            (x, y), inside, base = at[one].T, np.zeros(len(one), bool), first[own]
            for j in range(k):
                (ux, uy), (vx, vy) = xy[base + j].T, xy[base + (j + 1) % k].T
                with np.errstate(divide="ignore", invalid="ignore"):
                    inside ^= ((uy > y) != (vy > y)) & (x < (vx - ux) * (y - uy) / (vy - uy) + ux)
            found.append((one[inside], some[own[inside]]))
    return np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found])


def footprints(at: np.ndarray, rings: tuple[np.ndarray, np.ndarray, np.ndarray], values: np.ndarray, radius: float, sides: int) -> np.ndarray:
    """For each point of `at` (m, 2) of the rings that the regular polygon around it overlaps: how many they are, the area
    shared, and the sums of the values (rings, k)."""
    first, n, xy = rings
    out = np.zeros((2 + values.shape[1], len(at)))
    for k, part in by_size(np.where(n >= 3, n, 0), lambda k: 8 * k):
        if not k or not len(at):
            continue
        p = stack(first[part], k, xy)
        known = np.isfinite(p).all(axis=(1, 2))
        p, part = p[known], part[known]
        area, low, top = np.abs(signed_areas(p)), p.min(axis=1), p.max(axis=1)
        for one, own in boxed_pairs(at, low - radius, top + radius):
            x = at[one]
            gap = np.maximum(np.maximum(low[own] - x, x - top[own]), 0.0)
            near = gap[:, 0] * gap[:, 0] + gap[:, 1] * gap[:, 1] <= radius * radius
            one, own, x = one[near], own[near], x[near]
            far = np.maximum(x - low[own], top[own] - x)
            cut = np.flatnonzero(far[:, 0] * far[:, 0] + far[:, 1] * far[:, 1] > (radius * math.cos(math.pi / sides)) ** 2)
            shared = area[own]
            once = max(1, ROOM // 16 // k)
            for c in (cut[j : j + once] for j in range(0, len(cut), once)):
                shared[c] = disc_areas(p[own[c]], x[c], radius, sides)
            met = shared > 1e-9
            one, own, shared = one[met], own[met], shared[met]
            out[0] += np.bincount(one, minlength=len(at))
            out[1] += np.bincount(one, shared, len(at))
            for j in range(values.shape[1]):
                out[2 + j] += np.bincount(one, values[part[own], j], len(at))
    return out.T


def uncovered(sides: np.ndarray, low: np.ndarray, high: np.ndarray, rings: tuple[np.ndarray, np.ndarray, np.ndarray], off: float, margin: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, low, high): what rings leave of the stretches low to high of sides (m, 4), as shares of their ways.

    A ring takes of a side what it covers together with the places `off` to either hand, but for `margin` at the ends where
    the ring's own border is met; so what crosses an outline is left with its crossing. The rings come as flat_rings() gives
    them, the largest are taken first, and a later one meets only what is left then.
    """
    first, n, xy = rings
    row = np.flatnonzero(high > low)
    low, high = low[row], high[row]
    ux, uy, dx, dy = sides[:, 0], sides[:, 1], sides[:, 2] - sides[:, 0], sides[:, 3] - sides[:, 1]
    length = np.maximum(np.hypot(dx, dy), 1e-300)
    each = [xy[a : a + k] for a, k in zip(first, n, strict=True) if k >= 3]
    each = sorted((r for r in each if np.isfinite(r).all()), key=lambda r: -np.prod(np.ptp(r, axis=0)))
    for p in each:
        if not len(row):
            break
        (x0, y0), (x1, y1) = p.min(axis=0), p.max(axis=0)
        ax, bx, ay, by = ux[row] + dx[row] * low, ux[row] + dx[row] * high, uy[row] + dy[row] * low, uy[row] + dy[row] * high
        near = np.flatnonzero((np.minimum(ax, bx) < x1) & (np.maximum(ax, bx) > x0) & (np.minimum(ay, by) < y1) & (np.maximum(ay, by) > y0))
        once = max(1, ROOM // 8 // len(p))
        taken = [_covered(ux[r], uy[r], dx[r], dy[r], length[r], low[s], high[s], p, off, margin) for s in np.split(near, range(once, len(near), once)) for r in (row[s],)]
        at = np.concatenate([near[k * once : (k + 1) * once][t[0]] for k, t in enumerate(taken)])
        if not len(at):
            continue
        a, b = np.concatenate([t[1] for t in taken]), np.concatenate([t[2] for t in taken])
        # Between what is taken, in order: from each end to the next beginning.
        many = np.arange(len(row))
        ends, starts = np.argsort(np.concatenate([many, at]), kind="stable"), np.argsort(np.concatenate([at, many]), kind="stable")
        own, low, high = np.concatenate([many, at])[ends], np.concatenate([low, b])[ends], np.concatenate([a, high])[starts]
        left = high > low
        row, low, high = row[own[left]], low[left], high[left]
    return row, low, high


def _covered(ux, uy, dx, dy, length, low, high, p: np.ndarray, off: float, margin: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, from, to) of the stretches that the open ring p covers on both hands, in order."""
    c = lambda v: v[:, None]
    met = []
    for hand in (-off, off):
        x, y = p[:, 0] - c(ux - hand * dy / length), p[:, 1] - c(uy + hand * dx / length)
        aside, along = c(dx) * y - c(dy) * x, (x * c(dx) + y * c(dy)) / c(length * length)
        then, far = np.roll(aside, -1, axis=1), np.roll(along, -1, axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            t = along + (far - along) * (aside / (aside - then))
        met.append(np.where((aside >= 0) != (then >= 0), t, np.inf))
    t = np.concatenate(met, axis=1)
    order = np.argsort(t, axis=1, kind="stable")
    t = np.take_along_axis(t, order, axis=1)
    there, one = np.isfinite(t), order < len(p)
    both = (np.cumsum(there & one, axis=1) % 2 == 1) & (np.cumsum(there & ~one, axis=1) % 2 == 1)
    gap = c(margin / length)
    a, b = (np.where(t[:, :-1] > c(low), t[:, :-1] + gap, c(low)), np.where(t[:, 1:] < c(high), t[:, 1:] - gap, c(high)))
    place, k = np.nonzero(both[:, :-1] & there[:, 1:] & (b > a))
    return place, a[place, k], b[place, k]
