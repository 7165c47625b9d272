"""SimHash near-dedup with vantage-point trees.

A text's lower-cased words give runs of three (a shorter text is one run, repeats count). Every run votes with the 64 bits
of its XXH64; a bit of the fingerprint is set where more than half of the votes are. Documents of equal fingerprints are
one class, so exact copies cost one row. Classes link where fingerprints differ in at most REACH bits.

Pairs are found by vantage-point trees. A node has a vantage point v and a radius m: fingerprints x with d(v, x) <= m are
inside. By the triangle bound a partner of x within REACH is inside only if d(v, x) <= m + REACH and outside only if
d(v, x) > m - REACH, so most points go one way at some nodes and both ways at others, and none is lost. An upper tree,
fitted on a bounded sample of fingerprints (about SAMPLE, and a fourth of them at most, by a hash), cuts all of
them into shards of about SHARD (more where the sample has fewer than LEAST for each);
every fingerprint has one home, and is also sent as a visitor to the shards of higher number that its bounds overlap. A
shard's visitors are dealt over blocks with a copy of the shard each, so a task holds a bounded number. In a task a lower
tree of the shard's own members takes all points down at once, and its leaves are compared in numpy. The sample decides
about balance alone; pairs are exact whatever it is.

A task keeps a forest: links within one component that it knows already are not passed on, so a family of near copies
gives no more rows than it has members. Points too close to be parted are first joined by some hubs among them; then only
pairs across components are compared. Forests of all tasks are merged by alternating stars.

Defined results: null texts and texts without words have the fingerprint zero and link like any other. Rows with a null
id have a fingerprint, take no part in linking, and their component is null. Rows that share an id share a component only
if their fingerprints are linked. Repeated rows get equal results. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import add_columns, bound_batches, discard, gathered, materialize, utf8
from .components import components

WIDTH, SEED, REACH = 3, 42, 3
#: Fingerprints that fit the upper tree at most, and for each shard at least; fingerprints of a shard, about; visitors a
#: block takes for each member; fingerprints routed at once.
SAMPLE, LEAST, SHARD, VISITORS, ROUTED = 1 << 18, 16, 16_384, 16, 50_000
#: Points of a lower tree's leaf; candidates for vantage points; hubs of a leaf that cannot be parted; runs hashed at once;
#: pairs compared at once.
LEAF, TRIALS, HUBS, CHUNK, PAIRS = 96, 8, 32, 1 << 16, 1 << 21
_BLANKS = bytes(32 if b == 32 or 9 <= b <= 13 else b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: bytes | None) -> int:
    words = text.translate(_BLANKS).split(b" ") if text else []
    words = [w for w in words if w]
    if not words:
        return 0
    width = min(WIDTH, len(words))
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]])
    joined, votes, count = b" ".join(words), np.zeros(64, np.int64), len(words) - width + 1
    for at in range(0, count, CHUNK):
        to = min(at + CHUNK, count)
        spans = zip(starts[at:to].tolist(), (ends[at + width - 1 : to + width - 1] - 1).tolist(), strict=True)
        h = np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans), np.uint64, to - at)
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > count, bitorder="little").view(np.uint64)[0])


def signed(docs: DataFrame, text_col: str) -> DataFrame:
    """docs with fp in place of the text: the fingerprint's 64 bits as a long."""

    def make(batches):
        for batch in batches:
            yield [pa.array(np.array([fingerprint(t) for t in utf8(batch, text_col)], np.uint64).view(np.int64), pa.int64())]

    return add_columns(docs, "fp long", make).drop(text_col)


def split(points: np.ndarray, rng: np.random.Generator) -> tuple[np.uint64, int] | None:
    """The vantage point and radius that send fewest points both ways, of some tried.

    None if none saves a tenth of the pairs at least: points all within a few bits of each other are not worth a node.
    """
    best = None
    most = 0.9 * len(points) ** 2
    for v in points[rng.choice(len(points), min(TRIALS, len(points)), replace=False)]:
        d = np.bincount(np.bitwise_count(points ^ v), minlength=65)
        inside = np.cumsum(d)[:-1]
        # Points within the bounds of both sides, and the work of a node: both sides with what visits them.
        low, high = np.concatenate([np.zeros(REACH, int), inside])[: len(inside)], np.concatenate([inside, np.full(REACH, len(points))])[REACH : REACH + len(inside)]
        cost = np.where((inside > 0) & (inside < len(points)), high.astype(float) * inside + (len(points) - low).astype(float) * (len(points) - inside), np.inf)
        m = int(cost.argmin())
        if cost[m] < (best[0] if best else most):
            best = float(cost[m]), v, m
    return best and best[1:]


class Upper:
    """The tree that cuts all fingerprints into shards: nodes in arrays, shards numbered from the left."""

    def __init__(self, sample: np.ndarray, shards: int):
        self.nodes: list[tuple] = []
        self.shards = 0
        self._grow(sample, max(1, len(sample) // max(1, shards)), np.random.default_rng(5))

    def _grow(self, points: np.ndarray, size: int, rng: np.random.Generator) -> int:
        at, cut = len(self.nodes), split(points, rng) if len(points) > 1.5 * size else None
        self.nodes.append(())
        if cut is None:
            self.nodes[at] = (None, self.shards, 0, 0)
            self.shards += 1
            return at
        v, m = cut
        inside = np.bitwise_count(points ^ v) <= m
        self.nodes[at] = (v, m, self._grow(points[inside], size, rng), self._grow(points[~inside], size, rng))
        return at

    def route(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, shard, home) of every fingerprint's home and of the later shards that its bounds overlap."""
        rows, shards, homes = [], [], []
        stack = [(0, np.arange(len(fps)), np.ones(len(fps), bool))]
        while stack:
            at, row, home = stack.pop()
            if not len(row):
                continue
            v, m, left, right = self.nodes[at]
            if v is None:
                rows.append(row), shards.append(np.full(len(row), m)), homes.append(home)
                continue
            d = np.bitwise_count(fps[row] ^ v).astype(int)
            # Visitors go to the right of their home alone: of two partners in different shards, one visits the other.
            inside = (home & (d <= m)) | (~home & (d <= m + REACH))
            outside = d > m - REACH
            stack.append((left, row[inside], home[inside]))
            stack.append((right, row[outside], (home & (d > m))[outside]))
        if not rows:
            return np.zeros(0, int), np.zeros(0, int), np.zeros(0, bool)
        return np.concatenate(rows), np.concatenate(shards), np.concatenate(homes)


class Forest:
    """Components of points numbered from 0; link() says which links joined two."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self) -> np.ndarray:
        while (self.up != (over := self.up[self.up])).any():
            self.up = over
        return self.up

    def link(self, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
        top = self.roots()
        apart = top[a] != top[b]
        if not apart.any():
            return []
        a, b = a[apart], b[apart]
        _, first = np.unique(np.minimum(top[a], top[b]) * len(top) + np.maximum(top[a], top[b]), return_index=True)
        up, used = self.up.tolist() if len(first) * 8 > len(top) else self.up, []
        for i in first.tolist():
            x, y = int(a[i]), int(b[i])
            p, q = x, y
            while p != up[p]:
                p = int(up[p])
            while q != up[q]:
                q = int(up[q])
            if p != q:
                up[max(p, q)] = min(p, q)
                used.append((x, y))
        self.up = np.asarray(up)
        return used


def compare(points: np.ndarray, forest: Forest, own: np.ndarray, ask: np.ndarray) -> list[tuple[int, int]]:
    """Links of the pairs within REACH of own and ask points that join components, all pairs compared in blocks."""
    out: list[tuple[int, int]] = []
    wide = min(len(own), PAIRS)
    for o in range(0, len(own), max(1, wide)):
        some = own[o : o + wide]
        step = max(1, PAIRS // len(some))
        for at in range(0, len(ask), step):
            i, j = np.nonzero(np.bitwise_count(points[ask[at : at + step], None] ^ points[None, some]) <= REACH)
            a, b = ask[at + i], some[j]
            out += forest.link(a[a != b], b[a != b])
    return out


def compare_dense(points: np.ndarray, forest: Forest, own: np.ndarray, ask: np.ndarray, rng: np.random.Generator) -> list[tuple[int, int]]:
    """As compare(), for many points close to each other: some hubs join most of them, and pairs within one component are passed over."""
    out: list[tuple[int, int]] = []
    every = np.concatenate([own, ask])
    for hub in own[rng.choice(len(own), min(HUBS, len(own)), replace=False)].tolist():
        near = every[np.bitwise_count(points[every] ^ points[hub]) <= REACH]
        near = near[near != hub]
        out += forest.link(near, np.full(len(near), hub))
    top = forest.roots()
    names, sizes = np.unique(top[own], return_counts=True)
    large = names[sizes.argmax()]
    inner = top[ask] == large
    return out + compare(points, forest, own[top[own] != large], ask[inner]) + compare(points, forest, own, ask[~inner])


def forest_links(members: np.ndarray, visitors: np.ndarray, within: bool) -> list[tuple[int, int]]:
    """Links that span the components of all pairs within REACH of members and visitors, and of members if `within`.

    Points are numbered members first. A lower tree of the members takes down the visitors, or the members themselves.
    """
    out: list[tuple[int, int]] = []
    forest, rng = Forest(len(members) + len(visitors)), np.random.default_rng(6)
    points = np.concatenate([members, visitors])
    asked = np.arange(0 if within else len(members), len(points))
    stack = [(np.arange(len(members)), asked)]
    while stack:
        own, ask = stack.pop()
        if not len(own) or not len(ask):
            continue
        cut = split(points[own], rng) if len(own) > LEAF else None
        if cut is None:
            out += compare_dense(points, forest, own, ask, rng) if len(own) > 4 * LEAF else compare(points, forest, own, ask)
            continue
        v, m = cut
        d_own, d_ask = np.bitwise_count(points[own] ^ v).astype(int), np.bitwise_count(points[ask] ^ v).astype(int)
        stack.append((own[d_own <= m], ask[d_ask <= m + REACH]))
        stack.append((own[d_own > m], ask[d_ask > m - REACH]))
    return out


def links(classes: DataFrame, *, sample: int = SAMPLE, shard: int = SHARD) -> DataFrame:
    """(u, v) of distinct fingerprints (fp): links that span the components of all pairs within REACH."""
    bound_batches(classes.sparkSession)
    total = classes.count()
    drawn_n = min(sample, max(1, total // 4))
    shards = min(-(-total // shard), max(1, drawn_n // LEAST))
    # About drawn_n of them: those whose hash's low half is small.
    drawn = classes.where(F.xxhash64("fp").bitwiseAND(F.lit((1 << 32) - 1)) < (drawn_n << 32) // total).collect() if shards > 1 else []
    fitted = np.array([r.fp for r in drawn], np.int64).view(np.uint64)
    upper = Upper(fitted, shards)
    # Visitors for each member, as the sample foretells.
    blocks = max(1, -(-int((~upper.route(fitted)[2]).sum()) // max(1, len(fitted) * VISITORS)))

    def run(batches):
        for batch in gathered(batches, ROUTED, 1 << 20):
            fp = batch.column("fp").to_numpy(zero_copy_only=False)
            row, to, home = upper.route(fp.view(np.uint64))
            block = (fp[row].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % blocks
            for k in range(blocks):  # members stand in every block
                take = home | (block == k)
                n = int(take.sum())
                yield pa.RecordBatch.from_arrays([pa.array(to[take], pa.int64()), pa.array(np.full(n, k), pa.int64()), pa.array(home[take], pa.bool_()), pa.array(fp[row[take]], pa.int64())], names=["shard", "block", "home", "fp"])

    def search(key, table):
        home, fp = table.column("home").to_numpy(), table.column("fp").to_numpy()
        points = np.concatenate([np.sort(fp[home]), np.sort(fp[~home])])
        n = int(home.sum())
        found = np.array(forest_links(points[:n].view(np.uint64), points[n:].view(np.uint64), key[1].as_py() == 0), np.int64).reshape(-1, 2)
        return pa.table({"u": pa.array(points[found[:, 0]], pa.int64()), "v": pa.array(points[found[:, 1]], pa.int64())})

    dealt = classes.mapInArrow(run, "shard long, block long, home boolean, fp long")
    return dealt.groupBy("shard", "block").applyInArrow(search, "u long, v long")


def near_duplicates(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", sample: int = SAMPLE, shard: int = SHARD) -> DataFrame:
    """(doc_id, fingerprint, component_id), a row for each row of docs."""
    marked = materialize(signed(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "text"), "simhash")
    classes = materialize(marked.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("id")), "fingerprints")
    found = materialize(links(classes.select("fp"), sample=sample, shard=shard), "links")
    # Components are named by a fingerprint first, then by the least id of all their classes.
    labels = materialize(components(found), "labels")
    least = labels.join(classes, F.col("node") == F.col("fp")).groupBy("component").agg(F.min("id").alias("least"))
    named = labels.join(least, "component").select(F.col("node").alias("fp"), "least")
    table = materialize(classes.join(named, "fp", "left").select("fp", F.coalesce("least", "id").alias("component_id")), "components")
    discard(found, labels)
    out = marked.join(table, "fp", "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
