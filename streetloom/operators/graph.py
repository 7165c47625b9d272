"""Street-graph operators on node and edge tables."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import shared_base
from .clean import numbered
from .perron import perron


def _held(df: DataFrame) -> DataFrame:
    """Cut the lineage of an iteration: checkpoint() writes to the folder all executors share.

    What is held keeps the size that Spark guessed from the bytes of its source, whatever rows were made of them; so joins
    with it are merge joins, unless the other side is to be broadcast by name.
    """
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_base(df.sparkSession))
    return df.checkpoint().hint("merge")


def out_degree(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    n = edges.groupBy(F.col("u").alias(key)).agg(F.count(F.lit(1)).alias("degree"))
    return nodes.select(key).join(n, key, "left").na.fill(0, ["degree"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component): least node of each weakly connected component, by alternating large and small stars."""
    now = _held(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    mark = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    while (found := mark(now)) != before and found[0]:
        before = found
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        wide = both.join(least, "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = wide.groupBy("u").agg(F.min("v").alias("m"))
        now = _held(wide.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct())
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


def triangles(both: DataFrame) -> DataFrame:
    """(i, t): for each node the sum, over the ordered pairs of others that close a triangle with it, of the product of the
    three sides' w, from undirected weights (u, v, w) that list both directions.

    A side points from the node of fewer neighbours to that of more, so that a wedge is only opened where its tip has few:
    a hub opens none of its own pairs. Each triangle is found once and counts for its three nodes.
    """
    size = both.groupBy("u").agg(F.count(F.lit(1)).alias("k"))
    place = lambda c: F.struct(F.col(f"k{c}"), F.col(c))
    ranked = both.join(size.withColumnRenamed("k", "ku"), "u").join(size.select(F.col("u").alias("v"), F.col("k").alias("kv")), "v")
    up = _held(ranked.where(place("u") < place("v")).select("u", "v", "w", "kv"))
    a = up.select(F.col("u").alias("i"), F.col("v").alias("j"), F.col("w").alias("wij"), F.col("kv").alias("kj"))
    b = up.select(F.col("u").alias("i"), F.col("v").alias("k"), F.col("w").alias("wik"), F.col("kv").alias("kk"))
    wedge = a.join(b, "i").where(F.struct("kj", "j") < F.struct("kk", "k"))
    closed = wedge.join(up.select(F.col("u").alias("j"), F.col("v").alias("k"), F.col("w").alias("wjk")), ["j", "k"])
    each = closed.select((2 * F.col("wij") * F.col("wik") * F.col("wjk")).alias("t"), F.explode(F.array("i", "j", "k")).alias("i_"))
    return each.groupBy(F.col("i_").alias("i")).agg(F.sum("t").alias("t"))


def clustering(edges: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """Directed clustering: triangles over 2 (d (d - 1) - 2 b), with total degree d and two-way neighbours b, parallel edges as one."""
    one = edges.where("u <> v").select("u", "v").distinct()
    both = _held(one.union(one.select("v", "u")).groupBy("u", "v").agg(F.count(F.lit(1)).alias("w")))
    degree = both.groupBy(F.col("u").alias("i")).agg(F.sum("w").alias("d"), F.sum((F.col("w") == 2).cast("long")).alias("b"))
    most = F.col("d") * (F.col("d") - 1) - 2 * F.col("b")
    value = F.when(most > 0, F.coalesce("t", F.lit(0)) / (2 * most)).otherwise(0.0)
    out = degree.join(triangles(both), "i", "left").select(F.col("i").alias(key), value.alias("clustering"))
    return nodes.select(key).join(out, key, "left").na.fill(0.0, ["clustering"])


def _change(now: DataFrame, before: DataFrame) -> float:
    old = before.select("id", F.col("value").alias("old"))
    return now.join(old, "id").agg(F.coalesce(F.sum(F.abs(F.col("value") - F.col("old"))), F.lit(0.0))).first()[0]


#: Links and nodes up to which an iteration runs in the driver's numpy, where thousands of rounds cost seconds.
SMALL = 2_000_000


def _local(nodes: DataFrame, links: DataFrame, columns: list[str]):
    """(ids and other columns of nodes, ends and weights of links as places among them), or None above SMALL rows of either."""
    if links.limit(SMALL + 1).count() > SMALL or nodes.limit(SMALL + 1).count() > SMALL:
        return None
    # As Arrow batches: rows as Python objects take ten times their bytes.
    table, e = ({c: t.column(c).to_numpy() for c in t.column_names} for t in (nodes.select(*columns).toArrow(), links.select("u", "v", "w").toArrow()))
    ids = table[columns[0]]
    order = np.argsort(ids, kind="stable")
    at = lambda c: order[np.minimum(np.searchsorted(ids[order], e[c]), len(ids) - 1)] if len(ids) else np.zeros(0, int)
    u, v = at("u"), at("v")
    there = (ids[u] == e["u"]) & (ids[v] == e["v"]) if len(ids) else np.zeros(0, bool)
    return table, u[there], v[there], e["w"].astype(float)[there]


def _named(spark, ids: np.ndarray, name: str, values: np.ndarray, key: str) -> DataFrame:
    return spark.createDataFrame(pa.table({key: pa.array(ids, pa.int64()), name: pa.array(values, pa.float64())}))


#: Links that a block of nodes has, about.
BLOCK_LINKS = 500_000


def _in_blocks(nodes: DataFrame, weights: DataFrame, key: str, first: float, send, take, tol: float) -> DataFrame:
    """The rounds of _iterate on blocks of nodes that follow one another by id, a block a partition.

    A block keeps its links and its nodes' values as arrays where they are. A round sends a sum for each node that a block
    has links to, not one for each link, and nothing else; links never move again.
    """
    spark = nodes.sparkSession
    at = _held(numbered(nodes.select(F.col(key).cast("long").alias("id")), "id", "_i"))
    n, links = at.count(), weights.count()
    parts = max(spark.sparkContext.defaultParallelism, -(-links // BLOCK_LINKS))
    size = -(-n // parts)
    place = lambda c: at.select(F.col("id").alias(c), F.col("_i").alias(f"_{c}"))
    near = weights.join(place("u"), "u").join(place("v"), "v", "left").select(F.floor(F.col("_u") / size).alias("b"), F.col("_u").alias("u"), F.coalesce("_v", F.lit(-1).cast("long")).alias("v"), F.col("w").cast("double"))

    def packed(table):
        c = {k: table.column(k).to_numpy() for k in ("u", "v", "w")}
        return pa.table({"b": table.column("b").slice(0, 1), **{k: pa.array([c[k].tobytes()], pa.binary()) for k in c}})

    whole = _held(near.groupBy("b").applyInArrow(packed, "b long, u binary, v binary, w binary"))
    many = lambda b: max(0, min(size, n - b * size))

    def block(b, rows):
        """(targets by block, places of links' sources and targets, weights, links out of each node)."""
        got = [r for _, r in rows]
        u, v = (np.frombuffer(got[0][k], np.int64) if got else np.zeros(0, np.int64) for k in (0, 1))
        w = np.frombuffer(got[0][2]) if got else np.zeros(0)
        u = u - b * size
        out = np.bincount(u, w, many(b))
        u, v, w = u[v >= 0], v[v >= 0], w[v >= 0]
        to, slot = np.unique(v, return_inverse=True)
        yield to, u, slot, w, out

    blocks = whole.rdd.map(lambda r: (r.b, (r.u, r.v, r.w))).partitionBy(parts, int).mapPartitionsWithIndex(block).persist(StorageLevel.MEMORY_AND_DISK)

    def sent(both):
        (to, u, slot, w, out), value = both
        with np.errstate(divide="ignore", invalid="ignore"):
            each = send(value, out)
        sums = np.bincount(slot, w * each[u], len(to)) if len(to) else np.zeros(0)
        cut = np.flatnonzero(np.diff(to // size)) + 1
        return [(int(t[0] // size), (t % size, s)) for t, s in zip(np.split(to, cut), np.split(sums, cut), strict=True) if len(t)]

    def summed(b, rows):
        got = np.zeros(many(b))
        for _, (place, s) in rows:
            got[place] += s
        yield take(got)

    values = before = blocks.mapPartitionsWithIndex(lambda b, _: [np.full(many(b), first)])
    for k in itertools.count(1):
        before, values = values, blocks.zip(values).flatMap(sent).partitionBy(parts, int).mapPartitionsWithIndex(summed)
        if k % 8 == 0:
            values.persist(StorageLevel.MEMORY_AND_DISK)
            values.checkpoint()
            if values.zip(before).map(lambda p: float(np.abs(p[0] - p[1]).sum())).sum() < tol:
                break

    def spread(batches):
        for batch in batches:
            for b, v in zip(batch.column("b").to_pylist(), batch.column("v").to_pylist(), strict=True):
                v = np.frombuffer(v)
                yield pa.RecordBatch.from_arrays([pa.array(b * size + np.arange(len(v))), pa.array(v)], names=["_i", "value"])

    flat = spark.createDataFrame(values.mapPartitionsWithIndex(lambda b, it: [(b, bytearray(v.tobytes())) for v in it]), "b long, v binary").mapInArrow(spread, "_i long, value double")
    return at.join(flat, "_i").select(F.col("id").alias(key), "value")


def _iterate(nodes: DataFrame, edges: DataFrame, key: str, first: float, send, take, tol: float) -> DataFrame:
    """Rounds until all values together change by less than tol in one of them; parallel edges are one link with a weight.

    Small graphs are iterated in numpy, others in blocks.
    """
    weights = _held(edges.groupBy("u", "v").agg(F.count(F.lit(1)).alias("w")))
    if (small := _local(nodes, weights, [key])) is None:
        return _in_blocks(nodes, weights, key, first, send, take, tol)
    table, u, v, w = small
    n = len(table[key])
    out = np.bincount(u, w, n)
    now, change = np.full(n, first), np.inf
    while n and change >= tol:
        before, now = now, take(np.bincount(v, w * send(now[u], out[u]), n))
        change = np.abs(now - before).sum()
    return _named(nodes.sparkSession, table[key], "value", now, key)


def pagerank(nodes: DataFrame, edges: DataFrame, key: str, damping: float = 0.85, tol: float = 1e-8) -> DataFrame:
    """Ranks; those of nodes without a way out are not dealt to others."""
    n = max(1, nodes.count())
    return _iterate(nodes, edges, key, 1.0 / n, lambda v, out: v / out, lambda got: (1 - damping) / n + damping * got, tol).withColumnRenamed("value", "pagerank")


def katz(nodes: DataFrame, edges: DataFrame, key: str, alpha: float = 0.01, tol: float = 1e-8) -> DataFrame:
    """Not scaled; alpha must be below one over the largest eigenvalue, or the values grow without end."""
    return _iterate(nodes, edges, key, 1.0, lambda v, out: v, lambda got: 1.0 + alpha * got, tol).withColumnRenamed("value", "katz")


def dual(edges: DataFrame, key: str = "street_id") -> DataFrame:
    """Pairs of streets of which one begins where the other ends."""
    a = edges.select(F.col(key).alias("a"), F.col("v").alias("at"))
    b = edges.select(F.col(key).alias("b"), F.col("u").alias("at"))
    return a.join(b, "at").where("a <> b").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct()


#: Rounds of the power iteration after which elimination is tried.
ROUNDS = 500


def _eliminated(of: np.ndarray, u: np.ndarray, v: np.ndarray, w: np.ndarray, now: np.ndarray) -> np.ndarray | None:
    """The vector of each group by elimination (perron), or None if one of them has none."""
    out, inner = np.zeros(len(now)), of[u] == of[v]
    if not inner.all():
        return None
    for g in range(int(of.max()) + 1):
        nodes = np.flatnonzero(of == g)
        at = np.full(len(now), -1)
        at[nodes] = np.arange(len(nodes))
        some = of[u] == g
        if (found := perron(len(nodes), at[u[some]], at[v[some]], w[some], now[nodes])) is None:
            return None
        out[nodes] = found[1]
    return out


def eigenvector(nodes: DataFrame, edges: DataFrame, key: str, tol: float = 1e-8, group: str | None = None, most: int = 2000) -> DataFrame:
    """Power iteration of (I + transposed adjacency), scaled to length 1 (of each group) each round; parallel edges count.

    It goes on until all values together change by less than tol in a round. Where the largest eigenvalue is not single
    that may not be: after `most` rounds a ValueError is raised. In the driver's numpy long, narrow graphs that are slow
    to converge go on by elimination, which gives the limit of the rounds.
    """
    links = _held(edges.groupBy("u", "v").agg(F.count(F.lit(1)).alias("w")))
    if (small := _local(nodes, links, [key, *([group] if group else [])])) is not None:
        table, u, v, w = small
        n = len(table[key])
        of = np.unique(table[group], return_inverse=True)[1] if group else np.zeros(n, int)
        scaled = lambda x: x / np.sqrt(np.bincount(of, x * x))[of]
        now, change = scaled(np.ones(n)) if n else np.zeros(0), np.inf
        for k in itertools.count(1):
            if not n or change < tol:
                break
            before, now = now, scaled(now + np.bincount(v, w * now[u], n))
            change = np.abs(now - before).sum()
            if k == ROUNDS and (found := _eliminated(of, u, v, w, now)) is not None:
                now = found
                break
        return _named(nodes.sparkSession, table[key], "eigenvector", now, key)
    now = nodes.select(F.col(key).alias("id"), F.lit(1.0).alias("value"), *([F.col(group).alias("_g")] if group else [F.lit(0).alias("_g")]))
    groups = F.broadcast if group is None else (lambda df: df)
    for k in itertools.count(1):
        got = links.join(now, links.u == now.id).groupBy("v").agg(F.sum(F.col("w") * F.col("value")).alias("got"))
        after = now.join(got, F.col("id") == F.col("v"), "left").select("id", "_g", (F.col("value") + F.coalesce("got", F.lit(0.0))).alias("value"))
        before = now
        if k % 4:
            now = after
            continue
        size = after.groupBy("_g").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("size"))
        now = _held(after.join(groups(size), "_g").select("id", "_g", (F.col("value") / F.col("size")).alias("value")))
        scaled = before.groupBy("_g").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("size"))
        if _change(now, before.join(groups(scaled), "_g").select("id", (F.col("value") / F.col("size")).alias("value"))) < tol:
            return now.select(F.col("id").alias(key), F.col("value").alias("eigenvector"))
        if k >= most:
            raise ValueError(f"no eigenvector after {k} rounds")


def fill_along(values: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, value): null values become those of the nearest node that has one, by hops in either direction, ties to the least id.

    Every round settles the nodes one hop farther; it ends when no node is reached.
    """
    both = _held(edges.select("u", "v").union(edges.select("v", "u")).where("u <> v").distinct())
    done = _held(values.where("value IS NOT NULL").select("id", "value", F.col("id").alias("from")))
    front = done
    while True:
        reached = both.join(front, both.u == front.id).groupBy("v").agg(F.min(F.struct("from", "value")).alias("best")).select(F.col("v").alias("id"), "best.value", "best.from")
        front = _held(reached.join(done, "id", "left_anti"))
        if front.isEmpty():
            break
        done = _held(done.unionByName(front))
    return values.select("id").join(done.select("id", "value"), "id", "left")
