"""Merkle dataset manifest: a node store in level-partitioned Parquet, built by scans, and proofs by merge joins.

A row's leaf is the digest of its columns; the leaves of a tree stand in the order of the key, then of the leaf. While a
tree has several nodes, every FANOUT neighbouring ones become one node of the next level. The roots of all trees are in
turn the leaves of one tree, whose root stands for the dataset.

Leaves are sorted into runs (a range of the order each, so one tree may span all of them) and written as level 0. A
leaf's coordinate is its place within the run plus what earlier runs hold of its tree. Each level is made by reading the
one before once, in stored order, in bounded memory: runs of FANOUT neighbours that a task meets together are hashed as
they pass; what a task's edge cuts is put together from its few pieces by a small shuffle. Levels stay in the shared
folder as `level=k`, each node beside the digests below it.

A proof is read from the top: the nodes of a level meet their parents by (tree, coordinate) in a merge join and put
their own neighbours before the parent's path. At the last step a parent's path serves all its leaves, so paths are
moved once for FANOUT rows.

Defined results: a null counts as `-`, any other value as its length in bytes, `:` and the value, so null and empty
differ. Null keys stand first; rows equal in key and leaf are interchangeable and have a proof each. Null is a tree of
its own, before all others. Columns beyond those named count for nothing. A tampered row of a null key is one whose key
reads as the empty text. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bound_batches, fresh_path, id_remainder, materialize

FANOUT = 8
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Leaves of one sorted run, about.
RUN_ROWS = 250_000
#: Pairs of run and tree that are broadcast at most; more (very many trees) are met by a shuffle.
FEW_RUNS = 1_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PATH = "array<struct<before:string,after:string>>"
_NODES = "tree string, n long, pos long, digest string, members array<string>"


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(**columns: Column) -> Column:
    """The leaf of a row of the columns, in the order given."""
    return F.sha2(F.concat(*[field(c) for c in columns.values()]).cast("binary"), 256)


@dataclass
class Tree:
    """Stored levels of a set of trees; leaves: level 0 with all columns it came with."""

    leaves: DataFrame
    levels: list[DataFrame]


def sorted_leaves(rows: DataFrame, store: str, order: list[str]) -> DataFrame:
    """rows (tree, digest, ...) written in runs sorted by tree and `order`, with pos, the place within the tree, and n, its size."""
    spark, total = rows.sparkSession, rows.count()
    by = ["tree", *order, "digest", "_at"]
    # The last key tells equal rows apart, so that they can lie in several runs.
    ranged = rows.withColumn("_at", F.monotonically_increasing_id()).repartitionByRange(max(1, -(-total // RUN_ROWS), min(total // 64, spark.sparkContext.defaultParallelism)), *by)
    numbered = ranged.sortWithinPartitions(*by).drop("_at").withColumns({"run": F.spark_partition_id(), "at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    numbered.write.option("compression", "zstd").parquet(f"{store}/runs")
    numbered = spark.read.schema(numbered.schema).parquet(f"{store}/runs")
    held = numbered.groupBy("run", "tree").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("here"))
    whole = Window.partitionBy("tree")
    held = held.select("run", "tree", (F.coalesce(F.sum("here").over(whole.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("first")).alias("shift"), F.sum("here").over(whole).alias("n"))
    held = materialize(held, "runs-held")
    few = held.count() <= FEW_RUNS
    placed = numbered.join(F.broadcast(held) if few else held, ["run", "tree"]).withColumn("pos", F.col("at") + F.col("shift")).drop("run", "at", "shift")
    return placed if few else placed.sortWithinPartitions("tree", "pos")


def _folded(batches):
    """Runs of neighbours as they pass: (tree, n, pos, digest, members), digest null where the task has not met the whole run."""
    key, members, places, size = None, [], [], 0
    out: list[tuple] = []

    def close():
        if key is not None:
            tree, n, pos = key
            whole = len(members) == min(FANOUT, n - pos * FANOUT)
            digest = hashlib.sha256("".join(members).encode()).hexdigest() if whole else None
            out.append((tree, -(-n // FANOUT), pos, digest, list(members), list(places)))

    def flush():
        names = ["tree", "n", "pos", "digest", "members", "places"]
        types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int64())]
        made = pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=names)
        out.clear()
        return made

    for batch in batches:
        for tree, n, pos, digest in zip(*[batch.column(c).to_pylist() for c in ("tree", "n", "pos", "digest")], strict=True):
            this = (tree, n, pos // FANOUT)
            if this != key or places[-1] + 1 != pos:
                close()
                key, members, places = this, [], []
            members.append(digest)
            places.append(pos)
        size += batch.num_rows
        if size >= 20_000:
            yield flush()
            size = 0
    close()
    yield flush()


def next_level(nodes: DataFrame, path: str) -> DataFrame:
    """The level above `nodes` (tree, n, pos, digest), written to path; trees of one node have no more levels."""
    spark = nodes.sparkSession
    met = materialize(nodes.where("n > 1").select("tree", "n", "pos", "digest").mapInArrow(_folded, f"{_NODES}, places array<long>"), "met")
    # What a task's edge has cut: a few pieces of at most FANOUT digests for each task.
    pieces = met.where("digest IS NULL").select("tree", "n", "pos", F.explode(F.arrays_zip("places", "members")).alias("m"))
    joined = pieces.groupBy("tree", "n", "pos").agg(F.transform(F.array_sort(F.collect_list("m")), lambda m: m["members"]).alias("members"))
    joined = joined.withColumn("digest", F.sha2(F.array_join("members", "").cast("binary"), 256))
    columns = ["tree", "n", "pos", "digest", "members"]
    met.where("digest IS NOT NULL").select(*columns).union(joined.select(*columns)).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(_NODES).parquet(path)


def build(rows: DataFrame, order: list[str], store: str) -> Tree:
    """The trees over rows (tree, digest, ...), each in the order of `order` and the digest."""
    bound_batches(rows.sparkSession)
    leaves = sorted_leaves(rows, store, order)
    leaves.write.option("compression", "zstd").parquet(f"{store}/level=0")
    leaves = rows.sparkSession.read.schema(leaves.schema).parquet(f"{store}/level=0")
    most = leaves.agg(F.max("n")).first()[0] or 0
    levels = [leaves]
    while most > 1:
        levels.append(next_level(levels[-1], f"{store}/level={len(levels)}"))
        most = -(-most // FANOUT)
    return Tree(leaves, levels)


def roots(tree: Tree) -> DataFrame:
    """(tree, digest) of every tree's last node."""
    out = tree.levels[0].where("n = 1").select("tree", "digest")
    for level in tree.levels[1:]:
        out = out.union(level.where("n = 1").select("tree", "digest"))
    return out


def paths(tree: Tree, above: DataFrame | None = None) -> DataFrame:
    """The leaves of all trees with `path`, the digests before and after each node on the way up.

    above: (tree, path) from each tree's root on; without it paths end at the tree's root.
    """
    empty = F.array().cast(_PATH)
    known: DataFrame | None = None
    for k in range(len(tree.levels) - 1, -1, -1):
        level = tree.levels[k]
        top = level.where("n = 1")
        top = top.withColumn("path", empty) if above is None else top.join(above.select("tree", "path"), "tree")
        if known is None:
            known = top
            continue
        parents = known.select("tree", F.col("pos").alias("_parent"), F.col("members").alias("_beside"), F.col("path").alias("_up"))
        inner = level.where("n > 1").withColumn("_parent", F.floor(F.col("pos") / FANOUT)).join(parents.hint("merge"), ["tree", "_parent"])
        at = F.pmod("pos", F.lit(FANOUT)).cast("int")
        step = F.struct(F.array_join(F.slice("_beside", F.lit(1), at), "").alias("before"), F.array_join(F.slice("_beside", at + 2, F.lit(FANOUT)), "").alias("after"))
        known = top.unionByName(inner.withColumn("path", F.concat(F.array(step), F.col("_up"))).drop("_parent", "_beside", "_up"))
    return known


def folded(path: str, leaf: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.concat(s["before"], h, s["after"]).cast("binary"), 256))


def proof_digest(path: str) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), "").cast("binary"), 256)


def manifest(rows: DataFrame, *, tree_col: str = "lang", order: list[str], store: str | None = None) -> DataFrame:
    """rows (tree_col, digest and others) with subroot, root and path; the node store stays at `store`."""
    spark = rows.sparkSession
    store = store or fresh_path(spark, "merkle")
    # Null first, then by bytes: a mark before every other name.
    named = rows.withColumn("tree", F.when(F.col(tree_col).isNull(), F.lit("")).otherwise(F.concat(F.lit("+"), F.col(tree_col))))
    each = build(named, order, f"{store}/trees")
    subroots = roots(each).select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    over = build(subroots, ["name"], f"{store}/root")
    above = paths(over).select(F.col("name").alias("tree"), "path", F.col("digest").alias("subroot"))
    root = roots(over).first()
    above = materialize(above.withColumn("root", F.lit(root.digest if root else None).cast("string")), "above")
    return paths(each, above).join(above.select("tree", "subroot", "root"), "tree").drop("tree", "n", "pos")


def verified(docs: DataFrame, *, store: str | None = None) -> DataFrame:
    """Every document's leaf, roots and proof, and what its row gives against them after tampering."""
    low = F.translate("text", UPPER, LOWER)
    tampered = id_remainder("doc_id", 3) == 0
    cells = {c: F.col(c) for c in COLUMNS}
    rows = docs.select("doc_id", "lang", leaf_digest(**cells).alias("digest"), F.when(tampered, leaf_digest(**(cells | {"text": low}))).alias("changed"))
    proved = manifest(materialize(rows, "leaves"), order=["doc_id"], store=store)
    proved = proved.withColumn("folded_root", folded("path", F.coalesce("changed", "digest")))
    return proved.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", proof_digest("path").alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verified(spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS))
