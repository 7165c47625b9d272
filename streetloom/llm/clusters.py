"""Centroid clustering with weighted deduplication: Lloyd rounds over distinct quantised vectors.

A vector's components x become the integers floor(1024 * x). Equal integer vectors are one row with a multiplicity (a
partial aggregate, so a vector that many rows hold is met once a task). Every round broadcasts the k centroids, assigns
each distinct vector to the nearest in numpy, and sums its components times its multiplicity in integers; tasks send k
rows each, Spark adds them up, and k rows reach the driver. The last assignment is joined back to the ids by the vector.
The vectors that hold the most rows, at most HOT of them, meet their rows by a broadcast, so no key of the shuffled join
has more than a HOT-th of all rows.

All arithmetic is exact: components are held to +-2^27 (x of 131072; larger ones count as that), so a squared distance
of 64 components fits 64 bits, and sums are decimals outside a task (inertia beyond 2^63 - 1 counts as that).

Defined results: vectors that are null, have another length, or a null or non-finite component are left out. A null id
counts as the empty text where the first centroids are picked; ids that repeat are rows of their own, in the order of
the hash, then of the vector. With fewer rows than clusters, each row starts one. Ties go to the smaller number, a
centroid that nothing is assigned to stays, equal centroids leave all to the smaller one. Extra columns count for
nothing. An empty table, or one with no such vector, gives no rows.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, discard, materialize

WIDTH, SCALE, BOUND = 64, 1024, 1 << 27
CLUSTERS, ROUNDS, SEED = 8, 10, 3
HOT = 1000
#: Vectors times clusters compared at once in numpy.
BLOCK = 1 << 12


def quantised(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", width: int = WIDTH) -> DataFrame:
    """(id, q) of the vectors that count."""
    good = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.where((F.size(vector_col) == width) & good)
    bound = F.lit(float(BOUND))
    return rows.select(F.col(id_col).alias("id"), F.transform(vector_col, lambda x: F.floor(F.greatest(-bound, F.least(bound, x.cast("double") * SCALE))).cast("int")).alias("q"))


def first_centroids(rows: DataFrame, clusters: int, seed: int) -> np.ndarray:
    """The vectors whose ids hash lowest, in that order: `clusters` rows reach the driver."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    return np.array([r.q for r in rows.select("q", key.alias("key")).orderBy("key", "q").limit(clusters).collect()], np.int64)


def _vectors(batch: pa.RecordBatch) -> np.ndarray:
    q = batch.column("q")
    return q.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, -1)


def nearest(q: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of each vector's nearest centroid (the smaller one at a tie) and the squared distance."""
    cluster, distance = np.empty(len(q), np.int64), np.empty(len(q), np.int64)
    step = max(1, BLOCK // len(centroids))
    for at in range(0, len(q), step):
        gap = q[at : at + step, None, :] - centroids[None]
        square = (gap * gap).sum(axis=2)
        cluster[at : at + step] = square.argmin(axis=1)
        distance[at : at + step] = square.min(axis=1)
    return cluster, distance


def weighted_sums(distinct: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Rows and component sums of each cluster that has any."""
    k, width = centroids.shape

    def run(batches):
        count, total = [0] * k, [[0] * width for _ in range(k)]
        for batch in batches:
            q, w = _vectors(batch), batch.column("w").to_numpy(zero_copy_only=False)
            if not len(q):
                continue
            cluster, _ = nearest(q, centroids)
            for c in np.unique(cluster):
                here = cluster == c
                # Halves of the weights keep the products of a batch within 64 bits.
                high, low = w[here] >> 24, w[here] & ((1 << 24) - 1)
                count[c] += int(w[here].sum())
                sums = zip((q[here] * high[:, None]).sum(axis=0).tolist(), (q[here] * low[:, None]).sum(axis=0).tolist(), strict=True)
                total[c] = [t + (h << 24) + x for t, (h, x) in zip(total[c], sums, strict=True)]
        used = [c for c in range(k) if count[c]]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([str(count[c]) for c in used], pa.string()), pa.array([[str(x) for x in total[c]] for c in used], pa.list_(pa.string()))], names=["cluster", "w", "s"])

    number = "decimal(38,0)"
    parts = distinct.mapInArrow(run, "cluster int, w string, s array<string>")
    out = parts.groupBy("cluster").agg(F.sum(F.col("w").cast(number)).alias("w"), *[F.sum(F.get("s", F.lit(i)).cast(number)).alias(f"s{i}") for i in range(width)])
    return {r.cluster: (int(r.w), [int(r[f"s{i}"]) for i in range(width)]) for r in out.collect()}  # `clusters` rows


def moved(centroids: np.ndarray, sums: dict[int, tuple[int, list[int]]]) -> np.ndarray:
    """Every centroid with rows at the floor of their mean."""
    return np.array([[x // sums[c][0] for x in sums[c][1]] if c in sums else row.tolist() for c, row in enumerate(centroids)], np.int64)


def assigned(distinct: DataFrame, centroids: np.ndarray) -> DataFrame:
    """distinct (q, w) with cluster and distance."""

    def run(batches):
        for batch in batches:
            cluster, distance = nearest(_vectors(batch), centroids)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cluster.astype(np.int32)), pa.array(distance)], names=["q", "w", "cluster", "distance"])

    return distinct.mapInArrow(run, "q array<int>, w long, cluster int, distance long")


@dataclass
class Clustering:
    """members: (id, cluster, distance) of every vector; centroids; inertia: of each cluster that has vectors."""

    members: DataFrame
    centroids: np.ndarray
    inertia: dict[int, int]


def cluster(vectors: DataFrame, *, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, width: int = WIDTH, id_col: str = "vec_id", vector_col: str = "embedding") -> Clustering | None:
    """None where no vector counts."""
    bound_batches(vectors.sparkSession)
    rows = materialize(quantised(vectors, id_col=id_col, vector_col=vector_col, width=width), "quantised")
    centroids = first_centroids(rows, clusters, seed)
    if not len(centroids):
        return None
    distinct = materialize(rows.groupBy("q").agg(F.count(F.lit(1)).alias("w")), "distinct")
    for _ in range(rounds):
        now = moved(centroids, weighted_sums(distinct, centroids))
        if (now == centroids).all():
            break  # further rounds would repeat this one
        centroids = now
    last = materialize(assigned(distinct, centroids), "assigned")
    discard(distinct)
    inertia = {r.cluster: int(r.i) for r in last.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)") * F.col("w")).alias("i")).collect()}
    total = last.agg(F.sum("w")).first()[0]
    # At most HOT vectors hold so many rows.
    hot, rest = last.where(F.col("w") * HOT > total).drop("w"), last.where(F.col("w") * HOT <= total).drop("w")
    often, seldom = rows.join(F.broadcast(hot), "q"), rows.join(F.broadcast(hot.select("q")), "q", "left_anti").join(rest, "q")
    return Clustering(often.union(seldom).select("id", "cluster", "distance"), centroids, inertia)


def centroid_digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    out = cluster(vectors)
    if out is None:
        return vectors.limit(0).selectExpr("vec_id", "0 AS cluster", "0L AS distance", "0L AS cluster_inertia", "0L AS inertia", "'' AS centroid_sha256")
    named = lambda values: F.get(F.lit(values), F.col("cluster"))
    most = (1 << 63) - 1
    own = [out.inertia.get(c, 0) for c in range(len(out.centroids))]
    return out.members.select(
        F.col("id").alias("vec_id"), "cluster", "distance", named([min(x, most) for x in own]).cast("long").alias("cluster_inertia"),
        F.lit(min(sum(own), most)).cast("long").alias("inertia"), named([centroid_digest(c) for c in out.centroids]).alias("centroid_sha256"),
    )
