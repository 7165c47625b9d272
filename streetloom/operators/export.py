"""Export of a heterogeneous graph for training: feature arrays in id order, dense node numbers, edge tables, masks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import clean
from .hetero import UrbanGraph

_NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def features(nodes: DataFrame, key: str, plain: tuple[str, ...] = (), ids: tuple[str, ...] = ()) -> DataFrame:
    """(ix, key, features): numeric columns but ids as one array of floats, standardised unless Boolean or named in `plain`.

    Nulls become the column's mean before; `ix` numbers nodes from 0 in key order.
    """
    numeric = [c for c, t in nodes.dtypes if t in _NUMERIC and c != key and c not in ids]
    flags = [c for c, t in nodes.dtypes if t == "boolean"]
    scaled = [c for c in numeric if c not in plain]
    kept = nodes.select(key, *[F.col(c).cast("double").alias(c) for c in numeric], *[F.col(c).cast("double").alias(c) for c in flags])
    filled = clean.standardise(clean.fill_mean(kept, numeric), scaled) if scaled else kept.na.fill(0.0)
    vector = F.array(*[F.coalesce(F.col(c), F.lit(0.0)).cast("float") for c in numeric + flags]) if numeric or flags else F.array().cast("array<float>")
    return clean.numbered(filled.withColumn("features", vector), key, "ix").select("ix", key, "features")


def edges(relation: DataFrame, source: DataFrame, target: DataFrame, key: str, other: str) -> DataFrame:
    """(src, dst) of a relation by dense numbers; ends without a node are dropped."""
    a = source.select(F.col(key).alias("src"), F.col("ix").alias("a"))
    b = target.select(F.col(other).alias("dst"), F.col("ix").alias("b"))
    return relation.select("src", "dst").join(a, "src").join(b, "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"))


def write(graph: UrbanGraph, keys: dict[str, str], ends: dict[str, tuple[str, str]], path: str) -> None:
    """Write features of every node type and edges of every relation; `ends` names a relation's node types."""
    spark, made = next(iter(graph.nodes.values())).sparkSession, {}
    for name, df in graph.nodes.items():
        features(df, keys[name]).write.mode("overwrite").parquet(f"{path}/features/{name}")
        made[name] = spark.read.parquet(f"{path}/features/{name}")
    for name, df in graph.edges.items():
        a, b = ends[name]
        edges(df, made[a], made[b], keys[a], keys[b]).write.mode("overwrite").parquet(f"{path}/edges/relation={name}")
