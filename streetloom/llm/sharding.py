"""Sharding by a consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations alone.

The ring has SLOTS places. Every shard stands at VIRTUAL places, found by hashing its number; a document's place is the
hash of its id, checksum and size. Documents enter in ring order and go to the next shard clockwise that is not full;
those that overflow a full shard continue clockwise. Shard s holds n // shards documents, and one more if s < n % shards,
so counts are at most one apart: the law `rows`.

Only counts by ring place reach the driver (SLOTS rows at most, whatever the input); they fix which ranks within a place
go to which shard and slot. Rows are then ranked within their place, in thousands of even groups, and joined with that
table of ranges.

Defined results: null texts have size 1 and the checksum of the empty text. Null and repeated ids are placed like
others; rows equal in every column are interchangeable. An empty table gives no rows.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize

SHARDS = 16
SLOTS = 8192
VIRTUAL = 64


def ring(shards: int, virtual: int = VIRTUAL, slots: int = SLOTS) -> list[tuple[int, int]]:
    """(place, shard) of every virtual node, clockwise."""
    return sorted((zlib.crc32(f"{s}/{v}".encode()) % slots, s) for s in range(shards) for v in range(virtual))


def allocate(counts: dict[int, int], shards: int, virtual: int = VIRTUAL, slots: int = SLOTS) -> list[dict]:
    """Ranges of ranks within each place, with their shard and its first slot."""
    nodes = ring(shards, virtual, slots)
    n = sum(counts.values())
    room = [n // shards + (s < n % shards) for s in range(shards)]
    held = [0] * shards
    out = []
    for place in sorted(counts):
        left, rank = counts[place], 0
        at = bisect_left(nodes, (place, -1))
        while left:
            s = nodes[at % len(nodes)][1]
            take = min(left, room[s] - held[s])
            if take:
                out.append({"place": place, "low": rank, "high": rank + take, "shard": s, "first": held[s]})
                held[s] += take
                rank += take
                left -= take
            at += 1
    return out


def small_table(spark: SparkSession, rows: list[dict], ddl: str) -> DataFrame:
    """A table from a JSON literal: stays inside the JVM."""
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{ddl}>>")).alias("r")).select("r.*")


def shard(docs: DataFrame, *, shards: int = SHARDS, text_col: str = "text", id_col: str = "doc_id", slots: int = SLOTS, virtual: int = VIRTUAL) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of docs."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    keyed = keyed.withColumn("hash", F.xxhash64("doc_id", "text_crc32", "size")).withColumn("place", F.pmod("hash", F.lit(slots)).cast("int"))
    keyed = materialize(keyed, "shard-keys")
    counts = {r.place: r.n for r in keyed.groupBy("place").agg(F.count(F.lit(1)).alias("n")).collect()}
    ranges = small_table(spark, allocate(counts, shards, virtual, slots), "place:int,low:long,high:long,shard:int,first:long")
    rank = F.row_number().over(Window.partitionBy("place").orderBy("hash", "doc_id", "text_crc32", "size")).cast("long") - 1
    placed = keyed.withColumn("rank", rank).join(F.broadcast(ranges), "place").where("rank >= low AND rank < high")
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("first") + F.col("rank") - F.col("low")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
