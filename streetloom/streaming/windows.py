"""Structured Streaming forms of the observation queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def windowed(stream: DataFrame, group: Column, name: str, length: str, late: str = "1 day") -> DataFrame:
    """Count and mean of `value` by event-time window and group, with late rows up to `late`."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", length), group.alias(name)).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))


def distinct_events(stream: DataFrame, key: str, late: str = "1 day") -> DataFrame:
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def finished(df: DataFrame, path: str, mode: str = "complete") -> DataFrame:
    """Run a stream over all that is there now and return its result, written as Parquet below path.

    Each batch has its own folder, overwritten if the batch is run again. With mode `complete` the last one is the result,
    otherwise all of them together.
    """
    schema, last = df.schema, []

    def write(batch, number):
        batch.write.mode("overwrite").parquet(f"{path}/result/batch={number}")
        last.append(number)

    df.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    spark = df.sparkSession
    if not last:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/result/batch={max(last)}" if mode == "complete" else f"{path}/result")
