"""Cleaning, filling and encoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def id_suffix(df: DataFrame, key: str, order: str) -> DataFrame:
    """Repeated ids get _0, _1, ... in the order given; single ones stay."""
    same = Window.partitionBy(key)
    n, k = F.count(F.lit(1)).over(same), F.row_number().over(same.orderBy(order)) - 1
    return df.withColumn(key, F.when(n > 1, F.concat_ws("_", F.col(key).cast("string"), k.cast("string"))).otherwise(F.col(key).cast("string")))


def line_dedup(df: DataFrame, order: str, ends: tuple[str, str] | None = None, line: str = "line") -> DataFrame:
    """The first of the lines with the same vertices, in either direction; or, where `ends` are named, with the same ends."""
    if ends:
        same = F.least(*ends), F.greatest(*ends)
    else:
        same = (F.least(F.col(line), F.reverse(line)),)
    first = Window.partitionBy(*same).orderBy(order)
    return df.withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k")


def relabel_and_trim(df: DataFrame, column: str, names: dict[str, str], least: int) -> DataFrame:
    """Classes renamed by the table, then those with more than `least` rows kept."""
    new = F.coalesce(F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col(column)], F.col(column)) if names else F.col(column)
    df = df.withColumn(column, new)
    kept = df.groupBy(column).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > least).select(column)
    return df.join(kept, column, "left_semi")


def fill_mean(df: DataFrame, columns: list[str], source: DataFrame | None = None) -> DataFrame:
    """Nulls become the column's mean, that of `source` where one is given: one row of means is broadcast."""
    means = (df if source is None else source).agg(*[F.avg(c).alias(f"_m_{c}") for c in columns])
    return df.crossJoin(F.broadcast(means)).withColumns({c: F.coalesce(c, f"_m_{c}") for c in columns}).drop(*[f"_m_{c}" for c in columns])


def fill_by_group(df: DataFrame, column: str, groups: list[str], last: Column | None = None) -> DataFrame:
    """Own value, else the mean of the first group that has one, group by group, else `last`."""
    value = F.col(column)
    if not groups:
        return df if last is None else df.withColumn(column, F.coalesce(value, last))
    for k, g in enumerate(groups):
        means = df.groupBy(g).agg(F.avg(column).alias(f"_g{k}"))
        df = df.join(means, g, "left")
        value = F.coalesce(value, F.col(f"_g{k}"))
    return df.withColumn(column, value if last is None else F.coalesce(value, last)).drop(*[f"_g{k}" for k in range(len(groups))])


def standardise(df: DataFrame, columns: list[str]) -> DataFrame:
    """Z-scores with the population deviation; a deviation of 0 counts as 1."""
    stats = df.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    scale = lambda c: F.when(F.col(f"_s_{c}") == 0, 1.0).otherwise(F.col(f"_s_{c}"))
    return df.crossJoin(F.broadcast(stats)).withColumns({c: (F.col(c) - F.col(f"_m_{c}")) / scale(c) for c in columns}).drop(*[f"_{n}_{c}" for c in columns for n in "ms"])


def one_hot(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    return df.withColumns({f"{column}_{v}": (F.col(column) == v).cast("long") for v in values}).drop(column)


def numbered(df: DataFrame, key: str, name: str, bucket: Column | None = None, order: Column | None = None) -> DataFrame:
    """df with `name`: 0, 1, ... in the order given (the integer key's by default), without one task for all rows.

    Rows are counted by a bucket that grows with the order; the few buckets' offsets are summed and joined back.
    """
    bucket = F.shiftright(F.col(key).cast("long"), 16) if bucket is None else bucket
    order = F.col(key) if order is None else order
    held = df.withColumn("_b", bucket)
    sums = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = held.groupBy("_b").agg(F.count(F.lit(1)).alias("_n")).select("_b", F.coalesce(F.sum("_n").over(sums), F.lit(0)).alias("_o"))
    rank = F.row_number().over(Window.partitionBy("_b").orderBy(order, key))
    return held.join(before, held["_b"].eqNullSafe(before["_b"])).drop(before["_b"]).withColumn(name, (F.col("_o") + rank - 1).cast("long")).drop("_b", "_o")


def split_masks(df: DataFrame, key: str, train: float, val: float, seed: int) -> DataFrame:
    """train, val and test masks by the order of a digest of id and seed; the cut points are those of the shares."""
    n = df.count()
    digest = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))).cast("binary"))
    ranked = numbered(df, key, "_r", F.substring(digest, 1, 3), digest)
    a, b = int(n * train), int(n * train) + int(n * val)
    return ranked.withColumns({"train": F.col("_r") < a, "val": (F.col("_r") >= a) & (F.col("_r") < b), "test": F.col("_r") >= b}).drop("_r")


def ranked_mode(df: DataFrame, group: list[str], column: str, skip: tuple[str, ...] = ()) -> DataFrame:
    """The most frequent value of each group but those to skip, ties to the least; a group of such values alone has no row."""
    if skip:
        df = df.where(F.col(column).isNull() | ~F.col(column).isin(*skip))
    counts = df.groupBy(*group, column).agg(F.count(F.lit(1)).alias("_n"))
    return counts.withColumn("_k", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("_n"), column))).where("_k = 1").drop("_k", "_n")


def class_counts(df: DataFrame, group: str, column: str, values: list[str]) -> DataFrame:
    """A count for each class of a fixed list, 0 where there is none."""
    return df.groupBy(group).pivot(column, list(values)).count().na.fill(0)


def class_marks(column: str, values: list[str]) -> dict[str, Column]:
    """A column for each class of a fixed list: 1 where a row has it, else 0."""
    return {v: F.coalesce((F.col(column) == v).cast("long"), F.lit(0)) for v in values}


def top_classes(df: DataFrame, group: str, column: str, k: int, least: float) -> DataFrame:
    """(group, class, percent) of each group's k most frequent classes of at least `least` percent, ties to the least class."""
    counts = df.groupBy(group, column).agg(F.count(F.lit(1)).alias("_n"))
    share = counts.withColumn("percent", 100.0 * F.col("_n") / F.sum("_n").over(Window.partitionBy(group)))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("_n"), column))
    return share.withColumn("_k", rank).where((F.col("_k") <= k) & (F.col("percent") >= least)).drop("_k", "_n")


def poi_class(food: set[str]) -> Column:
    """A point's class from its tags: amenity as it is, then tourism, leisure, shops that sell food, and commercial for the rest."""
    return F.when(F.col("amenity").isNotNull(), F.col("amenity")).when(F.col("tourism").isNotNull(), "entertainment").when(F.col("leisure").isNotNull(), "recreational").when(F.col("shop").isin(sorted(food)), "shop").otherwise("commercial")


def has_word(column: Column, word: str) -> Column:
    """1 where the text has the word, whatever its case, else 0; null counts as without."""
    return F.coalesce(column.rlike(rf"(?i)\b{word}\b"), F.lit(False)).cast("int")


def prefixed(df: DataFrame, prefix: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """df with a prefix before every column's name but those to keep."""
    return df.select(*[F.col(f"`{c}`").alias(c if c in keep else prefix + c) for c in df.columns])


def by_position(df: DataFrame, places: list[int]) -> DataFrame:
    return df.select(*[F.col(f"`{df.columns[k]}`") for k in places])


def side_by_side(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Rows of two tables joined by their place in the order of their keys; the longer one's last rows have nulls."""
    a, b = numbered(left, left_key, "_at"), numbered(right, right_key, "_at")
    return a.join(b, "_at", "full").drop("_at")


def sample_by(df: DataFrame, group: str, key: str, most: str, seed: int) -> DataFrame:
    """A random sample of each group, of as many rows as its column `most` says; the draw is an order of digests of key and seed."""
    digest = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))).cast("binary"))
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(group).orderBy(digest, key))).where(F.col("_k") <= F.col(most)).drop("_k")


def segment_shares(segments: DataFrame, image: str, label: str, pixels: str, labels: list[str]) -> DataFrame:
    """(image, a share and a <label>_count for each label, visual_complexity): pixels by class, segments by class, entropy in nats."""
    per = segments.groupBy(image, label).agg(F.sum(pixels).alias("_p"), F.count(F.lit(1)).alias("_n"))
    total = per.groupBy(image).agg(F.sum("_p").alias("_t"))
    share = per.join(total, image).withColumn("_s", F.col("_p") / F.col("_t"))
    of = lambda c, name: F.coalesce(F.sum(F.when(F.col(label) == name, F.col(c))), F.lit(0))
    return share.groupBy(image).agg(*[of("_s", x).alias(x) for x in labels], *[of("_n", x).cast("long").alias(f"{x}_count") for x in labels], (-F.sum(F.col("_s") * F.log("_s"))).alias("visual_complexity"))


def local_time(column: Column, zone: str) -> Column:
    """Minutes since midnight, in a time zone, of a time in milliseconds since 1970."""
    at = F.from_utc_timestamp(F.timestamp_millis(column), zone)
    return F.hour(at) * 60 + F.minute(at)


def flipped(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    return edges.withColumnsRenamed({u: "_f", v: u}).withColumnRenamed("_f", v)


def to_wkb(df: DataFrame, ring: str, name: str) -> DataFrame:
    """df with polygons of one ring as well-known binary."""
    import pyarrow as pa

    from ..functions import kernels as K

    schema = df.withColumn(name, F.lit(None).cast("binary")).schema

    def run(batches):
        for batch in batches:
            made = [K.make_wkb([[(p["x"], p["y"]) for p in r]]) if r is not None else None for r in batch.column(ring).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())], names=[*batch.schema.names, name])

    return df.mapInArrow(run, schema)


def from_wkb(df: DataFrame, column: str) -> DataFrame:
    """df with `gtype` and `parts` (parts of rings of points) of a column of well-known binary; null where it is null."""
    import pyarrow as pa
    from pyspark.sql import types as T

    from ..functions import kernels as K

    new = T._parse_datatype_string("gtype string, parts array<array<array<struct<x:double,y:double>>>>")
    schema = T.StructType([*df.schema.fields, *new.fields])
    kind = pa.list_(pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))))

    def run(batches):
        for batch in batches:
            got = [K.parse_wkb(bytes(x)) if x is not None else (None, None) for x in batch.column(column).to_pylist()]
            parts = [p and [[[{"x": x, "y": y} for x, y in ring] for ring in part] for part in p] for _, p in got]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([k for k, _ in got], pa.string()), pa.array(parts, kind)], names=[*batch.schema.names, "gtype", "parts"])

    return df.mapInArrow(run, schema)
