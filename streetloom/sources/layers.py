"""Urban layers on a 5 km square, derived from the star-schema tables by integer arithmetic.

Coordinates are planar metres. Each function returns one layer as a DataFrame with the columns the operators expect, so
real sources (parquet of parsed map data) can stand in for them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WIDE, HIGH = 4999, 4993
LON0, LAT0 = 103.8, 1.3
POI_CLASSES = ("civic", "commercial", "entertainment", "food", "healthcare", "institutional", "recreational", "social")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _dealt(df: DataFrame) -> DataFrame:
    """df over all cores: a small file is one partition, whatever is worked out from each of its rows."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)


def _place(key: Column, a: int, b: int) -> dict[str, Column]:
    return {"x": (key * a % WIDE).cast("double"), "y": (key * b % HIGH).cast("double")}


def zone_of(x: str = "x", y: str = "y") -> Column:
    """Zones are a 5 x 5 grid of squares of 1000 m."""
    return (F.floor(F.col(y) / 1000) * 5 + F.floor(F.col(x) / 1000)).cast("long")


def intersections(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("intersection_id"), F.col("c_acctbal").alias("value"))
    return c.withColumns(_place(F.col("intersection_id"), 7919, 6007))


def streets(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "customer").count()
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("street_id"), F.col("o_custkey").cast("long").alias("u"))
    return o.withColumn("v", (F.col("u") + 1 + F.col("street_id") % 7) % n)


def lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A thin network over all orders: chains of up to eight lanes, each ended by a branch."""
    k = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("street_id"))
    u = F.col("street_id")
    return k.withColumns({"u": u, "v": F.when(u % 9 == 0, F.floor(u / 2)).otherwise(u + 1), "length": 10.0 + u % 13})


def located_streets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streets with the coordinates of both ends and their length."""
    nodes = intersections(spark, sf_dir)
    u = nodes.select(F.col("intersection_id").alias("u"), F.col("x").alias("ux"), F.col("y").alias("uy"))
    v = nodes.select(F.col("intersection_id").alias("v"), F.col("x").alias("vx"), F.col("y").alias("vy"))
    return streets(spark, sf_dir).join(u.hint("merge"), "u").join(v.hint("merge"), "v").withColumn("length", F.hypot(F.col("ux") - F.col("vx"), F.col("uy") - F.col("vy")))


def buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("bid"), F.col("p_size").cast("long").alias("size"), "p_brand", "p_retailprice")
    p = _dealt(p)
    p = p.withColumns(_place(F.col("bid"), 4649, 3571)).withColumns({"width": (F.col("size") + 5).cast("double"), "depth": (F.col("bid") % 23 + 5).cast("double")})
    return p.withColumns({"area": F.col("width") * F.col("depth"), "perimeter": 2 * (F.col("width") + F.col("depth"))})


def building_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buildings as closed rings: rectangles for even ids, L shapes for odd ones."""
    b = buildings(spark, sf_dir)
    at = lambda dx, dy: F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))
    w, d, o = F.col("width"), F.col("depth"), F.lit(0.0)
    rectangle = F.array(at(o, o), at(w, o), at(w, d), at(o, d), at(o, o))
    ell = F.array(at(o, o), at(w, o), at(w, d / 2), at(w / 2, d / 2), at(w / 2, d), at(o, d), at(o, o))
    return b.withColumn("ring", F.when(F.col("bid") % 2 == 0, rectangle).otherwise(ell))


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("zone_id"), F.col("n_name").alias("zone_name"), F.col("n_regionkey").cast("long").alias("region_id"))


def pois(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_id").cast("long").alias("poi_id"), "event_type", "value", "props", F.col("ts").cast("timestamp").alias("ts"), "user_id")
    named = F.get(F.lit(list(POI_CLASSES)), (F.col("poi_id") * 5 + F.floor(F.col("value"))).cast("long") % 8)
    return e.withColumns(_place(F.col("poi_id"), 7919, 6007)).withColumn("poi_class", named)


def population(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of 100 m: row, col, value."""
    cell = ((F.col("l_orderkey") * 4 + F.col("l_linenumber")) % 2500).cast("long")
    p = table(spark, sf_dir, "lineitem").select(cell.alias("cell"), F.col("l_quantity").cast("double").alias("value"))
    return p.withColumns({"row": F.floor(F.col("cell") / 50).cast("long"), "col": F.col("cell") % 50})


def raster(spark: SparkSession, year: int, height: int = 50, width: int = 50) -> DataFrame:
    """Cells of a raster of built-up values, row-major."""
    r = spark.range(height * width).select(F.floor(F.col("id") / width).cast("long").alias("row"), (F.col("id") % width).alias("col"))
    return r.withColumn("value", ((F.col("row") * 31 + F.col("col") * 17 + year) % 997).cast("double"))
