"""What the operators of this subpackage share: shared storage, Arrow row functions, small expressions."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes of one Arrow batch sent to Python: bounds a worker's memory whatever the row count of a partition.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset a local master gets one of its own; a cluster may not."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            base = held.get()
        else:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            base = tempfile.mkdtemp(prefix="streetloom-")
            spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors, computes df once."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete what materialize() wrote, once nothing will read it again."""
    for df in frames:
        delete_path(df.sparkSession, df._stored_at)


def delete_path(spark: SparkSession, path: str) -> None:
    jvm, conf = spark._jvm, spark._jsc.sc().hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(conf).delete(p, True)


def bound_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def gathered(batches: Iterable[pa.RecordBatch], rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """Batches joined until they have so many rows or bytes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows or sum(b.nbytes for b in held) >= size:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """df without columns whose names (in any case) are those of columns about to be added."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def add_columns(df: DataFrame, fields: str, make: Callable[[Iterator[pa.RecordBatch]], Iterator[list[pa.Array]]]) -> DataFrame:
    """df with columns of the DDL `fields`, filled by `make` from batches of df; older columns of those names go."""
    spark = df.sparkSession
    bound_batches(spark)
    new = T._parse_datatype_string(fields)
    df = without(df, new.names)
    schema = T.StructType([*[T.StructField(f.name, f.dataType, True) for f in df.schema], *new.fields])

    def run(batches):
        held: list[pa.RecordBatch] = []

        def watched():
            for batch in batches:
                held.append(batch)
                yield batch

        for arrays in make(watched()):
            batch = held.pop(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*batch.schema.names, *new.names])

    return df.mapInArrow(run, schema)


def utf8(batch: pa.RecordBatch, column: str) -> list[bytes | None]:
    """The texts of a column as UTF-8 bytes."""
    return batch.column(column).cast(pa.binary()).to_pylist()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_remainder(column: str, modulus: int):
    """crc32(id as text) mod modulus; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def frequent(counts: DataFrame, column: str, most: int) -> list:
    """The values of (column, n) of count t or more, for the least t (a step of a fine logarithmic scale) that leaves at most `most`."""
    level = F.floor(F.log2("n") * 16).cast("int")
    steps = {r.level: r.n for r in counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()}
    least, held = None, 0
    for s in sorted(steps, reverse=True):
        if held + steps[s] > most:
            break
        least, held = s, held + steps[s]
    return [] if least is None else [r[0] for r in counts.where(level >= least).select(column).collect()]
