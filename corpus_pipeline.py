"""A corpus pipeline of four operators: quality classifier, near-dedup, decontamination, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet to the shared folder and
reads it back as the next stage's docs. Rows that a stage rejects are gone for the stages after it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streetloom.llm import bpe, decontaminate, neardup, quality
from streetloom.llm.common import documents, materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Similarity in percent from which the near-dup stage links; op6 has 85 by its contract.
NEAR = 80


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model).where("predicted = 1").select(*docs.columns)


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: of least id, and one only of rows that repeat an id. Rows without an id stay."""
    keyed = materialize(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    kept = neardup.near_duplicates(keyed, percent=NEAR, row_col="_row").where("kept")
    one = kept.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("_row").alias("_row")).select("_row")
    return keyed.join(one.union(kept.where("doc_id IS NULL").select("_row")), "_row", "left_semi").select(*docs.columns)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of the benchmark: any hit word, in a long text too, is a leak. Null and wordless texts stay."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("n_hit = 0").select(*docs.columns)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of the text decoded from them."""
    return bpe.round_trip(docs.select("doc_id", "text")).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [("quality", quality_stage), ("neardup", neardup_stage), ("decontaminate", decontaminate_stage), ("bpe", bpe_stage)]

#: The classifier's weights and the tokenizer are not SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(*[F.col(c) for c in COLUMNS])
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
