"""MinHash near-dedup: universal hash minima, banding, signature verification, full-set check, star components.

A text's set is its distinct runs of five words (a text of fewer words is one run). Texts with equal sets are one class,
so exact copies cost one row each and are never paired. A class's signature is its least value under BANDS * ROWS
universal hash functions; some minima together give a band's key: the most, up to ROWS, at which two sets at the
threshold share no band with a probability below MISSED. At 0.85 that is 32 bands of 7 (4e-6), at 0.80 37 of 6 (1e-5).

Candidates never come from all pairs of a large bucket. First every class is paired with its bucket's leader, the class
that shares most buckets overall (in a family of copies that is the text they were made from). Links that hold are
merged into components. Only buckets whose classes are still in different components are looked at further. In those of
at most BLOCK classes, all pairs across components are compared. The classes of larger ones go to an exact prefix join:
runs are ordered by how few of these classes have them, and two sets at the threshold must share one of their first
n - ceil(t n) + 1 runs (t the threshold), at places that leave enough runs to share. So every pair of a bucket is compared, connected
already, or known to be below the threshold.

A pair is compared by the share of equal minima first (pairs more than five standard deviations below the threshold
go), then by the whole sets: linked if 100 * intersection >= percent * union (85 unless told otherwise).

Defined results: null texts and texts without words have 0 runs and are linked with nothing. Rows with a null id take no
part in linking: their component is null and they are kept. Rows that share an id share a component. Repeated rows get
equal results. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import add_columns, discard, materialize, utf8
from .components import components

WIDTH = 5
BANDS, ROWS = 32, 7
PERCENT, MISSED = 85, 2e-5
BLOCK = 32
_U = np.uint64
_P = _U(0x9E3779B97F4A7C15)
_SEED = np.random.default_rng(20)
_TAPS = _SEED.integers(0, 1 << 63, WIDTH, dtype=np.uint64) * _U(2) + _U(1)
_A = (_SEED.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * _U(2) + _U(1))[:, None]
_B = _SEED.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)[:, None] * _U(2)
_BAND_TAPS = _SEED.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * _U(2) + _U(1)
_BLANKS = bytes(32 if b == 32 or 9 <= b <= 13 else b + 32 if 65 <= b <= 90 else b for b in range(256))


def least_agree(percent: int) -> float:
    """Share of equal minima below which a pair is not looked at: the threshold less five standard deviations of 224 minima."""
    t = percent / 100
    return t - 5 * (t * (1 - t) / (BANDS * ROWS)) ** 0.5


def band_rows(percent: int) -> int:
    return next((k for k in range(ROWS, 1, -1) if (1 - (percent / 100) ** k) ** (BANDS * ROWS // k) <= MISSED), 1)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def word_hashes(text: bytes | None) -> np.ndarray:
    """A 64-bit hash of each word; A-Z count as a-z."""
    if not text:
        return np.zeros(0, np.uint64)
    flat = np.frombuffer(text.translate(_BLANKS), np.uint8)
    inside = flat != 32
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = ends - starts
    place = np.arange(len(flat)) - np.repeat(starts, np.diff(np.append(starts, len(flat))))[: len(flat)] if starts[0] == 0 else None
    if place is None:
        lead = starts[0]
        flat, inside, starts = flat[lead:], inside[lead:], starts - lead
        place = np.arange(len(flat)) - np.repeat(starts, np.diff(np.append(starts, len(flat))))
    powers = np.cumprod(np.full(int(sizes.max()), _P))
    value = (flat.astype(np.uint64) + _U(1)) * powers[np.minimum(place, len(powers) - 1)] * inside
    return mixed(np.add.reduceat(value, starts) + sizes.astype(np.uint64))


def runs(text: bytes | None) -> np.ndarray:
    """The set of a text: sorted distinct hashes of its runs of WIDTH words."""
    w = word_hashes(text)
    if not len(w):
        return w
    n = min(WIDTH, len(w))
    h = np.full(len(w) - n + 1, _U(n))
    for k in range(n):
        h = h + w[k : k + len(h)] * _TAPS[k]
    return np.unique(mixed(h))


def minima(s: np.ndarray) -> np.ndarray:
    """Least values of the set under every hash function (a * x + b mod 2^64; the high half counts)."""
    least = np.full(BANDS * ROWS, ~_U(0))
    for at in range(0, len(s), 4096):
        least = np.minimum(least, (_A * s[None, at : at + 4096] + _B).min(axis=1))
    return least >> _U(32)


def band_keys(least: np.ndarray, rows: int = ROWS) -> np.ndarray:
    n = len(least) // rows
    taken = (mixed(least[: n * rows]) * _BAND_TAPS[: n * rows]).reshape(n, rows)
    return mixed(taken.sum(axis=1, dtype=np.uint64) + np.arange(n, dtype=np.uint64)).view(np.int64)


def signed(docs: DataFrame, text_col: str, rows: int = ROWS) -> DataFrame:
    """docs with n_shingles, class (a digest of the set) and bands (keys); null without words."""

    def make(batches):
        for batch in batches:
            n, digest, bands = [], [], []
            for text in utf8(batch, text_col):
                s = runs(text)
                n.append(len(s))
                if len(s):
                    digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    bands.append(band_keys(minima(s), rows))
                else:
                    digest.append(None), bands.append(None)
            yield [pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]

    return add_columns(docs, "n_shingles long, class binary, bands array<long>", make).drop(text_col)


def with_sets(docs: DataFrame) -> DataFrame:
    """(id, n, sig, set) of docs (id, text)."""

    def make(batches):
        for batch in batches:
            sets = [runs(t) for t in utf8(batch, "text")]
            yield [pa.array([len(s) for s in sets], pa.int64()), pa.array([minima(s).astype(np.uint16).tobytes() for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())]

    return add_columns(docs, "n long, sig binary, set binary", make).drop("text")


def with_tokens(sets: DataFrame) -> DataFrame:
    """sets with its hashes as a list."""

    def make(batches):
        for batch in batches:
            yield [pa.array([np.frombuffer(s, np.int64) for s in batch.column("set").to_pylist()], pa.list_(pa.int64()))]

    return add_columns(sets, "tokens array<long>", make).drop("set")


def prefix_pairs(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b) of classes (id, n, component, set) of different components that may reach the threshold: none is left out."""
    tokens = with_tokens(sets).select("id", "n", "component", F.explode("tokens").alias("token"))
    common = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("df", "token"))
    first = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    ranked = tokens.join(common, "token").withColumn("at", place).where((F.col("at") <= first) & (F.col("df") > 1)).drop("df")
    one = ranked.select("token", *[F.col(c).alias(f"{c}_") for c in ("id", "n", "component", "at")])
    need = percent * (F.col("n") + F.col("n_"))
    room = F.least(F.col("n") - F.col("at"), F.col("n_") - F.col("at_")) + 1
    met = ranked.join(one, "token").where((F.col("id") < F.col("id_")) & (F.col("component") != F.col("component_")) & (room * (100 + percent) >= need))
    return met.select(F.col("id").alias("a"), F.col("id_").alias("b"))


def _keep(pairs: DataFrame, test) -> DataFrame:
    """(a, b) of the rows of (a, b, x, y) that pass the test of x and y."""

    def run(batches):
        for batch in batches:
            x, y = batch.column("x").to_pylist(), batch.column("y").to_pylist()
            good = pa.array([test(p, q) for p, q in zip(x, y, strict=True)], pa.bool_())
            yield batch.select(["a", "b"]).filter(good)

    return pairs.mapInArrow(run, "a long, b long")


def _agree(x: bytes, y: bytes, percent: int = PERCENT) -> bool:
    return (np.frombuffer(x, np.uint16) == np.frombuffer(y, np.uint16)).mean() >= least_agree(percent)


def linked(x: bytes, y: bytes, percent: int = PERCENT) -> bool:
    p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    if 100 * min(len(p), len(q)) < percent * max(len(p), len(q)):
        return False
    both = len(p) + len(q) - len(np.unique(np.concatenate([p, q])))
    return 100 * both >= percent * (len(p) + len(q) - both)


def _beside(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
    left = table.select(F.col("id").alias("a"), F.col(column).alias("x"))
    right = table.select(F.col("id").alias("b"), F.col(column).alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(u, v) of the pairs (a, b) that pass the signature's test, then the whole sets'."""
    likely = _keep(_beside(pairs, sets, "sig"), partial(_agree, percent=percent))
    return materialize(_keep(_beside(likely, sets, "set"), partial(linked, percent=percent)).select(F.col("a").alias("u"), F.col("b").alias("v")), "links")


def _ordered(a, b):
    return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")


def near_duplicates(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", percent: int = PERCENT, row_col: str | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of docs; with its row_col, where one is named."""
    row = [row_col] if row_col else []
    all_docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *row)
    docs = all_docs.select("doc_id", "text")
    marked = materialize(signed(all_docs, "text", band_rows(percent)), "signed")
    classes = marked.where("class IS NOT NULL AND doc_id IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("id"), F.min_by("bands", "doc_id").alias("bands"))
    classes = materialize(classes, "classes")

    # Buckets of two classes or more.
    rows = classes.select("id", F.explode("bands").alias("key"))
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    buckets = materialize(rows.join(sizes, "key"), "buckets")
    shared = buckets.groupBy("id").agg(F.sum("n").alias("shared"))
    leaders = buckets.join(shared, "id").groupBy("key").agg(F.max_by("id", F.struct("shared", -F.col("id"))).alias("leader"))
    pairs = buckets.join(leaders, "key").where("id <> leader").select(*_ordered(F.col("id"), F.col("leader"))).distinct()

    labels = None
    if not buckets.isEmpty():
        ids = buckets.select("id").distinct()
        # Told to shuffle, so that texts move the same way at every size.
        sets = materialize(with_sets(docs.withColumnRenamed("doc_id", "id").join(ids.hint("merge"), "id", "left_semi")), "sets")
        links = _confirmed(pairs, sets, percent)
        labels = materialize(components(links), "labels")
        # Buckets whose classes are in several components yet.
        named = buckets.join(labels, F.col("id") == F.col("node"), "left").select("key", "n", "id", F.coalesce("component", "id").alias("component"))
        apart = named.groupBy("key").agg(F.min("component").alias("l"), F.max("component").alias("h")).where("l <> h").select("key")
        left = materialize(named.join(apart, "key"), "open")
        small = left.where(F.col("n") <= BLOCK)
        other = small.select("key", F.col("id").alias("id_"), F.col("component").alias("component_"))
        more = small.join(other, "key").where("id < id_ AND component <> component_").select(F.col("id").alias("a"), F.col("id_").alias("b"))
        large = left.where(F.col("n") > BLOCK).select("id", "component").distinct()
        more = _confirmed(more.union(prefix_pairs(sets.select("id", "n", "set").join(large, "id"), percent)).distinct(), sets, percent)
        if not more.isEmpty():
            labels = materialize(components(labels.select(F.col("node").alias("u"), F.col("component").alias("v")).union(more)), "labels")
        discard(buckets, sets, left)
    out = marked.select("doc_id", "n_shingles", "class", *row).join(classes.select("class", "id"), "class", "left")
    if labels is not None:
        out = out.join(labels, F.col("id") == F.col("node"), "left").withColumn("component_id", F.coalesce("component", "id", "doc_id"))
    else:
        out = out.withColumn("component_id", F.coalesce("id", "doc_id"))
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), *row)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
