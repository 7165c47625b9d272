"""Document fingerprints: one-permutation MinHash with optimal densification, in DataFrame functions alone.

A text's lower-cased words give runs of five (a shorter text is one run); every run is hashed once. The top bits of a
hash name its bin, and a bin keeps the least hash that falls into it. An empty bin takes the value of another, found by
probing bins in an order of the bin's own that reaches every bin once. BITS low-order bits of each bin's value are kept,
written as one hex digit; two values also agree by chance, and likeness corrects for that.

All of it is one projection of a row: hashes and one marker for each bin (above all hashes of the bin) are sorted, and
the first entry of each bin is its least hash, or the marker of an empty bin.

The next document by id is found without one global sort: ids are cut at percentiles into ranges, ranges into even
pieces (an id of very many rows by a hash of their texts), the first document of each piece is also sent to the piece
before it (the very first one to the last), and each piece is sorted on its own. Pieces are small and dealt over
partitions of PART_BYTES of text, so a task does not grow with the input.

Defined results: null and empty texts, and texts without words, have the fingerprint of 256 zeros written as dashes; two of them
have likeness 1, one of them and a text with words 0. Null ids come first; equal ids are ordered by a hash of their text,
then the text; rows equal in both stand in one piece. A single document is its own next document. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize

WIDTH = 5
BINS, BITS = 256, 4
DIRECT = 8
#: Rows of one sorted piece, about; ranges of ids; bytes of text of a partition of pieces, about.
PIECE_ROWS, RANGES, PART_BYTES = 500, 256, 16 << 20
#: First documents of pieces that are broadcast at most; more are met by a shuffle.
FEW_FIRSTS = 2_000_000
_LOW = (1 << 56) - 1
_LEAST = -(1 << 63)


def _step(p):
    """An odd step for each bin: probing p + t * step reaches every bin."""
    return (F.pmod(F.xxhash64(p), F.lit(BINS // 2)) * 2 + 1).cast("int")


def _spark_steps(spark: SparkSession) -> tuple[list[int], list[int]]:
    steps = [r.s for r in spark.range(BINS).select("id", _step(F.col("id").cast("int")).alias("s")).orderBy("id").collect()]
    return steps, [pow(s, -1, BINS) for s in steps]


def add_fingerprint(df: DataFrame, text: Column, out: str) -> DataFrame:
    """df with `out`: an array of BINS small numbers, null for a text without words."""
    t = f"_{out}"
    steps, inverse = _spark_steps(df.sparkSession)
    steps_, inverse_ = F.lit(steps), F.lit(inverse)
    low = F.lit(_LOW)
    df = df.withColumn(f"{t}w", F.transform(F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), ""), lambda w: F.xxhash64(w)))
    n = F.size(f"{t}w")
    runs = F.transform(F.sequence(F.lit(0), F.greatest(n - WIDTH, F.lit(0))), lambda i: F.xxhash64(*[F.get(F.col(f"{t}w"), i + k) for k in range(WIDTH)]))
    marks = F.array(*[F.lit((b << 56 | _LOW) - (1 << 64 if b > 127 else 0)) for b in range(BINS)])
    df = df.withColumn(f"{t}s", F.when(n > 0, F.sort_array(F.concat(runs, marks))))
    bin_of = lambda x: F.shiftrightunsigned(x, 56)
    df = df.withColumn(f"{t}m", F.filter(f"{t}s", lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(F.col(f"{t}s"), i - 1)))))
    value = lambda x: F.when(x.bitwiseAND(low) != low, x.bitwiseAND(F.lit((1 << BITS) - 1)).cast("int"))
    df = df.withColumn(f"{t}v", F.transform(f"{t}m", value))
    v = F.col(f"{t}v")
    df = df.withColumn(f"{t}k", F.filter(F.transform(v, lambda x, q: F.when(x.isNotNull(), q)), lambda q: q.isNotNull()))

    def filled(x: Column, p: Column) -> Column:
        step = F.get(steps_, p)
        near = [F.get(v, (p + step * k).bitwiseAND(F.lit(BINS - 1))) for k in range(1, DIRECT + 1)]
        # The same probing order for the rest: the filled bin that comes first in it.
        rest = F.array_min(F.transform(F.col(f"{t}k"), lambda q: ((q - p + BINS) * F.get(inverse_, p)).bitwiseAND(F.lit(BINS - 1)) * (1 << BITS) + F.get(v, q)))
        return F.coalesce(x, *near, rest.bitwiseAND(F.lit((1 << BITS) - 1)))

    df = df.withColumn(out, F.transform(v, filled))
    return df.drop(*[f"{t}{c}" for c in "wsmvk"])


def packed(values: str) -> Column:
    """The fingerprint as text: a hex digit for each bin."""
    return F.coalesce(F.array_join(F.transform(values, lambda x: F.substring(F.lit("0123456789abcdef"), x + 1, F.lit(1))), ""), F.lit("-" * BINS))


def likeness(a: str, b: str) -> Column:
    """Share of equal bins, corrected for chance agreement; 0 to 1."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / BINS
    by_chance = 1 / (1 << BITS)
    both = F.greatest(F.lit(0.0), (same - by_chance) / (1 - by_chance))
    return F.when(F.col(a).isNull() & F.col(b).isNull(), F.lit(1.0)).when(F.col(a).isNull() | F.col(b).isNull(), F.lit(0.0)).otherwise(both)


def in_pieces(docs: DataFrame, piece_rows: int = PIECE_ROWS) -> tuple[DataFrame, Window]:
    """docs (doc_id, text) with the window that puts each beside its next one; rows with _copy = 1 stand after a piece's end."""
    spark = docs.sparkSession
    docs = docs.withColumns({"_key": F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)), "_hash": F.xxhash64("text")})
    cuts, n, size = docs.agg(F.percentile_approx("_key", F.lit([k / RANGES for k in range(RANGES + 1)]), 10_000), F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    parts = max(spark.sparkContext.defaultParallelism, -(-(size or 0) // PART_BYTES))
    order = "_copy", "_key", "_hash", "text"
    if not n:
        return docs.withColumns({"_piece": F.lit(0).cast("long"), "_copy": F.lit(0)}), Window.partitionBy("_piece").orderBy(*order)
    # An id that is several cuts at once holds so many ranges' rows: these are cut by their hash.
    lows = sorted(set(cuts))
    heavy = [-(-(cuts.count(x) - 1) * n // (RANGES * piece_rows)) for x in lows]
    even = max(1, -(-n // (len(lows) * piece_rows)))
    width = even + max(heavy)
    lows_, heavy_, highs = F.lit(lows), F.lit(heavy), F.lit([*lows[1:], lows[-1] + 1])
    docs = docs.withColumn("_range", F.greatest(F.lit(0), F.size(F.filter(lows_, lambda x: x <= F.col("_key"))) - 1))
    low, high = F.get(lows_, F.col("_range")), F.get(highs, F.col("_range")).cast("double")
    cut = F.get(heavy_, F.col("_range"))
    share = F.when((F.col("_key") == low) & (cut > 0), F.col("_hash") / 2.0**64 + 0.5).otherwise((F.col("_key").cast("double") - low.cast("double")) / F.greatest(high - low.cast("double"), F.lit(1.0)))
    steps = F.when((F.col("_key") == low) & (cut > 0), cut).otherwise(F.lit(even))
    first = F.when((F.col("_key") == low) & (cut > 0), F.lit(0)).otherwise(cut)
    within = first + F.least(steps - 1, F.greatest(F.lit(0), F.floor(share * steps)))
    docs = docs.withColumn("_piece", F.col("_range").cast("long") * width + within.cast("long")).drop("_range")
    # A row for each piece: ids only. Each goes to the piece before: within a range by a window, between the ranges by the few last pieces.
    firsts = docs.groupBy("_piece").agg(F.min(F.struct("_key", "_hash")).alias("_f")).select("_piece", "_f.*", F.floor(F.col("_piece") / width).alias("_range"))
    firsts = materialize(firsts, "firsts")
    ends = {r[0]: r[1] for r in firsts.groupBy("_range").agg(F.max("_piece")).collect()}  # RANGES + 1 rows at most
    there = sorted(ends)
    before = F.create_map(*[F.lit(x) for k, r in enumerate(there) for x in (r, ends[there[k - 1]])])
    lag = F.lag("_piece").over(Window.partitionBy("_range").orderBy("_piece"))
    firsts = firsts.select("_key", "_hash", F.coalesce(lag, before[F.col("_range")]).alias("_before"))
    few = n // piece_rows * 2 + 2 * RANGES < FEW_FIRSTS
    docs = docs.join(F.broadcast(firsts) if few else firsts, ["_key", "_hash"], "left")
    at = lambda p, c: F.struct(F.col(p).alias("p"), F.lit(c).alias("c"))
    sent = F.when(F.col("_before").isNull(), F.array(at("_piece", 0))).otherwise(F.array(at("_piece", 0), at("_before", 1)))
    docs = docs.select("doc_id", "text", "_key", "_hash", F.explode(sent).alias("_to")).select("doc_id", "text", "_key", "_hash", F.col("_to.p").alias("_piece"), F.col("_to.c").alias("_copy"))
    return docs.repartition(parts, "_piece"), Window.partitionBy("_piece").orderBy(*order)


def fingerprints(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """For each document: its fingerprint, that of its edited text, and their likeness to it and to the next document's."""
    docs, beside = in_pieces(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")))
    docs = docs.withColumn("_next", F.lead("text").over(beside))
    docs = add_fingerprint(docs, F.col("text"), "_own")
    docs = docs.withColumn("_beside", F.lead("_own").over(beside)).where("_copy = 0")
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    docs = docs.withColumn("n_chars", n.cast("long")).withColumn("_edited", F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("_next"), F.lit(1), half)))
    docs = add_fingerprint(docs, F.col("_edited"), "_other")
    return docs.select(
        "doc_id", "n_chars", F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"),
        packed("_own").alias("fingerprint"), packed("_other").alias("edited_fingerprint"),
        likeness("_own", "_other").alias("near_edited"), likeness("_own", "_beside").alias("near_next"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
