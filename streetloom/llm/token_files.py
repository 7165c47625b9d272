"""Token-ID output in the Arrow stream-file format: fixed-size-list batches of equal-length sequences and masks.

Documents are dealt by ranges of ascending id, so shard k holds the documents after those of shard k-1. A shard is two
Arrow files: `tokens` has rows of SEQUENCE ids (two bytes each where the vocabulary allows, else four) and as many mask
bits (1: a token, 0: padding after the shard's last token), in batches of ROWS_PER_BATCH rows, so the row and batch of any position follow by division and a memory map
gives it without copying; `documents` has each document's id, start within the shard and length. A manifest row per
shard is all that reaches the driver, and it names the shard's files. Each attempt of a task writes files of its own, so a
retried or doubled task never meets another's; files that no manifest row names may be deleted.

Text is encoded by the tokenizers library. Pieces between single spaces are encoded once and kept in a bounded cache,
which starts with the pieces met most often in a sample of documents (that changes time, not results): byte-level pre-tokenization always starts a new word at a space that stands between two other characters, so the
pieces' ids joined are those of the whole text. Texts with other white space next to a space are encoded whole.

Defined results: null and empty texts have the end id alone. Equal document ids stand next to each other, ordered by a
hash of their text, then the text, so that many rows of one id or of none are spread over shards; null ids come first. An empty table gives shards without rows and an empty result.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections import Counter
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, frequent, fresh_path, gathered, materialize

VOCABULARY = "byte_bpe_50k.json"
SEQUENCE = 2048
ROWS_PER_BATCH = 64
END = 0
#: Bytes of text of a shard, about.
SHARD_BYTES = 32 << 20
CACHE_PIECES, FIRST_PIECES = 1_000_000, 50_000
HOT_SAMPLE, HOT_PIECES = 16, 300_000
#: Pieces of one text when new ones are encoded; rows and bytes of texts encoded at once.
LEARN_PIECES, ROWS_AT_ONCE, BYTES_AT_ONCE = 500, 8000, 8 << 20


class Encoder:
    """`hot`: ids of pieces known from the start, as learn() makes them; others are kept until CACHE_PIECES."""

    def __init__(self, path: str, hot: dict[str, bytes] | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        #: Tokens that begin with a space: where pieces stand one after another, each begins with one and has no other.
        self.begins = np.zeros(size, bool)
        self.begins[[i for t, i in self.tokenizer.get_vocab().items() if t.startswith("\u0120")]] = True
        self.hot = hot or {}
        #: Ids of a space and a piece, by piece; b"" marks pieces that may not stand alone.
        self.cache, self.firsts = dict(self.hot), {}

    def whole(self, *texts: str) -> bytes:
        """The ids of each text, one text's after another's."""
        return b"".join([np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(list(texts), add_special_tokens=False)])

    def learn(self, pieces: list[str]) -> dict[str, bytes]:
        """Encode pieces, each after a space, in texts of LEARN_PIECES."""
        good = [p for p in pieces if p and p == p.strip()]
        got = dict.fromkeys(pieces, b"") if len(good) < len(pieces) else {}
        if good:
            ids = np.frombuffer(self.whole(*[" " + " ".join(good[at : at + LEARN_PIECES]) for at in range(0, len(good), LEARN_PIECES)]), self.kind)
            data, cuts = ids.tobytes(), (self.kind.itemsize * np.append(np.flatnonzero(self.begins[ids]), len(ids))).tolist()
            got.update(zip(good, [data[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], strict=True))
        return got

    def known(self, pieces: list[str]) -> list[bytes]:
        """The ids of distinct pieces, each after a space."""
        found = list(map(self.cache.get, pieces))
        if lacking := [p for p, ids in zip(pieces, found, strict=True) if ids is None]:
            new = self.learn(lacking)
            found = [new[p] if ids is None else ids for p, ids in zip(pieces, found, strict=True)]
            if len(self.cache) + len(new) > len(self.hot) + CACHE_PIECES:
                self.cache = dict(self.hot)
            self.cache.update(islice(new.items(), CACHE_PIECES))
        return found

    def encode(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        """The ids of each text, in self.kind.

        All pieces of the texts are numbered by what they are, distinct ones looked up, and their ids laid out by number.
        """
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        cut = pc.split_pattern(texts.fill_null(""), " ")
        ends = cut.offsets.to_numpy()
        if not len(texts):
            return []
        coded = cut.flatten().dictionary_encode()
        pieces, numbers = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        ids = self.known(pieces)
        size = np.fromiter(map(len, ids), np.int32, len(ids)) // self.kind.itemsize
        flat, starts = np.frombuffer(b"".join(ids), self.kind), np.cumsum(size, dtype=np.int32) - size
        at = ends[:-1] - ends[0]
        whole = np.logical_or.reduceat(size[numbers] == 0, at)
        firsts = numbers[at].tolist()
        # First pieces have no space before them and are looked up apart; here they take no room.
        n = size[numbers]
        n[at] = 0
        upto = np.cumsum(n, dtype=np.int32)
        place = np.repeat(starts[numbers] - upto + n, n)
        place += np.arange(len(place), dtype=np.int32)
        data = flat[place].tobytes()
        stops = (np.append(upto[at], upto[-1]) * self.kind.itemsize).tolist()
        return [(self.whole(texts[k].as_py()) if texts[k].as_py() else b"") if whole[k] else self.first(pieces[p]) + data[stops[k] : stops[k + 1]] for k, p in enumerate(firsts)]

    def first(self, piece: str) -> bytes:
        """The ids of a text's first piece, which has no space before it."""
        got = self.firsts.get(piece)
        if got is None:
            if len(self.firsts) > FIRST_PIECES:
                self.firsts.clear()
            got = self.firsts[piece] = self.whole(piece)
        return got


def hot_pieces(docs: DataFrame, path: str) -> dict[str, bytes]:
    """Ids of the pieces seen most often in one of HOT_SAMPLE documents, HOT_PIECES at most: they save time alone."""

    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                counts.update(text.split(" ") if text else ())
            if len(counts) > CACHE_PIECES:
                yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["piece", "n"])
                counts.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["piece", "n"])

    drawn = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(HOT_SAMPLE)) == 0).select("text")
    counts = drawn.mapInArrow(run, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n")).where((F.col("n") > 1) & (F.octet_length("piece") <= 64))
    counts = materialize(counts, "pieces")
    return Encoder(path).learn(sorted(frequent(counts, "piece", HOT_PIECES)))


_encoders: dict = {}


def encoder(path: str, hot) -> Encoder:
    """The worker's encoder for a broadcast of hot pieces."""
    key = path, hot._jbroadcast.id() if hot._jbroadcast is not None else hot._path
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(path, hot.value)
    return _encoders[key]


def token_schema(sequence: int, kind: np.dtype) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.field("item", pa.from_numpy_dtype(kind), False), sequence)), ("mask", pa.list_(pa.field("item", pa.bool_(), False), sequence))])


DOCUMENT_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
MANIFEST = "shard int, tokens_path string, documents_path string, n_docs long, n_tokens long"


class ShardWriter:
    """Writes one shard; holds one batch of sequences."""

    def __init__(self, base: str, shard: int, sequence: int, kind: np.dtype):
        self.fs, self.base = pafs.FileSystem.from_uri(base)
        self.fs.create_dir(self.base, recursive=True)
        self.sequence, self.shard, self.kind, self.docs, self.at = sequence, shard, kind, 0, 0
        own = uuid.uuid4().hex
        names = {n: f"{n}-{shard:05d}-{own}.arrow" for n in ("tokens", "documents")}
        self.paths = [f"{base}/{name}" for name in names.values()]
        self.out = {n: self.fs.open_output_stream(f"{self.base}/{name}") for n, name in names.items()}
        self.schema = token_schema(sequence, kind)
        self.tokens = pa.ipc.new_file(self.out["tokens"], self.schema)
        self.index = pa.ipc.new_file(self.out["documents"], DOCUMENT_SCHEMA)
        self.held: list[bytes] = []
        self.held_ids = 0

    def add(self, ids: list[int], encoded: list[bytes]) -> None:
        sizes = np.array([len(x) // self.kind.itemsize for x in encoded], np.int64)
        starts = self.at + np.cumsum(sizes) - sizes
        self.index.write_batch(pa.record_batch([pa.array(ids, pa.int64()), pa.array(starts), pa.array(sizes)], schema=DOCUMENT_SCHEMA))
        self.at += int(sizes.sum())
        self.docs += len(ids)
        self.held += encoded
        self.held_ids += int(sizes.sum())
        if self.held_ids >= ROWS_PER_BATCH * self.sequence:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.held), self.kind)
        step = ROWS_PER_BATCH * self.sequence
        full = len(ids) - len(ids) % step
        for at in range(0, len(ids) if last else full, step):
            part = ids[at : at + step]
            rows = -(-len(part) // self.sequence)
            mask = np.arange(rows * self.sequence) < len(part)
            padded = np.zeros(rows * self.sequence, self.kind)
            padded[: len(part)] = part
            self.tokens.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(x), type=f.type) for x, f in zip((padded, mask), self.schema, strict=True)], schema=self.schema))
        self.held, self.held_ids = [ids[full:].tobytes()], len(ids) - full

    def close(self) -> None:
        self._flush(True)
        self.tokens.close()
        self.index.close()
        for out in self.out.values():
            out.close()


class ShardReader:
    """Random access to a shard: read(start, n) copies nothing but what it returns."""

    def __init__(self, tokens: str, documents: str):
        fs, path = pafs.FileSystem.from_uri(tokens)
        local = isinstance(fs, pafs.LocalFileSystem)
        self.tokens = pa.ipc.open_file(pa.memory_map(path) if local else fs.open_input_file(path))
        fs, path = pafs.FileSystem.from_uri(documents)
        self.documents = pa.ipc.open_file(pa.memory_map(path) if local else fs.open_input_file(path))
        self.sequence = self.tokens.schema.field("ids").type.list_size
        self._at, self._ids = -1, np.zeros(0, np.uint16)

    def batch(self, k: int) -> np.ndarray:
        """The ids of a batch, flat: a view of the file."""
        if k != self._at:
            self._at, self._ids = k, self.tokens.get_batch(k).column("ids").flatten().to_numpy(zero_copy_only=True)
        return self._ids

    def sequence_at(self, row: int) -> tuple[np.ndarray, pa.Array]:
        """Ids and mask, both views of the file, of one equal-length sequence."""
        batch, k = self.tokens.get_batch(row // ROWS_PER_BATCH), row % ROWS_PER_BATCH
        ids, mask = (batch.column(c).slice(k, 1).flatten() for c in ("ids", "mask"))
        return ids.to_numpy(zero_copy_only=True), mask

    def read(self, start: int, n: int):
        """Views that hold ids start to start + n, one for each batch they touch."""
        step = ROWS_PER_BATCH * self.sequence
        while n > 0:
            k, at = divmod(start, step)
            view = self.batch(k)[at : at + n]
            yield view
            start, n = start + len(view), n - len(view)


def write_shards(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", path: str | None = None, out: str | None = None, end: int = END, sequence: int = SEQUENCE, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write docs as shards; returns the manifest, a row for each shard, with the start of the shard among all ids."""
    spark = docs.sparkSession
    bound_batches(spark)
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    base = out or fresh_path(spark, "tokens")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    hot = spark.sparkContext.broadcast(hot_pieces(docs, path))
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = max(spark.sparkContext.defaultParallelism, -(-total // shard_bytes))
    order = F.col("doc_id").asc_nulls_first(), F.xxhash64("text")
    ordered = docs.repartitionByRange(shards, *order).sortWithinPartitions(*order, F.col("text").asc_nulls_first())

    def run(batches):
        from pyspark import TaskContext

        shard, writer = TaskContext.get().partitionId(), None
        for batch in gathered(batches, ROWS_AT_ONCE, BYTES_AT_ONCE):
            coder = encoder(path, hot)
            writer = writer or ShardWriter(base, shard, sequence, coder.kind)
            tail = np.array([end], coder.kind).tobytes()
            writer.add(batch.column("doc_id").to_pylist(), [x + tail for x in coder.encode(batch.column("text"))])
        if writer:
            writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), *[pa.array([p]) for p in writer.paths], pa.array([writer.docs]), pa.array([writer.at])], names=["shard", "tokens_path", "documents_path", "n_docs", "n_tokens"])

    # The manifest has a row for each shard of shard_bytes: the only thing collected.
    rows, start = [], 0
    for r in sorted(ordered.mapInArrow(run, MANIFEST).collect(), key=lambda r: r.shard):
        rows.append((*r, start))
        start += r.n_tokens
    return spark.createDataFrame(rows, MANIFEST + ", start long")


def read_documents(manifest: DataFrame) -> DataFrame:
    """doc_id, start among all ids, n_tokens, ids_crc32, read back from the files."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                shard = ShardReader(r["tokens_path"], r["documents_path"])
                for k in range(shard.documents.num_record_batches):
                    part = shard.documents.get_batch(k)
                    crc = []
                    for start, n in zip(part.column("start").to_pylist(), part.column("n_tokens").to_pylist(), strict=True):
                        c = 0
                        for view in shard.read(start, n):
                            c = zlib.crc32(view.astype("<u4"), c)
                        crc.append(c)
                    starts = pa.array(part.column("start").to_numpy() + r["start"])
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), starts, part.column("n_tokens"), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    spark = manifest.sparkSession
    shards = max(1, manifest.count())
    return manifest.repartition(min(shards, 4096)).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return read_documents(write_shards(docs))
