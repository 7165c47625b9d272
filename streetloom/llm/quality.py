"""Quality classifier: hashed word and character n-gram vectors, averaged per document, softmax, numpy SGD.

Every word of a text is a feature, and so is each pair of words that follow one another, and each run of 3 and of 4 bytes
of `<word>`; features are hashed into BUCKETS learned vectors. Pairs are those of a text in which a word equal to the one
before it reads as the symbol AGAIN, so that repetition is one learned feature instead of one for each word. A document is the mean of its features' vectors; a softmax
over the two labels follows. Training is stochastic gradient descent, a document at a time, over a bounded sample of
labelled rows: the first in the order of a hash of the id, SAMPLE_ROWS of them at most, until their whole texts are
SAMPLE_BYTES together. No text is too long for it. Rows with crc32(id) mod 5 = 0 are held out.

A score needs only the difference of the two logits, which is linear in the vectors: each bucket's share is computed
once, each word's sum is cached, and a whole text is a sum over its words and pairs.

Defined results: null and empty texts get the score of the bias alone. Labels that are null or belong to no document
are not used; an id with several labels or texts gives several examples, repeated rows too. Without training rows every score is 0.5.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_columns, id_remainder, utf8

BUCKETS, DIM = 1 << 17, 16
SIZES = (3, 4)
SAMPLE_ROWS, SAMPLE_BYTES = 6000, 32 << 20
EPOCHS, RATE = 6, 0.5
THRESHOLD = 0.3
CACHE_WORDS = 200_000
_M = 0x9E3779B97F4A7C15
#: Hash of the symbol that stands for a word equal to the one before it, and for what precedes it, in a pair.
AGAIN = np.uint64(0xA6A1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h ^ (h >> np.uint64(32))) % np.uint64(BUCKETS)).astype(np.int64)


def hashed(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A 64-bit hash of each word; buckets of all words and runs of bytes, and which word each belongs to."""
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    sizes = np.array([len(w) + 2 for w in words], np.int64)
    flat = np.frombuffer(b"<" + b"><".join(words) + b">", np.uint8).astype(np.uint64) + np.uint64(1)
    owner = np.repeat(np.arange(len(words)), sizes)
    starts = np.cumsum(sizes) - sizes
    place = np.arange(len(flat)) - starts[owner]
    m = np.uint64(_M)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int(sizes.max()), m))
        whole = np.add.reduceat(flat * powers[place], starts)
        out, of = [_mixed(whole)], [np.arange(len(words))]
        for n in SIZES:
            h = flat[: max(0, len(flat) - n + 1)] + np.uint64(n)
            for k in range(1, n):
                h = h * m + flat[k : k + len(h)]
            good = place[: len(h)] + n <= sizes[owner[: len(h)]]
            out.append(_mixed(h[good]))
            of.append(owner[: len(h)][good])
    return whole, np.concatenate(out), np.concatenate(of)


def pairs(words: np.ndarray) -> np.ndarray:
    """Buckets of the pairs of neighbours in a row of word hashes; all pairs of equal words are one."""
    same = words[:-1] == words[1:]
    first, second = np.where(same, AGAIN, words[:-1]), np.where(same, AGAIN, words[1:])
    with np.errstate(over="ignore"):
        return _mixed(first * np.uint64(_M) + (second ^ np.uint64(_M >> 1)))


def features(words: list[bytes]) -> np.ndarray:
    """Buckets of all features of a text."""
    whole, ids, _ = hashed(words)
    return np.concatenate([ids, pairs(whole)])


def train(texts: list[bytes], labels: list[int], *, epochs: int = EPOCHS, rate: float = RATE, seed: int = 0) -> tuple[np.ndarray, float]:
    """Each bucket's share of the logit of label 1 over label 0, and the bias."""
    rng = np.random.default_rng(seed)
    vectors = ((rng.random((BUCKETS, DIM)) - 0.5) / DIM).astype(np.float32)
    out, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    docs = []
    for text in texts:
        ids, n = np.unique(features(text.split()), return_counts=True)
        docs.append((ids, (n / max(1, n.sum())).astype(np.float32)))
    steps, done = epochs * len(docs), 0
    for _ in range(epochs):
        for k in rng.permutation(len(docs)):
            ids, share = docs[k]
            step = rate * (1 - done / steps)
            done += 1
            mean = share @ vectors[ids]
            logits = mean @ out + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[labels[k]] -= 1
            back = out @ p
            out -= step * np.outer(mean, p).astype(np.float32)
            bias -= 0.1 * step * p
            # A mean over many features leaves each a small share: the vectors take a larger step.
            vectors[ids] -= (step * 20) * share[:, None] * back[None, :]
    return vectors @ (out[:, 1] - out[:, 0]), float(bias[1] - bias[0])


class Words(dict):
    """Numbers of words in the order they are met, with those not yet summed."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self.new.append(word)
        n = self[word] = len(self)
        return n


class Scorer:
    """Keeps each word's hash, sum and number of features, of CACHE_WORDS words and a batch's at most."""

    def __init__(self, table: np.ndarray, bias: float):
        self.table, self.bias = table, bias
        self.clear()

    def clear(self) -> None:
        self.words, self.hash, self.sum, self.n = Words(), np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, np.int64)

    def score(self, texts: list[bytes | None]) -> list[float]:
        if len(self.words) > CACHE_WORDS:
            self.clear()
        found = [np.fromiter(map(self.words.__getitem__, ws), np.int64, len(ws)) for ws in [t.split() if t else [] for t in texts]]
        if new := self.words.new:
            whole, ids, owner = hashed(new)
            self.hash = np.append(self.hash, whole)
            self.sum = np.append(self.sum, np.bincount(owner, self.table[ids], len(new)))
            self.n = np.append(self.n, np.bincount(owner, minlength=len(new)))
            self.words.new = []
        out = []
        for ws in found:
            logit = self.bias
            if len(ws):
                logit += (self.sum[ws].sum() + self.table[pairs(self.hash[ws])].sum()) / (self.n[ws].sum() + len(ws) - 1)
            out.append(float(1 / (1 + np.exp(-np.clip(logit, -60, 60)))))
        return out


_scorers: dict = {}


def fit(docs: DataFrame, labels: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES):
    """Learn from a bounded sample of labelled rows; returns what score() takes."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).where(F.col("_label").isin(0, 1) & (id_remainder("_id", 5) != 0)).distinct()
    place = F.xxhash64("_id")
    # At most sample_rows rows, so that they may be broadcast; each limit is one of an order.
    drawn = known.orderBy(place, "_id", "_label").limit(sample_rows)
    met = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_text")).where("_text IS NOT NULL").join(F.broadcast(drawn), "_id")
    sizes = met.select(place.alias("_at"), "_id", F.octet_length("_text").alias("_n")).orderBy("_at", "_id", "_n").limit(sample_rows).collect()
    total = last = 0
    for r in sizes:
        total += r._n
        if last and total > sample_bytes:
            break
        last += 1
    rows = met.orderBy(place, "_id", F.octet_length("_text"), "_label", "_text").limit(last).select("_id", "_text", "_label").collect() if last else []
    rows.sort(key=lambda r: (r._id, r._label, bytes(r._text)))
    return train([bytes(r._text) for r in rows], [r._label for r in rows]) if rows else (np.zeros(BUCKETS, np.float32), 0.0)


def score(docs: DataFrame, model, *, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with score and predicted."""
    broadcast = docs.sparkSession.sparkContext.broadcast(model)

    def make(batches):
        key = broadcast._jbroadcast.id() if broadcast._jbroadcast is not None else (float(broadcast.value[0][:64].sum()), broadcast.value[1])
        if key not in _scorers:
            _scorers.clear()
            _scorers[key] = Scorer(*broadcast.value)
        for batch in batches:
            scores = _scorers[key].score(utf8(batch, text_col))
            yield [pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())]

    return add_columns(docs, "score double, predicted int", make)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", (id_remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
