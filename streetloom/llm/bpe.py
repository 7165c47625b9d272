"""BPE encoding and decoding by batched numpy merge rounds.

The symbols of many words stand in one flat array. A round looks up the rank of every adjacent pair by binary search
over the sorted pair keys, takes each word's lowest rank, merges its occurrences and closes the gaps; words without a
known pair are done. Words come from white-space chunks of the text (no piece of the pattern spans white space), and a
bounded cache keeps the chunks already encoded.

Defined results: null and empty texts have no ids and decode to the empty text. Repeated texts get equal rows.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_columns

VOCABULARY = "word_bpe_49k.json"
CACHE_CHUNKS = 150_000
#: White space of the pattern: Unicode White_Space. str.split() also cuts at U+001C to U+001F, which the pattern takes as symbols.
_SPACE = regex.compile(r"[\t-\r \x85\xa0  -     　]+")
_ODD = regex.compile(r"[\x1c-\x1f]|<\|")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return [chr(b) if b in set(plain) else chr(256 + rest.index(b)) for b in range(256)]


class Bpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        self.suffix = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        alphabet = byte_alphabet()
        self.plain = np.array([vocab[c] for c in alphabet], np.int64)
        self.last = np.array([vocab[c + self.suffix] for c in alphabet], np.int64)
        names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.width = max(vocab.values()) + 1
        left, right = (np.array([vocab[m[k]] for m in merges], np.int64) for k in (0, 1))
        into = np.array([vocab[a + b] for a, b in merges], np.int64)
        keys = left * self.width + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.into = keys[order], order, into[order]
        # A merge's own parts are made by earlier merges: then all occurrences of a word's lowest pair may merge in one round.
        made = np.full(self.width, -1, np.int64)
        made[into[::-1]] = np.arange(len(merges))[::-1]
        self.at_once = bool((np.maximum(made[left], made[right]) < np.arange(len(merges))).all())
        self.cache: dict[str, bytes] = {}

    def merge_words(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word (its bytes), as little-endian unsigned 32-bit integers."""
        sizes = np.array([len(w) for w in words], np.int64)
        flat = np.frombuffer(b"".join(words), np.uint8)
        ids = self.plain[flat]
        ends = np.cumsum(sizes) - 1
        ids[ends] = self.last[flat[ends]]
        owner = np.repeat(np.arange(len(words)), sizes)
        done_ids, done_owner = [], []
        while len(ids):
            same = owner[:-1] == owner[1:]
            pair = ids[:-1] * self.width + ids[1:]
            at = np.searchsorted(self.keys, pair)
            at[at == len(self.keys)] = 0
            known = same & (self.keys[at] == pair)
            rank = np.where(known, self.ranks[at], len(self.keys))
            starts = np.flatnonzero(np.concatenate([[True], ~same]))
            lowest = np.minimum.reduceat(np.append(rank, len(self.keys)), starts)
            per = np.diff(np.append(starts, len(ids)))
            open_ = np.repeat(lowest < len(self.keys), per)
            done_ids.append(ids[~open_])
            done_owner.append(owner[~open_])
            if not open_.any():
                break
            chosen = np.flatnonzero(known & (rank == np.repeat(lowest, per)[:-1]))
            if self.at_once:
                # In a run of overlapping occurrences every other one merges, from the left.
                head = np.concatenate([[True], np.diff(chosen) != 1])
                begin = np.maximum.accumulate(np.where(head, np.arange(len(chosen)), 0))
                chosen = chosen[(np.arange(len(chosen)) - begin) % 2 == 0]
            else:
                chosen = chosen[np.concatenate([[True], owner[chosen][1:] != owner[chosen][:-1]])]
            ids[chosen] = self.into[at[chosen]]
            keep = open_.copy()
            keep[chosen + 1] = False
            ids, owner = ids[keep], owner[keep]
        ids, owner = np.concatenate(done_ids), np.concatenate(done_owner)
        ids = ids[np.argsort(owner, kind="stable")].astype("<u4")
        cuts = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(words)))]) * 4
        data = ids.tobytes()
        return [data[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    def pieces(self, text: str) -> list[bytes]:
        """Words of a text without special tokens: composed, lower-cased code point by code point, cut by the pattern."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return [w.encode("utf-8") for w in self.pattern.findall(text.lower())]

    def learn(self, chunks: set[str]) -> None:
        """Put chunks into the cache, all their distinct words merged together."""
        by_chunk = {c: self.pieces(c) for c in chunks}
        words = list({w for ws in by_chunk.values() for w in ws})
        ids = dict(zip(words, self.merge_words(words), strict=True)) if words else {}
        for c, ws in by_chunk.items():
            self.cache[c] = ids[ws[0]] if len(ws) == 1 else b"".join([ids[w] for w in ws])

    def parts(self, text: str) -> list[str | int]:
        """White-space chunks, and ids of special tokens between them."""
        if not _ODD.search(text):
            return text.split()
        out: list[str | int] = []
        for part in self.split_special.split(text) if self.split_special else [text]:
            if part in self.special:
                out.append(self.special[part])
            else:
                out += [c for c in _SPACE.split(part) if c]
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if len(self.cache) > CACHE_CHUNKS:
            self.cache.clear()
        parts = [self.parts(t) if t else [] for t in texts]
        new = {c for p in parts for c in p if type(c) is str and c not in self.cache}
        if new:
            self.learn(new)
        get = self.cache.__getitem__
        return [b"".join([get(c) if type(c) is str else c.to_bytes(4, "little") for c in p]) for p in parts]

    def decode(self, ids: bytes) -> str:
        """The library joins tokens by a space where a file names no decoder; special tokens stay."""
        return " ".join(map(self.names.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_loaded: dict[str, Bpe] = {}


def loaded(path: str) -> Bpe:
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def vocabulary(path: str | None) -> str:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    return path


def encode(docs: DataFrame, *, text_col: str = "text", path: str | None = None) -> DataFrame:
    """docs with ids (array<int>)."""
    path = vocabulary(path)

    def make(batches):
        for batch in batches:
            got = [np.frombuffer(x, "<i4") for x in loaded(path).encode(batch.column(text_col).to_pylist())]
            cuts = np.concatenate([[0], np.cumsum([len(x) for x in got])]).astype(np.int32)
            yield [pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate([*got, np.zeros(0, np.int32)])))]

    return add_columns(docs, "ids array<int>", make)


def decode(docs: DataFrame, *, ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """docs with decoded (string); a null list of ids decodes to the empty text."""
    path = vocabulary(path)

    def make(batches):
        for batch in batches:
            yield [pa.array([loaded(path).decode(np.array(x if x is not None else [], "<u4").tobytes()) for x in batch.column(ids_col).to_pylist()], pa.string())]

    return add_columns(docs, "decoded string", make)


def round_trip(docs: DataFrame, *, text_col: str = "text", path: str | None = None) -> DataFrame:
    """docs with n_tokens, and sha256 of the ids and of the text decoded from them, made in one pass."""
    path = vocabulary(path)

    def make(batches):
        for batch in batches:
            bpe = loaded(path)
            got = bpe.encode(batch.column(text_col).to_pylist())
            yield [
                pa.array([len(x) // 4 for x in got], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in got], pa.string()),
                pa.array([hashlib.sha256(bpe.decode(x).encode("utf-8")).hexdigest() for x in got], pa.string()),
            ]

    return add_columns(docs, "n_tokens long, ids_sha256 string, decoded_sha256 string", make)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return round_trip(docs).select(F.col("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256")
