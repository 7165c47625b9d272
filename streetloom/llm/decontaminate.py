"""Benchmark decontamination: one Aho-Corasick automaton over normalised test questions and answers.

A text is lower-cased (A-Z only) and cut into words of digits, a-z and all code points from U+0080 on. An item gives
every run of 13 consecutive words as a window; an item of 1 to 12 words is one window. All windows go into one
automaton, a text is scanned once, and the words within any occurrence are hit; their places are mapped back to
character offsets of the original text.

The benchmark is read in blocks of at most `block_bytes` of text. A block's automaton takes some 340 bytes of memory for
a byte of text (measured), so a worker holds about 64 MB. A benchmark within one block (the usual case) is scanned in one
pass. Further blocks add passes that merge their hits, PASSES of them in a stage; between stages the rows are written to
the shared folder, so neither a stage's workers nor what is broadcast at a time grows with the benchmark.

Defined results: null or wordless texts have 0 words, no items, contaminated false. Null items and items without words
give no windows. Repeated items count once by item_id; a null item_id is no item. An empty benchmark hits nothing.
Repeated documents get equal rows. Columns of documents named as the added ones are replaced.
"""

from __future__ import annotations

from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_columns, materialize, utf8

WINDOW = 13
BLOCK_BYTES = 192 << 10
PASSES = 4
#: Lower-cases A-Z, keeps 0-9, a-z and bytes of non-ASCII code points, makes the rest a space: one pass over the bytes.
_NORMAL = bytes(b if chr(b).isdigit() and b < 128 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
FIELDS = "n_words long, n_hit long, n_items long, items array<string>, spans array<struct<start:long,end:long>>, contaminated boolean"


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_NORMAL).split() if text else []


def windows_of(words: list[bytes], width: int = WINDOW) -> list[bytes]:
    if not words:
        return []
    return [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]


def build(items: list[tuple[str, bytes]], width: int = WINDOW) -> ahocorasick.Automaton | None:
    """The automaton; bytes stand as code points below 256, so that offsets are byte offsets. Values: words, item ids."""
    found: dict[bytes, tuple[int, set[str]]] = {}
    for item, text in items:
        for w in windows_of(words_of(text), width):
            found.setdefault(w, (w.count(b" ") + 1, set()))[1].add(item)
    if not found:
        return None
    automaton = ahocorasick.Automaton()
    for w, value in found.items():
        automaton.add_word(f" {w.decode('latin-1')} ", value)
    automaton.make_automaton()
    return automaton


def scan(automaton, words: list[bytes], hit: np.ndarray, items: set[str]) -> None:
    """One pass over the words; marks hit words and adds the items found."""
    flat = b" " + b" ".join(words) + b" "
    gaps = None
    for end, (n, ids) in automaton.iter(flat.decode("latin-1")):
        if gaps is None:
            gaps = np.flatnonzero(np.frombuffer(flat, np.uint8) == 32)
        last = int(np.searchsorted(gaps, end))
        hit[last - n : last] = True
        items |= ids


def spans_of(text: bytes, hit: np.ndarray) -> list[dict]:
    """Character offsets in the original text of maximal runs of hit words."""
    flat = np.frombuffer(text, np.uint8)
    inside = np.frombuffer(text.translate(_NORMAL), np.uint8) != 32
    turns = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
    # A code point begins at each byte that continues none.
    chars = np.concatenate([[0], np.cumsum((flat & 0xC0) != 0x80)])
    starts, ends = chars[turns[::2][edge[::2]]].tolist(), chars[turns[1::2][edge[1::2] - 1]].tolist()
    return [{"start": a, "end": b} for a, b in zip(starts, ends, strict=True)]


_built: dict = {}


def _automaton(broadcast, width: int):
    """The automaton of a broadcast block; a worker keeps that of its last one."""
    key = (broadcast._jbroadcast.id() if broadcast._jbroadcast is not None else id(broadcast.value), width)
    if key not in _built:
        _built.clear()
        _built[key] = build(broadcast.value, width), broadcast.value
    return _built[key][0]


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int):
    """Blocks of (item id, text), each of at most block_bytes of text (or one longer item), streamed to the driver one at a time."""
    block, held = [], 0
    rows = benchmark.where(F.col(item_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(item_col).cast("string"), F.col(text_col).cast("binary"))
    for item, text in rows.toLocalIterator():
        if block and held + len(text) > block_bytes:
            yield block
            block, held = [], 0
        block.append((item, bytes(text)))
        held += len(text)
    if block:
        yield block


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with n_words, n_hit, n_items, items (sorted ids), spans (character offsets of hit runs) and contaminated."""
    sc = docs.sparkSession.sparkContext
    out, k, sent, block = docs, 0, [], None
    for following in chain(item_blocks(benchmark, item_col, item_text_col, block_bytes), [None]):
        if block is not None or following is None:
            sent.append(sc.broadcast(block or []))
            out = _pass(out, sent[-1], text_col, width, k, following is None)
            k += 1
            if k % PASSES == 0 and following is not None:
                out = materialize(out, "passes")
                for b in sent:
                    b.unpersist()
                sent = []
        block = following
    return out


def _pass(docs: DataFrame, broadcast, text_col: str, width: int, k: int, final: bool) -> DataFrame:
    """Pass k takes what pass k - 1 has found in columns of its own, and adds to it."""
    carries, was, now = k > 0, (f"dc_hit_{k - 1}", f"dc_items_{k - 1}"), (f"dc_hit_{k}", f"dc_items_{k}")

    def make(batches):
        automaton = _automaton(broadcast, width)
        for batch in batches:
            rows = []
            before = batch.column(was[0]).to_pylist() if carries else None
            earlier = batch.column(was[1]).to_pylist() if carries else None
            for k, text in enumerate(utf8(batch, text_col)):
                words = words_of(text)
                hit = np.frombuffer(before[k], bool).copy() if carries and before[k] else np.zeros(len(words), bool)
                items = set(earlier[k]) if carries else set()
                if automaton is not None and words:
                    scan(automaton, words, hit, items)
                rows.append((text, len(words), hit, items))
            if not final:
                yield [pa.array([h.tobytes() if i else None for _, _, h, i in rows], pa.binary()), pa.array([sorted(i) for *_, i in rows], pa.list_(pa.string()))]
                continue
            hits = [int(h.sum()) if i else 0 for _, _, h, i in rows]
            yield [
                pa.array([n for _, n, _, _ in rows], pa.int64()),
                pa.array(hits, pa.int64()),
                pa.array([len(i) for *_, i in rows], pa.int64()),
                pa.array([sorted(i) for *_, i in rows], pa.list_(pa.string())),
                pa.array([spans_of(t, h) if i else [] for t, _, h, i in rows], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                pa.array([h > 0 and 20 * h >= n for h, (_, n, _, _) in zip(hits, rows, strict=True)], pa.bool_()),
            ]

    if not final:
        return add_columns(docs, f"{now[0]} binary, {now[1]} array<string>", make).drop(*was)
    return add_columns(docs, FIELDS, make).drop(*was)


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), "contaminated")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digest(decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))
