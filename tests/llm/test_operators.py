"""Operators of the training-data subpackage against brute force, and their edge cases."""

import collections
import glob
import hashlib
import math
import os
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from streetloom.llm import bpe, decontaminate, fingerprint, html, language_model, neardup, quality, sharding, token_files, url_filter
from streetloom.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
DOCS = "doc_id long, text string, lang string, N_WORDS string, score double"
EDGES = [
    (None, "no id here at all ok", "en", "x", 1.0), (1, None, None, None, None), (2, "", "en", "x", 2.0), (3, " \n\t ", "en", "x", 2.0), (4, "word", "en", "x", 2.0),
    (5, "one two three four five six seven", "en", "x", 2.0), (5, "one two three four five six seven", "en", "x", 2.0), (6, "one two three four five six seven", "fr", "x", 2.0),
    (7, "é Ünï  漢字   A’b <|endoftext|> can't", "fr", "x", 2.0), (8, "long " * 30000 + "end", "en", "x", 2.0), (9, "x" * 50000, "en", "x", 2.0),
]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGES, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


def words(text, pattern="[^\x20\x09-\x0d]+"):
    return re.findall(pattern, text.translate(LOW))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    df = QUERIES[name](spark, SF)
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    cur = con.execute(ORACLES[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(repr, (tuple(r[c] for c in names) for r in df.collect()))) == sorted(map(repr, cur.fetchall()))


def test_decontaminate_blocks_and_spans(spark, docs):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    one = {r.doc_id: r for r in decontaminate.decontaminate(docs, bench).collect()}
    many = {r.doc_id: r for r in decontaminate.decontaminate(docs, bench, block_bytes=2000).collect()}
    assert one == many and any(r.n_hit for r in one.values())
    assert len(list(decontaminate.item_blocks(bench, "item_id", "text", 2000))) > decontaminate.PASSES
    for r in one.values():
        found = sum(len(re.findall("[0-9a-z\u0080-\U0010ffff]+", r.text[s.start : s.end].translate(LOW))) for s in r.spans)
        assert found == r.n_hit


def test_decontaminate_edges(spark, edge, empty):
    bench = spark.createDataFrame([(1, "Word"), (1, "word"), (2, None), (None, "two three"), (3, "Two, three."), (4, "!")], "item_id long, text string")
    got = {(r.doc_id, r.lang): r for r in decontaminate.decontaminate(edge, bench).collect()}
    assert got[4, "en"]["items"] == ["1"] and got[5, "en"].n_hit == 2 and got[5, "en"]["items"] == ["3"] and got[1, None].n_words == 0
    assert decontaminate.decontaminate(empty, bench).count() == 0
    assert not decontaminate.decontaminate(edge, bench.limit(0)).where("n_hit > 0").count()


def test_token_files_round_trip(spark, edge, empty, docs, texts):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    at, got = 0, {r.doc_id: r for r in token_files.read_documents(token_files.write_shards(docs, sequence=32)).collect()}
    for k in sorted(texts):
        ids = np.array([*library.encode(texts[k], add_special_tokens=False).ids, 0], "<u4")
        assert (got[k].start, got[k].n_tokens, got[k].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    rows = token_files.read_documents(token_files.write_shards(edge)).collect()
    assert len(rows) == len(EDGES) and {r.doc_id: r.n_tokens for r in rows}[1] == 1
    assert token_files.read_documents(token_files.write_shards(empty)).count() == 0


def test_token_files_spread_rows_of_one_id(spark):
    df = spark.createDataFrame([(None if k % 10 else k, f"text {k} of its own " * 20) for k in range(4000)], "doc_id long, text string")
    manifest = token_files.write_shards(df, shard_bytes=40_000).collect()
    n = sorted(r.n_docs for r in manifest)
    assert sum(n) == 4000 and n[-1] < 4 * n[len(n) // 2] and all(os.path.exists(p) for r in manifest for p in (r.tokens_path, r.documents_path))


def test_token_file_rows_are_views(spark, docs):
    m = token_files.write_shards(docs, sequence=16).first()
    reader = token_files.ShardReader(m.tokens_path, m.documents_path)
    ids, mask = reader.sequence_at(3)
    assert len(ids) == 16 and all(mask.to_pylist()) and ids.tolist() == np.concatenate(list(reader.read(48, 16))).tolist()


def test_encoder_equals_library():
    e, rng = token_files.Encoder(public_tokenizers.path("byte_bpe_50k.json")), random.Random(3)
    parts = ["a", "don't", " ", "  ", "\n", "\t", "é", "12", "...", "'s", "<|endoftext|>", " ", "漢", "Ġ", " Ġ"]
    for _ in range(2000):
        s = "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))
        assert np.frombuffer(e.encode([s])[0], e.kind).tolist() == e.tokenizer.encode(s, add_special_tokens=False).ids


def test_sharding_law(spark, docs, edge, empty):
    rows = sharding.shard(docs).collect()
    counts = collections.Counter(r["shard"] for r in rows)
    assert len(counts) == 16 and max(counts.values()) - min(counts.values()) <= 1
    for s in counts:
        assert sorted(r.slot for r in rows if r["shard"] == s) == list(range(counts[s]))
    assert {(r.doc_id, r.text_crc32, r["size"]) for r in rows} == {(r.doc_id, zlib.crc32(r.text.encode()), len(r.text.encode()) + 1) for r in docs.collect()}
    assert sharding.shard(edge).count() == len(EDGES) and sharding.shard(empty).count() == 0


def test_ring_moves_little():
    counts = {k: 100 for k in range(8192)}
    owner = lambda n: {(r["place"], k): r["shard"] for r in sharding.allocate(counts, n) for k in range(r["low"], r["high"])}
    a, b = owner(16), owner(17)
    assert sum(a[k] != b[k] for k in a) / len(a) < 0.35


def test_quality(spark, docs, edge, empty):
    rows = {r.doc_id: r for r in QUERIES["op4_quality"](spark, "/root/testdata/sf0.01").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    held = [k for k in labels if zlib.crc32(str(k).encode()) % 5 == 0]
    assert all(rows[k].held_out for k in held)
    assert np.mean([rows[k].predicted == labels[k] for k in held]) > 0.93
    assert np.mean([rows[k].predicted for k in held if labels[k]]) > 0.98
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    got = {r.doc_id: r.score for r in quality.score(edge, model).collect()}
    assert got[1] == got[2] == got[3] and all(0 <= s <= 1 for s in got.values()) and quality.score(empty, model).count() == 0
    assert {r.score for r in quality.score(edge, quality.fit(empty, spark.createDataFrame([], "doc_id long, quality int"))).collect()} == {0.5}


def test_word_features_are_those_of_each_word():
    whole, a, owner = quality.hashed([b"abc", b"de", b"abc"])
    assert whole[0] == whole[2] and sorted(a[owner == 0]) == sorted(a[owner == 2]) == sorted(quality.features([b"abc"]))


def test_quality_score_is_the_mean_of_all_features():
    rng = np.random.default_rng(3)
    table, text = rng.standard_normal(quality.BUCKETS), b"one two  two three one two \xc3\xa9"
    ids = quality.features(text.split())
    got = quality.Scorer(table, 0.25).score([None, text, text])
    assert got[0] == pytest.approx(1 / (1 + math.exp(-0.25))) and got[1] == got[2] == pytest.approx(1 / (1 + math.exp(-0.25 - table[ids].mean())))


def test_quality_sample_is_bounded_and_takes_long_texts(spark):
    """Good texts are all of 40 000 bytes; the sample stays within its bounds whatever repeats."""
    good, bad = "fine words here " * 2500, "junk trash noise"
    docs = spark.createDataFrame([(k, good if k % 2 else bad) for k in range(60)] * 2, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int")
    got = {r.doc_id: r.predicted for r in quality.score(docs, quality.fit(docs, labels)).collect()}
    assert got == {k: k % 2 for k in range(60)}
    assert {r.score for r in quality.score(docs, quality.fit(docs, labels, sample_rows=0)).collect()} == {0.5}
    assert quality.fit(docs, labels, sample_rows=5, sample_bytes=1)[1] != 0


EVENTS = "list string, action string, kind string, pattern string, event string, day date"


def test_url_filter_edges(spark):
    c = spark.createDataFrame([(1, "http://A.b.example.com:80/x?q", "2024-01-05", 0), (2, "https://u@b.example.com/x", "2024-01-10", 0), (3, None, "2024-01-05", 0), (4, "http://b.example.com/x", None, 0), (5, "nonsense", "2024-01-05", 0), (6, "http://b.example.com./x", "2024-01-09", 0)], "id long, url string, fetched string, host int")
    e = spark.createDataFrame([("l", "block", "domain", "b.example.com", "add", "2024-01-02"), ("l", "block", "domain", "b.example.com", "remove", "2024-01-10"), ("w", "allow", "url", "b.example.com/x", "add", "2024-01-09"), ("l", "block", "domain", None, "add", "2024-01-01")], EVENTS.replace("date", "string")).withColumn("day", F.col("day").cast("date"))
    got = {r.id: r for r in url_filter.filter_urls(c, e).collect()}
    assert [got[k].blocked for k in range(1, 7)] == [True, False, False, False, False, False]
    assert got[6].lists == "l,w" and got[2].lists == "w" and got[1].host == "a.b.example.com"
    assert url_filter.filter_urls(c, e.limit(0)).where("blocked").count() == 0 and url_filter.filter_urls(c.limit(0), e).count() == 0


def test_url_filter_keeps_columns_and_takes_hot_keys(spark):
    """Every host is below `com`, which is listed; half of the captures have no url or no day; names begin with underscores."""
    n = 600
    rows = [(k, f"http://h{k % 50}.com/{'p' * ((k + 1) % 3 * 5000)}{k % 7}" if k % 4 else None, "2024-01-05" if k % 3 else None, k, -k) for k in range(n)] * 2
    c = spark.createDataFrame(rows, "id long, URL string, fetched string, _host int, __x int").withColumn("lists", F.lit("old"))
    e = spark.createDataFrame([("tops", "block", "domain", "com", "add", "2024-01-02"), ("pages", "allow", "url", "h1.com/1", "add", "2024-01-02")], EVENTS.replace("date", "string")).withColumn("day", F.col("day").cast("date"))
    got = url_filter.filter_urls(c, e, url_col="URL").collect()
    assert got[0].__fields__ == ["id", "URL", "fetched", "_host", "__x", "host", "n_entries", "lists", "blocked"] and len(got) == 2 * n
    for r in got:
        there, free = bool(r.URL and r.fetched), r.URL == "http://h1.com/1"
        assert (r._host, r['__x']) == (r.id, -r.id) and r.blocked == (there and not free) and r.lists == ("" if not there else "pages,tops" if free else "tops")


def _components(texts, percent=85):
    sets = {}
    for k, t in texts.items():
        w = words(t)
        sets[k] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in keys}


def test_neardup_large_buckets(spark):
    """A family far larger than a block whose members link only to its base, one of near-links, copies and strangers."""
    rng = random.Random(5)
    base = [f"w{k}" for k in range(150)]
    texts = {0: " ".join(base)}
    for k in range(1, 90):
        w = list(base)
        for at in rng.sample(range(150), 2 + k % 4):
            w[at] = f"n{k}-{at}"
        texts[k + 3] = " ".join(w)
    for k in range(200, 300):
        texts[k] = " ".join(rng.choice(base) for _ in range(rng.randint(1, 60)))
    for k in range(300, 340):
        texts[k] = texts[k - 300] if k - 300 in texts else texts[200]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == _components(texts)


def test_neardup_edges(spark, edge, empty):
    rows = neardup.near_duplicates(edge).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(EDGES) and got[6].component_id == 5 and not got[6].kept and got[1].n_shingles == 0 and got[3].kept and got[None].component_id is None and got[8].n_shingles == 2
    assert neardup.near_duplicates(empty).count() == 0


def test_language_model(spark, edge, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    held = lambda k: zlib.crc32(str(k).encode()) % 7 == 2
    tokens = {k: [*words(t), "\n"] for k, t in texts.items()}
    c = collections.Counter(w for k, ws in tokens.items() if not held(k) for w in ws)
    n, v = sum(c.values()), len(c)
    got = {r.doc_id: r for r in language_model.score_documents(docs).collect()}
    for k, ws in tokens.items():
        r = got[k]
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) and r.score < 0
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(k), len(ws), sum(c[w] > 0 for w in ws), n)
    assert sum(r.score for r in got.values() if r.held_out) > 0.97 * sum(r.base_score for r in got.values() if r.held_out)
    rows = language_model.score_documents(edge).collect()
    assert len(rows) == len(EDGES) and {r.doc_id: r.n_tokens for r in rows}[1] == 1 and all(math.isfinite(r.score) for r in rows)
    assert language_model.score_documents(empty).count() == 0


def test_language_model_sums_to_one():
    counts = {f"w{k}".encode(): k % 7 + 2 for k in range(2000)} | {language_model.END: 5}
    v = language_model.Vocabulary(counts, sum(counts.values()) + 60, len(counts) + 40)
    net, h = language_model.Network(v), language_model.HIDDEN
    state = np.full((language_model.HEAD + 2, h), 0.3, np.float32)
    p = np.exp(net.logs(state, np.arange(language_model.HEAD + 2)).astype(float))
    assert p.sum() == pytest.approx(1, abs=1e-4)
    middle = sum(10 ** v.within[k] for k in range(language_model.HEAD, v.rare_from))
    assert middle == pytest.approx(1)


def test_lanes_do_not_change_scores():
    counts = {f"w{k}".encode(): 3 for k in range(50)} | {language_model.END: 5}
    v = language_model.Vocabulary(counts, sum(counts.values()), len(counts))
    net, rng = language_model.Network(v, 3), np.random.default_rng(0)
    outs = [rng.integers(0, 40, n) for n in (5, 300, 1, 70, 129, 64, 65)]
    together = language_model.log_likelihoods(net, outs, outs)
    alone = [language_model.log_likelihoods(net, [o], [o])[0] for o in outs]
    assert together == pytest.approx(alone, rel=1e-4)


def test_fingerprint(spark, docs, texts, edge, empty):
    got = {r.doc_id: r for r in fingerprint.fingerprints(docs).collect()}
    order, errors = sorted(texts), []
    grams = lambda t: {tuple(w[i : i + 5]) for w in [t.lower().split()] for i in range(max(1, len(w) - 4))}
    for i, k in enumerate(order):
        t, u = texts[k], texts[order[(i + 1) % len(order)]]
        cut = len(t) // 2
        e = t[: len(t) - cut] + u[:cut]
        r = got[k]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        a, b = grams(t), grams(e)
        errors.append(abs(r.near_edited - len(a & b) / len(a | b)))
    assert np.mean(errors) < 0.05
    rows = fingerprint.fingerprints(edge).collect()
    same = {r.fingerprint for r in rows if r.doc_id in (5, 6)}
    assert len(rows) == len(EDGES) and len(same) == 1 and fingerprint.fingerprints(empty).count() == 0
    assert fingerprint.fingerprints(edge.where("doc_id = 4")).first().near_next == 1


def test_fingerprint_of_many_rows_of_one_id(spark):
    """Nine tenths of the rows have no id: their pieces stay even, and each still stands beside the next one."""
    df = spark.createDataFrame([(None if k % 10 else k, f"text {k} of its own") for k in range(9000)], "doc_id long, text string")
    pieces, _ = fingerprint.in_pieces(df, 300)
    sizes = sorted(r[1] for r in pieces.where("_copy = 0").groupBy("_piece").count().collect())
    assert sum(sizes) == 9000 and sizes[-1] < 2 * 300
    order = {r.text: k for k, r in enumerate(df.orderBy(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text").collect())}
    texts = list(order)
    got = fingerprint.fingerprints(df).collect()
    assert len(got) == 9000
    want = collections.Counter()
    for k, t in enumerate(texts):
        u = texts[(k + 1) % len(texts)]
        half = len(t) // 2
        want[hashlib.sha256((t[: len(t) - half] + u[:half]).encode()).hexdigest()] += 1
    assert collections.Counter(r.edited_sha256 for r in got) == want


def test_fingerprint_is_the_plain_algorithm(spark):
    df = spark.createDataFrame([(1, "a b c d e f g h"), (2, "a"), (3, " ".join(str(k) for k in range(900)))], "id int, text string")
    got = {r.id: r for r in fingerprint.add_fingerprint(df, F.col("text"), "fp").collect()}
    steps, _ = fingerprint._spark_steps(spark)
    for r in df.collect():
        w = r.text.split()
        rows = spark.createDataFrame([(k, *w[k : k + 5], *[None] * (5 - len(w[k : k + 5]))) for k in range(max(1, len(w) - 4))], "k int, a string, b string, c string, d string, e string")
        hashes = [x.h for x in rows.select(F.xxhash64(*[F.xxhash64(c) if n < len(w) else F.lit(None).cast("long") for n, c in enumerate("abcde")]).alias("h")).collect()]
        bins = {}
        for h in hashes:
            b = (h >> 56) + 128
            bins[b] = min(bins.get(b, h), h)
        want = []
        for p in range(256):
            q = p
            while q not in bins:
                q = (q + steps[p]) % 256
            want.append(bins[q] & 15)
        assert got[r.id].fp == want


def test_bpe(spark, docs, edge, empty):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for frame in (docs, edge):
        rows = bpe.decode(bpe.encode(frame)).collect()
        for r in rows:
            ids = library.encode(r.text or "", add_special_tokens=False).ids
            assert list(r["ids"]) == ids and r.decoded == library.decode(ids, skip_special_tokens=False)
    r = bpe.round_trip(docs).first()
    assert r.ids_sha256 == hashlib.sha256(np.array(library.encode(r.text, add_special_tokens=False).ids, "<u4").tobytes()).hexdigest()
    assert bpe.encode(empty).count() == 0


def test_html(spark):
    page = """<html><head><title>T</title><script>var a="<p>";</script></head><body><header><h1>Site</h1></header><nav><a href=1>x</a></nav>
    <div class="cookie-notice">We use cookies</div><main><article><header><h1>Head &amp; line</h1></header><p>First   para
    graph with <b>bold</b> &#233;t&eacute;.</p><div class="ad">Buy!</div><ul><li>one</li><li>two</li></ul><form><input><p>form</p></form>
    <section id="comments"><article><p>Nice post</p></article></section></article></main><aside>side</aside><footer>f</footer></body></html>"""
    assert html.extract(page) == "Head & line\nFirst para graph with bold été.\none\ntwo"
    assert html.extract(None) == html.extract("") == html.extract("<p") == ""
    plain = "<body><ul>" + "<li><a href=/>m</a></li>" * 8 + "</ul><div><p>" + "long text " * 30 + "</p><p>" + "more text " * 25 + "</p></div><ul>" + "<li><a href=/>z</a></li>" * 8 + "</ul></body>"
    assert html.extract(plain) == ("long text " * 30).strip() + "\n" + ("more text " * 25).strip()
    assert html.extract("<article><p>cut off &am") == "cut off &am" and len(html.extract("<p>" + "word " * 100000 + "</p>")) == 499999
    df = spark.createDataFrame([(1, "u", None), (2, "u", page)], "page_id long, url string, html string")
    assert [r.n_chars for r in html.extract_text(df).orderBy("page_id").collect()] == [0, len("Head & line\nFirst para graph with bold été.\none\ntwo")] and html.extract_text(df.limit(0)).count() == 0


def _plain_content(lines):
    """The clusters by their formulas, line by line."""
    n = len(lines)
    ratio = [max(0, len(x.text) - x.linked) / max(1, x.tags) * (html.MARK if x.region else 1) for x in lines]
    weight = lambda d: math.exp(-0.5 * (d / html.SIGMA) ** 2)
    near = lambda i: range(max(0, i - 3), min(n, i + 4))
    score = [sum(ratio[j] * weight(i - j) for j in near(i)) / sum(weight(i - j) for j in near(i)) for i in range(n)]
    runs = []
    for i in range(n):
        if score[i] >= html.THRESHOLD * sum(score) / n:
            if runs and runs[-1][-1] == i - 1 and lines[i].region == lines[i - 1].region:
                runs[-1].append(i)
            else:
                runs.append([i])
    sums, kept = [sum(score[i] for i in r) for r in runs], set()
    menu = lambda x: x.linked > html.LINKS * len(x.text)
    for r, total in zip(runs, sums):
        held = [lines[i] for i in r if not menu(lines[i])]
        if total >= html.SHARE * max(sums) and held:
            if held[0].region:
                kept |= {i for i in range(n) if lines[i].region == held[0].region}
            else:
                shared = [c for c in held[0].path if all(c in x.path for x in held)]
                kept |= {i for i in range(n) if not lines[i].region and not menu(lines[i]) and (not shared or shared[-1] in lines[i].path)}
    return "\n".join(lines[i].text for i in sorted(kept))


def test_html_query_is_the_plain_method(spark):
    pages = {r.page_id: r.html or "" for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = {r.page_id: r for r in QUERIES["op10_html"](spark, SF).collect()}
    assert got.keys() == pages.keys()
    for k, page in pages.items():
        assert got[k].text == _plain_content(html.lines_of(page)) and got[k].n_chars == len(got[k].text)
        unmarked = page.replace("<article>", "<div>").replace("</article>", "</div>")
        assert html.extract(unmarked) == _plain_content(html.lines_of(unmarked))


PAR = "A sentence of the article that goes on for a while, with a comma and a full stop. "


def _link_list(n):
    return "<ul>" + "".join(f'<li><a href="/{k}">Item {k}</a></li>' for k in range(n)) + "</ul>"


UNMARKED = {
    # An article's tail: a short heading and a list after the last long paragraph.
    "tail": (f"<body><div>{_link_list(9)}</div><div><h1>Title</h1>" + f"<p>{PAR * 7}</p>" * 8 + "<h2>In short</h2><ul>" + "<li>a short point</li>" * 6 + f"</ul></div><div>{_link_list(12)}</div></body>", ["Title", *[(PAR * 7).strip()] * 8, "In short", *["a short point"] * 6]),
    "table": (f"<table><tr><td>{_link_list(15)}</td><td><h2>Head</h2><p>{PAR * 4}</p><p>Short one.</p><p>{PAR * 5}</p></td></tr></table>", ["Head", (PAR * 4).strip(), "Short one.", (PAR * 5).strip()]),
    "names": (f'<div class="site-header">Name of the site</div><div class="post-body"><h2 id="side-effects">Side effects</h2><p>{PAR * 3}</p><section id="related-work"><h2>Related work</h2><p>{PAR * 4}</p></section></div><div class="comment-list"><p>{PAR}</p></div><div class="cookie-notice">{PAR * 9}</div>', ["Side effects", (PAR * 3).strip(), "Related work", (PAR * 4).strip()]),
    "sections": (f"<div>{_link_list(6)}</div><main><section><h2>One</h2><p>{PAR * 3}</p></section><section><h2>Two</h2><p>{PAR * 2}</p></section></main><div><p>Made by someone</p></div>", ["One", (PAR * 3).strip(), "Two", (PAR * 2).strip()]),
}


@pytest.mark.parametrize("name", sorted(UNMARKED))
def test_html_pages_by_hand(name):
    page, want = UNMARKED[name]
    assert html.extract(page).split("\n") == want


def test_html_precision_and_recall_without_marks():
    """Random pages of plain divs: long and short paragraphs among menus, teasers and footers."""
    rng, right, kept, there = random.Random(11), 0, 0, 0
    for k in range(60):
        body = [f"b{k} " + PAR * rng.randint(1, 6) if rng.random() < 0.7 else f"b{k} short line {j}" for j in range(rng.randint(6, 20))]
        teasers = "".join(f'<div><a href="/{j}">Teaser {j} of another page</a> read on</div>' for j in range(rng.randint(0, 8)))
        page = f"<body><div>{_link_list(rng.randint(3, 15))}</div><div>" + "".join(f"<p>{t}</p>" for t in body) + f"</div><div>{teasers}</div><div><p>Terms and imprint</p></div></body>"
        got, want = collections.Counter(html.extract(page).split()), collections.Counter(" ".join(body).split())
        right, kept, there = right + (got & want).total(), kept + got.total(), there + want.total()
    assert right / kept > 0.99 and right / there > 0.99


def test_html_keeps_columns_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "u", "<article><p>one</p></article>", "x", 5)] * 3 + [(1, "u", None, None, None)], "page_id long, url string, html string, TEXT string, n_lines int")
    got = html.extract_text(df).collect()
    assert got[0].__fields__ == ["page_id", "url", "html", "n_lines", "text", "n_chars"]
    assert sorted((r.text, r.n_chars, r.n_lines) for r in got if r.html) == [("one", 3, 5)] * 3


def test_bpe_keeps_columns(spark):
    df = spark.createDataFrame([(1, "one two", 7, "x")] * 2, "doc_id long, text string, IDS int, note string")
    got = bpe.decode(bpe.encode(df)).collect()
    assert got[0].__fields__ == ["doc_id", "text", "note", "ids", "decoded"] and {(r.note, r.decoded) for r in got} == {("x", "one</w> two</w>")}


def test_pipeline(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [r for r in docs.collect()]
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    good = {r.doc_id for r in quality.score(docs, model).where("predicted = 1").collect()}
    kept = {r.doc_id: r.text for r in kept if r.doc_id in good}
    kept = {k: kept[k] for k, (_, c) in _components(kept, 80).items() if c == k}
    found = decontaminate.build([(str(r.item_id), r.text.encode()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    library, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), {}
    for k, t in kept.items():
        w = decontaminate.words_of(t.encode())
        hit, items = np.zeros(len(w), bool), set()
        decontaminate.scan(found, w, hit, items)
        if not hit.any():
            want[k] = len(library.encode(t, add_special_tokens=False).ids)
    assert {r.doc_id: r.n_tokens for r in P.run(spark, SF).collect()} == want
