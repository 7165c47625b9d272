"""Operators that take all of their input: cases that a sample, a fixed threshold or a missing row key would lose."""

import random

import corpus_pipeline
import numpy as np
import pytest
from streetloom.llm import language_model, neardup

DOCS = "doc_id long, text string, lang string, source string, n_chars double"


def test_language_model_learns_from_long_documents(spark):
    """All texts are longer than the sample takes, each word foretells the next."""
    rows = [(k, " ".join(f"word{(k + i) % 60}" for i in range(6000))) for k in range(40)]
    assert min(len(t) for _, t in rows) > language_model.SAMPLE_LONGEST
    got = [r for r in language_model.score_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect() if r.held_out]
    assert got and sum(r.score for r in got) > 0.95 * sum(r.base_score for r in got)


def test_language_model_sums_rows_by_key():
    """No rows, one row, runs about the length from which a run is summed on its own, and far longer ones."""
    rng, most = np.random.default_rng(2), language_model.LONG_RUN
    keys = rng.permutation(np.repeat(np.arange(9), [0, 1, 2, most - 1, most, most + 1, 0, 20 * most, 3]))
    rows = rng.standard_normal((len(keys), 6)).astype(np.float32)
    want = np.array([rows[keys == k].sum(axis=0) for k in range(10)])
    assert language_model.sums_of_rows(rows, keys, 10) == pytest.approx(want, abs=1e-3)
    assert not language_model.sums_of_rows(rows[:0], keys[:0], 10).any()


def test_language_model_gradients_are_those_of_its_likelihood():
    """By central differences along a random direction of each array of weights, over documents that start within lanes."""
    counts = {f"w{k}".encode(): 5 + k % 9 for k in range(1700)} | {language_model.END: 40}
    v = language_model.Vocabulary(counts, sum(counts.values()) + 30, len(counts) + 20)
    net, rng = language_model.Network(v, 4), np.random.default_rng(3)
    docs = [rng.integers(0, language_model.HEAD + 2, n).astype(np.int16) for n in (7, 3, 9, 1, 5, 8)]
    lanes = list(language_model.streams(docs, docs, [[0, 1], [2, 3], [4], [5]]))
    target, feed, fresh, owner = next(language_model.windows(sorted(lanes, key=lambda x: -len(x[0])), 10))
    g, _ = net.train_window(feed, target, fresh, owner >= 0, np.zeros((4, language_model.HIDDEN), np.float32))
    for name, w in net.p.items():
        way, ends = rng.standard_normal(w.shape).astype(np.float32), []
        for step in (0.01, -0.01):
            net.p[name] = w + np.float32(step) * way
            ends.append(-language_model.log_likelihoods(net, docs, docs).sum())
        net.p[name] = w
        assert float(np.vdot(g[name], way)) == pytest.approx((ends[0] - ends[1]) / 0.02, rel=0.02, abs=0.02), name


def _near_texts():
    """Pairs of 120 runs of words, one to three spoiled words apart at 5-word runs: similarities from 0.77 to 0.92."""
    out, rng = {}, random.Random(7)
    for k in range(60):
        w = [f"p{k}w{i}" for i in range(124)]
        other = list(w)
        for at in rng.sample(range(10, 114, 10), 1 + k % 3):
            other[at] = f"q{k}at{at}"
        out[2 * k], out[2 * k + 1] = " ".join(w), " ".join(other)
    return out


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates_take_the_threshold(spark, percent):
    texts = _near_texts()
    sets = {k: neardup.runs(t.encode()) for k, t in texts.items()}
    want = {}
    for k in range(0, len(texts), 2):
        both = len(np.intersect1d(sets[k], sets[k + 1]))
        near = 100 * both >= percent * (len(sets[k]) + len(sets[k + 1]) - both)
        want |= {k: k, k + 1: k if near else k + 1}
    got = neardup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), percent=percent)
    assert {r.doc_id: r.component_id for r in got.collect()} == want and len(set(want.values())) < len(want)


def test_pipeline_links_from_eighty(spark):
    texts = _near_texts()
    docs = spark.createDataFrame([(k, t, "en", "x", 1.0) for k, t in texts.items()], DOCS)
    want = {r.doc_id for r in neardup.near_duplicates(docs, percent=80).where("kept").collect()}
    at_85 = {r.doc_id for r in neardup.near_duplicates(docs, percent=85).where("kept").collect()}
    assert want < at_85 and {r.doc_id for r in corpus_pipeline.neardup_stage(spark, docs, "").collect()} == want


def test_pipeline_keeps_null_ids_and_one_of_repeated_rows(spark):
    rows = [(None, "a text without an id that is unlike others"), (None, None), *[(1, "one text that is in the table three times")] * 3, (2, "one text that is in the table three times"), (3, "another text of its own")]
    docs = spark.createDataFrame([(k, t, "en", "x", 1.0) for k, t in rows], DOCS)
    got = corpus_pipeline.neardup_stage(spark, docs, "").collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == sorted((k or 0, t or "") for k, t in [*rows[:3], rows[-1]])


def test_pipeline_drops_every_leak_and_no_clean_document(spark, tmp_path):
    """A benchmark passage within a long text is far less than a twentieth of it."""
    passage = " ".join(f"secret{k}" for k in range(20))
    plain = " ".join(f"word{k}" for k in range(3000))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, plain), (2, f"{plain} {passage} {plain}"), (3, passage), (4, None), (5, ""), (None, "kept"), (None, passage)]
    docs = spark.createDataFrame([(k, t, "en", "x", 1.0) for k, t in rows], DOCS)
    got = corpus_pipeline.decontaminate_stage(spark, docs, str(tmp_path))
    assert got.columns == docs.columns and sorted((r.doc_id or 0) for r in got.collect()) == [0, 1, 4, 5]


def test_pipeline_takes_an_empty_table(spark):
    empty = spark.createDataFrame([], DOCS)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "/root/testdata/sf0.001").count() == 0, name
