"""Queries of this subpackage for the entry module: each applies its operator to its whole table."""

from __future__ import annotations

from . import bpe, clusters, decontaminate, fingerprint, html, language_model, merkle, neardup, quality, sharding, simhash, token_files, url_filter
from .oracles import ORACLES


def pipeline(spark, sf_dir: str):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_decontaminate": decontaminate.query,
    "op2_token_files": token_files.query,
    "op3_bounded_ring": sharding.query,
    "op4_quality": quality.query,
    "op5_url_filter": url_filter.query,
    "op6_neardup": neardup.query,
    "op7_language_model": language_model.query,
    "op8_fingerprint": fingerprint.query,
    "op9_bpe": bpe.query,
    "op10_html": html.query,
    "op11_simhash": simhash.query,
    "op12_merkle_manifest": merkle.query,
    "op13_centroid_clustering": clusters.query,
    "pipeline": pipeline,
}
