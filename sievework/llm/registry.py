"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import ann, centroids, html_text, importance, merkle, mixing, ngram_join, packing, quality, substring_dedup, suffix_dedup, toxicity, warc

QUERIES = {
    f.__name__: f
    for f in (
        packing.op1_best_fit_packing,
        toxicity.op2_toxicity,
        substring_dedup.op3_substring_dedup,
        merkle.op4_merkle_fingerprints,
        html_text.op5_html_extraction,
        quality.op6_quality,
        mixing.op7_mixing,
        suffix_dedup.op8_suffix_dedup,
        ngram_join.op9_ngram_join,
        ann.op10_nearest_neighbours,
        centroids.op11_centroid_clustering,
        warc.op12_warc,
        importance.op13_importance_resampling,
    )
}
ORACLES = {
    "op3_substring_dedup": substring_dedup.ORACLE,
    "op4_merkle_fingerprints": merkle.ORACLE,
    "op8_suffix_dedup": suffix_dedup.ORACLE,
    "op9_ngram_join": ngram_join.ORACLE,
    "op11_centroid_clustering": centroids.ORACLE,
    "op12_warc": warc.ORACLE,
    "op13_importance_resampling": importance.ORACLE,
}
