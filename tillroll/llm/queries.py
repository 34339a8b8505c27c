"""The registered queries of this subpackage and their DuckDB twins."""

from __future__ import annotations

from . import bpe, centroids, jaccard, langid, mixing, negatives, pii, pitman_yor, quality, suffix, toxicity, warc, winnow

QUERIES = {
    "op4_suffix_dedup": suffix.op4_suffix_dedup,
    "op3_ngram_join": jaccard.op3_ngram_join,
    "op2_language_id": langid.op2_language_id,
    "language_id_pages": langid.language_id_pages,
    "op5_toxicity": toxicity.op5_toxicity,
    "op1_warc": warc.op1_warc,
    "op6_winnowing": winnow.op6_winnowing,
    "op7_pii": pii.op7_pii,
    "op8_quality_rules": quality.op8_quality_rules,
    "op9_mix_sources": mixing.op9_mix_sources,
    "op10_byte_bpe": bpe.op10_byte_bpe,
    "op11_hard_negatives": negatives.op11_hard_negatives,
    "op12_centroid_clustering": centroids.op12_centroid_clustering,
    "op13_pitman_yor": pitman_yor.op13_pitman_yor,
}

ORACLE: dict[str, str] = {
    "op1_warc": warc.OP1_SQL,
    "op9_mix_sources": mixing.OP9_SQL,
    "op11_hard_negatives": negatives.OP11_SQL,
    "op12_centroid_clustering": centroids.OP12_SQL,
}
