"""The queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from . import audio, byte_bpe, centroids, collocations, jaccard_join, main_text, one_bit_search, packing, pii, piece_table, substring_dedup, toxicity, url_filter

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_ngram_jaccard_join": jaccard_join.op2_ngram_jaccard_join,
    "op3_nearest_neighbours": one_bit_search.op3_nearest_neighbours,
    "op4_substring_dedup": substring_dedup.op4_substring_dedup,
    "op5_html_main_text": main_text.op5_html_main_text,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_best_fit_packing": packing.op7_best_fit_packing,
    "op8_pii": pii.op8_pii,
    "op9_audio_features": audio.op9_audio_features,
    "op10_sentencepiece": piece_table.op10_sentencepiece,
    "op11_byte_bpe": byte_bpe.op11_byte_bpe,
    "op12_collocations": collocations.op12_collocations,
    "op13_centroid_clustering": centroids.op13_centroid_clustering,
}
SQL: dict[str, str] = {"op6_url_filter": url_filter.SQL, "op12_collocations": collocations.SQL, "op13_centroid_clustering": centroids.SQL}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)
