"""The registered queries of this subpackage and their DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from . import bpe, line_dedup, lm_scoring, mixing, pii, set_join, toxicity, url_filter, vector_dedup, vector_search

QUERIES = {
    "op1_embedding_dedup": vector_dedup.op1_embedding_dedup,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_lm_scoring": lm_scoring.op3_lm_scoring,
    "op4_ngram_jaccard_join": set_join.op4_ngram_jaccard_join,
    "op5_mixing": mixing.op5_mixing,
    "op6_nearest_neighbours": vector_search.op6_nearest_neighbours,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_pii": pii.op8_pii,
    "op9_url_filters": url_filter.op9_url_filters,
    "op10_byte_bpe": bpe.op10_byte_bpe,
}


def oracles() -> dict[str, str]:
    return {"op2_line_dedup": line_dedup.ORACLE, "op9_url_filters": url_filter.oracle()}
