"""Queries of this subpackage and their SQL, for the entry module."""

from __future__ import annotations

from quillspark.llm import bpe_sql, exact_dedup, language_id, nearest, packing, runs, sharding, simhash, token_count, topk, toxicity, transcripts, whitening

QUERIES = {
    "op1_toxicity": toxicity.query,
    "op2_sharding": sharding.query,
    "op3_packing": packing.query,
    "op4_token_count": token_count.query,
    "op5_nearest": nearest.query,
    "op6_simhash": simhash.query,
    "op7_exact_dedup": exact_dedup.query,
    "op8_language": language_id.query,
    "op9_bpe_round_trip": bpe_sql.query,
    "op10_transcripts": transcripts.query,
    "op11_runs": runs.query,
    "op12_whitening": whitening.query,
    "op13_exact_topk": topk.query,
}

ORACLE_SQL = {"op7_exact_dedup": exact_dedup.SQL, "op13_exact_topk": topk.SQL}
