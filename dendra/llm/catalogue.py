"""The subpackage's queries, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from dendra.llm import queries as q
from dendra.llm import sql


def queries() -> dict:
    return {
        "op1_secret_scans": q.secret_scans,
        "op2_lm_scoring": q.lm_scores,
        "op3_quality_rules": q.quality_rules,
        "op4_url_filters": q.url_filters,
        "op5_packing": q.packed,
        "op6_exact_topk": q.exact_top_k,
        "op7_simhash": q.near_duplicates,
        "op8_sentencepiece": q.sentencepiece_round_trip,
        "op9_sharding": q.shards,
        "op10_chat": q.chats,
        "op11_whitening": q.whitened,
        "op12_fill_in_middle": q.fill_in_the_middle,
        "op13_minhash": q.minhash_groups,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    piped = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return piped | {
        "op2_lm_scoring": sql.LM_SCORES,
        "op3_quality_rules": sql.QUALITY_RULES,
        "op6_exact_topk": sql.EXACT_TOP_K,
        "op10_chat": sql.CHATS,
        "op12_fill_in_middle": sql.FILL_IN_MIDDLE,
    }
