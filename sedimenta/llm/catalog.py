"""Queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import bpe, decontaminate, embedding_dedup, jaccard_join, language_id, lm_score, substring_dedup, token_files, url_filter, warc


def queries() -> dict:
    return {
        "op1_language_id": language_id.op1,
        "op2_jaccard_join": jaccard_join.op2,
        "op3_token_files": token_files.op3,
        "op4_warc": warc.op4,
        "op5_lm_score": lm_score.op5,
        "op6_decontaminate": decontaminate.op6,
        "op7_substring_dedup": substring_dedup.op7,
        "op8_url_filter": url_filter.op8,
        "op9_bpe": bpe.op9,
        "op10_embedding_dedup": embedding_dedup.op10,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_jaccard_join": jaccard_join.OP2_SQL, "op4_warc": warc.OP4_SQL, "op6_decontaminate": decontaminate.OP6_SQL, "op7_substring_dedup": substring_dedup.OP7_SQL, "op8_url_filter": url_filter.OP8_SQL, "op10_embedding_dedup": embedding_dedup.OP10_SQL}
