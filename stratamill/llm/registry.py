"""Queries of this subpackage and their SQL, for __spark_entry__."""

from __future__ import annotations

import corpus_pipeline
from stratamill.llm import clustering, conversations, decontam, langid, licenses, lm, mixing, neardup, ogg, rollups, secrets, tokens, toxicity


def queries() -> dict:
    return {
        "pipeline": corpus_pipeline.run,
        "op1_secret_scan": secrets.op1_secret_scan,
        "op2_near_duplicates": neardup.op2_near_duplicates,
        "op3_token_ids": tokens.op3_token_ids,
        "op4_mixing": mixing.op4_mixing,
        "op5_license_scan": licenses.op5_license_scan,
        "op6_lm_score": lm.op6_lm_score,
        "op7_token_rollups": rollups.op7_token_rollups,
        "rollups_of_words": rollups.rollups_of_words,
        "op8_ogg_media": ogg.op8_ogg_media,
        "op9_decontaminate": decontam.op9_decontaminate,
        "op10_language_id": langid.op10_language_id,
        "op11_conversation_repair": conversations.op11_conversation_repair,
        "op12_centroid_clustering": clustering.op12_centroid_clustering,
        "op13_toxicity": toxicity.op13_toxicity,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_secret_scan": secrets.ORACLE_OP1,
        "op4_mixing": mixing.ORACLE_OP4,
        "op5_license_scan": licenses.ORACLE_OP5,
        "rollups_of_words": rollups.ORACLE_WORDS,
        "op11_conversation_repair": conversations.ORACLE_OP11,
        "op12_centroid_clustering": clustering.ORACLE_OP12,
    }
