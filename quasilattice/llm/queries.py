"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import chat_collapse, decontaminate, jaccard_join, lang_crf, media_jpeg, mixing, pfor, secret_scan, substring_dedup, toxicity_fm


def queries() -> dict:
    return {
        "op1_secret_scan": secret_scan.op1_secret_scan,
        "op2_media_columns": media_jpeg.op2_media_columns,
        "op3_substring_dedup": substring_dedup.op3_substring_dedup,
        "op4_chat_collapse": chat_collapse.op4_chat_collapse,
        "op5_jaccard_join": jaccard_join.op5_jaccard_join,
        "op6_language_id": lang_crf.op6_language_id,
        "op7_toxicity": toxicity_fm.op7_toxicity,
        "op8_source_mixing": mixing.op8_source_mixing,
        "op9_decontaminate": decontaminate.op9_decontaminate,
        "op10_token_output": pfor.op10_token_output,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_secret_scan": secret_scan.ORACLE_SQL, "op4_chat_collapse": chat_collapse.ORACLE_SQL}
