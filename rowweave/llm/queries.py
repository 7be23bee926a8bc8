"""The queries and oracle SQL of this subpackage."""

from __future__ import annotations

from . import chains, decontaminate, forest, langid, licences, mixing, ppm, shards, transport, webtext


def queries() -> dict:
    return {
        "op1_language_id": langid.op1_language_id,
        "op2_media": transport.op2_media,
        "op3_jaccard_join": forest.op3_jaccard_join,
        "op4_decontamination": decontaminate.op4_decontamination,
        "op5_html_extraction": webtext.op5_html_extraction,
        "op6_sharding": shards.op6_sharding,
        "op7_substring_dedup": chains.op7_substring_dedup,
        "op8_lm_scoring": ppm.op8_lm_scoring,
        "op9_licence_scan": licences.op9_licence_scan,
        "op10_mixing": mixing.op10_mixing,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_decontamination": decontaminate.ORACLE_OP4, "op10_mixing": mixing.ORACLE_OP10}
