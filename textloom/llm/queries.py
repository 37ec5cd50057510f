"""The queries of this folder by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from textloom.llm import decontaminate, html_text, language, license_scan, line_dedup, media, negatives, packing, pieces, sharding, simhash, toxicity, whitening

QUERIES = {
    "op1_license_scan": license_scan.op1_license_scan,
    "op2_sharding": sharding.op2_sharding,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_packing": packing.op4_packing,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_simhash": simhash.op6_simhash,
    "op7_language_id": language.op7_language_id,
    "op8_html_extraction": html_text.op8_html_extraction,
    "op9_media_columns": media.op9_media_columns,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_sentencepiece": pieces.op11_sentencepiece,
    "op12_hard_negatives": negatives.op12_hard_negatives,
    "op13_whitening": whitening.op13_whitening,
}

ORACLES: dict[str, str] = {"op3_line_dedup": line_dedup.ORACLE, "op12_hard_negatives": negatives.ORACLE}
