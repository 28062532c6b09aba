"""The registered queries of the operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from termweave.llm import decontamination, hardnegatives, htmltext, jaccard, language, lines, neighbours, packing, quality, resampling, sharding, substrings, warc

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_jaccard_join": jaccard.op2_jaccard_join,
    "op3_sharding": sharding.op3_sharding,
    "op4_quality": quality.op4_quality,
    "op5_substring_dedup": substrings.op5_substring_dedup,
    "op6_nearest": neighbours.op6_nearest,
    "op7_language_id": language.op7_language_id,
    "op8_warc": warc.op8_warc,
    "op9_line_dedup": lines.op9_line_dedup,
    "op10_decontamination": decontamination.op10_decontamination,
    "op11_hard_negatives": hardnegatives.op11_hard_negatives,
    "op12_main_text": htmltext.op12_main_text,
    "op13_resampling": resampling.op13_resampling,
}

ORACLE: dict[str, str] = {"op2_jaccard_join": jaccard.ORACLE, "op8_warc": warc.ORACLE, "op9_line_dedup": lines.ORACLE, "op11_hard_negatives": hardnegatives.ORACLE, "op13_resampling": resampling.ORACLE}
