"""The opN_ queries and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from tropica.llm import decontam, hamming, html_text, neardup, packing, pfor, quality, substrings, transducer, warc


def queries() -> dict:
    return {"op1_html_text": html_text.op1_html_text, "op2_quality": quality.op2_quality, "op3_multi_index_hashing": hamming.op3_multi_index_hashing, "op4_substring_dedup": substrings.op4_substring_dedup, "op5_minhash_near_dedup": neardup.op5_minhash_near_dedup, "op6_token_ids": pfor.op6_token_ids, "op7_decontamination": decontam.op7_decontamination, "op8_warc": warc.op8_warc, "op9_best_fit_packing": packing.op9_best_fit_packing, "op10_token_counts": transducer.op10_token_counts}


def oracle_sql() -> dict[str, str]:
    return {"op4_substring_dedup": substrings.OP4_SQL, "op5_minhash_near_dedup": neardup.OP5_SQL, "op7_decontamination": decontam.oracle(), "op8_warc": warc.OP8_SQL}
