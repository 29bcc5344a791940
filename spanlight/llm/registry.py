"""The subpackage's queries and the SQL that some of them are held against."""

from __future__ import annotations

from . import byte_bpe, decontaminate, exact_dedup, line_dedup, near_dedup, quality, suffix_dedup, suffix_tree_lm, token_table, toxicity


def queries():
    return {
        "op1_byte_bpe": byte_bpe.op1_byte_bpe,
        "op2_quality": quality.op2_quality,
        "op3_line_dedup": line_dedup.op3_line_dedup,
        "op4_decontaminate": decontaminate.op4_decontaminate,
        "op5_minhash": near_dedup.op5_minhash,
        "op6_token_table": token_table.op6_token_table,
        "op7_exact_dedup": exact_dedup.op7_exact_dedup,
        "op8_lm": suffix_tree_lm.op8_lm,
        "op9_toxicity": toxicity.op9_toxicity,
        "op10_suffix_dedup": suffix_dedup.op10_suffix_dedup,
    }


def oracle_sql():
    return {
        "op3_line_dedup": line_dedup.ORACLE_SQL,
        "op4_decontaminate": decontaminate.ORACLE_SQL,
        "op7_exact_dedup": exact_dedup.ORACLE_SQL,
    }
