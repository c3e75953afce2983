"""The queries of this subpackage and the SQL that checks those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, exact_dedup, fill_middle, html_text, licenses, line_dedup, near_dedup, packing, shards, spelling, token_files, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_files": token_files.op1_token_files,
        "op2_chat_format": chat.op2_chat_format,
        "op3_shard_compaction": shards.op3_shard_compaction,
        "op4_license_scan": licenses.op4_license_scan,
        "op5_exact_dedup": exact_dedup.op5_exact_dedup,
        "op6_decontamination": decontaminate.op6_decontamination,
        "op7_packing": packing.op7_packing,
        "op8_html_text": html_text.op8_html_text,
        "op9_toxicity": toxicity.op9_toxicity,
        "op10_near_dedup": near_dedup.op10_near_dedup,
        "op11_line_dedup": line_dedup.op11_line_dedup,
        "op12_fill_middle": fill_middle.op12_fill_middle,
        "op13_spelling": spelling.op13_spelling,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_chat_format": chat.OP2_SQL,
        "op4_license_scan": licenses.OP4_SQL,
        "op5_exact_dedup": exact_dedup.OP5_SQL,
        "op8_html_text": html_text.OP8_SQL,
        "op11_line_dedup": line_dedup.OP11_SQL,
        "op12_fill_middle": fill_middle.OP12_SQL,
    }
