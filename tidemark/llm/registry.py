"""The subpackage's queries and their SQL, for the driver."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import chat, decontaminate, language, mixing, neighbours, quality, simhash, token_ids, toxicity, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mixing": mixing.op1_mixing,
        "op2_decontaminate": decontaminate.op2_decontaminate,
        "op3_chat": chat.op3_chat,
        "op4_quality": quality.op4_quality,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_language": language.op6_language,
        "op7_warc": warc.op7_warc,
        "op8_simhash": simhash.op8_simhash,
        "op9_token_ids": token_ids.op9_token_ids,
        "op10_neighbours": neighbours.op10_neighbours,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_decontaminate": decontaminate.OP2_SQL,
        "op3_chat": chat.OP3_SQL,
        "op7_warc": warc.OP7_SQL,
    }
