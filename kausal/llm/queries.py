"""Queries of the pipeline operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, chat, embedding, exact_dedup, fim, langid, minhash, mixing, quality, resample, toxicity, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_byte_bpe": bpe.op1_byte_bpe,
        "op2_language_id": langid.op2_language_id,
        "op3_exact_dedup": exact_dedup.op3_exact_dedup,
        "op4_embedding_near_dedup": embedding.op4_embedding_near_dedup,
        "op5_warc": warc.op5_warc,
        "op6_minhash_near_dedup": minhash.op6_minhash_near_dedup,
        "op7_mixing": mixing.op7_mixing,
        "op8_quality": quality.op8_quality,
        "op9_chat_format": chat.op9_chat_format,
        "op10_toxicity": toxicity.op10_toxicity,
        "op11_fill_in_middle": fim.op11_fill_in_middle,
        "op12_importance_resampling": resample.op12_importance_resampling,
        "op13_nearest": ann.op13_nearest,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_exact_dedup": exact_dedup.ORACLE,
        "op4_embedding_near_dedup": embedding.ORACLE,
        "op5_warc": warc.ORACLE,
        "op6_minhash_near_dedup": minhash.ORACLE,
        "op9_chat_format": chat.ORACLE,
        "op11_fill_in_middle": fim.ORACLE,
        "op12_importance_resampling": resample.ORACLE,
    }
