"""The thin queries over the corpus operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, dedup, lm, media, mixing, packing, pii, quality, repair, repeats, secret_scan, simhash, whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_nbsvm": quality.op1_quality_nbsvm,
        "op2_media_audio": media.op2_media_audio,
        "op3_chat_round_trip": chat.op3_chat_round_trip,
        "op4_minhash_dedup": dedup.op4_minhash_dedup,
        "op5_systematic_mix": mixing.op5_systematic_mix,
        "op6_simhash": simhash.op6_simhash,
        "op7_lm_backoff": lm.op7_lm_backoff,
        "op8_pii": pii.op8_pii,
        "op9_secret_ownership": secret_scan.op9_secret_ownership,
        "op10_pack_gga": packing.op10_pack_gga,
        "op11_suffix_dedup": repeats.op11_suffix_dedup,
        "op12_embedding_whitening": whitening.op12_embedding_whitening,
        "op13_conversation_repair": repair.op13_conversation_repair,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_chat_round_trip": chat.ORACLE, "op4_minhash_dedup": dedup.ORACLE, "op5_systematic_mix": mixing.ORACLE, "op9_secret_ownership": secret_scan.ORACLE, "op11_suffix_dedup": repeats.ORACLE, "op13_conversation_repair": repair.ORACLE}
