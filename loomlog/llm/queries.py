"""Queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, langid, licenses, pieces, secrets, simhash, surrogates, topk, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": warc.op1_warc,
    "op2_surrogates": surrogates.op2_surrogates,
    "op3_pieces": pieces.op3_pieces,
    "op4_chat": chat.op4_chat,
    "op5_secrets": secrets.op5_secrets,
    "op6_licenses": licenses.op6_licenses,
    "op7_simhash": simhash.op7_simhash,
    "op8_language": langid.op8_language,
    "op9_topk": topk.op9_topk,
    "op10_decontaminate": decontaminate.op10_decontaminate,
}

ORACLE_SQL: dict[str, str] = {
    "op1_warc": warc.ORACLE,
    "op4_chat": chat.ORACLE,
    "op5_secrets": secrets.ORACLE,
    "op6_licenses": licenses.ORACLE,
    "op9_topk": topk.ORACLE,
    "op10_decontaminate": decontaminate.ORACLE,
}
