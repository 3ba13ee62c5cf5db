"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weirflow.llm import chat, decontam, line_dedup, mixing, near_dup, pii, quality, sharding, urls, warc
from weirflow.llm._common import read

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_near_dup": lambda s, d: near_dup.op1_rows(read(s, d, "documents")),
        "op2_warc": lambda s, d: warc.op2_rows(read(s, d, "pages")),
        "op3_quality": lambda s, d: quality.op3_rows(read(s, d, "documents")),
        "op4_mixing": lambda s, d: mixing.op4_rows(read(s, d, "documents")),
        "op5_sharding": lambda s, d: sharding.shard(read(s, d, "documents")),
        "op6_decontam": lambda s, d: decontam.op6_rows(read(s, d, "documents"), read(s, d, "benchmark")),
        "op7_pii": lambda s, d: pii.op7_rows(read(s, d, "documents")),
        "op8_chat": lambda s, d: chat.op8_rows(chat.with_probe(read(s, d, "conversations"))),
        "op9_line_dedup": lambda s, d: line_dedup.op9_rows(read(s, d, "documents")),
        "op10_urls": lambda s, d: urls.judge(read(s, d, "pages")),
        "url_aliases": lambda s, d: urls.judge(read(s, d, "pages"), urls.chained(read(s, d, "pages"))),
        "quality_ablations": lambda s, d: quality.ablations(quality.ledger(read(s, d, "documents"))),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_warc": warc.ORACLE,
        "op3_quality": quality.ORACLE,
        "op4_mixing": mixing.ORACLE,
        "op6_decontam": decontam.ORACLE,
        "op8_chat": chat.ORACLE,
        "op9_line_dedup": line_dedup.ORACLE,
        "op10_urls": urls.ORACLE,
        "url_aliases": urls.ORACLE_CHAINED,
        "quality_ablations": quality.ORACLE_ABLATIONS,
    }
