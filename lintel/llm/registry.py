"""The queries of this subpackage and their SQL; __spark_entry__ adds them where the subpackage is there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lintel.llm import exact_dedup, line_dedup, packing, simhash, spm, tokens, topk, toxicity, url_filter, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_token_codes": tokens.op2_token_codes,
    "op3_topk": topk.op3_topk,
    "op4_warc_revisits": warc.op4_warc_revisits,
    "op5_packing": packing.op5_packing,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_sentencepiece": spm.op9_sentencepiece,
    "op10_simhash": simhash.op10_simhash,
}

ORACLE_SQL: dict[str, str] = {
    "op3_topk": topk.OP3_SQL,
    "op4_warc_revisits": warc.OP4_SQL,
    "op6_url_filter": url_filter.OP6_SQL,
    "op7_line_dedup": line_dedup.OP7_SQL,
    "op8_exact_dedup": exact_dedup.OP8_SQL,
}
