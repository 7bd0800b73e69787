"""The registered queries: each applies its operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bytebpe, jaccard, linededup, matroska, packing, pii, quality, suffixdedup, tokencount, toolcalls
from .common import read_table


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.store_texts(read_table(spark, sf_dir, "documents"))


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(read_table(spark, sf_dir, "documents"))


def op3_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.remove_repeats(read_table(spark, sf_dir, "documents"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytebpe.encode_texts(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def pii_key(spark: SparkSession) -> str:
    """The secret of the session; the registered queries run without one of their own, so that tests repeat."""
    return spark.conf.get("spark.xdoc.pii.key", "not a secret: set spark.xdoc.pii.key")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_entities(read_table(spark, sf_dir, "documents"), pii_key(spark), count="n_entities").select("doc_id", "text", "n_entities")


#: The schema of the one tool that plain chat calls.
REPLY = {"reply": {"text": ("string", True), "turn": ("integer", True)}}


def op8_toolcalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results, others = toolcalls.parse_messages(read_table(spark, sf_dir, "conversations"))
    turns = toolcalls.turns_as_calls(others)  # what holds no tool calls
    return toolcalls.link(calls.unionByName(turns[0]), results.unionByName(turns[1]), turns[2], REPLY)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_features(read_table(spark, sf_dir, "documents"))


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_report(read_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_media, op2_jaccard, op3_tokens, op4_suffixes, op5_bpe, op6_packing, op7_pii, op8_toolcalls, op9_quality, op10_lines)}
