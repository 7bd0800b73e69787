"""The corpus pipeline: quality rules, line dedup, near duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a table; all but the last keep
the columns of ``documents``. ``run`` writes each stage's table to the shared
folder and gives the next one what it reads from there, so a lost executor costs
one stage's work at most.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from xdoc.llm import jaccard, linededup, packing, pii, quality
from xdoc.llm.common import fresh, materialize, read_table
from xdoc.llm.queries import pii_key


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars as the text has it now."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects."""
    return quality.quality_filter(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that stand on many sites."""
    return _counted(linededup.remove_boilerplate(docs))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id; documents without words or id stay."""
    groups = jaccard.near_duplicates(docs)
    name = fresh(docs, "__gone")
    others = materialize(groups.where("component_id <> doc_id").select(F.col("doc_id").alias(name)).distinct(), "duplicates")
    return docs.join(others, F.col("doc_id").cast("long") == F.col(name), "left_anti")


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with surrogates for personal data."""
    return _counted(pii.replace_entities(docs, pii_key(spark)))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document in a sequence."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [("quality rules", quality_stage), ("line dedup", line_stage), ("near duplicates", near_duplicate_stage), ("personal data", personal_data_stage), ("packing", packing_stage)]

#: Ids of a tokenizer and keyed surrogates can't be told in SQL; tests hold the result against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
