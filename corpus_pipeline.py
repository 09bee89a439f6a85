"""A training-data pipeline over ``documents``: quality rules, near-duplicates, personal data, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read back as the next
stage's docs.  All but the last return the columns of ``documents``.  A rejected document goes; of each group of
near-duplicates the one with the smallest id stays; personal data is replaced in the text; the mix repeats a document
once for each whole epoch and adds its first words where the target ends inside it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quireframe.llm import mixing, near_dedup, personal_data, pieces, quality_rules
from quireframe.llm.tables import source, stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep(docs, quality_rules.train(docs, source(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_first(docs)


def personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return personal_data.sanitised(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.digests(pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model")))


STAGES = [("quality rules", quality), ("near-duplicates", near_duplicates), ("personal data", personal), ("mixing", mixed), ("encoding", encoded)]
#: The quality stage holds a fitted model, which SQL cannot express; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = source(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
