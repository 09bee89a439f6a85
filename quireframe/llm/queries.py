"""The registered queries of this package, each over its whole table with production parameters, and the SQL that checks them where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quireframe.llm import ball_tree, class_lm, hard_negatives, mixing, near_dedup, personal_data, pieces, prefix_tree, quality_kernel, quality_rules, suffix_dedup, token_files, url_filters
from quireframe.llm.tables import source

PIECE_MODEL = "piece_bpe_32k.model"
WORD_TOKENIZER = "word_bpe_49k.json"


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(source(spark, sf_dir, "documents"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(source(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(source(spark, sf_dir, "documents"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(source(spark, sf_dir, "pages"))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.report(source(spark, sf_dir, "documents"))


def op6_quality_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_kernel.score(source(spark, sf_dir, "documents"), source(spark, sf_dir, "labels"))


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(pieces.encode(source(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_MODEL)))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read(token_files.write(source(spark, sf_dir, "documents"), public_tokenizers.path(WORD_TOKENIZER), end=2))


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_tree.top_k(source(spark, sf_dir, "embeddings"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = source(spark, sf_dir, "documents")
    return quality_rules.judge(docs, quality_rules.train(docs, source(spark, sf_dir, "labels")))


def op11_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm.score(source(spark, sf_dir, "documents"))


def op12_prefix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_tree.rank(source(spark, sf_dir, "documents"), source(spark, sf_dir, "benchmark"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(source(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_mixing, op2_near_dedup, op3_suffix_dedup, op4_url_filters, op5_personal_data, op6_quality_kernel, op7_pieces, op8_token_files, op9_top_k, op10_quality_rules,
              op11_class_lm, op12_prefix_tree, op13_hard_negatives)
}
ORACLES: dict[str, str] = {"op1_mixing": mixing.sql(), "op9_top_k": ball_tree.sql(), "op12_prefix_tree": prefix_tree.sql(), "op13_hard_negatives": hard_negatives.sql()}
