"""Counts and warnings about converted text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from quireframe.functions import encoding as E
from quireframe.operators import scale

def char_issue_report(df: DataFrame, key: str, text: str, most: int | None = None) -> DataFrame:
    """Per document and kind (missing glyph, control): the characters met, their counts, and how many kinds in all; ``most`` keeps the first so many.

    Characters are counted before the shuffle; what is ranked per document is at most one row per distinct character.
    """
    counts = E.char_counts(df.select(key, E.nfc(F.col(text)).alias(text)), key, text)
    issues = counts.withColumn("kind", E.issue_kind(F.col("cp"))).filter("kind is not null")
    w = W.partitionBy(key, "kind")
    ranked = issues.withColumn("rk", F.row_number().over(w.orderBy("first_pos"))).withColumn("kinds", F.count(F.lit(1)).over(w))
    if most is not None:
        ranked = ranked.filter(F.col("rk") <= most)
    return ranked.select(key, "kind", "cp", "n", "kinds", "rk")


def group_warnings(warnings: DataFrame, key: str) -> DataFrame:
    """Warnings numbered inside each kind, in the order raised (``pos``, a number); a busy key is cut into blocks of positions."""
    blocks = warnings.withColumn("_c", F.floor(F.col("pos") / 4096))
    return scale.row_number(blocks, [key, "kind"], "_c", ["pos"], "group_pos").drop("_c")


def replace_summary(outcomes: DataFrame) -> DataFrame:
    """outcomes(doc_id, pos, outcome, font) -> edited, substituted, failed, and the substitute fonts by first use."""
    per_font = outcomes.groupBy("doc_id", "outcome", "font").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))

    def total(kind: str):
        return F.coalesce(F.sum(F.when(F.col("outcome") == kind, F.col("n"))), F.lit(0)).alias(kind)

    used = F.array_sort(F.collect_list(F.when(F.col("outcome") == "substituted", F.struct("first", "font"))))
    return per_font.groupBy("doc_id").agg(total("edited"), total("substituted"), total("failed"), F.array_join(F.transform(used, lambda u: u["font"]), ",").alias("fonts"))
