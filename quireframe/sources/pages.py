"""Page tables: checked sizes, and the runs that can be seen."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quireframe.functions import geometry as G


def validate_pages(pages: DataFrame) -> DataFrame:
    """A page without a usable size becomes A4 and is flagged; a user unit that is not positive becomes 1."""
    unit = F.when(G.finite(F.col("user_unit")) & (F.col("user_unit") > 0), F.col("user_unit")).otherwise(F.lit(1.0))
    good = G.valid_page_size(F.col("width_pt"), F.col("height_pt"), F.col("user_unit"))
    return (
        pages.withColumn("_good", good)
        .withColumn("width_pt", F.when(F.col("_good"), F.col("width_pt")).otherwise(F.lit(G.SUBSTITUTE_W)))
        .withColumn("height_pt", F.when(F.col("_good"), F.col("height_pt")).otherwise(F.lit(G.SUBSTITUTE_H)))
        .withColumn("user_unit", F.when(F.col("_good"), unit).otherwise(F.lit(1.0)))
        .withColumn("invalid_size", ~F.col("_good"))
        .drop("_good")
    )


def visible_runs(runs: DataFrame, page_table: DataFrame) -> DataFrame:
    """Runs that meet the visible box of their page; a page of invalid size clips nothing."""
    p = page_table.select("doc_id", "page_index", "origin_x", "origin_y", "width_pt", "height_pt", "invalid_size")
    j = runs.join(p, ["doc_id", "page_index"])
    box = [F.col(c) for c in ("x", "y", "w", "h", "origin_x", "origin_y", "width_pt", "height_pt")]
    return j.filter(F.col("invalid_size") | G.is_visible(*box)).select(runs.columns)
