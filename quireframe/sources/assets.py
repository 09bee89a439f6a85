"""Saved picture assets (stored signatures): validation, one per id, in the order saved."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

PNG_URL = r"^data:image/png;base64,[A-Za-z0-9+/]+={0,2}\z"


def saved_assets(assets: DataFrame, max_assets: int | None = None, max_name: int | None = None, max_url: int | None = None) -> DataFrame:
    """Valid assets: the first of each id (by ``pos``), a partial aggregate.

    The limits (assets of an owner, characters of a name, of a picture) hold only where given; a limit on assets is a
    ranked window, which Spark also applies before its shuffle.
    """
    good = assets.filter(
        (F.col("id") != "") & F.col("data_url").rlike(PNG_URL) & (F.col("width") > 0) & (F.col("height") > 0)
    )
    if max_url is not None:
        good = good.filter(F.length("data_url") <= max_url)
    if max_name is not None:
        good = good.withColumn("name", F.left("name", F.lit(max_name)))
    rest = [c for c in good.columns if c not in ("owner", "id")]
    first = good.groupBy("owner", "id").agg(F.min_by(F.struct(*rest), "pos").alias("_r")).select("owner", "id", "_r.*")
    if max_assets is None:
        return first
    rank = F.row_number().over(W.partitionBy("owner").orderBy("pos"))
    return first.withColumn("_k", rank).filter(F.col("_k") <= max_assets).drop("_k")
