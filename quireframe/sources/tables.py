"""Reading the given Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load_spread(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """Like :func:`load`, in at least as many parts as a shuffle has.

    A text table blows up many-fold when it is tokenised.  Where the scan's own splits are as many as the parts of a shuffle
    they carry the work, and no text is moved; a table of fewer splits (one small file) is dealt out by ``key`` while it is
    small, so what is shuffled here never passes ``spark.sql.shuffle.partitions`` splits.
    """
    df, parts = load(spark, sf_dir, name), int(spark.conf.get("spark.sql.shuffle.partitions"))
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    scanned = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df if scanned >= parts * split else df.repartition(parts, key)
