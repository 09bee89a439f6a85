"""Reading columns and writing intermediate tables, for every operator of this package."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quireframe.session import checkpoint_root

WORD = r"[^\x20\x09-\x0D]+"


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, what: str) -> DataFrame:
    """``df`` written once as Parquet in the shared checkpoint folder and read back.

    Cuts the lineage, gives later joins a plain scan (so that adaptive execution may split a hot key) and survives the
    loss of executors.  The folder is never a machine-local one on a cluster.
    """
    path = f"{checkpoint_root(df.sparkSession).rstrip('/')}/llm-{what}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    out = df.sparkSession.read.schema(schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove stored tables that later stored tables have taken the place of; a result still to be computed must not read them."""
    for t in tables:
        jvm = t.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(t.stored_at)
        path.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def text_key(text: str = "text") -> tuple[Column, Column]:
    """Two 64-bit hashes that together name a text's content; null and empty texts are told apart by neither."""
    t = F.coalesce(F.col(text), F.lit(""))
    return F.xxhash64(t).alias("k1"), F.xxhash64(F.lit(41), t).alias("k2")
