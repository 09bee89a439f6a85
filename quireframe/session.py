"""Session defaults shared by the bench, the tests and interactive use."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "quireframe", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with AQE, UTC and Arrow on.  On a cluster leave ``master`` and ``shuffle_partitions`` unset."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        b = b.master(master).config("spark.driver.memory", os.environ.get("QUIRE_DRIVER_MEMORY", "12g")).config("spark.ui.enabled", "false")
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``; a fresh local one only where that is unset and one process is all there is."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", root)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder: for a table that several branches of a plan read.

    Unlike a cache or a local checkpoint it survives the loss of executors.
    """
    checkpoint_root(df.sparkSession)
    return df.checkpoint()
