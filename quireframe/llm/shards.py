"""Vectors in shards: candidates of a shard are held once, the queries of that shard stream past them.

``integers`` turns a table of vectors into integer rows with a row id of their own, so rows that share a ``vec_id`` stay
apart.  ``dealt`` gives each row a shard of at most about ``rows`` rows, all of one vector length.  ``meet`` sends every
shard's candidates and its queries to one task, candidates first, and lets the queries pass in Arrow batches: a task holds
one shard and one batch, whatever the number of queries, and no candidate is copied.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireframe.llm.tables import stored

LONG = 2**63 - 1


def integers(vectors: DataFrame, *more: str) -> DataFrame:
    """(rid, vec_id, v, dims, *more): every row with an id and a finite vector; written once, so that row ids stay as they are."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"), *more).where("vec_id IS NOT NULL AND e IS NOT NULL")
    v = v.where(~F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    # floors beyond a long cannot be products within one either: they are held to its range
    v = v.withColumn("v", F.transform("e", lambda x: F.floor(F.least(F.greatest(x * 256, F.lit(-9.2e18)), F.lit(9.2e18))).cast("long"))).drop("e")
    return stored(v.select(F.monotonically_increasing_id().alias("rid"), "vec_id", "v", F.size("v").alias("dims"), *more), "vectors")


def dealt(v: DataFrame, rows: int) -> tuple[DataFrame, DataFrame, int]:
    """(v with its shard, the (dims, first, shards) table, all shards): shards are numbered over all vector lengths, those of one length in a row."""
    sizes = v.groupBy("dims").agg(F.ceil(F.count("*") / rows).cast("int").alias("shards"))
    before = 0
    table = []
    for r in sizes.orderBy("dims").collect():  # one row for each length of vector: no more than the longest vector has components
        table.append((r["dims"], before, r["shards"]))
        before += r["shards"]
    sizes = v.sparkSession.createDataFrame(table, "dims int, first int, shards int")
    at = v.join(F.broadcast(sizes), "dims").withColumn("shard", (F.col("first") + F.pmod(F.xxhash64("rid"), F.col("shards"))).cast("int"))
    return at.drop("first", "shards"), sizes, before


def matrix(col: pa.Array, rows: int) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return col.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def meet(candidates: DataFrame, queries: DataFrame, shards: int, load: Callable[[pa.Table], object], scan: Callable[[object, pa.RecordBatch], pa.RecordBatch | None], out: str) -> DataFrame:
    """``scan(load(candidates of a shard), queries of that shard)`` for every batch of queries; both tables hold ``shard``."""
    both = candidates.withColumn("asks", F.lit(False)).unionByName(queries.withColumn("asks", F.lit(True)), allowMissingColumns=True)
    both = both.repartitionById(max(shards, 1), "shard").sortWithinPartitions("shard", "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        shard, loaded = None, None
        for batch in batches:
            key = batch.column("shard").to_numpy() * 2 + batch.column("asks").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), key.size]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                at, asks = divmod(int(key[a]), 2)
                if at != shard:
                    shard, held, loaded = at, [], None
                part = batch.slice(a, b - a)
                if not asks:
                    held.append(part)
                elif held or loaded is not None:
                    if loaded is None:
                        loaded, held = load(pa.Table.from_batches(held)), []
                    if (found := scan(loaded, part)) is not None:
                        yield found

    return both.mapInArrow(run, out)
