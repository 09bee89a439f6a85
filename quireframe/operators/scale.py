"""Two-level window functions.

A plain window puts one whole partition key into one task.  A document (or user) may hold a third of all rows, so every
ordered operator keyed by document or user goes through these helpers instead: rows are first cut into *chunks* that
respect the order (a page, a block of sequence numbers); the window runs inside (key, chunk); only one summary row per
chunk is ordered per key; and the summary is joined back.  The large side is shuffled once, on (key, chunk).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

SUMMARY = "__carry"


def _join_summary(rows: DataFrame, summary: DataFrame, on: list[str]) -> DataFrame:
    # null-safe: a null key is a group of its own, as in a window
    r, s = rows.alias("r"), summary.alias("s")
    cond = reduce(lambda a, b: a & b, [F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in on])
    extra = [c for c in summary.columns if c not in on]
    return r.join(s, cond, "left").select("r.*", *[F.col(f"s.{c}").alias(c) for c in extra])


def row_number(df: DataFrame, keys: list[str], chunk: str, order: list, out: str) -> DataFrame:
    """``row_number() over (partition by keys order by chunk, order)``."""
    local = df.withColumn(out, F.row_number().over(W.partitionBy(*keys, chunk).orderBy(*order)))
    per = df.groupBy(*keys, chunk).agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy(*keys).orderBy(chunk).rowsBetween(W.unboundedPreceding, -1)
    per = per.withColumn(SUMMARY, F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    return _join_summary(local, per, [*keys, chunk]).withColumn(out, (F.col(out) + F.col(SUMMARY)).cast("long")).drop(SUMMARY)


def running_sum(df: DataFrame, keys: list[str], chunk: str, order: list, value: Column, out: str, exclusive: bool = False) -> DataFrame:
    """Running sum in (chunk, order); ``exclusive`` leaves the current row out."""
    w = W.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(W.unboundedPreceding, -1 if exclusive else 0)
    df = df.withColumn("__v", value)
    local = df.withColumn(out, F.coalesce(F.sum("__v").over(w), F.lit(0)))
    per = df.groupBy(*keys, chunk).agg(F.sum("__v").alias("__n"))
    before = W.partitionBy(*keys).orderBy(chunk).rowsBetween(W.unboundedPreceding, -1)
    per = per.withColumn(SUMMARY, F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    return _join_summary(local, per, [*keys, chunk]).withColumn(out, F.col(out) + F.col(SUMMARY)).drop(SUMMARY, "__v")


def running_max(df: DataFrame, keys: list[str], chunk: str, order: list, values: dict[str, Column], exclusive: bool = False) -> DataFrame:
    """Running maximum of each of ``values`` in (chunk, order), nulls skipped; structs compare field by field."""
    w = W.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(W.unboundedPreceding, -1 if exclusive else 0)
    for k, v in values.items():
        df = df.withColumn(f"__v_{k}", v)
    local = df
    for k in values:
        local = local.withColumn(k, F.max(f"__v_{k}").over(w))
    per = df.groupBy(*keys, chunk).agg(*[F.max(f"__v_{k}").alias(f"__n_{k}") for k in values])
    before = W.partitionBy(*keys).orderBy(chunk).rowsBetween(W.unboundedPreceding, -1)
    per = per.select(*keys, chunk, *[F.max(f"__n_{k}").over(before).alias(f"__c_{k}") for k in values])
    res = _join_summary(local, per, [*keys, chunk])
    for k in values:
        res = res.withColumn(k, F.greatest(k, f"__c_{k}"))
    return res.drop(*[f"__c_{k}" for k in values], *[f"__v_{k}" for k in values])


def lag(df: DataFrame, keys: list[str], chunk: str, order: list[str], values: dict[str, str], back: bool = True) -> DataFrame:
    """Previous (or, with ``back=False``, next) row's columns in (chunk, order): ``values`` maps new name -> source column."""
    desc = [F.col(c) if back else F.col(c).desc() for c in order]
    w = W.partitionBy(*keys, chunk).orderBy(*desc)
    src = F.struct(*[F.col(c) for c in values.values()])
    local = df.withColumn("__p", F.lag(src).over(w)).withColumn("__first", F.row_number().over(w) == 1)
    edge = F.struct(*order)
    per = df.groupBy(*keys, chunk).agg((F.max_by if back else F.min_by)(src, edge).alias("__e"))
    cw = W.partitionBy(*keys).orderBy(F.col(chunk) if back else F.col(chunk).desc())
    per = per.withColumn(SUMMARY, F.lag("__e").over(cw)).drop("__e")
    res = _join_summary(local, per, [*keys, chunk])
    prev = F.when(F.col("__first"), F.col(SUMMARY)).otherwise(F.col("__p"))
    res = res.withColumn("__prev", prev)
    for new, old in values.items():
        res = res.withColumn(new, F.col("__prev")[old])
    return res.drop("__p", "__first", SUMMARY, "__prev")


def neighbours(df: DataFrame, keys: list[str], chunk: str, order: list[str], item: Column) -> DataFrame:
    """Adds ``prev`` and ``next`` (the rows beside it) and ``first`` and ``last`` (of the whole key) of a non-null ``item``, in one pass."""
    w = W.partitionBy(*keys, chunk).orderBy(*order)
    df = df.withColumn("__i", item)
    local = df.withColumn("__p", F.lag("__i").over(w)).withColumn("__x", F.lead("__i").over(w)).drop("__i")
    edge = F.struct(*order)
    per = df.groupBy(*keys, chunk).agg(F.min_by("__i", edge).alias("__a"), F.max_by("__i", edge).alias("__b"))
    cw = W.partitionBy(*keys).orderBy(chunk)
    whole = cw.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    per = per.select(*keys, chunk, F.lag("__b").over(cw).alias("__before"), F.lead("__a").over(cw).alias("__after"), F.first("__a").over(whole).alias("first"), F.last("__b").over(whole).alias("last"))
    res = _join_summary(local, per, [*keys, chunk])
    return res.withColumn("prev", F.coalesce("__p", "__before")).withColumn("next", F.coalesce("__x", "__after")).drop("__p", "__x", "__before", "__after")


def changes(df: DataFrame, keys: list[str], chunk: str, order: list[str], value: str, out: str) -> DataFrame:
    """Number (1, 2, ...) of each row's run of equal values in (chunk, order); a null is a run of its own.

    A chunk tells how many runs begin inside it, and its first and last values; whether its first row begins a run is
    settled between chunks.
    """
    w = W.partitionBy(*keys, chunk).orderBy(*order)
    local = df.withColumn("__first", F.row_number().over(w) == 1)
    begins = F.col(value).isNull() | F.coalesce(F.lag(value).over(w) != F.col(value), F.lit(True))
    local = local.withColumn("__new", F.when(F.col("__first"), 0).otherwise(begins.cast("int")))
    edge = F.struct(*order)
    per = local.groupBy(*keys, chunk).agg(F.sum("__new").alias("__n"), F.min_by(value, edge).alias("__a"), F.max_by(value, edge).alias("__b"))
    cw = W.partitionBy(*keys).orderBy(chunk)
    per = per.withColumn("__s", (F.col("__a").isNull() | F.coalesce(F.lag("__b").over(cw) != F.col("__a"), F.lit(True))).cast("int"))
    ahead = cw.rowsBetween(W.unboundedPreceding, -1)
    per = per.select(*keys, chunk, (F.coalesce(F.sum(F.col("__n") + F.col("__s")).over(ahead), F.lit(0)) + F.col("__s")).alias(SUMMARY))
    local = local.withColumn("__k", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return _join_summary(local, per, [*keys, chunk]).withColumn(out, F.col("__k") + F.col(SUMMARY)).drop("__first", "__new", "__k", SUMMARY)


def islands(df: DataFrame, keys: list[str], chunk: str, order: list, starts: Column, out: str) -> DataFrame:
    """Island number (1, 2, ...) of each row, a new island beginning wherever ``starts`` is true."""
    return running_sum(df, keys, chunk, order, F.when(starts, F.lit(1)).otherwise(F.lit(0)).cast("long"), out)
