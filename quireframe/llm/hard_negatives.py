"""Hard negatives by vertical scans of columnar shards.

Candidates lie in shards of about ``SHARD`` rows, dimension by dimension.  An anchor reads a shard's dimensions in the
order of its own components' magnitude and adds up partial products.  What the unread dimensions can still add is bounded
by their smallest and largest values in the shard, so after every ``STEP`` dimensions each candidate has a lower and an
upper bound of its score, and the bitmap of candidates shrinks to those that can still matter:

* positives (rows of the anchor's label): an upper bound below the k-th lower bound leaves the bitmap;
* negatives (rows of another label): every positive opens a window from 80 % of its score to its score.  A candidate stays
  while its bounds reach into a window and its upper bound is not below the k-th lower bound of those surely inside it.

What is left when all dimensions are read has exact integer scores, and the windows are resolved on these.  Positives are
found first over all shards; their windows then go with the anchors to all shards again.  The shards are ``shards.meet``.

Scores are exact: sums of doubles while none can pass 2^53, else integers of any size held to the range of a long (the
bounds then carry a margin for rounding).

Defined cases: rows with a null id, label or vector, or a null or non-finite component, take no part; only vectors of one
length meet; rows that share an id are rows of their own (each its own anchor, positive and negative); ties go to the
smaller id; fewer than k positives or negatives give fewer rows; a negative positive score has an empty window; repeated
vectors tie; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quireframe.llm import shards
from quireframe.llm.ball_tree import products
from quireframe.llm.shards import LONG
from quireframe.llm.tables import stored

SHARD, STEP = 4096, 8


class Columns:
    """A shard's rows by dimension, with the smallest and largest value of each."""

    def __init__(self, table: pa.Table) -> None:
        self.rid = table.column("rid").to_numpy()
        self.ids = table.column("vec_id").to_numpy()
        self.label = table.column("label").to_numpy()
        self.rows = shards.matrix(table.column("v"), table.num_rows)
        self.dims = np.ascontiguousarray(self.rows.T.astype(float))
        self.low, self.high = self.dims.min(1), self.dims.max(1)
        self.top = np.maximum(np.abs(self.low), np.abs(self.high))

    def scan(self, q: np.ndarray, start: np.ndarray, keep) -> tuple[np.ndarray, np.ndarray]:
        """(rows, exact scores) of what ``keep(lower, upper)`` leaves of the bitmap ``start`` to the end."""
        alive, qf = np.flatnonzero(start), q.astype(float)
        order = np.argsort(-np.abs(qf), kind="stable")
        span = np.stack([qf * self.low, qf * self.high])[:, order]
        rest = lambda part: np.append(np.cumsum(part[::-1])[::-1], 0.0)
        least, most = rest(span.min(0)), rest(span.max(0))
        reach = float((np.abs(qf) * self.top).sum())
        slack = 0.0 if reach < 2**53 else reach * 1e-12 * q.size
        sums = np.zeros(alive.size)
        for i, d in enumerate(order, 1):
            column = self.dims[d]
            sums += qf[d] * (column if alive.size == column.size else column[alive])
            if alive.size and (i % STEP == 0 or i == q.size):
                inside = keep(sums + (least[i] - slack), sums + (most[i] + slack))
                if not inside.all():
                    alive, sums = alive[inside], sums[inside]
        if slack:
            return alive, products(q[None, :], self.rows[alive])[0]
        return alive, sums.astype(np.int64)


def kth(values: np.ndarray, k: int) -> float:
    return float(np.partition(values, values.size - k)[-k]) if values.size >= k else -np.inf


def first(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties by smaller id."""
    return np.lexsort((ids, -1 - score))[:k]


def _positives(k: int):
    def scan(shard: Columns, asked: pa.RecordBatch) -> pa.RecordBatch | None:
        out = []
        q = shards.matrix(asked.column("v"), asked.num_rows)
        for i, (rid, label) in enumerate(zip(asked.column("rid").to_numpy(), asked.column("label").to_numpy())):
            start = (shard.label == label) & (shard.rid != rid)
            rows, score = shard.scan(q[i], start, lambda low, high: high >= kth(low, k))
            best = first(score, shard.ids[rows], k)
            out.append((np.full(best.size, rid), shard.ids[rows[best]], score[best]))
        if not any(o[0].size for o in out):
            return None
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["rid", "positive_id", "positive_score"])

    return scan


def _negatives(k: int):
    def scan(shard: Columns, asked: pa.RecordBatch) -> pa.RecordBatch | None:
        out = []
        q = shards.matrix(asked.column("v"), asked.num_rows)
        for i, (rid, label, tops) in enumerate(zip(asked.column("rid").to_numpy(), asked.column("label").to_numpy(), asked.column("positive_scores").to_pylist())):
            # the smallest n with 80 p <= 100 n, without passing the range of a long
            windows = [(p - p // 5, p) for p in tops]
            if not any(a <= b for a, b in windows):
                continue

            def keep(low: np.ndarray, high: np.ndarray) -> np.ndarray:
                inside = np.zeros(low.size, bool)
                for a, b in dict.fromkeys(windows):
                    if a <= b:
                        sure = (low >= a) & (high <= b)
                        inside |= (low <= b) & (high >= max(a, kth(low[sure], k)))
                return inside

            rows, score = shard.scan(q[i], shard.label != label, keep)
            for place, (a, b) in enumerate(windows):
                fit = np.flatnonzero((score >= a) & (score <= b))
                best = fit[first(score[fit], shard.ids[rows[fit]], k)]
                out.append((np.full(best.size, rid), np.full(best.size, place + 1), shard.ids[rows[best]], score[best]))
        if not any(o[0].size for o in out):
            return None
        columns = [np.concatenate(c) for c in zip(*out)]
        columns[1] = columns[1].astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["rid", "place", "negative_id", "negative_score"])

    return scan


def _ranked(df: DataFrame, keys: list[str], score: str, ident: str, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(keys).orderBy(F.desc(score), ident))
    return df.withColumn("rank", rank).where(F.col("rank") <= k)


def mine(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); anchors are the rows whose id is divisible by ``every``, and a label moves on by one (modulo 10) where the id is divisible by 7."""
    v = shards.integers(vectors.select("vec_id", "embedding", F.col("label").cast("int").alias("label")).where("label IS NOT NULL"), "label")
    v = v.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("int"))
    v, sizes, count = shards.dealt(v, SHARD)
    anchors = v.where(F.col("vec_id") % every == 0).drop("shard")

    def everywhere(asked: DataFrame) -> DataFrame:
        to = asked.join(F.broadcast(sizes), "dims")  # one row for each length of vector
        return to.withColumn("shard", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("shards") - 1))).drop("first", "shards")

    found = shards.meet(v, everywhere(anchors), count, Columns, _positives(positives), "rid long, positive_id long, positive_score long")
    top = stored(_ranked(found, ["rid"], "positive_score", "positive_id", positives), "positives")
    tops = top.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("rank", "positive_score"))).alias("tops"))  # at most ``positives`` of them
    asked = anchors.join(tops.select("rid", F.col("tops.positive_score").alias("positive_scores")), "rid")
    found = shards.meet(v, everywhere(asked), count, Columns, _negatives(negatives), "rid long, place int, negative_id long, negative_score long")
    best = _ranked(found, ["rid", "place"], "negative_score", "negative_id", negatives)
    named = top.withColumnRenamed("rank", "place").join(anchors.select("rid", F.col("vec_id").alias("anchor_id")), "rid")
    return best.join(named, ["rid", "place"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def sql(every: int = 100, positives: int = 5, negatives: int = 5) -> str:
    """The same rows in DuckDB."""
    return f"""
WITH v AS (SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.rid, a.vec_id AS anchor_id, c.rid AS other, c.vec_id, a.label = c.label AS same, list_dot_product(a.v, c.v)::BIGINT AS score FROM v a JOIN v c ON a.vec_id % {every} = 0 AND a.rid <> c.rid AND len(a.v) = len(c.v)),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id, other) AS place FROM s WHERE same) WHERE place <= {positives}),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    (row_number() OVER (PARTITION BY p.rid, p.place ORDER BY s.score DESC, s.vec_id, s.other))::INTEGER AS rank
  FROM p JOIN s ON s.rid = p.rid AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {negatives}"""
