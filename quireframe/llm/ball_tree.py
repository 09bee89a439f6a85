"""Exact top-k inner products by ball trees, one per shard of candidates.

Candidates are dealt into shards of about ``SHARD`` rows.  A shard and its ball tree (centre, radius, halves by the widest
direction) are built once, and all queries stream past them (``shards.meet``), so no candidate is copied.  The tree is
searched by branch and bound for a batch of queries at once: a node's bound for a query is ``q . centre + |q| radius``, the
children with the higher bounds come first, and a node is left out for the queries whose k-th score so far is above its
bound.  The k-th score is shared: the first shard is searched first, and what it finds for a query is where the search of
every other shard starts.

Components are turned into integers, ``floor(256 x)``, so scores are exact: products are summed in doubles while no sum
can pass 2^53, in 64-bit integers up to 2^63, and beyond in Python's integers, held to the range of a long.

Defined cases: rows with a null id, a null or non-finite vector take no part; only vectors of one length meet; rows that
share an id are rows of their own, each a candidate of the others and, where the id asks, a query; fewer than k candidates give fewer rows; ties go to the smaller id;
an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quireframe.llm import shards
from quireframe.llm.tables import stored

SHARD, LEAF = 8192, 256
LONG = 2**63 - 1


@dataclass
class Node:
    centre: np.ndarray
    radius: float
    rows: np.ndarray | None
    halves: tuple[Node, Node] | None


def build(v: np.ndarray, rows: np.ndarray) -> Node:
    """A ball tree over ``v[rows]`` (doubles); halves are cut at the median along the line between two far points."""
    part = v[rows]
    centre = part.mean(0)
    away = np.sqrt(((part - centre) ** 2).sum(1))
    radius = float(away.max())
    if rows.size <= LEAF or radius == 0:
        return Node(centre, radius, rows, None)
    one = part[away.argmax()]
    two = part[((part - one) ** 2).sum(1).argmax()]
    side = np.argsort(part @ (two - one), kind="stable")
    half = rows.size // 2
    return Node(centre, radius, None, (build(v, rows[side[:half]]), build(v, rows[side[half:]])))


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows, held to the range of a long."""
    top = float(np.abs(q.astype(float)).max(initial=0)) * float(np.abs(v.astype(float)).max(initial=0)) * max(q.shape[1], 1)
    if top < 2**53:
        return (q.astype(float) @ v.astype(float).T).astype(np.int64)
    if top < 2**62:
        return q.astype(np.int64) @ v.astype(np.int64).T
    exact = [[min(max(sum(int(a) * int(b) for a, b in zip(x, y)), -LONG - 1), LONG) for y in v] for x in q]
    return np.array(exact, np.int64).reshape(q.shape[0], v.shape[0])


class Ball:
    """A shard's rows and the tree over them."""

    def __init__(self, table: pa.Table) -> None:
        self.rid, self.ids = table.column("rid").to_numpy(), table.column("vec_id").to_numpy()
        self.v = shards.matrix(table.column("v"), table.num_rows)
        self.root = build(self.v.astype(float), np.arange(self.ids.size))


def search(q_rid: np.ndarray, q: np.ndarray, ball: Ball, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, score) of each query's k best candidates at least; ``floor``: k-th scores known so far (lowest long: none)."""
    ids, v, qf = ball.ids, ball.v, q.astype(float)
    norm = np.sqrt((qf**2).sum(1))
    best = np.full((q.shape[0], k), -LONG - 1, np.int64)
    best_id = np.full((q.shape[0], k), LONG, np.int64)
    kth = floor.copy()

    def visit(node: Node, rows: np.ndarray, bound: np.ndarray) -> None:
        open_ = bound >= kth[rows].astype(float) * (1 - np.sign(kth[rows]) * 1e-9) - 1
        rows = rows[open_]
        if not rows.size:
            return
        if node.halves is None:
            s = products(q[rows], v[node.rows])
            own = q_rid[rows][:, None] == ball.rid[node.rows][None, :]
            s_all = np.concatenate([best[rows], s], 1)
            i_all = np.concatenate([best_id[rows], np.broadcast_to(ids[node.rows], s.shape)], 1)
            s_all[:, k:][own], i_all[:, k:][own] = -LONG - 1, LONG
            if s_all.shape[1] > 4 * k:  # the k best and their ties by score, then by id
                edge = np.partition(s_all, s_all.shape[1] - k, 1)[:, -k]
                keep = s_all >= edge[:, None]
                width = int(keep.sum(1).max())
                order = np.argsort(~keep, 1, kind="stable")[:, :width]
                s_all, i_all = np.take_along_axis(s_all, order, 1), np.take_along_axis(i_all, order, 1)
            o = np.lexsort((i_all, -1 - s_all), axis=1)[:, :k]
            best[rows], best_id[rows] = np.take_along_axis(s_all, o, 1), np.take_along_axis(i_all, o, 1)
            kth[rows] = np.maximum(kth[rows], best[rows][:, -1])
            return
        bounds = [qf[rows] @ h.centre + norm[rows] * h.radius for h in node.halves]
        for i in (0, 1) if bounds[0].sum() >= bounds[1].sum() else (1, 0):
            visit(node.halves[i], rows, bounds[i])

    visit(ball.root, np.arange(q.shape[0]), qf @ ball.root.centre + norm * ball.root.radius)
    row, rank = np.nonzero(best_id != LONG)
    return row, best_id[row, rank], best[row, rank]


def _scan(k: int):
    def scan(ball: Ball, asked: pa.RecordBatch) -> pa.RecordBatch:
        rid, q = asked.column("rid"), shards.matrix(asked.column("v"), asked.num_rows)
        row, found, score = search(rid.to_numpy(), q, ball, k, asked.column("floor").to_numpy())
        at = pa.array(row)
        return pa.RecordBatch.from_arrays([rid.take(at), asked.column("vec_id").take(at), pa.array(found), pa.array(score)], names=["rid", "query_id", "vec_id", "score"])

    return scan


def top_k(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) for every vector whose id is divisible by ``every``, against all others."""
    v, sizes, count = shards.dealt(shards.integers(vectors), SHARD)
    queries = v.where(F.col("vec_id") % every == 0).drop("shard").join(F.broadcast(sizes), "dims")  # one row for each length of vector
    out = "rid long, query_id long, vec_id long, score long"
    opening = queries.withColumn("shard", F.col("first")).drop("first", "shards").withColumn("floor", F.lit(-LONG - 1))
    first = stored(shards.meet(v.join(F.broadcast(sizes.select(F.col("first").alias("shard"))), "shard"), opening, count, Ball, _scan(k), out), "first-shard")
    floors = first.groupBy("rid").agg(F.count("*").alias("n"), F.min("score").alias("s")).where(F.col("n") >= k).select("rid", F.col("s").alias("known"))
    rest = queries.where("shards > 1").join(floors, "rid", "left").withColumn("floor", F.coalesce("known", F.lit(-LONG - 1)))
    rest = rest.withColumn("shard", F.explode(F.sequence(F.col("first") + 1, F.col("first") + F.col("shards") - 1))).drop("first", "shards", "known")
    other = shards.meet(v, rest, count, Ball, _scan(k), out)
    rank = F.row_number().over(Window.partitionBy("rid").orderBy(F.desc("score"), "vec_id"))
    return first.union(other).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def sql(every: int = 50, k: int = 5) -> str:
    """The same rows in DuckDB."""
    return f"""
WITH v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.rid, q.vec_id AS query_id, c.vec_id, c.rid AS other, list_dot_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % {every} = 0 AND c.rid <> q.rid AND len(c.v) = len(q.v)),
r AS (SELECT *, (row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id, other))::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {k}"""
