"""Quality scores: random Fourier features over document statistics, ridge by summed normal equations, isotonic calibration.

Every labelled document outside the held-out fifth takes part.  Each task sums its own part of the normal equations; the
parts, one row for each feature and task, are added up by feature, and only the finished (D + 1) x (D + 2) matrix reaches
the driver, whatever the size of the corpus.  Raw ridge outputs are calibrated on the same rows, counted in ``BINS`` bins:
pool-adjacent-violators gives a monotone step function, read with interpolation.

Only the text is measured: labels, language, source and id never enter a score.  Defined cases: a null or empty text is
scored from its (zero) statistics; a null ``doc_id`` counts as the empty string for the fold and is carried through;
contradicting labels of an id are averaged; without labels, or with one class, every score is the share of ones (0.5
without any); repeated rows are scored alike; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quireframe.llm import textstats as T
from quireframe.llm.tables import stored

FOLDS = 5
CUT = 0.3
#: Random features, the kernel's width in standard deviations, and the ridge penalty for each row.
D, WIDTH, RIDGE = 256, 3.0, 1e-4
BINS = 256


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == 0


class Kernel:
    """The map from statistics to random Fourier features, linear terms and a constant."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = 6) -> None:
        rng = np.random.Generator(np.random.PCG64(seed))
        self.mean, self.scale = mean, scale
        self.w = rng.normal(size=(mean.size, D)) / (WIDTH * np.sqrt(mean.size) / 2)
        self.b = rng.uniform(0, 2 * np.pi, D)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.concatenate([np.sqrt(2 / D) * np.cos(z @ self.w + self.b), z, np.ones((x.shape[0], 1))], 1)


def statistics(docs: DataFrame) -> DataFrame:
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stored(d.mapInArrow(T.stats_batches(["doc_id"]), T.stats_schema("doc_id long")).select("doc_id", *T.FEATURES), "quality-statistics")


def training_rows(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics with y for the labelled ids outside the held-out fold."""
    y = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg("quality").alias("y"))
    return stored(stats.join(y.where(~held_out(F.col("doc_id"))), "doc_id"), "quality-training")


def _x(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in T.FEATURES], 1) if batch.num_rows else np.zeros((0, len(T.FEATURES)))


def fit(rows: DataFrame) -> tuple[Kernel, np.ndarray] | None:
    """The kernel map and the ridge weights; None where there are not two classes."""
    m = rows.agg(F.count("*").alias("n"), F.min("y").alias("low"), F.max("y").alias("high"), *[f(c).alias(f"{k}_{c}") for c in T.FEATURES for k, f in (("mean", F.avg), ("sd", F.stddev_pop))]).first()
    if not m["n"] or m["low"] == m["high"]:
        return None
    kernel = Kernel(np.array([m[f"mean_{c}"] for c in T.FEATURES]), np.array([max(m[f"sd_{c}"], 1e-9) for c in T.FEATURES]))
    size = D + len(T.FEATURES) + 1

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size + 1))
        for batch in batches:
            z = kernel(_x(batch))
            total += z.T @ np.concatenate([z, batch.column("y").to_numpy(zero_copy_only=False)[:, None]], 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "part"])

    def add(key, table):
        parts = table.column("part").combine_chunks().flatten().to_numpy().reshape(table.num_rows, size + 1)
        return pa.table({"i": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([parts.sum(0)], pa.list_(pa.float64()))})

    schema = "i int, part array<double>"
    summed = rows.select("y", *T.FEATURES).mapInArrow(partial, schema).groupBy("i").applyInArrow(add, schema)
    a = np.array([r["part"] for r in sorted(summed.collect(), key=lambda r: r["i"])])
    return kernel, np.linalg.solve(a[:, :size] + RIDGE * m["n"] * np.eye(size), a[:, size])


def isotonic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing function nearest to y (weights n) by pooling adjacent violators."""
    blocks: list[list[float]] = []  # mean, weight, first x, last x
    for a, b, c in zip(x, y, n):
        blocks.append([b, c, a, a])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m, w, _, last = blocks.pop()
            p = blocks[-1]
            p[0], p[1], p[3] = (p[0] * p[1] + m * w) / (p[1] + w), p[1] + w, last
    return np.array([v for k in blocks for v in (k[2], k[3])]), np.array([v for k in blocks for v in (k[0], k[0])])


def _raw(kernel: Kernel, weights: np.ndarray, batch: pa.RecordBatch) -> np.ndarray:
    return np.clip(kernel(_x(batch)) @ weights, -1, 2)


def calibrate(rows: DataFrame, kernel: Kernel, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_raw(kernel, weights, batch)), batch.column("y")], names=["raw", "y"])

    raw = rows.select("y", *T.FEATURES).mapInArrow(run, "raw double, y double")
    bins = raw.groupBy(F.floor((F.col("raw") + 1) * (BINS / 3)).alias("bin")).agg(F.count("*").alias("n"), F.avg("y").alias("y"), F.avg("raw").alias("raw")).toPandas().sort_values("bin")
    return isotonic(bins["raw"].to_numpy(), bins["y"].to_numpy(), bins["n"].to_numpy(float))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``."""
    stats = statistics(docs)
    rows = training_rows(stats, labels)
    model = fit(rows)
    if model is None:
        share = rows.agg(F.avg("y")).first()[0]
        scored = stats.select("doc_id", F.lit(0.5 if share is None else float(share)).alias("score"))
    else:
        knots = calibrate(rows, *model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.clip(np.interp(_raw(*model, batch), *knots), 0, 1))], names=["doc_id", "score"])

        scored = stats.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
