"""Quality rules: exact base counts, and boosted trees over document statistics for what the base lets through.

The trees (``gbt``) are trained on a bounded sample of labelled documents (``SAMPLE`` rows, chosen by a hash of the id,
so that reruns agree), with monotone constraints: more repeated lines, repeated windows or symbols never raise a score,
more distinct words never lower it.  Scoring needs no shuffle: each Arrow batch of whole texts is measured and walked
through flat node arrays.

Defined cases: a null text has no words and fails the base; an empty table gives no rows; without labels every document
scores the constant of ``gbt.constant`` and only the base decides; rows are judged one by one, so repeated rows give
repeated results; a null ``doc_id`` is carried through; further columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireframe.llm import bytesops as B
from quireframe.llm import gbt
from quireframe.llm import textstats as T

#: Labelled documents that the trees see at most.
SAMPLE = 12_000
#: A document whose score is below this is rejected.
THRESHOLD = 0.4
MONOTONE = {"dup_line_share": -1, "repeat_share": -1, "symbol_share": -1, "distinct_share": 1, "adjacent_repeat_share": -1}
MIN_WORDS = 20


def labelled_sample(labels: DataFrame, rows: int = SAMPLE) -> DataFrame:
    """(doc_id, y): at most ``rows`` labelled ids, those with the smallest hash; contradicting labels of an id are averaged and rounded."""
    y = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.round(F.avg("quality")).cast("int").alias("y"))
    return y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> gbt.Trees:
    """Trees fitted to ``labels.quality``.  The sample of ids is broadcast: its size is bounded by ``rows``."""
    ids = labelled_sample(labels, rows)
    few = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    keys = "doc_id long, y int"
    stats = few.select(F.col("doc_id").cast("long").alias("doc_id"), "y", "text").mapInArrow(T.stats_batches(["doc_id", "y"]), T.stats_schema(keys))
    got = stats.select("doc_id", "y", *T.FEATURES).orderBy("doc_id").limit(2 * rows).toPandas()
    x = got[list(T.FEATURES)].to_numpy(float)
    return gbt.fit(x, got["y"].to_numpy(float), monotone={T.FEATURES.index(k): v for k, v in MONOTONE.items()})


def _verdicts(got: dict[str, np.ndarray], model: gbt.Trees, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    failed = (got["n_words"] < MIN_WORDS) | (100 * got["n_repeat_words"] > 30 * got["n_words"])
    score = model.score(np.stack([got[c] for c in T.FEATURES], 1)) if failed.size else np.zeros(0)
    return failed, score, ~failed & (score >= threshold)


def judge(docs: DataFrame, model: gbt.Trees, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, the five base counts, base_failed, score, kept) of every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            for a, b in B.slices(text):
                got = T.measure(*B.buffers(text.slice(a, b - a)))
                failed, score, kept = _verdicts(got, model, threshold)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), *(pa.array(got[c], pa.int64()) for c in T.COUNTS), pa.array(failed), pa.array(score), pa.array(kept)],
                                                 names=["doc_id", *T.COUNTS, "base_failed", "score", "kept"])

    schema = f"doc_id long, {', '.join(f'{c} long' for c in T.COUNTS)}, base_failed boolean, score double, kept boolean"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def keep(docs: DataFrame, model: gbt.Trees, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, that pass: one pass without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            for a, b in B.slices(text):
                _, _, kept = _verdicts(T.measure(*B.buffers(text.slice(a, b - a))), model, threshold)
                yield batch.slice(a, b - a).filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)
