"""Structured Streaming: search as pages arrive, page invalidation, histories, activity windows, progress."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

from quireframe.operators.history import latest_pages
from quireframe.operators.search import find_text


def latest_queries(queries: DataFrame) -> DataFrame:
    """queries(session, seq, q): a newer query takes the place of an older one."""
    return queries.groupBy("session").agg(F.max_by("q", "seq").alias("q"), F.max("seq").alias("seq"))


def incremental_search(pages: DataFrame, q: str, **how) -> DataFrame:
    """Matches of ``q`` in pages as they arrive, stream or batch: stateless, so results are only ever appended."""
    return find_text(pages, q, **how)


def upsert_pages(target: str):
    """A ``foreachBatch`` writer that keeps the newest version of every page in the table at ``target``.

    Only the buckets that a batch touches are rewritten.  Each goes to a path of its own named by the batch, and readers
    take the newest batch of a bucket, so a task that runs again writes the same files.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = latest_pages(batch).withColumn("bucket", F.pmod(F.hash("doc_id"), F.lit(64)))
        try:
            old = read_pages(spark, target, before=batch_id)
        except AnalysisException:  # first batch: nothing there yet
            old = None
        if old is not None:
            touched = new.select("bucket").distinct()
            new = latest_pages(old.join(touched, "bucket", "left_semi").drop("bucket", "batch").unionByName(new.drop("bucket"))).withColumn("bucket", F.pmod(F.hash("doc_id"), F.lit(64)))
        new.write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/batch={batch_id}")

    return write


def read_pages(spark, target: str, before: int | None = None) -> DataFrame:
    """The current state of a table written by :func:`upsert_pages`, or its state before a batch."""
    all_rows = spark.read.option("basePath", target).parquet(f"{target}/batch=*")
    if before is not None:
        all_rows = all_rows.filter(F.col("batch") < before)
    newest = all_rows.groupBy("bucket").agg(F.max("batch").alias("batch"))
    return all_rows.join(newest, ["bucket", "batch"], "left_semi")


class UndoState(StatefulProcessor):
    """A document's undo and redo stacks as one tape with a cursor between them: a state row per entry, by (doc_id, place), and one for the ends and the lock.

    Batches read and write only the entries they touch; the rules are those of :class:`~quireframe.operators.history.Stacks`.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tape = handle.getMapState("tape", "place long", "seq long, key string")
        self.ends = handle.getValueState("ends", "cursor long, size long, holder string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        cursor, size, holder = self.ends.get() if self.ends.exists() else (0, 0, None)
        holder, stored, new = holder and tuple(json.loads(holder)), size, {}
        at = lambda place: new[place] if place in new else tuple(self.tape.getValue((place,)))
        pdf = pd.concat(list(rows)).sort_values("seq")
        pdf = pdf.astype(object).where(pdf.notna(), None)
        none = [None] * len(pdf)
        for seq, op, merge_key, owner in zip(pdf["seq"].tolist(), pdf["op"].tolist(), *(pdf[c].tolist() if c in pdf else none for c in ("coalesce_key", "owner"))):
            if op == "lock":
                holder = holder or (owner,)
            elif op == "unlock":
                holder = None if holder == (owner,) else holder
            elif op in ("undo", "redo"):
                if holder is None:
                    cursor = max(0, cursor - 1) if op == "undo" else min(size, cursor + 1)
            elif holder in (None, (owner,)):
                if cursor and merge_key is not None and at(cursor - 1)[1] == merge_key:
                    cursor -= 1
                new[cursor] = (int(seq), merge_key)
                cursor = size = cursor + 1
        for place, entry in new.items():
            if place < size:
                self.tape.updateValue((place,), entry)
        for place in range(size, stored):
            self.tape.removeKey((place,))
        self.ends.update((cursor, size, holder and json.dumps(holder)))
        yield pd.DataFrame({"doc_id": [key[0]], "applied": [cursor], "redoable": [size - cursor], "top": [at(cursor - 1)[0] if cursor else None]}).astype({"top": "Int64"})

    def close(self) -> None:
        pass


def undo_redo_stream(commands: DataFrame) -> DataFrame:
    """Per document and micro-batch: how many commands are applied, how many could be redone, and the last applied one.

    State by entry needs the RocksDB store, which is set for the session.  What a micro-batch brings for one document is
    sorted in its task; bound it by the source's options.
    """
    commands.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return commands.groupBy("doc_id").transformWithStateInPandas(UndoState(), "doc_id long, applied long, redoable long, top long", "Update", "None")


def activity(events: DataFrame, width: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Events counted per window and type; tumbling, or sliding with ``slide``."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    g = events.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    """Bursts of one user's events with no pause longer than ``gap``."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    g = events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return g.select("user_id", F.col("w.start").alias("session_start"), "n")


PROGRESS = "progress"


def with_progress(df: DataFrame, step: Column | None = None) -> DataFrame:
    """``df`` with the metrics that a progress bar needs, observed as the rows pass: done (rows) and step (the highest ``step`` seen)."""
    return df.observe(PROGRESS, F.count(F.lit(1)).alias("done"), F.max(step if step is not None else F.lit(None).cast("long")).cast("long").alias("step"))


def observed(df: DataFrame, step: Column | None = None) -> tuple[DataFrame, Observation]:
    """The same for a batch job: the observation is filled by the first action that runs ``df``."""
    seen = Observation(PROGRESS)
    return df.observe(seen, F.count(F.lit(1)).alias("done"), F.max(step if step is not None else F.lit(None).cast("long")).cast("long").alias("step")), seen


class ProgressLog(StreamingQueryListener):
    """``done``: rows so far after every micro-batch; ``steps``: the highest step so far.

    Both come from the metrics of ``with_progress`` where the query has them; else rows are those that the source gave.
    """

    def __init__(self) -> None:
        self.done: list[int] = []
        self.steps: list[int | None] = []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        seen = event.progress.observedMetrics.get(PROGRESS)
        self.done.append((self.done[-1] if self.done else 0) + (event.progress.numInputRows if seen is None else seen["done"]))
        known = [s for s in (self.steps[-1] if self.steps else None, seen and seen["step"]) if s is not None]
        self.steps.append(max(known, default=None))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
