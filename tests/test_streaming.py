"""Stream jobs give what the batch jobs give."""

import random
import time

from pyspark.sql import functions as F
from stacks import Stacks

from quireframe.streaming import jobs

SF = "/root/testdata/sf0.001"


def replay(spark, tmp_path, df, name):
    """The rows of ``df`` as a file stream of a few micro-batches."""
    src = str(tmp_path / name)
    df.repartition(3).write.parquet(src)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)


def test_search_stream_appends_what_batch_finds(spark, tmp_path):
    c = spark.read.parquet(f"{SF}/conversations.parquet").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("page_index"), F.lit(0).alias("line_id"), "text")
    log = jobs.ProgressLog()
    spark.streams.addListener(log)
    q = jobs.incremental_search(replay(spark, tmp_path, c, "pages"), "en").writeStream.format("memory").queryName("hits").option("checkpointLocation", str(tmp_path / "cp1")).start()
    q.processAllAvailable()
    q.stop()
    spark.streams.removeListener(log)
    got = sorted(map(tuple, spark.table("hits").collect()))
    assert got == sorted(map(tuple, jobs.incremental_search(c, "en").collect())) and got


def test_progress_from_observed_metrics(spark, tmp_path):
    c = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "text")
    log = jobs.ProgressLog()
    spark.streams.addListener(log)
    seen = jobs.with_progress(replay(spark, tmp_path, c, "watched").where("turn < 2"), F.col("turn"))
    q = seen.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "cp5")).start()
    q.processAllAvailable()
    q.stop()
    end = time.time() + 20
    while (not log.done or log.done[-1] < c.where("turn < 2").count()) and time.time() < end:
        time.sleep(0.2)
    spark.streams.removeListener(log)
    assert log.done[-1] == c.where("turn < 2").count() < c.count() and log.done == sorted(log.done)
    assert log.steps[-1] == c.where("turn < 2").agg(F.max("turn")).first()[0]


def test_page_upserts_keep_the_newest(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet").select(F.col("user_id").alias("doc_id"), (F.col("event_id") % 3).cast("int").alias("page_index"), F.col("event_id").alias("version"), "event_type")
    target = str(tmp_path / "state")
    q = replay(spark, tmp_path, e, "updates").writeStream.foreachBatch(jobs.upsert_pages(target)).option("checkpointLocation", str(tmp_path / "cp2")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r["doc_id"], r["page_index"]): r["version"] for r in jobs.read_pages(spark, target).collect()}
    want = {(r["doc_id"], r["page_index"]): r["v"] for r in e.groupBy("doc_id", "page_index").agg(F.max("version").alias("v")).collect()}
    assert got == want


def test_undo_state_across_batches(spark, tmp_path):
    rows = [(d, s, op) for s, op in enumerate(["do", "do", "undo", "redo", "undo", "do", "undo"]) for d in (1, 2)]
    parts = [rows[:6], rows[6:10], rows[10:]]
    src = str(tmp_path / "cmd")
    for k, part in enumerate(parts):
        spark.createDataFrame(part, "doc_id long, seq long, op string").coalesce(1).write.mode("append").parquet(f"{src}/p={k}")
    stream = spark.readStream.schema("doc_id long, seq long, op string, p int").option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(src).drop("p")
    q = jobs.undo_redo_stream(stream).writeStream.outputMode("update").format("memory").queryName("undo").option("checkpointLocation", str(tmp_path / "cp3")).start()
    q.processAllAvailable()
    q.stop()
    s = Stacks()
    for _, seq, op in rows[::2]:
        s.apply(op, seq)
    last = spark.table("undo").filter("doc_id = 1").collect()[-1]
    assert (last["applied"], last["redoable"], last["top"]) == (len(s.undo), len(s.redo), s.undo[-1])


def test_undo_state_keeps_a_row_per_entry(spark, tmp_path):
    rng = random.Random(3)
    rows = [(7, s, rng.choice(["do", "do", "do", "undo", "redo", "lock", "unlock"]), rng.choice("abc"), rng.choice("xy")) for s in range(120)] + [(7, 120, "unlock", None, "x"), (7, 121, "unlock", None, "y")] + [(7, 122 + k, "do", str(k), "x") for k in range(40)] + [(7, 162, "undo", None, "x")]
    columns = "doc_id long, seq long, op string, coalesce_key string, owner string"
    src = str(tmp_path / "cmd")
    for k, part in enumerate((rows[:50], rows[50:90], rows[90:])):
        spark.createDataFrame(part, columns).coalesce(1).write.mode("append").parquet(f"{src}/p={k}")
    stream = spark.readStream.schema(columns + ", p int").option("maxFilesPerTrigger", 1).parquet(src).drop("p")
    q = jobs.undo_redo_stream(stream).writeStream.outputMode("update").format("memory").queryName("entries").option("checkpointLocation", str(tmp_path / "cp5")).start()
    q.processAllAvailable()
    kept = q.recentProgress[-1].stateOperators[0].numRowsTotal
    q.stop()
    s = Stacks()
    for _, seq, op, key, owner in rows:
        s.apply(op, seq, key, owner)
    got = max(spark.table("entries").collect(), key=lambda r: r["top"] or 0)
    assert (got["applied"], got["redoable"], got["top"]) == (len(s.undo), len(s.redo), s.undo[-1])
    assert kept >= len(s.undo) + len(s.redo) >= 40


def test_activity_stream_closes_windows(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value", "user_id")
    q = jobs.activity(replay(spark, tmp_path, e, "act"), "1 hour", late="400 days").writeStream.outputMode("update").format("memory").queryName("act").option("checkpointLocation", str(tmp_path / "cp4")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r["window_start"], r["event_type"]): r["n"] for r in spark.sql("select window_start, event_type, max(n) n from act group by 1, 2").collect()}
    want = {(r["window_start"], r["event_type"]): r["n"] for r in jobs.activity(e, "1 hour").collect()}
    assert got == want


def test_map_images_loads_once_per_task(spark):
    from quireframe.sources.corpus import map_images

    def make():
        def recognise(pdf):
            return pdf.assign(text=pdf["vec_id"].map(lambda v: f"img{v}"))[["vec_id", "text"]]

        return recognise

    im = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id")
    assert map_images(im, make, "vec_id long, text string").count() == im.count()
