"""Joins inside a page are made where the page is: the same rows as from tables, and little or nothing moved."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quireframe.functions import geometry as G
from quireframe.operators import annotations as A
from quireframe.operators import references as R
from quireframe.operators.chars import Pages


def test_stale_lines_in_pages(spark):
    """Repeated texts, ties, edits at one place, null texts, and texts that are not there."""
    rng = random.Random(5)
    pages = [(d, p, [rng.randint(0, 30) for _ in range(n)], [rng.choice(["a", "b", "c", "d", None]) for _ in range(n)], [rng.randint(0, 35) for _ in range(m)], [rng.choice(["a", "b", "c", "x", None]) for _ in range(m)])
             for d, p, n, m in [(d, p, rng.randint(0, 12), rng.randint(0, 9)) for d in range(20) for p in range(3)]]
    pages = [(d, p, sorted(set(ids)), texts[: len(set(ids))], runs, old) for d, p, ids, texts, runs, old in pages]
    df = spark.createDataFrame(pages, "doc_id long, page_index int, line_id array<int>, text array<string>, run_id array<int>, old_text array<string>")
    lines = df.select("doc_id", "page_index", F.explode(F.arrays_zip("line_id", "text")).alias("l")).select("doc_id", "page_index", "l.*")
    edits = df.select("doc_id", "page_index", F.explode(F.arrays_zip("run_id", "old_text")).alias("e")).select("doc_id", "page_index", "e.*")
    got = R.relocate_in_pages(Pages(df, lambda b: b))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    want = sorted(map(tuple, R.relocate_stale_lines(edits, lines).collect()))
    assert sorted(map(tuple, got.collect())) == want and len(want) > 50


def test_annotations_under_points_as_by_trying_all(spark):
    rng = random.Random(6)
    spot = lambda: (rng.randint(0, 40) * 2.5, rng.randint(0, 40) * 2.5)
    points = [(d, p, k, *spot()) for d in range(4) for p in range(2) for k in range(60)]
    marks = []
    for d in range(4):
        for p in range(2 if d else 1):
            for k in range(rng.randint(1, 9)):
                (x, y), (w, h) = spot(), spot()
                quads = [[x, y + h, x + w, y + h + 7, x + 3, y, x + w, y + 7], [*spot(), *spot(), *spot(), *spot()]][: rng.randint(0, 2)]
                marks.append((d, p, k, rng.choice(["note", "highlight"]), x, y, w, h, quads))
    points = spark.createDataFrame(points, "doc_id long, page_index int, point_id int, px double, py double")
    annots = spark.createDataFrame(marks, "doc_id long, page_index int, annot_index int, kind string, rx double, ry double, rw double, rh double, quads array<array<double>>")
    inside = F.when((F.col("kind") == "note") | (F.size("quads") == 0), F.col("px").between(F.col("rx"), F.col("rx") + F.col("rw")) & F.col("py").between(F.col("ry"), F.col("ry") + F.col("rh"))).otherwise(
        F.exists("quads", lambda q: G.point_in_quad(F.col("px"), F.col("py"), q)))
    want = points.join(annots, ["doc_id", "page_index"]).filter(inside).groupBy("doc_id", "page_index", "point_id").agg(F.max("annot_index").alias("annot_index"))
    paged = points.groupBy("doc_id", "page_index").agg(F.collect_list(F.struct("point_id", "px", "py")).alias("c")).select("doc_id", "page_index", "c.point_id", "c.px", "c.py")
    want = sorted(map(tuple, want.collect()))
    assert sorted(map(tuple, A.annotation_at_point(points, annots).collect())) == want and len(want) > 50
    assert sorted(map(tuple, A.annotation_at_point(Pages(paged, lambda b: b), annots).collect())) == want


@pytest.mark.parametrize("name", ["j08_relocate_stale_line"])
def test_queries_move_no_words(spark, tmp_path, name):
    from quireframe.plans import QUERIES

    spark.createDataFrame([(1, "a b a c " * 200)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    plan = QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == plan.count("REPARTITION_BY_NUM") <= 1 and "Join" not in plan
