"""Paths near points, edits of runs and pages of items are found where their page or document is read: the same rows as from tables, nothing moved."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quireframe.operators import annotations as A
from quireframe.operators import pages as P
from quireframe.operators import paging
from quireframe.operators.chars import Pages


def words_plan(spark, tmp_path, name):
    from quireframe.plans import QUERIES

    spark.createDataFrame([(1, "a b a c " * 200)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    return QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()


def test_nearest_paths_in_pages(spark, monkeypatch):
    """Ties, points on a path, segments of one point, upright and long ones, places without numbers, empty pages, few pairs at a time."""
    rng = random.Random(11)
    spot = lambda: rng.choice([rng.randint(-20, 60) * 5.0, rng.uniform(-100, 300)])
    rows = []
    for d, p in [(d, p) for d in range(20) for p in range(3)] + [(None, 0), (7, None)]:
        n, m = rng.choice([0, 1, 60]), rng.choice([0, 1, 15])
        ends = [[spot() for _ in range(m)] for _ in range(4)]
        for k in range(0, m, 3):
            ends[2][k], ends[3][k] = rng.choice([(ends[0][k], ends[1][k]), (ends[0][k], ends[3][k]), (ends[2][k], ends[1][k])])
        px = [rng.choice([spot()] * 20 + [None, float("nan")]) for _ in range(n)]
        rows.append((d, p, list(range(n)), px, [spot() for _ in range(n)], rng.sample(range(40), m), *ends))
    names = ["point_id", "px", "py", "obj_index", "ax", "ay", "bx", "by"]
    df = spark.createDataFrame(rows, "doc_id long, page_index int, " + ", ".join(f"{c} array<{'int' if c in ('point_id', 'obj_index') else 'double'}>" for c in names))
    part = lambda cs: df.select("doc_id", "page_index", F.explode(F.arrays_zip(*cs)).alias("v")).select("doc_id", "page_index", "v.*")
    near = lambda t: sorted(map(tuple, t.withColumn("dist", F.round("dist", 9)).collect()))
    want = near(A.nearest_path(part(names[:3]), part(names[3:]), 15.0))
    assert near(A.nearest_path(Pages(df, lambda b: b), None, 15.0)) == want and len(want) > 100
    monkeypatch.setattr(A, "PAIRS", 7)
    got = A._nearest(df.where("doc_id is not null and page_index is not null").toArrow().combine_chunks().to_batches()[0], 15.0)
    assert len(got[0]) == len(want) and sorted(zip(got[1].to_pylist(), got[2].tolist())) == sorted((r[2], r[3]) for r in want)


def test_nearest_path_moves_no_words(spark, tmp_path):
    plan = words_plan(spark, tmp_path, "j03_nearest_path")
    assert plan.count("Exchange") == plan.count("REPARTITION_BY_NUM") <= 1 and "Join" not in plan


def test_edits_of_runs_in_pages(spark):
    """Refused sizes and fonts, sizes at the bounds, edits of nothing, runs without a line or a number, empty pages, pages that begin inside a batch."""
    rng = random.Random(12)
    asked = {"dx": [None, 5.0, -2.5], "dy": [None, -3.0], "new_size": [None, None, None, 20.0, 1.0, 400.0, 400.5, 0.5, float("nan")], "new_color": [None, "#ff0000"], "new_font": [None, None, None, "Times-Bold", "Symbol", "Arial"]}
    rows = []
    for d, p in [(d, p) for d in range(8) for p in range(3)]:
        n = rng.choice([0, 1, 40])
        edits = [[rng.choice(v) if rng.random() < 0.5 else None for _ in range(n)] for v in asked.values()]
        rows.append((d, p, list(range(n)), [rng.choice([None, 0, 1, 2, 9, 70, 71, 72]) for _ in range(n)], *[[rng.choice([rng.uniform(1, 90)] * 30 + [None]) for _ in range(n)] for _ in range(5)], ["#000000"] * n, ["Helvetica"] * n, *edits))
    runs = ["run_id", "line_id", "x", "y", "w", "h", "size_eff_pt", "color", "font_name"]
    kind = lambda c: "int" if c.endswith("_id") else "string" if c in ("color", "font_name", "new_color", "new_font") else "double"
    df = spark.createDataFrame(rows, "doc_id long, page_index int, " + ", ".join(f"{c} array<{kind(c)}>" for c in [*runs, *asked]))
    part = lambda t, cs: t.select("doc_id", "page_index", F.explode(F.arrays_zip(*cs)).alias("v")).select("doc_id", "page_index", "v.*")
    edits = part(df, ["run_id", *asked]).where(" or ".join(f"{c} is not null" for c in asked))
    want = sorted(map(repr, P.transform_runs(part(df, runs), edits).collect()))

    def read(batches, change=P.transform_runs(Pages(df, lambda b: b)).read):
        for b in batches:
            for k in range(0, b.num_rows, 5):
                yield change(b.slice(k, 5))

    got = df.mapInArrow(read, "doc_id long, page_index int, " + ", ".join(f"{c} array<{kind(c)}>" for c in runs))
    assert sorted(map(repr, part(got, runs).collect())) == want and len(want) > 200
    assert sum("#ff0000" in r for r in want) > 5 and sum("Symbol" in r for r in want) > 1


def test_transform_runs_moves_no_words(spark, tmp_path):
    plan = words_plan(spark, tmp_path, "p31_transform_runs")
    assert plan.count("Exchange") == plan.count("REPARTITION_BY_NUM") <= 1 and "Join" not in plan and "Window" not in plan


@pytest.mark.parametrize("columns", [["height", "page_break", "keep_next", "header", "notes"], ["height", "need"]])
def test_pages_of_documents(spark, columns):
    """Short, long and empty documents, one without an id, items higher than a page, nulls, halves of a unit, queues of notes."""
    rng = random.Random(13)
    made = {
        "height": lambda: rng.choice([0, 5, 10, 17.0005, 30, None]) if rng.random() < 0.97 else 250, "page_break": lambda: rng.choice([False] * 20 + [True, None]),
        "keep_next": lambda: rng.choice([False] * 4 + [True, None]), "header": lambda: rng.choice([0.0, 0.0, 8.0, -3.0, None]), "notes": lambda: rng.choice([0, 0, 0, 0, 6, 40, None]) if rng.random() < 0.97 else 180,
        "need": lambda: rng.choice([None, 3, 8]),
    }
    sizes = [*(rng.choice([0, 1, 2, 40, 200]) for _ in range(40)), 3000]
    cols = {c: [[v if v is None or c in ("page_break", "keep_next") else float(v) for v in (made[c]() for _ in range(n))] for n in sizes] for c in columns}
    if "need" in columns:  # what is asked for is at most the height
        cols["need"] = [[h if h is None or n is not None and n > h else n for n, h in zip(*x)] for x in zip(cols["need"], cols["height"])]
    kind = lambda c: "boolean" if c in ("page_break", "keep_next") else "double"
    df = spark.createDataFrame([(None if d == 3 else d, *(cols[c][d] for c in columns)) for d in range(len(sizes))], "doc_id long, " + ", ".join(f"{c} array<{kind(c)}>" for c in columns))
    rows = df.select("doc_id", F.posexplode(F.arrays_zip(*columns)).alias("item", "v")).select("doc_id", "item", "v.*")
    want = sorted(map(tuple, paging.paginate(rows, 100.0, 3.0).collect()))
    assert sorted(map(tuple, paging.paginate(paging.Documents(df, lambda b: b), 100.0, 3.0).collect())) == want and len(want) > 3000


def test_paginate_shuffles_and_stores_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(paging, "checkpointed", lambda df: pytest.fail("stored"))
    plan = words_plan(spark, tmp_path, "l02_paginate")
    assert "Exchange" not in plan and "Join" not in plan and "Window" not in plan


def test_edits_reach_a_document_without_an_id(spark, tmp_path):
    from quireframe.plans import QUERIES

    spark.createDataFrame([(None, "a b c d e f g " * 3), (1, "a b c d e f g " * 3)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["p31_transform_runs"](spark, str(tmp_path)).collect()}
    assert got[None] == got[1] and got[1][-2:] == (1, 1)  # the fifth word of the second line; the first is asked for 500 pt
