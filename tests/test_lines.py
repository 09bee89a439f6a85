"""Lines, reading order and exports on small hand-made pages."""

import pytest
from pyspark.sql import functions as F

from conftest import run, run_frame
from quireframe.operators import lines as L
from quireframe.operators import structure as S


def line_texts(spark, rows):
    out = L.lines(run_frame(spark, rows)).orderBy("doc_id", "page_index", "line_id").collect()
    return [r["text"] for r in out]


def test_glyph_runs_join_and_generated_space_counts_once(spark):
    rows = [run(0, "H", 72, 700), run(1, "o", 78, 700), run(2, "la", 90, 700, space=True), run(3, "mundo", 72, 680)]
    assert line_texts(spark, rows) == ["Ho la", "mundo"]


def test_space_in_the_text_is_not_doubled(spark):
    assert line_texts(spark, [run(0, "Hola ", 72, 700), run(1, "mundo", 102, 700, space=True)]) == ["Hola mundo"]


def test_wide_gap_after_a_real_space_still_joins(spark):
    rows = [run(0, "uno ", 72, 700), run(1, "dos", 112, 700)]  # gap of 1.3 em
    assert line_texts(spark, rows) == ["uno dos"]
    assert line_texts(spark, [run(0, "uno", 72, 700), run(1, "dos", 112, 700)]) == ["uno", "dos"]


def test_superscript_joins_but_a_lower_line_does_not(spark):
    rows = [run(0, "x", 72, 700), run(1, "2", 78, 705, size=7), run(2, "y", 82, 700)]
    assert line_texts(spark, rows) == ["x2y"]
    assert line_texts(spark, [run(0, "x", 72, 700), run(1, "2", 78, 690, size=12)]) == ["x", "2"]


def test_baseline_is_that_of_the_first_run(spark):
    # each step is small, but the fourth has drifted too far from the first
    rows = [run(k, "ab", 72 + 12 * k, 700 + 2 * k) for k in range(4)]
    segs = {r["run_id"]: r["segment_id"] for r in L.segment_runs(run_frame(spark, rows)).collect()}
    assert segs == {0: 0, 1: 0, 2: 2, 3: 2}


def test_visible_and_hidden_text_stay_apart(spark):
    assert line_texts(spark, [run(0, "ab", 72, 700), run(1, "cd", 84, 700, mode=3)]) == ["ab", "cd"]


def test_piece_written_late_is_merged_and_order_is_visual(spark):
    rows = [run(0, "uno", 72, 700), run(1, "tres", 112, 700), run(2, "otra", 72, 650), run(3, "dos", 92, 700, font="Helvetica-Bold")]
    line = L.lines(run_frame(spark, rows)).orderBy("line_id").first()
    assert line["run_ids"] == [0, 3, 1]
    assert [s["font_name"] for s in line["spans"]] == ["Helvetica", "Helvetica-Bold", "Helvetica"]


def test_rotated_line(spark):
    rows = [run(0, "ab", 72, 700, angle=90, width=0), run(1, "cd", 72, 712, angle=90, width=0)]
    rows[1]["f"] = 712.0
    line = L.lines(run_frame(spark, rows)).collect()
    assert [x["text"] for x in line] == ["abcd"] and line[0]["angle_deg"] == 90


def test_hebrew_line_reads_right_to_left(spark):
    line = L.lines(run_frame(spark, [run(0, "אב", 72, 700), run(1, " ", 84, 700), run(2, "גד", 90, 700)])).first()
    assert line["direction"] == "rtl" and line["text"] == "גד אב" and line["notice"] == "mixed"


def page_lines(spark, rows):
    pieces = S.read_pages(run_frame(spark, rows))
    return [r["text"] for r in S.reading_lines(pieces).orderBy("page_index", "row_no").collect()]


def test_columns_are_read_one_after_the_other(spark):
    left = [run(k, f"izq{k}", 72, 700 - 14 * k, width=60) for k in range(3)]
    right = [run(10 + k, f"der{k}", 300, 700 - 14 * k, width=60) for k in range(3)]
    assert page_lines(spark, left + right) == ["izq0", "izq1", "izq2", "der0", "der1", "der2"]


def test_cells_share_a_row(spark):
    rows = [run(0, "a", 72, 700), run(1, "b", 200, 701), run(2, "c", 72, 640), run(3, "d", 200, 640)]
    assert page_lines(spark, rows) == ["a b", "c d"]


def test_row_clustering_matches_a_plain_loop():
    import random

    rng = random.Random(3)
    for _ in range(200):
        n = rng.randint(1, 12)
        y = [rng.choice([700, 699, 697, 694, 690, 650]) + rng.random() * 3 for _ in range(n)]
        size = [rng.choice([8.0, 12.0, 20.0]) for _ in range(n)]
        want, rows = {}, []
        for k in sorted(range(n), key=lambda k: (-y[k], k)):
            for r in rows:
                if abs(y[r] - y[k]) <= 0.35 * max(size[r], size[k]):
                    want[k] = r
                    break
            else:
                rows.append(k)
                want[k] = k
        import numpy as np

        got = S._row_openers(np.arange(n), np.array(y), np.array(size))
        assert list(got) == [want[k] for k in range(n)]


def test_markdown_headings_lists_bold_and_escapes(spark):
    rows = [
        run(0, "Título", 72, 760, size=22, font="Helvetica-Bold"),
        run(1, "Cuerpo con *estrella* bastante largo", 72, 700),
        run(2, "• punto", 72, 684),
        run(3, "2) dos", 72, 668),
        run(4, "#no", 72, 652),
        run(5, "negrita", 72, 636, font="Arial-Bold"),
    ]
    df = run_frame(spark, rows)
    pieces = S.read_pages(df)
    pages = df.select("doc_id", "page_index").distinct()
    out = S.to_markdown(S.render_markdown(pieces, S.body_font_size(pieces), pages), pages).first()["page_markdown"]
    assert out == "# Título\n\nCuerpo con \\*estrella\\* bastante largo\n- punto\n2. dos\n\\#no\n**negrita**"


def test_plain_text_marks_pages(spark):
    rows = [run(0, "uno", 72, 700), run(0, "dos", 72, 700, page=1)]
    df = run_frame(spark, rows)
    t = S.to_plain_text(S.reading_lines(S.read_pages(df)), df.select("doc_id", "page_index").distinct()).orderBy("page_index").collect()
    assert "".join(r["page_text"] for r in t) == "uno\n\n--- Página 2 ---\n\ndos"


def test_body_size_tie_goes_to_the_first(spark):
    df = run_frame(spark, [run(0, "abcd", 72, 700, size=10), run(1, "efgh", 72, 600, size=14)])
    assert S.body_font_size(S.read_pages(df)).first()["body_pt"] == 10.0


def test_shuffles_only_by_page(spark):
    from quireframe.sources import layout

    docs = spark.createDataFrame([(1, "a b c d " * 40)], "doc_id long, text string")
    plan = S.read_pages(layout.runs(docs))._jdf.queryExecution().executedPlan().toString()
    # one for the runs, and one after each of the two Python steps, which lose the partitioning
    assert plan.count("Exchange hashpartitioning(doc_id") == 3 and plan.count("Exchange") == 3
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
