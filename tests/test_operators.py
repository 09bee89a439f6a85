"""Ordered, spatial and stateful operators against brute force on small tables."""

import random
import re

import pytest
from pyspark.sql import Window as W, functions as F
from stacks import Stacks

from quireframe.operators import annotations as A, chars as C, flow, history as H, outline as O, pages as P, references as R, scale
from quireframe.operators import search as Q


def hot(spark, n=400, seed=1):
    """Two keys, one of them holding most rows."""
    rng = random.Random(seed)
    return spark.createDataFrame([(0 if rng.random() < 0.8 else 1, k // 16, k, rng.randint(0, 9), rng.choice([None, "a", "b"])) for k in range(n)], "k int, chunk int, pos int, v int, s string")


def test_two_level_windows_equal_plain_windows(spark):
    df = hot(spark)
    w = W.partitionBy("k").orderBy("pos")
    before = w.rowsBetween(W.unboundedPreceding, -1)
    want = df.select("pos", F.row_number().over(w).cast("long").alias("n"), F.sum("v").over(w).alias("s"), F.max("v").over(before).alias("m"), F.lag("s").over(w).alias("l"), F.lead("v").over(w).alias("d"))
    got = scale.row_number(df, ["k"], "chunk", ["pos"], "n")
    got = scale.running_sum(got, ["k"], "chunk", ["pos"], F.col("v").cast("long"), "s2")
    got = scale.running_max(got, ["k"], "chunk", ["pos"], {"m": F.col("v")}, exclusive=True)
    got = scale.lag(got, ["k"], "chunk", ["pos"], {"l": "s"})
    got = scale.lag(got, ["k"], "chunk", ["pos"], {"d": "v"}, back=False)
    got = got.select("pos", "n", F.col("s2").alias("s"), "m", "l", "d")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("seed", range(4))
def test_undo_redo(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.randint(0, 3), k, rng.choice(["do", "undo", "redo", "do"])) for k in range(300)]
    want = set()
    for d in range(4):
        s = Stacks()
        for doc, seq, op in rows:
            if doc == d:
                s.apply(op, seq)
        want |= {(d, i, q, len(s.redo)) for i, q in enumerate(s.undo)}
    got = H.undo_redo_state(spark.createDataFrame(rows, "doc_id long, seq long, op string"))
    assert {tuple(r) for r in got.collect()} == want


def test_undo_redo_by_chunk(spark, monkeypatch):
    monkeypatch.setattr(H, "CHUNK", 16)
    monkeypatch.setattr(H, "PART", 3)
    rng = random.Random(11)
    rows, want = [], set()
    for d in range(40):
        weights = [rng.random(), rng.random(), rng.random(), rng.choice([0, 0.02, 0.1]), 0.1]
        s = Stacks()
        for seq in range(rng.choice([5, 150])):
            r = (d, seq, rng.choices(["do", "undo", "redo", "lock", "unlock"], weights)[0], rng.choice([None, "a", "b"]), rng.choice([None, "x", "y"]))
            rows.append(r)
            s.apply(r[2], seq, r[3], r[4])
        want |= {(d, i, q, len(s.redo)) for i, q in enumerate(s.undo)}
    df = spark.createDataFrame(rows, "doc_id long, seq long, op string, coalesce_key string, owner string").repartition(5)
    got = H.undo_redo_state(df)
    assert {tuple(r) for r in got.collect()} == want
    # the whole history is dealt out by chunk, never by document alone
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    folds = plan.split("_fold(")[1:]
    assert folds and all(re.search(r"RepartitionByExpression \[doc_id#\d+L?, chunk#\d+L?\]", f) for f in folds)


def test_fold_sums_stay_small():
    rng = random.Random(12)
    fold = H.Fold()
    for seq in range(4000):
        if rng.random() < 0.5:
            fold.put(seq, None)
        else:
            fold.move(rng.choice([-1, -1, 1]))
    steps = fold.done()
    assert sum(len(m) for m, _ in steps) < 400


def tree(paths):
    return sorted(paths)


def outline(spark, items):
    rows = [(1, list(p), t, pg, None, a) for p, t, pg, a in items]
    return spark.createDataFrame(rows, "doc_id long, path array<int>, title string, page_index int, y_pt double, action string")


ITEMS = [((0,), "A", 0, None), ((0, 0), "A1", 1, None), ((0, 1), "A2", 2, None), ((0, 1, 0), "A2a", 2, None), ((0, 2), "A3", 3, None), ((1,), "B", 4, None)]


@pytest.mark.parametrize(
    "op, target, want",
    [
        ("delete", [0, 1], {"A": (0,), "A1": (0, 0), "A3": (0, 1), "B": (1,)}),
        ("indent", [0, 1], {"A": (0,), "A1": (0, 0), "A2": (0, 0, 0), "A2a": (0, 0, 0, 0), "A3": (0, 1), "B": (1,)}),
        ("outdent", [0, 1], {"A": (0,), "A1": (0, 0), "A2": (1,), "A2a": (1, 0), "A3": (1, 1), "B": (2,)}),
        ("move_down", [0, 0], {"A": (0,), "A2": (0, 0), "A2a": (0, 0, 0), "A1": (0, 1), "A3": (0, 2), "B": (1,)}),
        ("move_up", [0], {"A": (0,), "A1": (0, 0), "A2": (0, 1), "A2a": (0, 1, 0), "A3": (0, 2), "B": (1,)}),
        ("insert_child", [1], {"A": (0,), "A1": (0, 0), "A2": (0, 1), "A2a": (0, 1, 0), "A3": (0, 2), "B": (1,), "N": (1, 0)}),
        ("insert_sibling", [0], {"A": (0,), "A1": (0, 0), "A2": (0, 1), "A2a": (0, 1, 0), "A3": (0, 2), "N": (1,), "B": (2,)}),
    ],
)
def test_outline_edits(spark, op, target, want):
    e = spark.createDataFrame([(1, op, target, "N", 0)], "doc_id long, op string, target array<int>, title string, page int")
    got = O.edit_outline(outline(spark, ITEMS), e)
    assert {r["title"]: tuple(r["path"]) for r in got.collect()} == want


def test_outline_loses_a_page(spark):
    gone = spark.createDataFrame([(1, 2)], "doc_id long, gone int")
    got = {r["title"]: (tuple(r["path"]), r["page_index"]) for r in O.without_deleted_page(outline(spark, ITEMS), gone).collect()}
    assert got == {"A": ((0,), 0), "A1": ((0, 0), 1), "A3": ((0, 1), 2), "B": ((1,), 3)}
    up = {r["title"]: tuple(r["path"]) for r in O.without_deleted_page(outline(spark, ITEMS), spark.createDataFrame([(1, 0)], "doc_id long, gone int")).collect()}
    assert up == {"A1": (0,), "A2": (1,), "A2a": (1, 0), "A3": (2,), "B": (3,)}


@pytest.mark.parametrize("seed", range(3))
def test_outline_from_random_headings(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice([1, 1, 1, 2]), k // 8, k, rng.randint(1, 5), f"t{k}") for k in range(80)]
    want = {}
    for d in (1, 2):
        stack, kids = [], {(): 0}
        for doc, _, pos, level, _t in rows:
            if doc != d:
                continue
            while stack and stack[-1][0] >= level:
                stack.pop()
            parent = stack[-1][1] if stack else ()
            path = (*parent, kids[parent])
            kids[parent] += 1
            kids[path] = 0
            stack.append((level, path))
            want[(d, pos)] = path
    df = spark.createDataFrame(rows, "doc_id long, page_index int, pos int, level int, title string")
    got = {(r["doc_id"], r["pos"]): tuple(r["path"]) for r in O.outline_from_headings(df, max_level=5).collect()}
    assert got == want


def test_page_moves(spark):
    pages = spark.createDataFrame([(1, i, f"p{i}") for i in range(5)], "doc_id long, page_index int, name string")

    def names(df):
        return [r["name"] for r in df.orderBy("page_index").collect()]

    mv = lambda a, b: spark.createDataFrame([(1, a, b)], "doc_id long, src int, dst int")
    assert names(P.move_pages(pages, mv(0, 3))) == ["p1", "p2", "p3", "p0", "p4"]
    assert names(P.move_pages(pages, mv(4, 1))) == ["p0", "p4", "p1", "p2", "p3"]
    assert names(P.duplicate_pages(pages, spark.createDataFrame([(1, 1)], "doc_id long, dup int"))) == ["p0", "p1", "p1", "p2", "p3", "p4"]
    assert names(P.delete_pages(pages, spark.createDataFrame([(1, 2)], "doc_id long, gone int"))) == ["p0", "p1", "p3", "p4"]


def test_commands_merge_and_locks_hold(spark):
    rows = [(1, "do", "a", "x"), (2, "do", "a", "x"), (3, "do", "b", "x"), (4, "undo", None, "x"), (5, "do", "a", "x"), (6, "lock", None, "x"), (7, "do", "c", "y"), (8, "undo", None, "x"), (9, "unlock", None, "y"),
            (10, "do", "d", "x"), (11, "lock", None, "y"), (12, "unlock", None, "x"), (13, "do", "e", "y"), (14, "do", "e", "y"), (15, "undo", None, "y")]
    df = spark.createDataFrame([(1, *r) for r in rows], "doc_id long, seq long, op string, coalesce_key string, owner string")
    assert sorted(tuple(r)[1:] for r in H.undo_redo_state(df).collect()) == [(0, 5, 1), (1, 10, 1)]
    s = Stacks()
    for q, op, key, owner in rows:
        s = Stacks.load(s.dump())
        s.apply(op, q, key, owner)
    assert (s.undo, s.redo, s.holder) == ([5, 10], [14], None)


def test_match_neighbours_across_pages(spark):
    df = spark.createDataFrame([(1, p, k, 0) for p, k in [(0, 1), (0, 5), (2, 3), (7, 0)]] + [(2, 0, 0, 0)], "doc_id long, page_index int, line_id int, start int")
    got = {(r["doc_id"], r["page_index"], r["line_id"]): (r["prev"][:2], r["next"][:2], r["prev_wraps"], r["next_wraps"]) for r in Q.match_cursor(df).collect()}
    assert got[1, 0, 5] == ((0, 1), (2, 3), False, False) and got[1, 0, 1] == ((7, 0), (0, 5), True, False) and got[1, 7, 0] == ((2, 3), (0, 1), False, True)
    assert got[2, 0, 0] == ((0, 0), (0, 0), True, True)


def test_list_numbering(spark):
    levels = [0, 1, 1, 0, 1, 2, 1, 0]
    df = spark.createDataFrame([(1, 1, k // 2, k, lv, 1) for k, lv in enumerate(levels)], "doc_id long, list_id int, chunk int, pos int, level int, start int")
    got = [r["number"] for r in R.list_numbering(df, "chunk", 3).orderBy("pos").collect()]
    assert got == [1, 1, 2, 2, 1, 1, 2, 3]


def test_bands_walk_matches_the_rule():
    x, y, w, h = [0, 10, 20, 0, 10], [100, 101, 99, 80, 80], [8] * 5, [10] * 5
    assert C.line_bands(list(zip(x, y, w, h))) == ([0, 0, 0, 1, 1], [(False, 99, 111), (False, 80, 90)])
    assert C.line_bands([(0, 100, 10, 12), (0, 88, 10, 12), (1, 76, 10, 12)]) == ([0, 0, 0], [(True, 0, 11)])


def test_quads_of_vertical_lines_and_turned_pages(spark):
    rows = [(1, 0, k, 10.0, 500.0 - 12 * k, 10.0, 12.0) for k in range(5)] + [(2, 0, k, 10.0 * k, 50.0 + k % 2, 10.0, 12.0) for k in range(4)]
    banded = C.char_line_bands(spark.createDataFrame(rows, "doc_id long, page_index int, pos int, x double, y double, w double, h double"))
    ranges = spark.createDataFrame([(1, 0, 2, 1), (2, 0, 1, 2)], "doc_id long, page_index int, from_pos int, to_pos int")
    pages = spark.createDataFrame([(1, 0, 0), (2, 0, 90)], "doc_id long, page_index int, rotation int")
    got = {r["doc_id"]: r["quad"] for r in C.quads_for_range(banded, ranges, pages).collect()}
    assert got[1] == [10, 500, 20, 500, 10, 476, 20, 476]
    assert got[2] == [10, 50, 10, 63, 30, 50, 30, 63]
    flat = {r["doc_id"]: r["quad"] for r in C.quads_for_range(banded, ranges).collect()}
    assert flat[2] == [10, 63, 30, 63, 10, 50, 30, 50]


def test_annotation_edits_follow_each_other(spark):
    a = spark.createDataFrame([(1, 0, k, "note", f"t{k}", "me") for k in range(4)], "doc_id long, page_index int, annot_index int, kind string, text string, author string")
    e = spark.createDataFrame([(1, 0, 0, "remove", 0, None), (1, 0, 1, "set_text", 0, "first"), (1, 0, 2, "add", None, "new"), (1, 0, 3, "remove", 1, None), (1, 0, 4, "set_text", 2, "newer"), (1, 0, 5, "set_text", 9, "no")],
                              "doc_id long, page_index int, seq int, op string, annot_index int, text string").selectExpr("*", "'note' as kind", "'me' as author")
    got = [(r["annot_index"], r["text"]) for r in A.edit_annotations(a, e).orderBy("annot_index").collect()]
    assert got == [(0, "first"), (1, "t3"), (2, "newer")]


def test_markups_move_along_the_text(spark):
    quad = [0.0, 10.0, 5.0, 10.0, 0.0, 0.0, 5.0, 0.0]
    marks = spark.createDataFrame([(1, 0, 0, "Highlight", [quad]), (1, 0, 1, "Text", [quad])], "doc_id long, page_index int, annot_index int, subtype string, quads array<array<double>>")
    zone = (1, 0, -10.0, -10.0, 50.0, 50.0, 0.0, 10.0, 1.0, 2.0, 0.0, 1.0)
    z = spark.createDataFrame([zone, zone, (1, 0, -10.0, -10.0, 50.0, 50.0, 40.0, 10.0, 100.0, 0.0, 0.0, 1.0)], "doc_id long, page_index int, zl double, zb double, zr double, zt double, u_from double, em double, dx double, dy double, cos double, sin double")
    got = {r["annot_index"]: (r["moved"], r["quads"][0][0], r["quads"][0][1]) for r in A.shift_markups(marks, z).collect()}
    assert got == {0: (1, 2.0, 14.0), 1: (0, 0.0, 10.0)}


def test_nothing_is_cut(spark):
    many = spark.createDataFrame([(1, k // 100, k, 1, f"h{k}") for k in range(10_001)], "doc_id long, page_index int, pos int, level int, title string")
    assert O.outline_from_headings(many, max_level=2).count() == 10_001
    text = "".join(chr(1 + k % 8) * (k + 1) for k in range(8)) + "".join(chr(0x3041 + k) for k in range(60))
    from quireframe.operators.reports import char_issue_report

    issues = char_issue_report(spark.createDataFrame([(1, text)], "doc_id long, text string"), "doc_id", "text")
    assert issues.filter("kind = 'missing'").count() == 60 and issues.filter("kind = 'control'").count() == 8


def test_annotation_order(spark):
    rows = [(1, 0, 0, 100.0, 50.0, 10.0), (1, 0, 1, 10.0, 52.0, 10.0), (1, 0, 2, 5.0, 90.0, 10.0), (1, 0, 3, 5.0, 10.0, 10.0)]
    df = spark.createDataFrame(rows, "doc_id long, page_index int, annot_index int, left double, top double, height double")
    got = {r["annot_index"]: r["place"] for r in A.annotation_reading_order(df).collect()}
    assert got == {3: 0, 1: 1, 0: 2, 2: 3}


def test_nearest_path_brute_force(spark):
    import math

    rng = random.Random(2)
    pts = [(1, 0, k, rng.uniform(0, 300), rng.uniform(0, 300)) for k in range(40)]
    seg = [(1, 0, k % 12, *(rng.uniform(0, 300) for _ in range(4))) for k in range(30)]

    def dist(p, s):
        (ax, ay, bx, by), (px, py) = s[3:], p[3:]
        l2 = (bx - ax) ** 2 + (by - ay) ** 2
        t = 0 if l2 == 0 else max(0, min(1, ((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / l2))
        return math.hypot(px - ax - t * (bx - ax), py - ay - t * (by - ay))

    want = {}
    for p in pts:
        best = min((dist(p, s), s[2]) for s in seg)
        if best[0] <= 15:
            want[p[2]] = best[1]
    got = A.nearest_path(spark.createDataFrame(pts, "doc_id long, page_index int, point_id int, px double, py double"), spark.createDataFrame(seg, "doc_id long, page_index int, obj_index int, ax double, ay double, bx double, by double"), 15.0)
    assert {r["point_id"]: r["obj_index"] for r in got.collect()} == want


def test_logical_text_of_a_hebrew_line(spark):
    rows = [(1, 0, k, ch, 10.0 * x, 100.0, 9.0, 10.0, 0) for k, (ch, x) in enumerate(zip("שלום", (3, 2, 1, 0)))] + [(1, 0, 10 + k, ch, 10.0 * k, 50.0, 9.0, 10.0, 1) for k, ch in enumerate("abc")]
    df = spark.createDataFrame(rows, "doc_id long, page_index int, pos int, ch string, x double, y double, w double, h double, line int")
    assert {r["line"]: r["text"] for r in C.logical_line_text(df).collect()} == {0: "שלום", 1: "abc"}


@pytest.mark.parametrize("seed", range(3))
def test_wrap_brute_force(spark, seed):
    rng = random.Random(seed)
    words = ["x" * rng.choice([1, 3, 5, 9, 27]) for _ in range(60)]
    cap, lines, cur = 10, [], ""
    for w in words:
        for k in range(0, len(w), cap):
            piece, glue = w[k : k + cap], "" if k else " "
            if cur and len(cur) + len(glue) + len(piece) > cap:
                lines.append(cur)
                cur = piece
            else:
                cur = cur + glue + piece if cur else piece
    lines.append(cur)
    df = spark.createDataFrame([(1, words)], "doc_id long, words array<string>")
    assert [r["text"] for r in flow.wrap_words(df, 60.0, 10.0).orderBy("line_no").collect()] == lines


def test_transitive_footnotes(spark):
    refs = spark.createDataFrame([(1, 0, 5, "b"), (1, 0, 9, "a"), (1, 0, 9, "zz")], "doc_id long, chunk int, pos int, note_id string")
    notes = spark.createDataFrame([(1, "a", ["c"]), (1, "b", ["d", "a"]), (1, "c", ["b"]), (1, "d", ["e"]), (1, "e", []), (1, "un", [])], "doc_id long, note_id string, cites array<string>")
    got = {r["note_id"]: r["number"] for r in R.footnote_numbers(refs, notes, "chunk").collect()}
    assert got == {"b": 1, "a": 2, "d": 3, "c": 4, "e": 5}


@pytest.mark.parametrize("chunk", [4096, 7])
def test_operation_lock_by_owner(spark, monkeypatch, chunk):
    monkeypatch.setattr(H, "CHUNK", chunk)
    rng = random.Random(chunk)
    rows = [(d, k, rng.choice(["lock", "unlock", "do", "undo", "redo", "do"]), rng.choice(["a", "b", None])) for d in (1, 2) for k in range(120)]
    want = {}
    for d in (1, 2):
        holder = None
        for _, k, op, owner in [r for r in rows if r[0] == d]:
            own = holder == (owner,)
            if op == "lock":
                refused, after = holder is not None, holder or (owner,)
            elif op == "unlock":
                refused, after = not own, None if own else holder
            else:
                refused, after = holder is not None and (op != "do" or not own), holder
            want[d, k] = refused
            holder = after
    got = {(r["doc_id"], r["seq"]): r["refused"] for r in H.operation_lock(spark.createDataFrame(rows, "doc_id long, seq long, op string, owner string")).collect()}
    assert got == want
    alone = H.operation_lock(spark.createDataFrame([(1, 0, "lock"), (1, 1, "do"), (1, 2, "lock"), (1, 3, "unlock"), (1, 4, "unlock")], "doc_id long, seq long, op string")).orderBy("seq").collect()
    assert [r["refused"] for r in alone] == [False, False, True, False, True] and "owner" not in alone[0].asDict()


def test_notes_go_on_over_indented_lines(spark):
    from quireframe.operators import markdown as M

    text = "[^a]: one\n  two  \n\tthree\n\n  not\n[^b]: x\n  [^c]: inside\n  [r]: http://inside\n[s]: http://y\n  on\n[^d]:\n text"
    got = {(r["kind"], r["label"]): r["value"] for r in M.md_definitions(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()}
    assert got == {("note", "a"): "one two three", ("note", "b"): "x [^c]: inside [r]: http://inside", ("ref", "s"): "http://y", ("note", "d"): ""}


def test_match_rollup(spark):
    m = spark.createDataFrame([(1, 0), (1, 0), (1, 2), (2, 0)], "doc_id long, page_index int")
    assert {tuple(r) for r in Q.match_rollup(m).collect()} == {(1, 0, 2), (1, 2, 1), (2, 0, 1), (1, None, 3), (2, None, 1), (None, None, 4)}
