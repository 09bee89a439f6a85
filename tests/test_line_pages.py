"""Lines are built from pages where they are: the same rows as from a table of runs, and merged as by comparing all segments."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from conftest import RUN_SCHEMA, run, run_frame
from quireframe.operators import lines as L
from quireframe.operators import structure as S
from quireframe.operators.chars import Pages
from quireframe.sources import layout

TEXTS = [(1, " ".join(f"wörd{k}" if k % 7 else "שלום" for k in range(1100))), (2, "a\nb 𝒳y\tz"), (3, ""), (4, None), (5, "x")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string")


def same(a, b):
    cols = sorted(b.columns)
    assert sorted(map(repr, a.select(cols).collect())) == sorted(map(repr, b.select(cols).collect()))


def test_lines_of_pages_are_those_of_rows(docs):
    pages = Pages(layout.word_pages(docs), layout.run_reader())
    got = L.lines(pages)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.count() == L.lines(layout.runs(docs)).count() > 90
    same(got, L.lines(layout.runs(docs)))
    same(L.segment_runs(pages), L.segment_runs(layout.runs(docs)))
    same(S.reading_lines(S.read_pages(pages)), S.reading_lines(S.read_pages(layout.runs(docs))))


def merged(r: L._Runs, at: slice) -> list[int]:
    """Lines of one page: every segment is compared with every other until nothing changes."""
    seg = L._segments(np.arange(at.stop - at.start), r.opened[at], r.v[at], r.em[at])
    ids, place = np.unique(seg, return_inverse=True)
    v, em, u0, u1, theta, scale, hidden = (a[at] for a in (r.v, r.em, r.u0, r.u1, r.theta, r.scale, r.hidden))
    members = [np.flatnonzero(place == k) for k in range(len(ids))]
    first = [m[0] for m in members]
    head, tail, top = [m[u0[m].argmin()] for m in members], [m[u1[m].argmax()] for m in members], [em[m].max() for m in members]
    alive, owner = [True] * len(ids), np.arange(len(ids))

    def touching(i):
        for j in range(len(ids)):
            p, q = tail[i], head[j]
            turn, size = abs(theta[p] - theta[q]) % 360, max(em[p], em[q])
            if (j != i and alive[j] and min(turn, 360 - turn) <= 1 and abs(scale[p] - scale[q]) <= 0.01 * scale[p] and hidden[p] == hidden[q]
                    and -0.1 <= (u0[q] - u1[p]) / size <= 0.5 and L._on_baseline(v[first[i]], em[first[i]], max(top[i], top[j]), v[q], em[q])):
                return j

    for i in range(len(ids)):
        while alive[i] and (j := touching(i)) is not None:
            alive[j] = False
            owner[owner == j] = i
            top[i] = max(top[i], top[j])
            head[i], tail[i] = min(head[i], head[j], key=lambda k: (u0[k], k != head[i])), max(tail[i], tail[j], key=lambda k: (u1[k], k == tail[i]))
    return list(ids[owner[place]])


def test_merging_matches_a_comparison_of_all_segments(monkeypatch):
    """Pages in disorder, of sizes, places and angles drawn so that segments overlap, touch and chain."""
    rng = random.Random(11)
    names = [c.strip().split(" ")[0] for c in RUN_SCHEMA.split(",")]
    pages, merges = [], 0
    for p in range(300):
        rows = [run(k, rng.choice(["a", "bc", "d "]), 72 + rng.randint(0, 12) * rng.choice([4, 6]), 700 + rng.choice([0, 0, 1, 2.5, 5, 30]), size=rng.choice([7, 11, 12]), page=p, angle=rng.choice([0, 0, 0, 90]), mode=rng.choice([0, 0, 0, 3]))
                for k in range(rng.randint(1, 14))]
        rng.shuffle(rows)
        pages.append(rows)
    lists = {c: pa.array([[r[c] for r in rows] for rows in pages]) for c in names if c not in ("doc_id", "page_index")}
    segment = L._Runs._merge
    monkeypatch.setattr(L._Runs, "_merge", lambda self, fold: segment(self, np.ones_like(fold)))
    r = L._Runs(pa.RecordBatch.from_arrays(list(lists.values()), names=list(lists)))
    for p in range(300):
        at = slice(*np.searchsorted(r.page, [p, p + 1]))
        want = merged(r, at)
        assert (r.line[at] - at.start).tolist() == want, p
        merges += len(set((r.segment[at]).tolist())) - len(set(want))
    assert merges > 100


def test_a_page_with_nothing_to_show_has_no_lines(spark):
    assert L.lines(run_frame(spark, [run(0, "", 72, 700)])).count() == 0
