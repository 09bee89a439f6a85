"""From text objects to lines.

Text objects arrive in content-stream order (``run_id``).  Neighbours in that order that keep direction, scale,
visibility, baseline and a small gap form a segment; segments that touch are merged into lines.

A page is the unit of work.  Runs are rows, which one shuffle gathers by (document, page), or ``Pages``, whose runs are made in
the task that reads them and are never moved.  The pairwise tests are array operations over all pages of a slice at once.
Two rules need running state: the baseline of a segment's *first* run, and merging to a fixed point.  They are walked only on
a page where a joined run leaves that baseline, or where two segments touch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from quireframe.functions import bidi
from quireframe.functions.textcols import JS_SPACE
from quireframe.operators.chars import Pages

PAGE = ["doc_id", "page_index"]

# Thresholds, in em of the larger of the two objects unless said otherwise.
ANGLE_DEG = 1.0
SCALE_REL = 0.01
BASELINE_EM = 0.2
INDEX_OVERLAP = 0.5
GAP_MIN, GAP_MAX, GAP_MAX_AFTER_SPACE = -0.5, 0.6, 2.0
MERGE_MIN, MERGE_MAX = -0.1, 0.5
BEARING_EM = 0.05
BAND_LOW, BAND_HIGH = 0.25, 0.75
INVISIBLE_MODE = 3

METRICS = ["theta_deg", "scale", "invisible", "em", "v", "u_start", "u_end"]
CARRIED = ["text", "font_name", "size_eff_pt", "color", "x", "y", "w", "h", "e", "f", "virtual_space_before"]
#: Pages that are worked on at once: some 100,000 runs.
SLICE = 256
INPUT = ["run_id", *CARRIED, "a", "b", "advance_pt", "render_mode"]
#: SQL types of the columns that runs and lines may be asked for.
RUN_COLUMNS = {c: "int" for c in ("segment_id", "line_id", "place", "base")} | {"sure": "boolean", "run_id": "int"} | {c: "double" for c in METRICS} | {"invisible": "boolean"}
RUN_COLUMNS |= {c: "string" if c in ("text", "font_name", "color") else "boolean" if c == "virtual_space_before" else "double" for c in CARRIED}
BOX = "struct<x: double, y: double, w: double, h: double>"
SPAN = f"struct<span_no: int, start: int, end: int, text: string, font_name: string, size_eff_pt: double, color: string, box: {BOX}>"
LINE_COLUMNS = {
    "line_id": "int", "text": "string", "run_ids": "array<int>", "x": "double", "y": "double", "w": "double", "h": "double", "origin_x": "double", "origin_y": "double", "angle_deg": "int",
    "base": "int", "rtl": "boolean", "sure": "boolean", "size_pt": "double", "runs": "array<struct<run_id: int, start: int, end: int, span_no: int>>", "spans": f"array<{SPAN}>",
}


def run_metrics(runs: DataFrame) -> DataFrame:
    """Adds each run's frame along its own direction: theta_deg, scale, u, v, u_start, u_end, invisible."""
    df = runs.withColumn("_t", F.atan2("b", "a")).withColumn("_c", F.cos("_t")).withColumn("_s", F.sin("_t"))
    c, s, x, y, w, h = (F.col(k) for k in ("_c", "_s", "x", "y", "w", "h"))
    u = F.col("e") * c + F.col("f") * s
    v = F.col("f") * c - F.col("e") * s
    turn = F.abs(F.degrees("_t") % 90)
    boxed = (w > 0) & (h > 0) & ((turn < 0.5) | (turn > 89.5))
    corners = [x * c + y * s, (x + w) * c + y * s, x * c + (y + h) * s]
    bearing = BEARING_EM * F.col("size_eff_pt")
    return df.select(
        *runs.columns,
        F.degrees("_t").alias("theta_deg"),
        F.hypot("a", "b").alias("scale"),
        u.alias("u"),
        v.alias("v"),
        F.when(boxed, F.least(*corners) - bearing).otherwise(u).alias("u_start"),
        F.when(boxed, F.greatest(*corners) + bearing).otherwise(u + F.col("advance_pt")).alias("u_end"),
        (F.col("render_mode") == INVISIBLE_MODE).alias("invisible"),
    )


def _on_baseline(first_v, first_em, em_max, v, em):
    """On the first object's baseline, or a smaller object (an index) that mostly shares its band; numbers or arrays."""
    low = np.maximum(v - BAND_LOW * em, first_v - BAND_LOW * first_em)
    high = np.minimum(v + BAND_HIGH * em, first_v + BAND_HIGH * first_em)
    index = (em < first_em) & (high - low >= INDEX_OVERLAP * em)
    return (np.abs(first_v - v) <= BASELINE_EM * np.maximum(em_max, em)) | index


def _on_baseline_of(first_v: float, first_em: float, top: float, v: float, em: float) -> bool:
    """:func:`_on_baseline` of plain numbers, without the cost of arrays."""
    if abs(first_v - v) <= BASELINE_EM * max(top, em):
        return True
    low, high = max(v - BAND_LOW * em, first_v - BAND_LOW * first_em), min(v + BAND_HIGH * em, first_v + BAND_HIGH * first_em)
    return em < first_em and high - low >= INDEX_OVERLAP * em


def _segments(run_id, stretch, v, em):
    """Cut stretches where a run leaves the baseline of the segment's first run."""
    seg = np.array(stretch)
    first_v = first_em = top = current = None
    for k in range(len(seg)):
        opens = k == 0 or stretch[k] != stretch[k - 1]
        if opens or not _on_baseline(first_v, first_em, top, v[k], em[k]):
            current, first_v, first_em, top = run_id[k], v[k], em[k], em[k]
        top = max(top, em[k])
        seg[k] = current
    return seg


def _reading(line, run_id, u0, rtl, classes):
    """Per run: its place in reading order (-1 on a line without right-to-left text), the line's base direction, and
    whether the order was verified; an unverified line keeps its visual order."""
    n = len(line)
    place, base, sure = np.full(n, -1), np.zeros(n, int), np.ones(n, bool)
    if classes is None:
        return place, base, sure
    for k in np.unique(line[rtl]):
        members = np.flatnonzero(line == k)
        members = members[np.lexsort((run_id[members], u0[members]))]
        kinds = [classes[m] for m in members]
        order = bidi.logical_order(kinds, bidi.base_of(kinds))
        sure[members] = order is not None
        base[members] = bidi.base_of(kinds)
        place[members[list(order if order is not None else range(len(members)))]] = np.arange(len(members))
    return place, base, sure


class _Runs:
    """The runs with text of some pages, end to end in content-stream order, with their metrics, segments and lines.

    ``segment`` and ``line`` name a run's segment and line by the place of their first run; ``opened`` is the segment before a run
    is cut off for its baseline.
    """

    def __init__(self, pages: pa.RecordBatch) -> None:
        runs = pages.column("run_id")
        flat = {c: pages.column(c).flatten() for c in INPUT}
        page = np.repeat(np.arange(pages.num_rows), np.diff(runs.offsets.to_numpy()))
        shown = pc.fill_null(pc.not_equal(flat["text"], ""), False)
        run_id = flat["run_id"].to_numpy(zero_copy_only=False)
        order = np.lexsort((run_id, page))
        order = order[shown.to_numpy(zero_copy_only=False)[order]]
        if order.size < page.size or (np.diff(order) != 1).any():
            flat = {c: v.take(pa.array(order)) for c, v in flat.items()}
        self.page, self.flat = page[order], flat
        self.run_id = run_id[order]
        self.text = flat["text"]
        self._measure(*(flat[c].to_numpy(zero_copy_only=False).astype(float) for c in ("a", "b", "e", "f", "x", "y", "w", "h", "size_eff_pt", "advance_pt", "render_mode")))
        self._segment()
        self._order_lines()

    def _measure(self, a, b, e, f, x, y, w, h, size, advance, mode) -> None:
        """:func:`run_metrics` over arrays."""
        t = np.arctan2(b, a)
        c, s = np.cos(t), np.sin(t)
        u = e * c + f * s
        turn = np.abs(np.fmod(np.degrees(t), 90))
        boxed = (w > 0) & (h > 0) & ((turn < 0.5) | (turn > 89.5))
        corners = [x * c + y * s, (x + w) * c + y * s, x * c + (y + h) * s]
        self.theta, self.scale, self.v, self.em = np.degrees(t), np.hypot(a, b), f * c - e * s, size
        self.u0 = np.where(boxed, np.minimum.reduce(corners) - BEARING_EM * size, u)
        self.u1 = np.where(boxed, np.maximum.reduce(corners) + BEARING_EM * size, u + advance)
        self.hidden = np.where(np.isnan(mode), np.nan, mode == INVISIBLE_MODE)
        self.box = (x, y, w, h)

    def _alike(self, p, q):
        """Same direction, scale and visibility."""
        turn = np.abs(self.theta[p] - self.theta[q]) % 360
        return (np.minimum(turn, 360 - turn) <= ANGLE_DEG) & (np.abs(self.scale[p] - self.scale[q]) <= SCALE_REL * self.scale[p]) & (self.hidden[p] == self.hidden[q])

    def _gap(self, p, q):
        em = np.fmax(self.em[p], self.em[q])
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(em > 0, (self.u0[q] - self.u1[p]) / em, np.nan)

    def _segment(self) -> None:
        n = self.page.size
        p, q = np.arange(n - 1 if n else 0), np.arange(1, n)
        gap = self._gap(p, q)
        widest = np.where(_matches(self.text, f"[{JS_SPACE}]\\z")[p], GAP_MAX_AFTER_SPACE, GAP_MAX)
        joined = np.zeros(n, bool)
        joined[1:] = (self.page[p] == self.page[q]) & self._alike(p, q) & (gap >= GAP_MIN) & (gap <= widest)
        here = np.arange(n)
        first = np.maximum.accumulate(np.where(joined, 0, here)) if n else here
        self.opened = first.copy()
        self.rtl = bidi.holds_rtl(self.text)
        mixed = joined.copy()
        mixed[1:] &= (self.v[p] != self.v[q]) | (self.em[p] != self.em[q])
        # no run is cut off where all are on the first one's baseline even by the narrowest reckoning
        off = joined & ~_on_baseline(self.v[first], self.em[first], self.em[first], self.v, self.em)
        for k in np.unique(self.page[off]):
            at = slice(*np.searchsorted(self.page, [k, k + 1]))
            first[at] = at.start + _segments(np.arange(at.stop - at.start), first[at] - at.start, self.v[at], self.em[at])
        self.segment = first
        fold = np.zeros(int(self.page[-1]) + 1 if n else 0, bool)
        fold[self.page[mixed | (self.theta != 0) | self.rtl]] = True
        top = np.zeros(fold.size)
        np.maximum.at(top, self.page, self.em)
        # Two segments can only merge if some two openers, next to each other by baseline, are nearer than an index may sit.
        openers = np.flatnonzero(~joined)
        openers = openers[np.lexsort((self.v[openers], self.page[openers]))]
        lo, hi = openers[:-1], openers[1:]
        near = (self.page[lo] == self.page[hi]) & (self.v[hi] - self.v[lo] <= BAND_HIGH * top[self.page[hi]])
        fold[self.page[hi[near]]] = True
        self.line = self._merge(fold)

    def _merge(self, fold: np.ndarray) -> np.ndarray:
        """Merge touching segments of the pages in ``fold`` until nothing changes; each run's line."""
        start, no = np.unique(self.segment, return_inverse=True)
        on = fold[self.page[start]] if start.size else np.zeros(0, bool)
        if not on.any():
            return self.segment
        by = lambda key: np.lexsort((key, no))[np.append(0, np.cumsum(np.bincount(no))[:-1])]
        head, tail = by(self.u0), by(-self.u1)
        top = np.maximum.reduceat(self.em, start)
        page = self.page[start]
        # candidates: heads in the widest reach of a tail, found by place along the line in all pages at once
        low, most = min(self.u0.min(), self.u1.min()), float(np.nanmax(self.em))
        span = max(self.u0.max(), self.u1.max()) - low + 4 * abs(most) + 1
        at = lambda u: page * span + (u - low)
        heads = np.flatnonzero(on)
        key = at(self.u0[head])[heads]
        sort = np.argsort(key, kind="stable")
        heads, key = heads[sort], key[sort]
        tails = np.flatnonzero(on)
        reach, slack = at(self.u1[tail])[tails], 1e-6 * span
        a, b = np.searchsorted(key, reach + MERGE_MIN * most - slack), np.searchsorted(key, reach + MERGE_MAX * most + slack, "right")
        count = b - a
        i = np.repeat(tails, count)
        j = heads[np.arange(i.size) - np.repeat(np.cumsum(count) - count, count) + np.repeat(a, count)]
        gap = self._gap(tail[i], head[j])
        fits = (i != j) & (page[i] == page[j]) & (gap >= MERGE_MIN) & (gap <= MERGE_MAX) & self._alike(tail[i], head[j])
        i, j = i[fits], j[fits]
        first = _on_baseline(self.v[start[i]], self.em[start[i]], np.maximum(top[i], top[j]), self.v[head[j]], self.em[head[j]])
        owner = np.arange(start.size)
        wanted = np.zeros(fold.size, bool)
        wanted[page[i[first]]] = True
        walked = wanted[page[i]]
        bounds = np.searchsorted(page, np.flatnonzero(wanted)), np.searchsorted(page, np.flatnonzero(wanted), "right")
        i, j = i[walked], j[walked]
        cut = np.searchsorted(i, bounds[0]), np.searchsorted(i, bounds[1])
        for s, e, x, y in zip(*bounds, *cut):
            k = slice(s, e)
            owner[k] = s + np.array(_fuse(zip((i[x:y] - s).tolist(), (j[x:y] - s).tolist()), *(c.tolist() for c in (
                self.v[start[k]], self.em[start[k]], top[k], self.v[head[k]], self.em[head[k]], self.u0[head[k]], self.u1[tail[k]]))))
        return start[owner][no]

    def _order_lines(self) -> None:
        n = self.page.size
        self.place, self.base, self.sure = np.full(n, -1), np.zeros(n, int), np.ones(n, bool)
        for k in np.unique(self.page[self.rtl]):
            at = slice(*np.searchsorted(self.page, [k, k + 1]))
            classes = [bidi.text_class_of(t) for t in self.text[at.start : at.stop].to_pylist()]
            self.place[at], self.base[at], self.sure[at] = _reading(self.line[at], self.run_id[at], self.u0[at], self.rtl[at], classes)

    def column(self, c: str) -> pa.Array:
        made = {"segment_id": lambda: self.run_id[self.segment], "line_id": lambda: self.run_id[self.line], "place": lambda: self.place, "base": lambda: self.base, "sure": lambda: self.sure,
                "run_id": lambda: self.run_id, "theta_deg": lambda: self.theta, "scale": lambda: self.scale, "em": lambda: self.em, "v": lambda: self.v, "u_start": lambda: self.u0, "u_end": lambda: self.u1}
        if c == "invisible":
            return pa.array(self.hidden == 1, mask=np.isnan(self.hidden))
        return pa.array(made[c](), pa.int32() if RUN_COLUMNS[c] == "int" else None) if c in made else self.flat[c]


def _fuse(links, first_v, first_em, top, head_v, head_em, u0, u1) -> list[int]:
    """Merge the touching segments of a page until nothing changes; the segment that absorbed each one.

    ``links``: (i, j) where the head of segment j follows the tail of i, baselines aside.  A segment takes the first living one
    whose head continues its tail, and with it the farther head and tail.
    """
    follows: dict[int, list[int]] = {}
    for a, b in links:
        follows.setdefault(a, []).append(b)
    n = len(top)
    who, head, tail, held = list(range(n)), list(range(n)), list(range(n)), [[k] for k in range(n)]
    alive, owner = [True] * n, list(range(n))
    for i in range(n):
        while alive[i]:
            near = sorted({j for b in follows.get(tail[i], ()) if (j := who[b]) >= 0 and j != i})
            j = next((j for j in near if _on_baseline_of(first_v[i], first_em[i], max(top[i], top[j]), head_v[head[j]], head_em[head[j]])), None)
            if j is None:
                break
            alive[j], who[head[j]] = False, -1
            held[i] += held[j]
            top[i] = max(top[i], top[j])
            if u0[head[j]] < u0[head[i]]:
                who[head[i]], who[head[j]], head[i] = -1, i, head[j]
            if u1[tail[j]] > u1[tail[i]]:
                tail[i] = tail[j]
        if alive[i]:
            for k in held[i]:
                owner[k] = i
    return owner


def _matches(text: pa.Array, pattern: str) -> np.ndarray:
    return pc.match_substring_regex(text, pattern).to_numpy(zero_copy_only=False).astype(bool)


def _page_runs(runs: DataFrame | Pages) -> Pages:
    if isinstance(runs, Pages):
        return runs
    p = runs.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct(*INPUT))).alias("rs"))

    def read(b: pa.RecordBatch) -> pa.RecordBatch:
        rs = b.column("rs")
        offsets, rows = pa.array(rs.offsets.to_numpy() - rs.offsets[0].as_py()), rs.flatten()
        return pa.RecordBatch.from_arrays([*(b.column(c) for c in PAGE), *(pa.ListArray.from_arrays(offsets, rows.field(c)) for c in INPUT)], names=[*PAGE, *INPUT])

    return Pages(p, read)


def _over_pages(runs: DataFrame | Pages, columns: dict[str, str], make: Callable[[_Runs, pa.RecordBatch, list[str]], tuple[np.ndarray, list[pa.Array]]]) -> DataFrame:
    """``make`` gives, for the runs of some pages, the page of each row to return and its columns."""
    pages = _page_runs(runs)
    read, names = pages.read, list(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, SLICE):
                some = read(b.slice(k, SLICE))
                runs = _Runs(some)
                if not runs.page.size:
                    continue
                page, cols = make(runs, names)
                yield pa.RecordBatch.from_arrays([*(some.column(c).take(pa.array(page)) for c in PAGE), *cols], names=[*PAGE, *names])

    types = {c: pages.rows.schema[c].dataType.simpleString() for c in PAGE} | columns
    return pages.rows.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in types.items()))


def segment_runs(runs: DataFrame | Pages, columns: list[str] | None = None) -> DataFrame:
    """Runs that hold text, with metrics, ``segment_id`` and ``line_id`` (each named after its first run id), or ``columns`` of these.

    On lines with right-to-left text ``place`` is the run's position in reading order, elsewhere it is -1.
    """
    wanted = {c: RUN_COLUMNS[c] for c in columns or RUN_COLUMNS}
    return _over_pages(runs, wanted, lambda r, names: (r.page, [r.column(c) for c in names]))


def _hull(box: tuple[np.ndarray, ...], starts: np.ndarray) -> list[np.ndarray]:
    """x, y, w, h of the hull of each group's boxes with area, or of its first box."""
    x, y, w, h = box
    area = (w > 0) & (h > 0)
    x0, y0 = (np.minimum.reduceat(np.where(area, c, np.inf), starts) for c in (x, y))
    x1, y1 = (np.maximum.reduceat(np.where(area, c, -np.inf), starts) for c in (x + w, y + h))
    none = np.isinf(x0)
    with np.errstate(invalid="ignore"):
        return [np.where(none, first[starts], value) for first, value in ((x, x0), (y, y0), (w, x1 - x0), (h, y1 - y0))]


def _lists(starts: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)), pa.int32()), values)


def _line_rows(r: _Runs, names: list[str]) -> tuple[np.ndarray, list[pa.Array]]:
    n = r.page.size
    vis = np.lexsort((r.run_id, r.u0, r.line))  # as seen
    opens = np.append(True, np.diff(r.line[vis]) != 0)
    at = np.flatnonzero(opens)
    no = np.cumsum(opens) - 1
    size = np.append(at[1:], n) - at
    first = vis[at]
    rtl = r.place[first] >= 0
    read = vis[np.lexsort((np.where(rtl[no], r.place[vis], np.arange(n)), no))] if rtl.any() else vis

    text = r.text.take(pa.array(read))
    k = np.arange(n) - at[no]
    spaced = (k > 0) & ~rtl[no] & pc.fill_null(r.flat["virtual_space_before"], False).to_numpy(zero_copy_only=False)[read]
    spaced[1:] &= ~_matches(text, f"[{JS_SPACE}]\\z")[:-1]
    spaced &= ~_matches(text, f"^[{JS_SPACE}]")
    font, color = (r.flat[c].take(pa.array(read)) for c in ("font_name", "color"))
    kept = np.ones(n, bool)
    for c in (font, color):
        kept[1:] &= pc.fill_null(pc.equal(c[:-1], c[1:]), False).to_numpy(zero_copy_only=False)
    kept[1:] &= r.em[read][:-1] == r.em[read][1:]
    begins = (k == 0) | ~kept
    length = pc.utf8_length(text).to_numpy().astype(np.int64)
    end = np.cumsum(length + spaced)
    end = end - (end[at] - length[at] - spaced[at])[no]
    spot = np.flatnonzero(begins)
    span_no = np.cumsum(begins)
    span_no = span_no - (span_no[at] - 1)[no]
    joint = lambda mask: pc.binary_join_element_wise(pc.if_else(pa.array(mask), " ", ""), text, "")
    whole = lambda starts, pieces: pc.binary_join(_lists(starts, pieces), "")
    ints = lambda a: pa.array(a, pa.int32())
    box = _hull(tuple(c[vis] for c in r.box), at)

    def spans() -> pa.Array:
        hull = pa.StructArray.from_arrays([pa.array(c) for c in _hull(tuple(c[read] for c in r.box), spot)], ["x", "y", "w", "h"])
        last = np.append(spot[1:], n) - 1
        cols = [ints(span_no[spot]), ints((end - length)[spot]), ints(end[last]), whole(spot, joint(spaced & ~begins)), font.take(pa.array(spot)), pa.array(r.em[read][spot]), color.take(pa.array(spot)), hull]
        return _lists(np.searchsorted(spot, at), pa.StructArray.from_arrays(cols, ["span_no", "start", "end", "text", "font_name", "size_eff_pt", "color", "box"]))

    made = {
        "line_id": lambda: ints(r.run_id[r.line[first]]), "text": lambda: whole(at, joint(spaced)), "run_ids": lambda: _lists(at, ints(r.run_id[vis])),
        "origin_x": lambda: r.flat["e"].take(pa.array(first)), "origin_y": lambda: r.flat["f"].take(pa.array(first)),
        "angle_deg": lambda: ints(np.floor(r.theta[first] + 0.5) % 360), "base": lambda: ints(np.maximum.reduceat(r.base[vis], at)), "rtl": lambda: pa.array(rtl),
        "sure": lambda: pa.array(np.logical_and.reduceat(r.sure[vis], at)), "size_pt": lambda: pa.array(np.maximum.reduceat(r.em[vis], at)), "spans": spans,
        "runs": lambda: _lists(at, pa.StructArray.from_arrays([ints(r.run_id[read]), ints(end - length), ints(end), ints(span_no)], ["run_id", "start", "end", "span_no"])),
    } | {c: (lambda v=v: pa.array(v)) for c, v in zip("xywh", box)}
    return r.page[first], [made[c]() for c in names]


def lines(runs: DataFrame | Pages, columns: list[str] | None = None) -> DataFrame:
    """One row per line, with all of these or ``columns``.

    text, run_ids (visual order), x/y/w/h, origin_x/origin_y, angle_deg, direction, notice (why a right-to-left line
    should not be edited in place), size_pt, ``runs`` (reading order: run_id, start, end, span_no) and ``spans``
    (span_no, start, end, text, font_name, size_eff_pt, color, box).
    """
    if columns is not None:
        return _over_pages(runs, {c: LINE_COLUMNS[c] for c in columns}, _line_rows)
    g = _over_pages(runs, LINE_COLUMNS, _line_rows)
    notice = (
        F.when(~F.col("rtl"), None)
        .when(bidi.has_arabic(F.col("text")), "arabic")
        .when((F.size("run_ids") > 1) | ~F.col("sure"), "mixed")
        .when(F.col("angle_deg") != 0, "rotated")
    )
    wanted = [c for c in LINE_COLUMNS if c not in ("base", "rtl", "sure")]
    at = wanted.index("size_pt")
    return g.select(*PAGE, *wanted[:at], F.when(F.col("base") == 1, "rtl").otherwise("ltr").alias("direction"), notice.alias("notice"), *wanted[at:])


def union_box(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Hull of the boxes that have area; the first box where none has."""
    area = (F.col("w") > 0) & (F.col("h") > 0)
    g = df.groupBy(*keys).agg(
        F.min(F.when(area, F.col("x"))).alias("_x0"), F.min(F.when(area, F.col("y"))).alias("_y0"),
        F.max(F.when(area, F.col("x") + F.col("w"))).alias("_x1"), F.max(F.when(area, F.col("y") + F.col("h"))).alias("_y1"),
        F.min_by(F.struct("x", "y", "w", "h"), order).alias("_b"),
    )
    none = F.col("_x0").isNull()
    pick = {"x": F.col("_x0"), "y": F.col("_y0"), "w": F.col("_x1") - F.col("_x0"), "h": F.col("_y1") - F.col("_y0")}
    return g.select(*keys, *[F.when(none, F.col(f"_b.{k}")).otherwise(v).alias(k) for k, v in pick.items()])


def line_of_run(line_table: DataFrame) -> DataFrame:
    """doc_id, page_index, run_id -> line_id."""
    return line_table.select(*PAGE, "line_id", F.explode("run_ids").alias("run_id"))
