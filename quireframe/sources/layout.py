"""Layout tables derived from plain text.

The given data has no positioned text, so ``documents`` is set as fixed-pitch pages: 12 words to a line, 40 lines to a
page, heading lines in larger type.  Everything here is a narrow transformation of the document row: one row explodes
into lines and then runs without a shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

WORDS_PER_LINE = 12
LINES_PER_PAGE = 40
PITCH_EM = 0.6
PAGE_W, PAGE_H = 595.0, 842.0


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``; keeps an expensive expression out of inner lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, "[ \n]"), lambda t: t != "")


def line_size(line: Column) -> Column:
    return (
        F.when(line == 0, F.lit(18.0))
        .when(line % 40 == 30, F.lit(15.0))
        .when(line % 20 == 10, F.lit(14.0))
        .otherwise(F.lit(11.0))
    )


def doc_lines(documents: DataFrame) -> DataFrame:
    """doc_id, line, page_index, line_in_page, words, size_pt, y."""

    def cut(ws: Column) -> Column:
        last = F.greatest(F.floor((F.size(ws) - 1) / WORDS_PER_LINE), F.lit(0)).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda l: F.struct(l.alias("line"), F.slice(ws, l * WORDS_PER_LINE + 1, WORDS_PER_LINE).alias("words")))

    lines = documents.select("doc_id", F.explode(let(words_of(F.col("text")), cut)).alias("l"))
    line = F.col("l.line")
    return lines.filter(F.size("l.words") > 0).select(
        "doc_id",
        line.alias("line"),
        F.floor(line / LINES_PER_PAGE).cast("int").alias("page_index"),
        (line % LINES_PER_PAGE).alias("line_in_page"),
        F.col("l.words").alias("words"),
        line_size(line).alias("size_pt"),
        (F.lit(770.0) - 16.0 * (line % LINES_PER_PAGE)).alias("y"),
    )


def runs(documents: DataFrame) -> DataFrame:
    """One row per word with the full run schema of ``schemas.RUNS`` plus its line and slot."""

    def place(w: Column, j: Column) -> Column:
        before = F.length(F.array_join(F.slice(F.col("words"), F.lit(1), j), "")) + j
        return F.struct(w.alias("text"), j.alias("slot"), before.alias("before"))

    df = doc_lines(documents).withColumn("w", F.explode(F.transform("words", place)))
    i = F.col("line") * WORDS_PER_LINE + F.col("w.slot")
    size = F.col("size_pt")
    x = F.lit(72.0) + F.col("w.before") * PITCH_EM * size
    return df.select(
        "doc_id",
        "page_index",
        (F.col("line_in_page") * WORDS_PER_LINE + F.col("w.slot")).alias("run_id"),
        i.alias("i"),
        "line",
        "line_in_page",
        F.col("w.slot").alias("slot"),
        F.col("w.text").alias("text"),
        F.when(i % 37 == 0, "Helvetica-Bold").otherwise("Helvetica").alias("font_name"),
        size.alias("size_pt"),
        size.alias("size_eff_pt"),
        x.alias("x"),
        F.col("y"),
        (F.length("w.text") * PITCH_EM * size).alias("w"),
        size.alias("h"),
        F.lit(1.0).alias("a"),
        F.lit(0.0).alias("b"),
        x.alias("e"),
        F.col("y").alias("f"),
        (F.col("w.slot") > 0).alias("virtual_space_before"),
        (F.length("w.text") * PITCH_EM * size).alias("advance_pt"),
        F.lit(0).alias("render_mode"),
        F.lit("#000000").alias("color"),
    )


def word_pages(documents: DataFrame) -> DataFrame:
    """doc_id, page_index, words: the words of each page in one array."""
    per = WORDS_PER_LINE * LINES_PER_PAGE

    def cut(ws: Column) -> Column:
        last = F.greatest(F.floor((F.size(ws) - 1) / per), F.lit(0)).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda p: F.struct(p.alias("page_index"), F.slice(ws, p * per + 1, per).alias("words")))

    pages = documents.select("doc_id", F.explode(let(words_of(F.col("text")), cut)).alias("p"))
    return pages.select("doc_id", "p.page_index", "p.words").filter(F.size("words") > 0)


CHARS = {"pos": pa.int32(), "line": pa.int32(), "ch": pa.string(), "x": pa.float64(), "y": pa.float64(), "w": pa.float64(), "h": pa.float64()}


def _page_words(words: pa.Array, page_index: np.ndarray) -> dict[str, object]:
    """The words of a batch of pages, end to end, and where they stand: edges, flat, page, run, line, slot, size, length, ahead, x."""
    edges = words.offsets.to_numpy()
    flat = words.values.slice(edges[0], edges[-1] - edges[0])
    edges = edges - edges[0]
    page = np.repeat(np.arange(len(words)), np.diff(edges))
    run = np.arange(len(flat)) - edges[page]
    line, slot = run // WORDS_PER_LINE, run % WORDS_PER_LINE
    size = np.where(line == 30, 15.0, np.where(line == 10, 14.0, 11.0))
    size = np.where((line == 0) & (page_index[page] == 0), 18.0, size)
    length = pc.utf8_length(flat).to_numpy()
    ahead = np.cumsum(length + 1) - (length + 1)
    before = ahead - ahead[np.arange(len(flat)) - slot]
    x = 72.0 + before * PITCH_EM * size
    return {"edges": edges, "flat": flat, "page": page, "run": run, "line": line, "slot": slot, "size": size, "length": length, "ahead": ahead, "x": x}


def _page_chars(words: pa.Array, page_index: np.ndarray, stride: int, boxless: bool) -> tuple[np.ndarray, dict[str, object]]:
    """Offsets of each page in the characters of a batch, and their columns."""
    edges, flat, _, run, line, slot, size, length, ahead, x = _page_words(words, page_index).values()
    led = pc.binary_join_element_wise(pc.if_else(pa.array(slot > 0), " ", "\n"), flat, "")
    raw = np.frombuffer(led.buffers()[2], np.uint8, np.frombuffer(led.buffers()[1], np.int32)[len(led)])
    starts = np.append(np.flatnonzero((raw & 0xC0) != 0x80), raw.size).astype(np.int32)
    of = np.repeat(np.arange(len(flat)), length + 1)
    k = np.arange(of.size) - (ahead[of] if of.size else 0)
    shown, em = k > 0, (size * PITCH_EM)[of]
    ch = pa.StringArray.from_buffers(of.size, pa.py_buffer(starts), pa.py_buffer(raw.tobytes()))
    cols = {
        "pos": run[of] * stride + k, "line": line[of], "ch": ch, "x": np.where(shown, x[of] + (k - 1) * em, 0.0),
        "y": np.where(shown, (770.0 - 16.0 * line)[of], 0.0), "w": np.where(shown, em, 0.0), "h": np.where(shown, size[of], 0.0),
    }
    if not boxless:
        cols = {c: v.filter(pa.array(shown)) if isinstance(v, pa.Array) else v[shown] for c, v in cols.items()}
    return np.append(0, np.cumsum(length + boxless))[edges], cols


def char_reader(stride: int, columns: list[str], boxless: bool = True):
    """A function from batches of :func:`word_pages` to the characters of each page, every one of ``columns`` an array in order of ``pos``.

    A boxless newline opens a line and a boxless blank every later word; pos = run_id * stride + place.  Without ``boxless``
    these are left out.
    """

    def read(b: pa.RecordBatch) -> pa.RecordBatch:
        edges, cols = _page_chars(b.column("words"), b.column("page_index").to_numpy(), stride, boxless)
        offsets = pa.array(edges.astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, cols[c] if isinstance(cols[c], pa.Array) else pa.array(cols[c], CHARS[c])) for c in columns]
        names = [c for c in b.schema.names if c != "words"]
        return pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *lists], names=[*names, *columns])

    return read


def run_reader(moved=None):
    """A function from batches of :func:`word_pages` to the runs of each page, every column of :func:`runs` that lines are built from an array.

    ``moved`` may set the columns anew: it gets their arrays by name, with ``line_in_page`` and ``slot``.
    """

    def read(b: pa.RecordBatch) -> pa.RecordBatch:
        w = _page_words(b.column("words"), page_index := b.column("page_index").to_numpy())
        n, size, run = len(w["flat"]), w["size"], w["run"]
        y, zero = 770.0 - 16.0 * w["line"], np.zeros(n)
        width = w["length"] * PITCH_EM * size
        cols = {
            "run_id": run, "size_eff_pt": size, "x": w["x"], "y": y, "w": width, "h": size, "a": zero + 1.0, "b": zero, "e": w["x"], "f": y, "advance_pt": width, "line_in_page": w["line"], "slot": w["slot"],
        }
        cols = cols | (moved(cols) if moved else {})
        bold = (page_index[w["page"]].astype(np.int64) * (WORDS_PER_LINE * LINES_PER_PAGE) + run) % 37 == 0
        arrays = {c: pa.array(v, pa.int32() if c == "run_id" else pa.float64()) for c, v in cols.items() if c not in ("line_in_page", "slot")} | {
            "text": w["flat"], "font_name": pc.if_else(pa.array(bold), "Helvetica-Bold", "Helvetica"), "color": pa.repeat("#000000", n), "virtual_space_before": pa.array(w["slot"] > 0),
            "render_mode": pa.array(np.zeros(n, np.int32)),
        }
        offsets = pa.array(w["edges"].astype(np.int32))
        names = [c for c in b.schema.names if c != "words"]
        return pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *(pa.ListArray.from_arrays(offsets, v) for v in arrays.values())], names=[*names, *arrays])

    return read


def page_meta(documents: DataFrame) -> DataFrame:
    """doc_id, page_index and the page box of every derived page."""
    n_pages = F.expr(f"""greatest(int(ceil(size(filter(split(text, '[ \\n]'), t -> t <> '')) / {WORDS_PER_LINE * LINES_PER_PAGE}.0D)), 0)""")
    return (
        documents.select("doc_id", n_pages.alias("n"))
        .filter("n > 0")
        .select(
            "doc_id",
            F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("page_index"),
        )
        .select(
            "doc_id",
            "page_index",
            F.lit(PAGE_W).alias("width_pt"),
            F.lit(PAGE_H).alias("height_pt"),
            F.lit(0.0).alias("origin_x"),
            F.lit(0.0).alias("origin_y"),
            F.lit(1.0).alias("user_unit"),
            (F.pmod(F.col("doc_id"), F.lit(4)) * 90).cast("int").alias("rotation"),
        )
    )


def highlights(run_table: DataFrame) -> DataFrame:
    """One highlight per (doc, page) over the third line's words 2..5; rect is the hull of those runs."""
    hit = run_table.filter((F.col("line_in_page") == 3) & F.col("slot").between(2, 5))
    g = hit.groupBy("doc_id", "page_index").agg(
        F.min("x").alias("rx"), F.min("y").alias("ry"), F.max(F.col("x") + F.col("w")).alias("x1"), F.max(F.col("y") + F.col("h")).alias("y1")
    )
    return g.select(
        "doc_id", "page_index", F.lit(0).alias("annot_index"), F.lit("highlight").alias("kind"),
        "rx", "ry", (F.col("x1") - F.col("rx")).alias("rw"), (F.col("y1") - F.col("ry")).alias("rh"),
    )


def commands(events: DataFrame) -> DataFrame:
    """Edit history: one document per user, ``error`` = undo, ``signup`` = redo, anything else a command."""
    return events.select(
        F.col("user_id").alias("doc_id"),
        F.col("event_id").alias("seq"),
        "ts",
        F.when(F.col("event_type") == "error", "undo").when(F.col("event_type") == "signup", "redo").otherwise("do").alias("op"),
        F.when(~F.col("event_type").isin("error", "signup"), F.col("event_type")).alias("coalesce_key"),
        "value",
    )


def hrefs(pages: DataFrame) -> DataFrame:
    """page_id, pos, href for every href attribute of a stored web page, in order of appearance."""
    return pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("pos", "href"))


def gray_images(embeddings: DataFrame) -> DataFrame:
    """vec_id and a gray level 0..255 per cell of the vector, scaled from its own minimum and maximum."""
    v = F.col("embedding")

    def scale(lo: Column) -> Column:
        return let(F.array_max(v), lambda hi: F.transform(v, lambda c: F.floor((c.cast("double") - lo.cast("double")) / (hi.cast("double") - lo.cast("double")) * 255).cast("int")))

    return embeddings.select("vec_id", "label", let(F.array_min(v), scale).alias("gray"))
