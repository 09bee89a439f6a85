"""Reading order, paragraphs and text export from lines.

Every step works inside one page except the body size of a document, which is a plain two-step aggregation.  A line row
carries its style spans along, so putting lines in order never joins them back to their text.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from quireframe.functions.textcols import (
    ends_blank, escape_line_start, escape_markdown, heading_level, is_bold, js_trim, list_prefix, starts_blank, without_list_mark,
)
from quireframe.operators.chars import Pages
from quireframe.operators.lines import PAGE, lines

# Thresholds in units of the font size, or fractions of the smaller extent.
BLOCK_STEP_MIN, BLOCK_STEP_MAX, BLOCK_OVERLAP_X = 0.5, 2.5, 0.3
COLUMN_OVERLAP_Y, COLUMN_OVERLAP_X = 0.5, 0.1
ROW_TOLERANCE = 0.35
SPACE_GAP = 0.25
PARAGRAPH_GAP, PARAGRAPH_SIZE_CHANGE = 1.6, 0.3
DEFAULT_BODY = 12.0


def reading_units(line_table: DataFrame) -> DataFrame:
    """Lines that are not blank, as boxes to put in order: line_id, y (baseline), size_pt, x0, x1, spans."""
    return line_table.filter(js_trim(F.col("text")) != "").select(
        *PAGE, "line_id", F.col("origin_y").alias("y"), "size_pt", F.col("x").alias("x0"), (F.col("x") + F.col("w")).alias("x1"), "spans"
    )


def units_of(runs: DataFrame | Pages) -> DataFrame:
    return reading_units(lines(runs, ["line_id", "text", "x", "w", "origin_y", "size_pt", "spans"]))


def reading_blocks(units: DataFrame) -> DataFrame:
    """Adds block_id (the block's first line_id), block_units and the block's extent bx0, bx1, top, bottom.

    A unit right below the last one continues its block.
    """
    stream = W.partitionBy(*PAGE).orderBy("line_id")
    df = units.withColumn("_p", F.lag(F.struct("y", "size_pt", "x0", "x1")).over(stream))
    step = F.col("_p.y") - F.col("y")
    size = F.greatest(F.col("_p.size_pt"), F.col("size_pt"))
    narrow = F.least(F.col("_p.x1") - F.col("_p.x0"), F.col("x1") - F.col("x0"))
    overlap = F.least(F.col("_p.x1"), F.col("x1")) - F.greatest(F.col("_p.x0"), F.col("x0"))
    goes_on = F.coalesce(
        (step > BLOCK_STEP_MIN * size) & (step <= BLOCK_STEP_MAX * size) & (narrow > 0) & (overlap >= BLOCK_OVERLAP_X * narrow), F.lit(False)
    )
    df = df.withColumn("_start", ~goes_on).withColumn("block_id", F.max(F.when(F.col("_start"), F.col("line_id"))).over(stream))
    block = W.partitionBy(*PAGE, "block_id")
    return (
        df.withColumn("block_units", F.count(F.lit(1)).over(block))
        .withColumn("bx0", F.min("x0").over(block))
        .withColumn("bx1", F.max("x1").over(block))
        .withColumn("top", F.max(F.when(F.col("_start"), F.col("y") + F.col("size_pt"))).over(block))
        .withColumn("bottom", F.max(F.struct("line_id", "y")).over(block)["y"])
        .drop("_p", "_start")
    )


def _column_roots(x0, x1, top, bottom):
    """Index of the first block of each block's group: blocks side by side, joined transitively."""
    root = np.arange(len(x0))
    height = np.minimum.outer(top - bottom, top - bottom)
    oy = np.minimum.outer(top, top) - np.maximum.outer(bottom, bottom)
    ox = np.minimum.outer(x1, x1) - np.maximum.outer(x0, x0)
    narrow = np.minimum.outer(x1 - x0, x1 - x0)
    beside = (height > 0) & (oy >= COLUMN_OVERLAP_Y * height) & (ox <= COLUMN_OVERLAP_X * narrow)
    for i, j in zip(*np.nonzero(np.triu(beside, 1))):
        a, b = sorted((root[i], root[j]))
        root[root == b] = a
    return root


def _row_openers(ids, y, size):
    """First-match clustering: each loose line joins the first row, from the top, whose opener is on its baseline."""
    rows, out, y, size, order = [], {}, y.tolist(), size.tolist(), np.lexsort((ids, -y)).tolist()
    for k in order:
        hit = next((r for r in rows if abs(y[r] - y[k]) <= ROW_TOLERANCE * max(size[r], size[k])), None)
        if hit is None:
            rows.append(k)
            hit = k
        out[k] = ids[hit]
    return [out[k] for k in range(len(ids))]


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _columns_udf(ids: pd.Series, x0: pd.Series, x1: pd.Series, top: pd.Series, bottom: pd.Series) -> pd.Series:
    return pd.Series([None if page[0] is None else page[0][_column_roots(*page[1:])] for page in zip(ids, x0, x1, top, bottom)])


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _rows_udf(ids: pd.Series, y: pd.Series, size: pd.Series) -> pd.Series:
    return pd.Series([None if page[0] is None else _row_openers(*page) for page in zip(ids, y, size)])


def _fields(arr: str, names: list[str], gate: str) -> list[Column]:
    return [F.expr(f"if({gate}, transform({arr}, s -> s.{n}), null)") for n in names]


def reading_elements(blocked: DataFrame) -> DataFrame:
    """Adds ``element_id``: the column group of a unit in a many-line block, or the row of a loose line.

    Columns need blocks that overlap in height; rows need baselines that are near but not equal.  Pages without such
    blocks or lines pass nulls through the two Arrow functions and keep the plain answer.
    """
    unit = F.struct("line_id", "y", "size_pt", "x0", "x1", "spans", "block_id", "block_units", "bx0", "bx1", "top", "bottom")
    p = blocked.groupBy(*PAGE).agg(F.array_sort(F.collect_list(unit)).alias("us"))
    p = p.withColumn("multi", F.expr("array_sort(transform(filter(us, u -> u.block_units >= 2 and u.line_id = u.block_id), u -> struct(-u.top as t, u.block_id, u.bx0, u.bx1, u.top, u.bottom)))"))
    p = p.withColumn("loose", F.expr("array_sort(transform(filter(us, u -> u.block_units = 1), u -> struct(-u.y as t, u.line_id, u.y, u.size_pt)))"))
    p = p.withColumn("beside", F.expr("exists(transform(multi, (m, k) -> k > 0 and array_min(transform(slice(multi, 1, k), q -> q.bottom)) < m.top), hit -> hit)"))
    p = p.withColumn("near", F.expr(f"""exists(zip_with(slice(loose, 2, greatest(size(loose) - 1, 0)), slice(loose, 1, greatest(size(loose) - 1, 0)), (lo, hi) -> hi.y - lo.y),
        d -> d > 0 and d <= {ROW_TOLERANCE}D * array_max(transform(loose, l -> l.size_pt)))"""))
    p = p.withColumn("by_block", F.expr("array_sort(transform(multi, m -> struct(m.block_id, m.bx0, m.bx1, m.top, m.bottom)))"))
    p = p.withColumn("groups", _columns_udf(*_fields("by_block", ["block_id", "bx0", "bx1", "top", "bottom"], "beside")))
    p = p.withColumn("rows", _rows_udf(*_fields("loose", ["line_id", "y", "size_pt"], "near")))
    element = """if(u.block_units >= 2,
        coalesce(get(groups, cast(array_position(transform(by_block, m -> m.block_id), u.block_id) as int) - 1), u.block_id),
        coalesce(get(rows, cast(array_position(transform(loose, l -> l.line_id), u.line_id) as int) - 1), array_min(transform(filter(loose, l -> l.y = u.y), l -> l.line_id))))"""
    p = p.select(*PAGE, F.explode(F.expr(f"transform(us, u -> struct(u as u, {element} as element_id))")).alias("t"))
    return p.select(*PAGE, "t.u.*", "t.element_id").repartition(*PAGE)


def reading_order(units: DataFrame) -> DataFrame:
    """Units with ``row_no`` (1-based reading line of the page) and ``in_row`` (left to right inside it)."""
    j = reading_elements(reading_blocks(units))
    loose = F.col("block_units") == 1
    j = j.withColumn("_loose", loose.cast("int"))
    e = W.partitionBy(*PAGE, "_loose", "element_id")
    j = (
        j.withColumn("_top", F.max(F.when(loose, F.col("y") + F.col("size_pt")).otherwise(F.col("top"))).over(e))
        .withColumn("_left", F.min(F.when(loose, F.col("x0")).otherwise(F.col("bx0"))).over(e))
    )
    inner = F.struct(*[F.when(loose, F.lit(0.0)).otherwise(F.col(c).cast("double")).alias(c) for c in ("bx0", "block_id", "line_id")])
    order = [F.col("_top").desc(), F.col("_left"), F.col("_loose"), F.col("element_id"), inner]
    j = j.withColumn("row_no", F.dense_rank().over(W.partitionBy(*PAGE).orderBy(*order)))
    j = j.withColumn("in_row", F.row_number().over(W.partitionBy(*PAGE, "row_no").orderBy("x0", F.col("y").desc(), "line_id")))
    return j.select(*PAGE, "line_id", "row_no", "in_row", "y", "size_pt", "x0", "x1", "spans")


def reading_pieces(ordered: DataFrame) -> DataFrame:
    """Spans in reading order: row_no, piece_no, text, the space (or not) before the piece, row size and mean baseline."""
    row = W.partitionBy(*PAGE, "row_no")
    o = ordered.withColumn("row_y", F.avg("y").over(row)).withColumn("row_size", F.max("size_pt").over(row))
    s = o.select(*PAGE, "row_no", "in_row", "row_y", "row_size", F.explode("spans").alias("s"))
    s = s.select(*PAGE, "row_no", "in_row", "row_y", "row_size", "s.span_no", "s.text", "s.font_name", "s.size_eff_pt", "s.box.x", "s.box.w")
    along = row.orderBy("in_row", "span_no")
    s = s.withColumn("_p", F.lag(F.struct("text", "size_eff_pt", "x", "w")).over(along))
    gap = F.col("x") - (F.col("_p.x") + F.col("_p.w"))
    spaced = ~ends_blank(F.col("_p.text")) & ~starts_blank(F.col("text")) & (gap > SPACE_GAP * F.greatest("_p.size_eff_pt", "size_eff_pt"))
    return (
        s.withColumn("piece_no", F.row_number().over(along))
        .withColumn("space", F.when(F.col("_p").isNotNull() & spaced, " ").otherwise(""))
        .drop("_p", "in_row", "span_no", "x", "w")
    )


def reading_lines(pieces: DataFrame) -> DataFrame:
    return pieces.groupBy(*PAGE, "row_no").agg(
        F.expr("listagg(space || text, '') within group (order by piece_no)").alias("text"),
        F.first("row_y").alias("y"),
        F.first("row_size").alias("size_pt"),
    )


def paragraphs(rows: DataFrame) -> DataFrame:
    """Adds ``starts_paragraph``: a wide step down or a change of size against the row before."""
    p = F.lag(F.struct("y", "size_pt")).over(W.partitionBy(*PAGE).orderBy("row_no"))
    df = rows.withColumn("_p", p)
    ref = (F.col("_p.size_pt") + F.col("size_pt")) / 2
    brk = (ref > 0) & ((F.col("_p.y") - F.col("y") > PARAGRAPH_GAP * ref) | (F.abs(F.col("size_pt") - F.col("_p.size_pt")) > PARAGRAPH_SIZE_CHANGE * ref))
    return df.withColumn("starts_paragraph", F.col("_p").isNull() | F.coalesce(brk, F.lit(False))).drop("_p")


def body_font_size(pieces: DataFrame) -> DataFrame:
    """doc_id, body_pt: the size that carries most characters; on a tie, the one met first."""
    return body_of_sizes(pieces.withColumn("chars", F.greatest(F.lit(1), F.length("text"))))


def body_of_sizes(sizes: DataFrame) -> DataFrame:
    """The same from (doc_id, page_index, row_no, piece_no, size_eff_pt, chars)."""
    per = sizes.groupBy("doc_id", "size_eff_pt").agg(F.sum("chars").alias("chars"), F.min(F.struct("page_index", "row_no", "piece_no")).alias("first"))
    best = F.struct("chars", *[-F.col(f"first.{c}") for c in ("page_index", "row_no", "piece_no")])
    return per.groupBy("doc_id").agg(F.max_by("size_eff_pt", best).alias("body_pt"))


def render_markdown(pieces: DataFrame, body: DataFrame, page_table: DataFrame) -> DataFrame:
    """One Markdown line per reading line.

    The body size reaches the lines by way of the page table, so a long document does not draw all its lines into one
    task.
    """
    pages = page_table.select(*PAGE).join(body, "doc_id", "left")
    j = pieces.join(pages, PAGE)
    level = heading_level(F.col("row_size"), F.coalesce("body_pt", F.lit(DEFAULT_BODY)))
    j = j.withColumn("level", level)
    opener = (F.col("piece_no") == 1) & (F.col("level") == 0)
    raw = F.when(opener, without_list_mark(F.col("text"))).otherwise(F.col("text"))
    prefix = F.when(opener, list_prefix(F.col("text"))).otherwise("")
    shown = escape_markdown(raw)
    shown = F.when((F.col("level") == 0) & (shown != "") & is_bold(F.col("font_name")), F.concat(F.lit("**"), shown, F.lit("**"))).otherwise(shown)
    j = j.withColumn("_prefix", prefix).withColumn("_shown", F.concat("space", shown))
    g = j.groupBy(*PAGE, "row_no").agg(
        F.expr("listagg(_shown, '') within group (order by piece_no)").alias("_body"),
        F.max("_prefix").alias("_prefix"),
        F.first("level").alias("level"),
        F.first("row_y").alias("y"),
        F.first("row_size").alias("size_pt"),
    )
    return g.select(*PAGE, "row_no", "level", "y", "size_pt", markdown_line(F.col("level"), F.col("_prefix"), F.col("_body")).alias("markdown"))


def markdown_line(level: Column, prefix: Column, body: Column) -> Column:
    return (
        F.when(level > 0, F.concat(F.repeat(F.lit("#"), level), F.lit(" "), body))
        .when(prefix != "", F.concat(prefix, body))
        .otherwise(escape_line_start(body))
    )


def _per_page(rows: DataFrame, text: str, joint: Column, out: str, all_pages: DataFrame | None, divider: Column) -> DataFrame:
    df = rows.withColumn("_t", F.concat(F.when(F.col("row_no") == 1, "").otherwise(joint), F.col(text)))
    g = df.groupBy(*PAGE).agg(F.expr("listagg(_t, '') within group (order by row_no)").alias(out))
    if all_pages is not None:
        g = all_pages.select(*PAGE).join(g, PAGE, "left").withColumn(out, F.coalesce(out, F.lit("")))
    return g.withColumn(out, F.concat(F.when(F.col("page_index") > 0, divider).otherwise(""), out))


def to_plain_text(rows: DataFrame, all_pages: DataFrame | None = None) -> DataFrame:
    """One row per page; the pages of a document, in order, concatenate to its plain text."""
    divider = F.concat(F.lit("\n\n--- Página "), (F.col("page_index") + 1).cast("string"), F.lit(" ---\n\n"))
    return _per_page(rows, "text", F.lit("\n"), "page_text", all_pages, divider)


def to_markdown(rendered: DataFrame, all_pages: DataFrame | None = None) -> DataFrame:
    """One row per page; the pages of a document, in order, concatenate to its Markdown."""
    joint = F.when(F.col("starts_paragraph"), "\n\n").otherwise("\n")
    return _per_page(paragraphs(rendered), "markdown", joint, "page_markdown", all_pages, F.lit("\n\n---\n\n"))


def to_markdown_ybucket(runs: DataFrame) -> DataFrame:
    """The simpler export: runs bucketed by height in steps of 4 pt, top first, joined left to right by a space."""
    bucket = F.floor(F.col("f") / 4 + 0.5) * 4
    shown = F.when(js_trim(F.col("text")) != "", F.col("text"))
    g = runs.withColumn("bucket", bucket).withColumn("_t", shown)
    g = g.groupBy(*PAGE, "bucket").agg(F.expr("listagg(_t, ' ') within group (order by e, run_id)").alias("line"))
    page = g.groupBy(*PAGE).agg(F.expr("listagg(line || '\n\n', '') within group (order by bucket desc)").alias("_body"))
    head = F.concat(F.lit("\n<!-- Página "), (F.col("page_index") + 1).cast("string"), F.lit(" -->\n\n"))
    return page.select(*PAGE, F.concat(head, F.coalesce("_body", F.lit(""))).alias("page_markdown"))


def read_pages(runs: DataFrame | Pages) -> DataFrame:
    """Runs to pieces in reading order: the shared front half of every export."""
    return reading_pieces(reading_order(units_of(runs)))
