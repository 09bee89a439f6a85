"""Recognised text: nested JSON to lines, and lines to text runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quireframe.functions import geometry as G

LINE = "struct<text:string,bbox:struct<x0:double,y0:double,x1:double,y1:double>>"
OCR_SCHEMA = f"struct<blocks:array<struct<paragraphs:array<struct<lines:array<{LINE}>>>>>,lines:array<{LINE}>>"


def flatten_ocr(images: DataFrame, json: str = "json") -> DataFrame:
    """Lines of the blocks' paragraphs, trimmed, without the empty and the boxless; only where that gives none, the flat lines."""
    d = images.withColumn("_o", F.from_json(json, OCR_SCHEMA))
    empty = f"cast(array() as array<{LINE}>)"
    tidy = "filter(transform(coalesce({x}, {e}), l -> named_struct('text', trim(coalesce(l.text, '')), 'bbox', l.bbox)), l -> l.text <> '' and l.bbox is not null)"
    nested = F.expr(tidy.format(x="flatten(flatten(transform(coalesce(_o.blocks, array()), b -> transform(coalesce(b.paragraphs, array()), p -> coalesce(p.lines, array())))))", e=empty))
    flat = F.expr(tidy.format(x="_o.lines", e=empty))
    d = d.withColumn("_n", nested).withColumn("_l", F.when(F.size("_n") > 0, F.col("_n")).otherwise(flat))
    keep = [c for c in images.columns if c != json]
    return d.select(*keep, F.posexplode("_l").alias("line_no", "l")).select(*keep, "line_no", "l.text", "l.bbox.*")


def ocr_to_runs(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """Pixel boxes to invisible text runs in user space: the baseline is the box's lower edge, the size 0.8 of its height, 4 pt at least."""
    j = lines.join(pages, ["doc_id", "page_index"]).filter(F.trim("text") != "")
    page = [F.col(c) for c in ("origin_x", "origin_y", "width_pt", "height_pt", "rotation")]
    at = G.visual_to_pt(F.col("x0") / F.col("scale"), F.col("y1") / F.col("scale"), *page)
    size = F.greatest(F.lit(4.0), (F.col("y1") - F.col("y0")) / F.col("scale") * 0.8)
    return j.withColumn("_p", at).select("doc_id", "page_index", "line_no", F.col("_p.x").alias("x"), F.col("_p.y").alias("y"), size.alias("size_pt"), F.trim("text").alias("text"), F.lit(3).alias("render_mode"), F.col("rotation").alias("angle_deg"))
