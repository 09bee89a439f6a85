"""Page-set algebra.  Each operation takes the page table (any table with doc_id and page_index) and a table of edits
with at most one row per document, so many documents are changed in one pass."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from quireframe.functions.fonts import STANDARD_FONTS
from quireframe.operators.chars import Pages


def _with_edit(pages: DataFrame, edits: DataFrame) -> DataFrame:
    return pages.join(edits, "doc_id", "left")


def insert_documents(pages: DataFrame, inserts: DataFrame) -> DataFrame:
    """inserts(doc_id, src_doc, at): all pages of ``src_doc`` go in front of page ``at``."""
    n = pages.groupBy(F.col("doc_id").alias("src_doc")).agg(F.count(F.lit(1)).alias("_n"))
    ins = inserts.join(n, "src_doc").select("doc_id", "src_doc", "at", "_n")
    kept = _with_edit(pages, ins.drop("src_doc"))
    kept = kept.withColumn("page_index", F.when(F.col("page_index") >= F.col("at"), F.col("page_index") + F.col("_n")).otherwise(F.col("page_index")).cast("int"))
    new = pages.withColumnRenamed("doc_id", "src_doc").join(ins.drop("_n"), "src_doc").withColumn("page_index", (F.col("page_index") + F.col("at")).cast("int"))
    return kept.select(pages.columns).unionByName(new.select(pages.columns))


def extract_pages(pages: DataFrame, picks: DataFrame) -> DataFrame:
    """picks(doc_id, page_list array<int>): the listed pages in list order."""
    p = picks.select("doc_id", F.posexplode("page_list").alias("new_index", "page_index"))
    return pages.join(p, ["doc_id", "page_index"]).withColumn("page_index", F.col("new_index")).select(pages.columns)


def delete_pages(pages: DataFrame, deletes: DataFrame) -> DataFrame:
    """deletes(doc_id, gone int): later pages move up by one."""
    j = _with_edit(pages, deletes).filter(F.col("gone").isNull() | (F.col("page_index") != F.col("gone")))
    return j.withColumn("page_index", F.when(F.col("page_index") > F.col("gone"), F.col("page_index") - 1).otherwise(F.col("page_index"))).select(pages.columns)


def move_pages(pages: DataFrame, moves: DataFrame) -> DataFrame:
    """moves(doc_id, src, dst): page ``src`` ends up at index ``dst``."""
    i, a, b = F.col("page_index"), F.col("src"), F.col("dst")
    new = F.when(i == a, b).when((a < b) & (i > a) & (i <= b), i - 1).when((b < a) & (i >= b) & (i < a), i + 1).otherwise(i)
    return _with_edit(pages, moves).withColumn("page_index", new.cast("int")).select(pages.columns)


def duplicate_pages(pages: DataFrame, copies: DataFrame) -> DataFrame:
    """copies(doc_id, dup): a copy of the page right after it; one pass, the copy is the second element of an array."""
    i, d = F.col("page_index"), F.col("dup")
    new = F.when(i == d, F.array(i, i + 1)).when(i > d, F.array(i + 1)).otherwise(F.array(i))
    return _with_edit(pages, copies).withColumn("page_index", F.explode(new)).select(pages.columns)


def rotate_pages(pages: DataFrame, turns: DataFrame) -> DataFrame:
    """turns(doc_id, degrees): to the nearest quarter turn."""
    quarter = F.pmod(F.floor(F.col("rotation") / 90 + 0.5) + F.floor(F.col("degrees") / 90.0 + 0.5), F.lit(4)) * 90
    return _with_edit(pages, turns).withColumn("rotation", F.coalesce(quarter.cast("int"), "rotation")).select(pages.columns)


def redact_runs(runs: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """targets(doc_id, page_index, run_id): the runs are gone, not covered; returns (kept, removed per page)."""
    keys = ["doc_id", "page_index", "run_id"]
    t = targets.select(*keys).distinct()
    return runs.join(t, keys, "left_anti"), runs.join(t, keys, "left_semi").groupBy("doc_id", "page_index").agg(F.count(F.lit(1)).alias("removed"))


def upsert_marked(objects: DataFrame, new: DataFrame) -> DataFrame:
    """Objects of the same mark on the same page are replaced by the new ones."""
    keys = ["doc_id", "page_index", "mark"]
    return objects.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def _transformed(b: pa.RecordBatch) -> pa.RecordBatch:
    """The runs of some pages after the edits that stand beside them."""
    flat = {c: b.column(c).flatten() for c in b.schema.names if c not in ("doc_id", "page_index")}
    offsets = b.column("x").offsets.to_numpy()
    size, font, color, line = flat.pop("new_size"), flat.pop("new_font"), flat.pop("new_color"), flat["line_id"]
    fits = pc.fill_null(pc.and_(pc.greater_equal(size, 1.0), pc.less_equal(size, 400.0)), True)
    ok = pc.and_(fits, pc.or_(pc.is_null(font), pc.is_in(font, value_set=pa.array(STANDARD_FONTS)))).to_numpy(zero_copy_only=False)
    line = line.dictionary_encode("encode").indices.to_numpy().astype(np.int64)
    lines, of = np.unique(np.repeat(np.arange(b.num_rows), np.diff(offsets)) * (line.max(initial=0) + 1) + line, return_inverse=True)
    go = np.ones(lines.size, bool)
    go[of[~ok]] = False
    go = pa.array(go[of])
    asked = lambda c: pc.and_(go, pc.is_valid(c))
    for c, by in (("x", "dx"), ("y", "dy")):
        flat[c] = pc.add(flat[c], pc.if_else(go, pc.fill_null(flat.pop(by), 0.0), 0.0))
    k = pc.if_else(asked(size), pc.divide(size, flat["size_eff_pt"]), 1.0)
    flat |= {c: pc.multiply(flat[c], k) for c in ("w", "h", "size_eff_pt")}
    flat |= {c: pc.if_else(asked(new), new, flat[c]) for c, new in (("color", color), ("font_name", font))}
    edges = pa.array((offsets - offsets[0]).astype(np.int32))
    return pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("page_index"), *(pa.ListArray.from_arrays(edges, v) for v in flat.values())], names=["doc_id", "page_index", *flat])


def transform_runs(runs: DataFrame | Pages, edits: DataFrame | None = None) -> DataFrame | Pages:
    """edits(doc_id, page_index, run_id, dx, dy, new_color, new_size, new_font): move, recolour, resize, change font.

    Null means leave alone.  Sizes outside 1..400 pt and fonts that are not standard are refused, and a line changes
    wholly or not at all: one refused run keeps its line as it was.

    ``Pages`` hold the edits as arrays beside those of their runs (``edits`` is None) and become ``Pages``: lines are judged
    where their page is read, and no run is moved.
    """
    if isinstance(runs, Pages):
        return Pages(runs.rows, lambda b, read=runs.read: _transformed(read(b)))
    from pyspark.sql import Window as W

    j = runs.join(edits, ["doc_id", "page_index", "run_id"], "left")
    ok = F.coalesce(F.col("new_size").between(1, 400), F.lit(True)) & F.coalesce(F.col("new_font").isin(STANDARD_FONTS), F.lit(True))
    j = j.withColumn("_ok", F.min(ok).over(W.partitionBy("doc_id", "page_index", "line_id")))
    go = F.col("_ok")
    dx, dy = F.when(go, F.coalesce("dx", F.lit(0.0))).otherwise(0.0), F.when(go, F.coalesce("dy", F.lit(0.0))).otherwise(0.0)
    k = F.when(go & F.col("new_size").isNotNull(), F.col("new_size") / F.col("size_eff_pt")).otherwise(1.0)
    return (
        j.withColumn("_k", k).withColumn("x", F.col("x") + dx).withColumn("y", F.col("y") + dy).withColumn("w", F.col("w") * F.col("_k")).withColumn("h", F.col("h") * F.col("_k"))
        .withColumn("size_eff_pt", F.col("size_eff_pt") * F.col("_k"))
        .withColumn("color", F.when(go & F.col("new_color").isNotNull(), F.col("new_color")).otherwise(F.col("color")))
        .withColumn("font_name", F.when(go & F.col("new_font").isNotNull(), F.col("new_font")).otherwise(F.col("font_name")))
        .select(runs.columns)
    )


def page_number_labels(picks: DataFrame, start: int, template: str, totals: DataFrame, date) -> DataFrame:
    """Header text of each picked page: the number counts picked pages in the order given, the total all pages."""
    from quireframe.functions.textcols import expand_macros

    p = picks.select("doc_id", F.posexplode("page_list").alias("k", "page_index")).join(totals, "doc_id").filter((F.col("page_index") >= 0) & (F.col("page_index") < F.col("total")))
    return p.select("doc_id", "page_index", expand_macros(F.lit(template), F.col("k") + start, F.col("total"), date).alias("label"))


def text_diff(old: str, new: str):
    """struct<prefix, suffix, removed, inserted>: what is left of two texts between their common ends, as a column."""
    o, n = F.split(F.col(old), ""), F.split(F.col(new), "")
    m = F.least(F.length(old), F.length(new))

    def common(a, b, limit):
        diff = F.array_position(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), F.lit(True))
        return F.least(F.when(diff == 0, limit).otherwise((diff - 1).cast("int")), limit)

    p = common(o, n, m)
    s = common(F.split(F.reverse(F.col(old)), ""), F.split(F.reverse(F.col(new)), ""), m - p)
    mid = lambda c: F.substr(F.col(c), p + 1, F.length(c) - p - s)
    return F.struct(p.alias("prefix"), s.alias("suffix"), mid(old).alias("removed"), mid(new).alias("inserted"))


def apply_page_ops(objects: DataFrame, ops: DataFrame) -> DataFrame:
    """ops(doc_id, page_index, seq, type, x, y, w, h, payload): each op becomes an object, numbered after the page's last."""
    from pyspark.sql import Window as W

    last = objects.groupBy("doc_id", "page_index").agg(F.max("object_id").alias("_m"))
    j = ops.join(last, ["doc_id", "page_index"], "left")
    j = j.withColumn("object_id", (F.coalesce("_m", F.lit(-1)) + F.row_number().over(W.partitionBy("doc_id", "page_index").orderBy("seq"))).cast("int"))
    kind = F.when(F.col("type") == "insertText", "text").when(F.col("type").isin("fillRect", "drawRect", "drawStroke"), "path").when(F.col("type") == "insertImage", "image").otherwise("link")
    return objects.select("doc_id", "page_index", "object_id", "kind", "x", "y", "w", "h", "payload").unionByName(j.select("doc_id", "page_index", "object_id", kind.alias("kind"), "x", "y", "w", "h", "payload"))


def place_objects(objects: DataFrame, edits: DataFrame) -> DataFrame:
    """objects(doc_id, object_id, x, y, w, h) after edits(doc_id, object_id, seq, op, x, y, w, h), op being place or delete.

    Edits of an object take effect in the order of ``seq``: each side that a placement names is set, a deleted object is
    gone whatever follows.  The result lists every object that is left.
    """
    keys, sides = ["doc_id", "object_id"], ["x", "y", "w", "h"]
    last = edits.groupBy(*keys).agg(
        F.max(F.col("op") == "delete").alias("_gone"),
        *[F.max(F.when((F.col("op") == "place") & F.col(c).isNotNull(), F.struct("seq", F.col(c).alias("v"))))["v"].alias(f"_{c}") for c in sides],
    )
    j = objects.join(last, keys, "left").filter(~F.coalesce("_gone", F.lit(False)))
    return j.select(*[F.coalesce(f"_{c}", c).alias(c) if c in sides else c for c in objects.columns])
