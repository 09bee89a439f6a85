"""Text widths by any metric: every distinct (font, text) is measured once, and joined back to where it stands.

A metric is a table of glyph widths or a function of (font, text); both tell widths in em, so one measurement serves all
sizes.  Texts that are more than one in ``HOT`` of all rows (so at most ``HOT`` of them) come back by a broadcast, all
others by a shuffled join in which no key is hot.

Where a document's words are one row already, :func:`wrap_documents` measures and wraps them there, and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from quireframe.operators import paging, scale
from quireframe.session import checkpointed

HOT = 1000
Metric = DataFrame | Callable[[pd.Series, pd.Series], pd.Series]


def _measure(texts: DataFrame, metric: Metric, default_em: float) -> DataFrame:
    """texts(font, text, ...) with ``em``, the width of the text at size 1."""
    if not isinstance(metric, DataFrame):
        return texts.withColumn("em", F.pandas_udf(metric, "double")("font", "text"))
    glyph = texts.select("font", "text", F.explode(F.split("text", "")).alias("glyph")).where("glyph <> ''")
    glyph = glyph.groupBy("font", "text", "glyph").agg(F.count(F.lit(1)).alias("times"))
    table = metric.select("font", "glyph", F.col("em").cast("double").alias("_em"))
    sums = glyph.join(table, ["font", "glyph"], "left").groupBy("font", "text").agg(F.sum(F.col("times") * F.coalesce("_em", F.lit(default_em))).alias("em"))
    return texts.join(sums, ["font", "text"], "left").withColumn("em", F.coalesce("em", F.lit(0.0)))


def with_widths(rows: DataFrame, metric: Metric, out: str = "width", default_em: float = 0.6) -> DataFrame:
    """rows(font, text, size, ...) with the width of each text in its font and size.

    ``metric``: a table (font, glyph, em), where a glyph that is missing takes ``default_em``; or a function over two
    pandas series, fonts and texts, that returns widths in em.  A null font or text has no width.
    """
    texts = checkpointed(rows.where("font IS NOT NULL AND text IS NOT NULL").groupBy("font", "text").agg(F.count(F.lit(1)).alias("_n")))
    total = texts.agg(F.sum("_n")).first()[0] or 0
    known = checkpointed(_measure(texts, metric, default_em))
    hot = known.where(F.col("_n") * HOT > total).select("font", "text", F.col("em").alias("_hot"))
    rest = known.where(F.col("_n") * HOT <= total).select("font", "text", F.col("em").alias("_rest"))
    got = rows.join(F.broadcast(hot), ["font", "text"], "left")
    # a hot row carries no key into the shuffle, so it stays where it is dealt by its place
    cold = got.where("_hot IS NULL").join(rest, ["font", "text"], "left")
    both = got.where("_hot IS NOT NULL").withColumn("_rest", F.lit(None).cast("double")).unionByName(cold)
    return both.withColumn(out, F.coalesce("_hot", "_rest") * F.col("size")).drop("_hot", "_rest")


def _pieces(long: DataFrame, metric: Metric, width_pt: float, default_em: float) -> DataFrame:
    """long(doc_id, word, font, size, text): texts wider than the line, cut by characters, one at least in each piece."""
    glyph = long.select(F.struct("doc_id", "word").alias("at"), "font", "size", F.posexplode(F.split("text", "")).alias("item", "text")).where("text <> ''")
    wide = checkpointed(with_widths(glyph, metric, "height", default_em))
    page = paging.paginate(wide.select(F.xxhash64("at").alias("doc_id"), "item", "height"), width_pt)
    cut = wide.withColumn("doc_id", F.xxhash64("at")).join(page, ["doc_id", "item"])
    return cut.groupBy("at", "font", "size", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item", "text"))), lambda x: x["text"]), "").alias("text"), F.sum("height").alias("width")).select("at.*", F.col("page").alias("piece"), "font", "size", "text", "width")


def wrap_measured(words: DataFrame, metric: Metric, width_pt: float, default_em: float = 0.6) -> DataFrame:
    """words(doc_id, word from 0, font, size, text) -> doc_id, line_no, word, piece, text, width: greedy lines of measured words.

    Words of a line are one blank of the first one's font apart.  A word wider than a line is cut by characters, its pieces stand
    without blanks.  Line beginnings are found like page beginnings (``paging``), so a document of any length is spread.
    """
    blank = words.select("font").distinct().withColumn("text", F.lit(" ")).withColumn("size", F.lit(1.0))
    blank = with_widths(blank, metric, "_blank", default_em).select("font", "_blank")
    w = checkpointed(with_widths(words, metric, "width", default_em))
    over = w.where(F.col("width") > width_pt)
    plain = w.where(~(F.col("width") > width_pt)).select("doc_id", "word", F.lit(0).alias("piece"), "font", "size", "text", "width")
    cut = _pieces(over.select("doc_id", "word", "font", "size", "text"), metric, width_pt, default_em)
    atoms = plain.unionByName(cut).withColumn("_chunk", F.floor(F.col("word") / paging.CHUNK).cast("long"))
    atoms = scale.row_number(atoms, ["doc_id"], "_chunk", [F.col("word"), F.col("piece")], "item").withColumn("item", F.col("item") - 1)
    atoms = checkpointed(scale.lag(atoms, ["doc_id"], "_chunk", ["word", "piece"], {"_next": "word"}, back=False).join(blank, "font"))
    gap = F.when(F.col("_next").isNull() | (F.col("_next") == F.col("word")), 0.0).otherwise(F.col("_blank") * F.col("size"))
    # the blank belongs to the word before it, and is not asked for where that word ends the line
    lines = paging.paginate(atoms.select("doc_id", "item", (F.col("width") + gap).alias("height"), F.col("width").alias("need")), width_pt)
    return atoms.join(lines, ["doc_id", "item"]).select("doc_id", F.col("page").alias("line_no"), "word", "piece", "text", "width")


#: Documents that are wrapped at once.
SLICE = 64
ITEM = "struct<word: int, piece: int, text: string, width: double>"


def _ruler(metric: Metric, default_em: float) -> Callable[[np.ndarray, pa.Array], np.ndarray]:
    """Widths in em of texts in their fonts.  A glyph table comes to the driver: a row for each code point of a font at most."""
    if not isinstance(metric, DataFrame):

        def measured(fonts: np.ndarray, texts: pa.Array) -> np.ndarray:
            rows = pd.DataFrame({"font": fonts, "text": texts.to_pandas()})
            once = rows.drop_duplicates()
            return rows.merge(once.assign(em=np.asarray(metric(once["font"], once["text"]), float)), "left", ["font", "text"])["em"].to_numpy()

        return measured
    tables: dict[str, np.ndarray] = {}
    for font, glyph, em in metric.select("font", "glyph", F.col("em").cast("double")).where("char_length(glyph) = 1 AND em IS NOT NULL").collect():
        table = tables.setdefault(font, np.full(0x110000, default_em))
        table[ord(glyph)] = em
    tables = {f: t[: np.max(np.flatnonzero(t != default_em), initial=0) + 1].copy() for f, t in tables.items()}

    def summed(fonts: np.ndarray, texts: pa.Array) -> np.ndarray:
        code = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), np.uint32)
        length = pc.utf8_length(texts).to_numpy()
        font = np.repeat(fonts, length)
        em = np.full(code.size, default_em)
        for f, table in tables.items():
            of = np.flatnonzero((font == f) & (code < table.size))
            em[of] = table[code[of]]
        out, some = np.zeros(len(texts)), length > 0
        if code.size:
            out[some] = np.add.reduceat(em, (np.cumsum(length) - length)[some])
        return out

    return summed


def _units(width: np.ndarray) -> np.ndarray:
    return np.floor(width * paging.UNIT + 0.5).astype(np.int64)


def _cut(glyphs: list[str], widths: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Where the pieces of a word that is wider than a line begin and end."""
    upto = np.concatenate([[0], np.cumsum(_units(widths))])
    out, at = [], 0
    while at < len(glyphs):
        to = max(at + 1, int(np.searchsorted(upto, upto[at] + most, "right")) - 1)
        out.append((at, to))
        at = to
    return out


def _wrapped(b: pa.RecordBatch, ruler, width_pt: float) -> pa.RecordBatch:
    """One row for each line of the documents of a batch."""
    words = b.column("words")
    count = np.diff(words.offsets.to_numpy())
    text, doc = words.flatten(), np.repeat(np.arange(len(words)), count)
    word = np.arange(doc.size) - (np.cumsum(count) - count)[doc]
    fonts, size = b.column("font").to_numpy(zero_copy_only=False), b.column("size").to_numpy(zero_copy_only=False)
    width = ruler(fonts[doc], text) * size[doc]
    most = round(width_pt * paging.UNIT)
    pieces = np.ones(doc.size, np.int64)
    parts: dict[int, list[tuple[str, float]]] = {}
    for k in np.flatnonzero(width > width_pt):
        glyphs = list(text[int(k)].as_py())
        each = ruler(np.repeat(fonts[doc[k]], len(glyphs)), pa.array(glyphs)) * size[doc[k]]
        parts[k] = [("".join(glyphs[i:j]), float(each[i:j].sum())) for i, j in _cut(glyphs, each, most)]
        pieces[k] = len(parts[k])
    of = np.repeat(np.arange(doc.size), pieces)
    piece = np.arange(of.size) - (np.cumsum(pieces) - pieces)[of]
    doc, word, width = doc[of], word[of], width[of]
    if parts:
        cut = pieces[of] > 1
        text = text.take(pa.array(of))
        text = pc.replace_with_mask(text, pa.array(cut), pa.array([t for k in parts if len(parts[k]) > 1 for t, _ in parts[k]], text.type))
        width[cut] = [w for k in parts if len(parts[k]) > 1 for _, w in parts[k]]
    # the blank belongs to the word before it, and is not asked for where that word ends the line
    blank = ruler(fonts, pa.array([" "] * len(words))) * size
    goes_on = np.append((doc[1:] == doc[:-1]) & (word[1:] != word[:-1]), False)[: doc.size]
    height = _units(width + np.where(goes_on, blank[doc], 0.0))
    p = np.cumsum(height) - height
    end = np.searchsorted(doc, np.arange(len(words)), "right")
    # an item turns the line only where something stands on it
    after = np.maximum(np.searchsorted(p, p, "right"), np.searchsorted(p + np.maximum(_units(width), height - most), p + most, "right"))
    after = np.minimum(after, end[doc]).tolist()
    starts = []
    for k, last in zip(np.append(0, end[:-1]).tolist() if len(words) else [], end.tolist()):
        while k < last:
            starts.append(k)
            k = after[k]
    starts = np.array(starts, np.int64)
    of_line = doc[starts]
    line_no = np.arange(starts.size) - np.searchsorted(of_line, of_line)
    items = pa.StructArray.from_arrays([pa.array(word, pa.int32()), pa.array(piece, pa.int32()), text, pa.array(width)], ["word", "piece", "text", "width"])
    lists = pa.ListArray.from_arrays(pa.array(np.append(starts, doc.size), pa.int32()), items)
    return pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(of_line)), pa.array(line_no, pa.int32()), lists], names=["doc_id", "line_no", "items"])


def wrap_documents(docs: DataFrame, metric: Metric, width_pt: float, default_em: float = 0.6) -> DataFrame:
    """docs(doc_id, font, size, words) -> doc_id, line_no, items(word, piece, text, width): the lines of :func:`wrap_measured`, a row each.

    Every document is wrapped inside its row: all running widths of a slice of documents at once, then one step a line.  Words are
    not null; a document without words, font or size has no lines.
    """
    ruler = _ruler(metric, default_em)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, SLICE):
                yield _wrapped(b.slice(k, SLICE), ruler, width_pt)

    d = docs.where("size(words) > 0 AND font IS NOT NULL AND size IS NOT NULL").select("doc_id", "font", F.col("size").cast("double").alias("size"), "words")
    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, line_no int, items array<{ITEM}>")
