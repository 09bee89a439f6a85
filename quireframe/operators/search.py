"""Search and replace over units of text: runs, lines, anything with an id inside a page.

Offsets count code points.  Units are short (a run or a line); whatever does not match at all is filtered out before any
offset is worked out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quireframe.operators import scale

PAGE = ["doc_id", "page_index"]
WORD = r"[\p{L}\p{N}_]"


def pattern(q: str, match_case: bool = False, whole_word: bool = False) -> str:
    """Java pattern for a literal query; whole words by Unicode letters, digits and underscore."""
    body = "\\Q" + q.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    if whole_word:
        body = f"(?<!{WORD}){body}(?!{WORD})"
    return body if match_case else f"(?iu){body}"


def match_spans(text: Column, regex: str) -> Column:
    """array<struct<start, end>> of the non-overlapping matches."""
    parts, hits = F.split(text, regex, -1), F.regexp_extract_all(text, F.lit(regex), F.lit(0))
    both = F.struct(F.transform(parts, lambda p: F.length(p)).alias("gap"), F.transform(hits, lambda h: F.length(h)).alias("len"))

    def spans(s: Column) -> Column:
        def total(a: Column, n: Column) -> Column:
            return F.aggregate(F.slice(a, F.lit(1), n), F.lit(0), lambda acc, x: acc + x)

        def one(length: Column, k: Column) -> Column:
            start = total(s["gap"], k + 1) + total(s["len"], k)
            return F.struct(start.alias("start"), (start + length).alias("end"))

        return F.transform(s["len"], one)

    return F.element_at(F.transform(F.array(both), spans), 1)


def find_text(units: DataFrame, q: str, match_case: bool = False, whole_word: bool = False, unit: str = "line_id", text: str = "text") -> DataFrame:
    """doc_id, page_index, unit, start, end of every match; no rows for an empty query."""
    if not q:
        return units.limit(0).select(*PAGE, unit, F.lit(0).alias("start"), F.lit(0).alias("end"))
    rx = pattern(q, match_case, whole_word)
    hits = units.filter(F.col(text).rlike(rx))
    return hits.select(*PAGE, unit, F.explode(match_spans(F.col(text), rx)).alias("m")).select(*PAGE, unit, "m.start", "m.end")


def find_crossing(units: DataFrame, q: str, match_case: bool = False, whole_word: bool = False, unit: str = "line_id", text: str = "text") -> DataFrame:
    """Matches that span two or more units of a page, met on the page's text joined by a blank or by nothing.

    first_unit (position in the page) and offset name a match; a match found by both joins counts once.
    """
    rx = pattern(q, match_case, whole_word)
    page = units.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct(F.col(unit).alias("k"), F.col(text).alias("t")))).alias("us"))
    page = page.select(*PAGE, F.transform("us", lambda u: u["t"]).alias("ts"), F.explode(F.array(F.lit(" "), F.lit(""))).alias("sep"))
    page = page.withColumn("whole", F.expr("array_join(ts, sep)")).filter(F.col("whole").rlike(rx))
    page = page.withColumn("starts", F.expr("aggregate(ts, named_struct('at', 0, 'out', cast(array() as array<int>)), (s, t) -> named_struct('at', s.at + length(t) + length(sep), 'out', array_append(s.out, s.at)), s -> s.out)"))
    hits = page.select(*PAGE, "starts", F.explode(match_spans(F.col("whole"), rx)).alias("m"))
    at = "size(filter(starts, s -> s <= {p})) - 1"
    hits = hits.withColumn("first_unit", F.expr(at.format(p="m.start"))).withColumn("last_unit", F.expr(at.format(p="m.end - 1")))
    hits = hits.filter("first_unit <> last_unit").withColumn("offset", F.expr("m.start - element_at(starts, first_unit + 1)"))
    return hits.select(*PAGE, "first_unit", "offset").distinct()


def replace_all(text: Column, q: str, replacement: str, match_case: bool = False, whole_word: bool = False) -> Column:
    """Every match inside the text, replaced literally: no group references in the replacement."""
    safe = replacement.replace("\\", "\\\\").replace("$", "\\$")
    return F.regexp_replace(text, F.lit(pattern(q, match_case, whole_word)), F.lit(safe)) if q else text


def highlight_boxes(matches: DataFrame, chars: DataFrame, unit: str = "line_id") -> DataFrame:
    """Hull of each match's character boxes (characters without a box do not count); matches with none are left out."""
    keys = [*PAGE, unit]
    j = matches.join(chars, keys).filter((F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("end")) & (F.col("w") > 0) & (F.col("h") > 0))
    g = j.groupBy(*keys, "start", "end").agg(F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("w")).alias("x1"), F.max(F.col("y") + F.col("h")).alias("y1"))
    return g.select(*keys, "start", "end", "x", "y", (F.col("x1") - F.col("x")).alias("w"), (F.col("y1") - F.col("y")).alias("h"))


def match_cursor(matches: DataFrame, unit: str = "line_id") -> DataFrame:
    """Each match with the one after and before it in its document, and whether getting there wraps around."""
    m = matches.select("doc_id", "page_index", unit, "start")
    m = scale.neighbours(m, ["doc_id"], "page_index", [unit, "start"], F.struct("page_index", unit, "start"))
    return m.select(
        "doc_id", "page_index", unit, "start",
        F.coalesce("next", "first").alias("next"), F.col("next").isNull().alias("next_wraps"),
        F.coalesce("prev", "last").alias("prev"), F.col("prev").isNull().alias("prev_wraps"),
    )


def next_hit(matches: DataFrame, cursors: DataFrame, unit: str = "line_id") -> DataFrame:
    """First match at or after each document's cursor (page_at, unit_at), else its first match: two minima, no sort."""
    here = F.struct("page_index", F.col(unit).alias("unit"), "start")
    j = matches.join(cursors, "doc_id")
    later = (F.col("page_index") > F.col("page_at")) | ((F.col("page_index") == F.col("page_at")) & (F.col(unit) >= F.col("unit_at")))
    g = j.groupBy("doc_id").agg(F.min(F.when(later, here)).alias("_n"), F.min(here).alias("_f"))
    return g.select("doc_id", F.coalesce("_n", "_f").alias("h"), F.col("_n").isNull().alias("wrapped")).select("doc_id", "h.page_index", F.col("h.unit").alias(unit), "h.start", "wrapped")


def match_rollup(matches: DataFrame) -> DataFrame:
    """doc_id, page_index, hits: matches of each page, of each document (page_index null) and of all (both null), in one aggregation."""
    return matches.rollup("doc_id", "page_index").agg(F.count(F.lit(1)).alias("hits"))
