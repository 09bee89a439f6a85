"""Search and replace over lines and words of the derived pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from quireframe.operators import search as Q
from quireframe.plans.registry import LINES, RUNS, query
from quireframe.sources import layout
from quireframe.sources.tables import load_spread


def line_units(spark, sf_dir):
    ls = layout.doc_lines(load_spread(spark, sf_dir, "documents", "doc_id"))
    return ls.select("doc_id", "page_index", F.col("line").alias("line_id"), F.array_join("words", " ").alias("text"), "size_pt", "y")


# Matches of a plain literal, from the pieces between them.
MATCHES = r"""
pz AS (SELECT doc_id, page_index, line AS line_id, string_split({text}, '{q}') AS parts FROM lines WHERE contains({text}, '{q}')),
mt AS (SELECT doc_id, page_index, line_id, CAST(unnest(range(len(parts) - 1)) AS INTEGER) AS k, parts FROM pz),
matches AS (SELECT doc_id, page_index, line_id, CAST(length(array_to_string(list_slice(parts, 1, k + 1), '')) + k * {n} AS INTEGER) AS start, CAST(length(array_to_string(list_slice(parts, 1, k + 1), '')) + (k + 1) * {n} AS INTEGER) AS "end" FROM mt)"""


def matches_sql(q: str, text: str = "text") -> str:
    return MATCHES.replace("{q}", q).replace("{n}", str(len(q))).replace("{text}", text)


@query("x01_find_text", f"WITH {LINES}, {matches_sql('en', 'lower(text)')} SELECT doc_id, page_index, line_id, start, \"end\" FROM matches")
def find_text(spark, sf_dir):
    return Q.find_text(line_units(spark, sf_dir), "EN")


@query(
    "x01_find_whole_word",
    rf"""WITH {LINES}, s AS (SELECT doc_id, page_index, line, string_split(regexp_replace(lower(text), '[^\pL\pN_]', ' ', 'g'), ' ') AS ws FROM lines)
SELECT doc_id, page_index, CAST(sum(len(list_filter(ws, lambda w: w = 'la'))) AS BIGINT) AS n FROM s GROUP BY doc_id, page_index HAVING n > 0""",
)
def find_whole_word(spark, sf_dir):
    return Q.find_text(line_units(spark, sf_dir), "la", whole_word=True).groupBy("doc_id", "page_index").agg(F.count(F.lit(1)).alias("n"))


CROSS = r"""
nx AS (SELECT *, lead(text) OVER (PARTITION BY doc_id, page_index ORDER BY run_id) AS nt FROM runs)"""


@query(
    "x02_find_crossing",
    f"""WITH {RUNS} {CROSS.replace(chr(10), ',', 1)} SELECT doc_id, page_index, run_id AS first_unit, CAST(length(text) - 1 AS INTEGER) AS "offset" FROM nx WHERE right(text, 1) = 'e' AND left(nt, 1) = 'l'""",
)
def find_crossing(spark, sf_dir):
    r = layout.runs(load_spread(spark, sf_dir, "documents", "doc_id"))
    return Q.find_crossing(r, "e l", match_case=True, unit="run_id")


@query("x03_replace_all", f"WITH {LINES} SELECT doc_id, page_index, line AS line_id, replace(text, 'en', '$1' || chr(92) || 'E<>') AS text FROM lines")
def replace_all(spark, sf_dir):
    u = line_units(spark, sf_dir)
    return u.select("doc_id", "page_index", "line_id", Q.replace_all(F.col("text"), "en", "$1\\E<>", match_case=True).alias("text"))


@query(
    "x04_highlight_boxes",
    f"""WITH {LINES}, {matches_sql('el')} SELECT m.doc_id, m.page_index, m.line_id, m.start, m."end", round(72 + m.start * 0.6::DOUBLE * l.size_pt, 4) AS x, l.y, round(2 * 0.6::DOUBLE * l.size_pt, 4) AS w, l.size_pt AS h
FROM matches m JOIN lines l ON m.doc_id = l.doc_id AND m.line_id = l.line""",
)
def highlight_boxes(spark, sf_dir):
    u = line_units(spark, sf_dir)
    hits = Q.find_text(u, "el", match_case=True)
    chars = u.filter(F.contains("text", F.lit("el"))).select("doc_id", "page_index", "line_id", "size_pt", "y", F.posexplode(F.split("text", "")).alias("pos", "ch"))
    em = F.col("size_pt") * 0.6
    chars = chars.filter("ch <> ''").select("doc_id", "page_index", "line_id", "pos", (F.lit(72.0) + F.col("pos") * em).alias("x"), "y", F.when(F.col("ch") == " ", 0.0).otherwise(em).alias("w"), F.col("size_pt").alias("h"))
    b = Q.highlight_boxes(hits, chars)
    return b.select("doc_id", "page_index", "line_id", "start", "end", F.round("x", 4).alias("x"), "y", F.round("w", 4).alias("w"), "h")


@query(
    "a04_match_count",
    f"""WITH {LINES}, {matches_sql('de')}, c AS (SELECT *, lead(text) OVER (PARTITION BY doc_id, page_index ORDER BY line) AS nt FROM lines),
x AS (SELECT doc_id, count(*) AS n FROM c WHERE right(text, 1) = 'd' AND left(nt, 1) = 'e' GROUP BY doc_id), i AS (SELECT doc_id, count(*) AS n FROM matches GROUP BY doc_id)
SELECT coalesce(i.doc_id, x.doc_id) AS doc_id, coalesce(i.n, 0) AS inside, coalesce(x.n, 0) AS crossing FROM i FULL JOIN x ON i.doc_id = x.doc_id""",
)
def match_count(spark, sf_dir):
    """Hits inside lines, and those that only a joined page shows, counted in one aggregation."""
    u = line_units(spark, sf_dir)
    inside = Q.find_text(u, "de", match_case=True).select("doc_id", F.lit(1).alias("i"), F.lit(0).alias("x"))
    across = Q.find_crossing(u, "de", match_case=True).select("doc_id", F.lit(0).alias("i"), F.lit(1).alias("x"))
    return inside.unionByName(across).groupBy("doc_id").agg(F.sum("i").alias("inside"), F.sum("x").alias("crossing"))


@query("a04_match_rollup", f"WITH {LINES}, {matches_sql('de')} SELECT doc_id, page_index, count(*) AS hits FROM matches GROUP BY ROLLUP (doc_id, page_index)")
def match_rollup(spark, sf_dir):
    return Q.match_rollup(Q.find_text(line_units(spark, sf_dir), "de", match_case=True))


@query(
    "w13_match_cursor",
    f"""WITH {LINES}, {matches_sql('ch')}, k AS (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY doc_id) AS n, lead(line_id * 10000 + start) OVER w AS nx, lag(line_id * 10000 + start) OVER w AS pv,
 first_value(line_id * 10000 + start) OVER w AS f, last_value(line_id * 10000 + start) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l FROM matches WINDOW w AS (PARTITION BY doc_id ORDER BY page_index, line_id, start))
SELECT doc_id, line_id, start, coalesce(nx, f) AS next, nx IS NULL AS next_wraps, coalesce(pv, l) AS prev, pv IS NULL AS prev_wraps FROM k""",
)
def match_cursor(spark, sf_dir):
    m = Q.match_cursor(Q.find_text(line_units(spark, sf_dir), "ch", match_case=True))

    def code(c):
        return (F.col(f"{c}.line_id") * 10000 + F.col(f"{c}.start")).alias(c)

    return m.select("doc_id", "line_id", "start", code("next"), "next_wraps", code("prev"), "prev_wraps")


@query(
    "t01_next_hit",
    f"""WITH {LINES}, {matches_sql('st')}, k AS (SELECT m.*, (page_index, line_id) >= (quality + toxic, 45) AS later FROM matches m JOIN labels USING (doc_id))
SELECT doc_id, page_index, line_id, start, NOT later AS wrapped FROM k QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY later DESC, page_index, line_id, start) = 1""",
)
def next_hit(spark, sf_dir):
    from quireframe.sources.tables import load

    cur = load(spark, sf_dir, "labels").select("doc_id", (F.col("quality") + F.col("toxic")).alias("page_at"), F.lit(45).alias("unit_at"))
    return Q.next_hit(Q.find_text(line_units(spark, sf_dir), "st", match_case=True), cur)


@query("t02_replace_order", f"WITH {LINES}, {matches_sql('re')} SELECT doc_id, page_index, line_id, start, CAST(row_number() OVER (PARTITION BY doc_id, page_index ORDER BY line_id DESC, start DESC) AS INTEGER) AS step FROM matches")
def replace_order(spark, sf_dir):
    from pyspark.sql import Window as W

    m = Q.find_text(line_units(spark, sf_dir), "re", match_case=True)
    return m.select("doc_id", "page_index", "line_id", "start", F.row_number().over(W.partitionBy("doc_id", "page_index").orderBy(F.desc("line_id"), F.desc("start"))).alias("step"))


@query("t03_caps", f"""WITH {LINES} SELECT doc_id, line AS line_id, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS k FROM lines WHERE size_pt >= 14""")
def caps(spark, sf_dir):
    """What a report of any length is cut from: all headings of each document, ranked."""
    from quireframe.operators import scale

    u = line_units(spark, sf_dir).filter("size_pt >= 14").select("doc_id", "page_index", "line_id")
    return scale.row_number(u, ["doc_id"], "page_index", ["line_id"], "k").drop("page_index")


@query(
    "a10_replace_summary",
    f"""WITH {LINES}, h AS (SELECT *, CASE WHEN contains(text, 'ß') THEN 'failed' WHEN contains(text, 'é') OR contains(text, 'ñ') THEN 'substituted' ELSE 'edited' END AS outcome FROM lines WHERE contains(text, 'en'))
SELECT doc_id, count(*) FILTER (WHERE outcome = 'edited') AS edited, count(*) FILTER (WHERE outcome = 'substituted') AS substituted, count(*) FILTER (WHERE outcome = 'failed') AS failed,
 CASE WHEN min(line) FILTER (WHERE outcome = 'substituted' AND size_pt > 11) IS NULL AND min(line) FILTER (WHERE outcome = 'substituted' AND size_pt = 11) IS NULL THEN ''
 WHEN min(line) FILTER (WHERE outcome = 'substituted' AND size_pt > 11) IS NULL THEN 'Helvetica' WHEN min(line) FILTER (WHERE outcome = 'substituted' AND size_pt = 11) IS NULL THEN 'Helvetica-Bold'
 WHEN min(line) FILTER (WHERE outcome = 'substituted' AND size_pt > 11) < min(line) FILTER (WHERE outcome = 'substituted' AND size_pt = 11) THEN 'Helvetica-Bold,Helvetica' ELSE 'Helvetica,Helvetica-Bold' END AS fonts FROM h GROUP BY doc_id""",
)
def replace_summary(spark, sf_dir):
    """Outcome counts and the substitute fonts in the order first used."""
    from quireframe.operators.reports import replace_summary as summary

    u = line_units(spark, sf_dir).filter(F.contains("text", F.lit("en")))
    out = F.when(F.contains("text", F.lit("ß")), "failed").when(F.contains("text", F.lit("é")) | F.contains("text", F.lit("ñ")), "substituted").otherwise("edited")
    return summary(u.select("doc_id", F.col("line_id").alias("pos"), out.alias("outcome"), F.when(F.col("size_pt") > 11, "Helvetica-Bold").otherwise("Helvetica").alias("font")))


@query("u11_text_diff", """WITH e AS (SELECT conv_id, turn, text AS old, replace(text, 'en', 'EN!') AS new FROM conversations)
SELECT conv_id, turn, CASE WHEN old = new THEN '' ELSE substr(old, strpos(old, 'en'), length(old) - strpos(old, 'en') - (strpos(reverse(old), 'ne') - 1) + 1) END AS removed,
 CASE WHEN old = new THEN '' ELSE substr(new, strpos(new, 'EN!'), length(new) - strpos(new, 'EN!') - (strpos(reverse(new), '!NE') - 1) + 1) END AS inserted FROM e""")
def text_diff(spark, sf_dir):
    from quireframe.operators.pages import text_diff as diff

    c = load_spread(spark, sf_dir, "conversations", "conv_id").select("conv_id", "turn", F.col("text").alias("old"), F.replace("text", F.lit("en"), F.lit("EN!")).alias("new"))
    return c.withColumn("d", diff("old", "new")).select("conv_id", "turn", "d.removed", "d.inserted")
