"""Column functions over the given tables: geometry, text, fonts, links, encodings, numbering."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quireframe.functions import addresses as A, bidi, encoding as E, fonts, geometry as G, links as K, tables, textcols as X
from quireframe.plans.registry import LINES, RUNS, WORDS, query
from quireframe.session import checkpoint_root
from quireframe.sources import layout, text_source
from quireframe.sources.assets import saved_assets
from quireframe.sources.tables import load, load_spread


def r4(c):
    return F.round(c, 4)


# --- sources --------------------------------------------------------------------------------------------------------


@query(
    "s01_text_corpus",
    r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, CASE WHEN lang = 'en' THEN 'md' ELSE 'txt' END AS extension, regexp_matches(coalesce(text, ''), '[^\x00-\x7F\x{A0}-\x{FF}]') AS wide FROM documents)
SELECT doc_id, extension, CASE WHEN wide THEN 3 + strlen(text) ELSE length(text) END AS length,
CASE WHEN NOT wide AND NOT regexp_full_match(text, '(?s)[\x00-\x7F]*') THEN 'assumed-windows-1252' END AS warning, md5(text) AS digest FROM t""",
)
def text_corpus(spark, sf_dir):
    """Every document written as a text file, in UTF-8 with a mark or in Latin-1, with its source in a file beside it; only the texts are opened again."""
    text_source.register(spark)
    folder = f"{checkpoint_root(spark).rstrip('/')}/text-corpus-{uuid.uuid4().hex}"
    text = F.coalesce("text", F.lit(""))
    content = F.when(text.rlike(r"[^\x{0}-\x{7F}\x{A0}-\x{FF}]"), F.concat(F.unhex(F.lit("EFBBBF")), F.encode(text, "UTF-8"))).otherwise(F.encode(text, "ISO-8859-1"))
    files = F.array(F.struct(F.when(F.col("lang") == "en", "md").otherwise("txt").alias("extension"), content.alias("content")),
                    F.struct(F.lit("json").alias("extension"), F.encode(F.to_json(F.struct("source")), "UTF-8").alias("content")))
    docs = load_spread(spark, sf_dir, "documents", "doc_id").select("doc_id", F.explode(files).alias("f"))
    shelf = F.pmod(F.xxhash64("doc_id"), F.lit(1024))  # no folder holds all files, and no driver their names
    docs.select(F.concat_ws("", shelf, F.lit("/"), "doc_id", F.lit("."), "f.extension").alias("path"), "f.content").write.format("text_corpus").mode("append").save(folder)
    texts = text_source.decoded(spark.read.format("text_corpus").option("listing", "tasks").load(folder).filter(F.col("extension").isin("md", "txt")))
    return texts.select(F.regexp_extract("path", r"(-?\d+)\.[a-z]+$", 1).cast("long").alias("doc_id"), "extension", "length", "warning", F.md5("text").alias("digest"))


@query(
    "s02_decode_bytes",
    r"""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 6 = 5 AND regexp_matches(text, '[^\x00-\x{FF}]') THEN 0 ELSE doc_id % 6 END AS k, text FROM documents)
SELECT doc_id, CASE WHEN k = 0 THEN 'utf-8' WHEN k IN (1, 3) THEN 'utf-16le' WHEN k IN (2, 4) THEN 'utf-16be' WHEN regexp_full_match(text, '[\x00-\x7F]*') THEN 'utf-8' ELSE 'windows-1252' END AS encoding,
k IN (3, 4) OR (k = 5 AND NOT regexp_full_match(text, '[\x00-\x7F]*')) AS assumed, md5(text) AS digest FROM t""",
)
def decode_bytes(spark, sf_dir):
    """Every whole text written in one of six encodings, with or without a byte order mark, and read back; UTF-8 where Latin-1 cannot hold it."""
    d = load_spread(spark, sf_dir, "documents", "doc_id")
    t = d.select("doc_id", F.col("text").alias("t"))
    k = F.when((F.pmod("doc_id", F.lit(6)) == 5) & F.col("t").rlike(r"[^\x{0}-\x{FF}]"), 0).otherwise(F.pmod("doc_id", F.lit(6)))

    def mark(h):
        return F.unhex(F.lit(h))

    raw = (
        F.when(k == 0, F.concat(mark("EFBBBF"), F.encode("t", "UTF-8")))
        .when(k == 1, F.concat(mark("FFFE"), F.encode("t", "UTF-16LE")))
        .when(k == 2, F.concat(mark("FEFF"), F.encode("t", "UTF-16BE")))
        .when(k == 3, F.encode("t", "UTF-16LE"))
        .when(k == 4, F.encode("t", "UTF-16BE"))
        .otherwise(F.encode("t", "ISO-8859-1"))
    )
    return E.with_decoded(t.select("doc_id", raw.alias("content")), "content").select("doc_id", "encoding", "assumed", F.md5("text").alias("digest"))


@query(
    "s03_encoding_warnings",
    r"""SELECT doc_id, CASE WHEN NOT regexp_full_match(text, '[\x00-\x7F]*') AND NOT regexp_matches(text, '[^\x00-\x{FF}]') THEN 'assumed-windows-1252' END AS warning FROM documents""",
)
def encoding_warnings(spark, sf_dir):
    d = load_spread(spark, sf_dir, "documents", "doc_id")
    raw = d.select("doc_id", F.when(F.col("text").rlike(r"[^\x{0}-\x{FF}]"), F.encode("text", "UTF-8")).otherwise(F.encode("text", "ISO-8859-1")).alias("content"))
    return E.with_decoded(raw, "content").select("doc_id", E.encoding_warning(F.col("encoding"), F.col("assumed")).alias("warning"))


@query(
    "s04_validate_pages",
    """WITH p AS (SELECT o_orderkey, o_totalprice % 20000 - 500 AS w, CAST(o_custkey AS DOUBLE) AS h, CASE o_orderstatus WHEN 'P' THEN 0.0 WHEN 'F' THEN 1.25 ELSE 1.0 END::DOUBLE AS u FROM orders),
q AS (SELECT *, w > 0 AND h > 0 AND w <= 14400 * CASE WHEN u > 0 THEN u ELSE 1 END AND h <= 14400 * CASE WHEN u > 0 THEN u ELSE 1 END AS good FROM p)
SELECT o_orderkey, CASE WHEN good THEN w ELSE 595 END AS width_pt, CASE WHEN good THEN h ELSE 842 END AS height_pt, CASE WHEN good AND u > 0 THEN u ELSE 1.0 END AS user_unit, NOT good AS invalid_size FROM q""",
)
def validate_pages(spark, sf_dir):
    from quireframe.sources.pages import validate_pages as validate

    o = load(spark, sf_dir, "orders")
    raw = o.select(
        "o_orderkey", (F.col("o_totalprice") % 20000 - 500).alias("width_pt"), F.col("o_custkey").cast("double").alias("height_pt"),
        F.when(F.col("o_orderstatus") == "P", 0.0).when(F.col("o_orderstatus") == "F", 1.25).otherwise(1.0).alias("user_unit"),
    )
    return validate(raw)


VISIBLE = "(x + w > 150.5 AND x < 449.5 AND y + h > 200.5 AND y < 699.5)"


@query("s05_load_runs", f"WITH {RUNS} SELECT doc_id, page_index, count(*) AS n_runs, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM runs WHERE {VISIBLE} GROUP BY doc_id, page_index")
def load_runs(spark, sf_dir):
    """Runs inside the visible box of their page; the box here is the middle of the sheet."""
    from quireframe.sources.pages import visible_runs

    docs = load_spread(spark, sf_dir, "documents", "doc_id")
    crop = layout.page_meta(docs).withColumn("origin_x", F.lit(150.0)).withColumn("origin_y", F.lit(200.0)).withColumn("width_pt", F.lit(300.0)).withColumn("height_pt", F.lit(500.0)).withColumn("invalid_size", F.lit(False))
    v = visible_runs(layout.runs(docs), crop)
    return v.groupBy("doc_id", "page_index").agg(F.count(F.lit(1)).alias("n_runs"), F.sum(F.length("text")).alias("n_chars"))


@query("p01_is_visible", f"WITH {RUNS} SELECT doc_id, page_index, {VISIBLE} AS visible, count(*) AS n FROM runs GROUP BY ALL")
def is_visible(spark, sf_dir):
    r = layout.runs(load_spread(spark, sf_dir, "documents", "doc_id"))
    v = G.is_visible(*[F.col(c) for c in ("x", "y", "w", "h")], *[F.lit(k) for k in (150.0, 200.0, 300.0, 500.0)])
    return r.groupBy("doc_id", "page_index", v.alias("visible")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "s11_saved_asset_store",
    """WITH a AS (SELECT c_custkey AS pos, c_nationkey AS owner, CASE WHEN c_custkey % 9 = 0 THEN '' ELSE 'a' || (c_custkey % 200) END AS id, c_name || ' ' || c_name || ' ' || c_name AS name,
 CASE WHEN c_custkey % 5 = 0 THEN 'data:image/jpeg;base64,AAAA' ELSE 'data:image/png;base64,' || replace(c_name, '#', '+') || '==' END AS data_url, c_acctbal AS width, c_acctbal / 2 AS height FROM customer),
v AS (SELECT * FROM a WHERE id <> '' AND regexp_full_match(data_url, 'data:image/png;base64,[A-Za-z0-9+/]+={0,2}') AND width > 0 AND height > 0),
d AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY owner, id ORDER BY pos) = 1)
SELECT owner, id, name, pos FROM d""",
)
def saved_asset_store(spark, sf_dir):
    k = F.col("c_custkey")
    name = F.concat_ws(" ", "c_name", "c_name", "c_name")
    a = load(spark, sf_dir, "customer").select(
        k.alias("pos"), F.col("c_nationkey").alias("owner"), F.when(k % 9 == 0, "").otherwise(F.concat(F.lit("a"), k % 200)).alias("id"), name.alias("name"),
        F.when(k % 5 == 0, "data:image/jpeg;base64,AAAA").otherwise(F.concat(F.lit("data:image/png;base64,"), F.replace("c_name", F.lit("#"), F.lit("+")), F.lit("=="))).alias("data_url"),
        F.col("c_acctbal").alias("width"), (F.col("c_acctbal") / 2).alias("height"),
    )
    return saved_assets(a).select("owner", "id", "name", "pos")


# --- geometry -------------------------------------------------------------------------------------------------------


ORDER_POINTS = """pt AS (SELECT o_orderkey, o_totalprice % 595 AS x, (o_custkey % 842)::DOUBLE AS y, CAST((o_orderkey % 4) * 90 AS INTEGER) AS rot, 595.0::DOUBLE AS w, 842.0::DOUBLE AS h, 10.0::DOUBLE AS ox, 20.0::DOUBLE AS oy FROM orders)"""


def order_points(spark, sf_dir):
    return load(spark, sf_dir, "orders").select(
        "o_orderkey", (F.col("o_totalprice") % 595).alias("x"), (F.col("o_custkey") % 842).cast("double").alias("y"),
        ((F.col("o_orderkey") % 4) * 90).cast("int").alias("rot"), F.lit(595.0).alias("w"), F.lit(842.0).alias("h"), F.lit(10.0).alias("ox"), F.lit(20.0).alias("oy"),
    )


def _page():
    return [F.col(c) for c in ("ox", "oy", "w", "h", "rot")]


VX = "CASE rot WHEN 0 THEN {x} - ox WHEN 90 THEN {y} - oy WHEN 180 THEN w - ({x} - ox) ELSE h - ({y} - oy) END"
VY = "CASE rot WHEN 0 THEN h - ({y} - oy) WHEN 90 THEN {x} - ox WHEN 180 THEN {y} - oy ELSE w - ({x} - ox) END"


@query("p02_pt_to_visual", f"WITH {ORDER_POINTS} SELECT o_orderkey, round({VX.format(x='x', y='y')}, 4) AS vx, round({VY.format(x='x', y='y')}, 4) AS vy FROM pt")
def pt_to_visual(spark, sf_dir):
    v = G.pt_to_visual(F.col("x"), F.col("y"), *_page())
    return order_points(spark, sf_dir).select("o_orderkey", r4(v["x"]).alias("vx"), r4(v["y"]).alias("vy"))


@query("p02_visual_to_pt", f"WITH {ORDER_POINTS} SELECT o_orderkey, round(x, 4) AS px, round(y, 4) AS py FROM pt")
def visual_to_pt(spark, sf_dir):
    """There and back again."""
    df = order_points(spark, sf_dir).withColumn("v", G.pt_to_visual(F.col("x"), F.col("y"), *_page()))
    b = G.visual_to_pt(F.col("v.x"), F.col("v.y"), *_page())
    return df.select("o_orderkey", r4(b["x"]).alias("px"), r4(b["y"]).alias("py"))


@query(
    "p02_rect_to_visual",
    f"""WITH {ORDER_POINTS}, q AS (SELECT o_orderkey, {VX.format(x='x', y='y')} AS ax, {VY.format(x='x', y='y')} AS ay, {VX.format(x='(x + 40)', y='(y + 12)')} AS bx, {VY.format(x='(x + 40)', y='(y + 12)')} AS bye FROM pt)
SELECT o_orderkey, round(least(ax, bx), 4) AS "left", round(least(ay, bye), 4) AS top, round(abs(bx - ax), 4) AS width, round(abs(bye - ay), 4) AS height FROM q""",
)
def rect_to_visual(spark, sf_dir):
    df = order_points(spark, sf_dir).withColumn("r", G.rect_to_visual(F.col("x"), F.col("y"), F.lit(40.0), F.lit(12.0), *_page()))
    return df.select("o_orderkey", *[r4(F.col(f"r.{c}")).alias(c) for c in ("left", "top", "width", "height")])


@query(
    "p23_bounded_scale",
    """WITH p AS (SELECT o_orderkey, o_totalprice % 15000 AS w, (o_custkey * 10)::DOUBLE AS h, (o_orderkey % 7)::DOUBLE AS s0 FROM orders),
q AS (SELECT *, CASE WHEN s0 > 0 THEN s0 ELSE 1.0 END::DOUBLE AS s FROM p),
r AS (SELECT *, CASE WHEN w > 0 AND h > 0 THEN least(CASE WHEN w * s * h * s > 8000000 THEN sqrt(8000000.0::DOUBLE / (w * s * h * s)) * 0.999::DOUBLE ELSE 1.0 END, CASE WHEN greatest(w, h) * s > 16384 THEN 16384.0::DOUBLE / (greatest(w, h) * s) * 0.999::DOUBLE ELSE 1.0 END) ELSE 1.0 END AS f FROM q)
SELECT o_orderkey, round(s * f, 6) AS scale, f < 1 AS reduced, round(CASE WHEN w <= 0 THEN 0.25 ELSE least(4.0, greatest(0.25, floor(1000 / w * 1000) / 1000)) END, 4) AS fit,
 round(greatest(1.0, CASE WHEN greatest(1.0, w * h) * least(s, 2.5) * least(s, 2.5) > 8000000 THEN sqrt(8000000 / greatest(1.0, w * h)) ELSE least(s, 2.5) END), 6) AS sharp FROM r""",
)
def bounded_scale(spark, sf_dir):
    df = load(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") % 15000).alias("w"), (F.col("o_custkey") * 10).cast("double").alias("h"), (F.col("o_orderkey") % 7).cast("double").alias("s"))
    b = G.bounded_scale(F.col("w"), F.col("h"), F.col("s"))
    return df.select("o_orderkey", F.round(b["scale"], 6).alias("scale"), b["reduced"].alias("reduced"), r4(G.fit_width(F.lit(1000.0), F.col("w"))).alias("fit"), F.round(G.sharpness(F.col("s"), F.col("w"), F.col("h")), 6).alias("sharp"))


@query(
    "p28_normalize_rect",
    """WITH c AS (SELECT l_orderkey, l_linenumber, l_quantity AS x0, l_tax * 1000 AS y0, l_discount * 300 AS x1, l_quantity + l_linenumber AS y1 FROM lineitem)
SELECT l_orderkey, count(*) AS n, round(sum(least(x0, x1)), 3) AS x, round(sum(least(y0, y1)), 3) AS y, round(sum(abs(x1 - x0)), 3) AS w, round(sum(abs(y1 - y0)), 3) AS h FROM c GROUP BY l_orderkey""",
)
def normalize_rect(spark, sf_dir):
    r = G.normalize_rect(F.col("l_quantity"), F.col("l_tax") * 1000, F.col("l_discount") * 300, F.col("l_quantity") + F.col("l_linenumber"))
    df = load(spark, sf_dir, "lineitem").select("l_orderkey", r.alias("r"))
    return df.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.sum(f"r.{k}"), 3).alias(k) for k in "xywh"])


PLACED = """SELECT o_orderkey, vx, vy, CASE WHEN rot IN (90, 270) THEN vh ELSE vw END AS w, CASE WHEN rot IN (90, 270) THEN vw ELSE vh END AS h, vh, rot, ox, oy FROM {src}"""
BACK = """round(CASE rot WHEN 0 THEN ox + vx WHEN 90 THEN ox + (vh - vy) WHEN 180 THEN ox + w - vx ELSE ox + w - (vh - vy) END, 4) AS x,
 round(CASE rot WHEN 0 THEN oy + h - (vh - vy) WHEN 90 THEN oy + vx WHEN 180 THEN oy + (vh - vy) ELSE oy + h - vx END, 4) AS y"""


@query(
    "p29_place_box",
    f"""WITH {ORDER_POINTS}, b AS (SELECT *, CASE WHEN rot IN (90, 270) THEN h ELSE w END AS vw, CASE WHEN rot IN (90, 270) THEN w ELSE h END AS vh, o_orderkey % 3 AS al, o_orderkey % 2 AS zo FROM pt),
c AS (SELECT o_orderkey, vw, vh, rot, ox, oy, CASE al WHEN 0 THEN 36.0 WHEN 1 THEN vw - 36 - floor(x) / 4 ELSE (vw - floor(x) / 4) / 2 END AS vx, CASE zo WHEN 0 THEN vh - 28 - 0.72::DOUBLE * 9 ELSE 28 + 0.2::DOUBLE * 9 END AS vy FROM b),
d AS ({PLACED.format(src='c')}) SELECT o_orderkey, {BACK}, rot::DOUBLE AS angle FROM d""",
)
def place_box(spark, sf_dir):
    swap = F.col("rot").isin(90, 270)
    df = order_points(spark, sf_dir).withColumn("vw", F.when(swap, F.col("h")).otherwise(F.col("w"))).withColumn("vh", F.when(swap, F.col("w")).otherwise(F.col("h")))
    al = F.col("o_orderkey") % 3
    p = G.place_box(F.col("vw"), F.col("vh"), F.col("rot"), F.col("ox"), F.col("oy"), F.when(F.col("o_orderkey") % 2 == 0, "top").otherwise("bottom"),
                    F.when(al == 0, "left").when(al == 1, "right").otherwise("center"), F.floor("x") / 4, F.lit(9.0), F.lit(36.0), F.lit(28.0))
    return df.withColumn("p", p).select("o_orderkey", r4(F.col("p.x")).alias("x"), r4(F.col("p.y")).alias("y"), F.col("p.angle").alias("angle"))


@query(
    "p29_place_watermark",
    f"""WITH {ORDER_POINTS}, b AS (SELECT *, CASE WHEN rot IN (90, 270) THEN h ELSE w END AS vw, CASE WHEN rot IN (90, 270) THEN w ELSE h END AS vh, radians(45.0) AS t, -x / 2 AS lx, -(48 * 0.72::DOUBLE) / 2 AS ly FROM pt),
c AS (SELECT o_orderkey, vw, vh, rot, ox, oy, vw / 2 + lx * cos(t) - ly * sin(t) AS vx, vh / 2 + lx * sin(t) + ly * cos(t) AS vy FROM b),
d AS ({PLACED.format(src='c')}) SELECT o_orderkey, {BACK}, 45.0::DOUBLE + rot AS angle FROM d""",
)
def place_watermark(spark, sf_dir):
    swap = F.col("rot").isin(90, 270)
    df = order_points(spark, sf_dir).withColumn("vw", F.when(swap, F.col("h")).otherwise(F.col("w"))).withColumn("vh", F.when(swap, F.col("w")).otherwise(F.col("h")))
    p = G.place_watermark(F.col("vw"), F.col("vh"), F.col("rot"), F.col("ox"), F.col("oy"), F.col("x"), F.lit(48.0), F.lit(45.0))
    return df.withColumn("p", p).select("o_orderkey", r4(F.col("p.x")).alias("x"), r4(F.col("p.y")).alias("y"), F.col("p.angle").alias("angle"))


@query("p30_text_width", f"WITH {LINES} SELECT doc_id, round(sum(length(text)::DOUBLE * 0.6 * size_pt), 2) AS width FROM lines GROUP BY doc_id")
def text_width(spark, sf_dir):
    ls = layout.doc_lines(load_spread(spark, sf_dir, "documents", "doc_id"))
    return ls.groupBy("doc_id").agg(F.round(F.sum(G.fixed_text_width(F.array_join("words", " "), F.col("size_pt"))), 2).alias("width"))


# --- fonts and links ------------------------------------------------------------------------------------------------


FONT_SQL = """f AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'ABCDEF+' ELSE '' END || CASE p_partkey % 7 WHEN 0 THEN 'TimesNewRoman' WHEN 1 THEN 'CourierNew' WHEN 2 THEN 'Georgia' WHEN 3 THEN 'Consolas' WHEN 4 THEN 'Arial' WHEN 5 THEN p_name ELSE p_type END
 || CASE p_size % 4 WHEN 0 THEN '-Bold' WHEN 1 THEN ',Italic' WHEN 2 THEN '-BoldOblique' ELSE '' END AS font FROM part),
g AS (SELECT p_partkey, regexp_replace(font, '^[A-Z]{6}\\+', '') AS bare FROM f),
h AS (SELECT *, CASE WHEN regexp_matches(bare, '(?i)times|serif|georgia|garamond|cambria|minion') THEN 'serif' WHEN regexp_matches(bare, '(?i)courier|mono|consolas|menlo|consola') THEN 'monospace' ELSE 'sans-serif' END AS family,
 regexp_matches(bare, '(?i)bold') AS bold, regexp_matches(bare, '(?i)italic|oblique') AS italic FROM g)"""


@query(
    "p04_classify_font",
    f"""WITH {FONT_SQL} SELECT p_partkey, bare, family, bold, italic, CASE family WHEN 'serif' THEN CASE WHEN bold AND italic THEN 'Times-BoldItalic' WHEN bold THEN 'Times-Bold' WHEN italic THEN 'Times-Italic' ELSE 'Times-Roman' END
WHEN 'monospace' THEN CASE WHEN bold AND italic THEN 'Courier-BoldOblique' WHEN bold THEN 'Courier-Bold' WHEN italic THEN 'Courier-Oblique' ELSE 'Courier' END
ELSE CASE WHEN bold AND italic THEN 'Helvetica-BoldOblique' WHEN bold THEN 'Helvetica-Bold' WHEN italic THEN 'Helvetica-Oblique' ELSE 'Helvetica' END END AS standard FROM h""",
)
def classify_font(spark, sf_dir):
    k, s = F.col("p_partkey") % 7, F.col("p_size") % 4
    stem = F.when(k == 0, "TimesNewRoman").when(k == 1, "CourierNew").when(k == 2, "Georgia").when(k == 3, "Consolas").when(k == 4, "Arial").when(k == 5, F.col("p_name")).otherwise(F.col("p_type"))
    font = F.concat(F.when(F.col("p_partkey") % 3 == 0, "ABCDEF+").otherwise(""), stem, F.when(s == 0, "-Bold").when(s == 1, ",Italic").when(s == 2, "-BoldOblique").otherwise(""))
    df = load(spark, sf_dir, "part").select("p_partkey", font.alias("font"))
    c = fonts.classify_font(F.col("font"))
    return df.select("p_partkey", fonts.strip_subset(F.col("font")).alias("bare"), *[c[n].alias(n) for n in ("family", "bold", "italic")], fonts.standard_font(F.col("font")).alias("standard"))


URLS = """u AS (SELECT page_id, -1 AS pos, CASE page_id % 9 WHEN 0 THEN url WHEN 1 THEN replace(url, 'http://', 'HTTPS://') WHEN 2 THEN replace(url, 'http://', 'http://user:pw@') WHEN 3 THEN 'mailto:a.b@' || split_part(replace(replace(url, 'https://', ''), 'http://', ''), '/', 1)
 WHEN 4 THEN 'javascript:alert(' || page_id || ')' WHEN 5 THEN 'file:///etc/' || page_id WHEN 6 THEN url || chr(8238) WHEN 7 THEN 'mailto:nobody' ELSE url END AS url FROM pages
 UNION ALL SELECT page_id, unnest(range(len(h))) AS pos, unnest(h) AS url FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS h FROM pages))"""


def url_table(spark, sf_dir):
    p = load_spread(spark, sf_dir, "pages", "page_id")
    k, url = F.col("page_id") % 9, F.col("url")
    host = F.split_part(F.replace(F.replace(url, F.lit("https://"), F.lit("")), F.lit("http://"), F.lit("")), F.lit("/"), F.lit(1))
    made = (
        F.when(k == 1, F.replace(url, F.lit("http://"), F.lit("HTTPS://"))).when(k == 2, F.replace(url, F.lit("http://"), F.lit("http://user:pw@"))).when(k == 3, F.concat(F.lit("mailto:a.b@"), host))
        .when(k == 4, F.concat(F.lit("javascript:alert("), F.col("page_id"), F.lit(")"))).when(k == 5, F.concat(F.lit("file:///etc/"), F.col("page_id")))
        .when(k == 6, F.concat(url, F.lit("‮"))).when(k == 7, "mailto:nobody").otherwise(url)
    )
    return p.select("page_id", F.lit(-1).alias("pos"), made.alias("url")).unionByName(layout.hrefs(p).withColumnRenamed("href", "url"))


ALLOWED_SQL = "(regexp_matches(url, '(?i)^(https?|mailto):') AND (NOT regexp_matches(url, '(?i)^https?:') OR regexp_matches(url, '(?i)^https?://[^/?#]+')))"


@query("p05_is_allowed_url", f"WITH {URLS} SELECT page_id, {ALLOWED_SQL} AS allowed, count(*) AS n FROM u GROUP BY ALL")
def is_allowed_url(spark, sf_dir):
    return url_table(spark, sf_dir).groupBy("page_id", K.is_allowed_url(F.col("url")).alias("allowed")).agg(F.count(F.lit(1)).alias("n"))


# The given web addresses need no more than this: lower case up to the path, a path, and one character escaped.
PLACE = "lower(regexp_extract(url, '(?i)^https?://[^/?#]*', 0))"
CANON = f"({PLACE} || CASE WHEN substr(url, length({PLACE}) + 1, 1) = '/' THEN '' ELSE '/' END || replace(substr(url, length({PLACE}) + 1), chr(8238), '%E2%80%AE'))"


@query("p06_canonical_url", f"WITH {URLS} SELECT page_id, pos, CASE WHEN regexp_matches(url, '(?i)^mailto:') THEN url WHEN {ALLOWED_SQL} THEN {CANON} END AS url FROM u")
def canonical_url(spark, sf_dir):
    return url_table(spark, sf_dir).select("page_id", F.col("pos").cast("long").alias("pos"), A.canonical_url(F.col("url")).alias("url"))


@query(
    "p06_link_decision",
    f"""WITH {URLS}, skip AS (SELECT DISTINCT lower(regexp_extract(url, '(?i)^https?://([^/?#]+)', 1)) AS dom FROM pages WHERE page_id % 10 = 8),
b AS (SELECT page_id, pos, url, {ALLOWED_SQL} AS ok, regexp_matches(url, '(?i)^mailto:') AS mail, regexp_extract(url, '(?i)^https?://([^/?#]+)', 1) AS auth, regexp_extract(url, '(?i)^mailto:[^@]*@(.*)$', 1) AS md, contains(url, chr(8238)) AS hid FROM u),
c AS (SELECT *, CASE WHEN NOT ok THEN 'scheme' WHEN NOT mail AND contains(auth, '@') THEN 'credentials' WHEN mail AND md = '' THEN 'address' END AS reason FROM b),
d AS (SELECT *, CASE WHEN reason IS NOT NULL THEN '' WHEN mail THEN lower(md) ELSE lower(regexp_replace(auth, ':[0-9]*$', '')) END AS domain FROM c)
SELECT page_id, pos, CASE WHEN reason IS NOT NULL THEN 'blocked' WHEN skip.dom IS NOT NULL AND NOT hid THEN 'open' ELSE 'confirm' END AS action, reason, domain, CASE WHEN reason IS NULL AND NOT mail THEN {CANON} ELSE replace(url, chr(8238), '\\u202E') END AS shown, hid AS hidden
FROM d LEFT JOIN skip ON d.domain = skip.dom AND d.domain <> ''""",
)
def link_decision(spark, sf_dir):
    """The domains of every tenth page are trusted; a link to one of them opens without a question."""
    u = url_table(spark, sf_dir)
    p = load(spark, sf_dir, "pages")
    skip = p.filter("page_id % 10 = 8").select(K.url_host(F.col("url")).alias("skip_dom")).distinct()
    u = u.withColumn("domain", K.link_domain(F.col("url")))
    j = u.join(skip, (u.domain == skip.skip_dom) & (u.domain != ""), "left")
    d = K.link_decision(F.col("url"), F.col("skip_dom").isNotNull())
    return j.select("page_id", F.col("pos").cast("long").alias("pos"), d.alias("d")).select("page_id", "pos", "d.action", "d.reason", "d.domain", "d.shown", "d.hidden")


@query(
    "p07_link_dest_kind",
    f"""WITH {URLS}, a AS (SELECT *, CASE WHEN pos % 4 = 1 THEN 'goto' WHEN pos % 4 = 2 THEN 'launch' ELSE 'uri' END AS act, pos - 3 AS target FROM u)
SELECT page_id, CASE WHEN act = 'goto' AND target >= 0 THEN 'page' WHEN act = 'uri' AND {ALLOWED_SQL} THEN 'uri' WHEN act = 'uri' THEN 'blocked' ELSE 'other' END AS kind, count(*) AS n FROM a GROUP BY ALL""",
)
def link_dest_kind(spark, sf_dir):
    k = F.col("pos") % 4
    act = F.when(k == 1, "goto").when(k == 2, "launch").otherwise("uri")
    u = url_table(spark, sf_dir).withColumn("kind", K.link_dest_kind(act, F.col("url"), F.col("pos") - 3))
    return u.groupBy("page_id", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("p08_escape_hidden_chars", r"""SELECT event_id, replace(replace(props, ':', '\u0001'), ',', '‏') || event_type AS shown FROM events""")
def escape_hidden_chars(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    return e.select("event_id", K.escape_hidden_chars(F.concat(F.translate("props", ":,", "\u0001‏"), F.col("event_type"))).alias("shown"))


# --- text -----------------------------------------------------------------------------------------------------------

HEBREW = "אבגדה"


@query(
    "p09_text_class",
    f"""WITH {WORDS}, h AS (SELECT doc_id, i % 3 AS k, CASE WHEN i % 3 = 0 THEN translate(text, 'abcde', 'אבגדה') WHEN i % 3 = 1 THEN CAST(i AS VARCHAR) ELSE text END AS text FROM words)
SELECT doc_id, regexp_matches(text, '[אבגדה]') AS has_rtl, CASE WHEN regexp_matches(text, '^[0-9]+$') THEN 'EN' WHEN regexp_extract(text, '[A-Za-zÀ-ÖØ-öø-ÿאבגדה]', 0) = '' THEN CASE WHEN regexp_matches(text, '[0-9]') THEN 'EN' ELSE 'WS' END
 WHEN regexp_matches(regexp_extract(text, '[A-Za-zÀ-ÖØ-öø-ÿאבגדה]', 0), '[אבגדה]') THEN 'R' ELSE 'L' END AS class, count(*) AS n FROM h GROUP BY ALL""",
)
def text_class(spark, sf_dir):
    """Words with some letters written in Hebrew, plain numbers, and plain words."""
    d = load_spread(spark, sf_dir, "documents", "doc_id")
    w = d.select("doc_id", F.posexplode(layout.words_of(F.col("text"))).alias("i", "text"))
    t = F.when(F.col("i") % 3 == 0, F.translate("text", "abcde", HEBREW)).when(F.col("i") % 3 == 1, F.col("i").cast("string")).otherwise(F.col("text"))
    w = w.select("doc_id", t.alias("t"))
    return w.groupBy("doc_id", bidi.has_rtl(F.col("t")).alias("has_rtl"), bidi.text_class(F.col("t")).alias("class")).agg(F.count(F.lit(1)).alias("n"))


CHARS_SQL = "chars AS (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM documents)"


@query("p10_is_word_char", f"WITH {CHARS_SQL} SELECT ch, regexp_full_match(ch, '[\\pL\\pN_]') AS word, count(*) AS n FROM chars GROUP BY ch")
def is_word_char(spark, sf_dir):
    d = load_spread(spark, sf_dir, "documents", "doc_id")
    c = d.select(F.explode(F.filter(F.split("text", ""), lambda ch: ch != "")).alias("ch")).groupBy("ch").agg(F.count(F.lit(1)).alias("n"))
    return c.select("ch", X.is_word_char(F.col("ch")).alias("word"), "n")


def _sql_ranges(ranges) -> str:
    return "(" + " OR ".join(f"cp BETWEEN {lo} AND {hi}" for lo, hi in ranges) + ")"


REPERTOIRE_SQL = f"CASE WHEN {_sql_ranges(E.WINANSI)} THEN 'winansi' WHEN {_sql_ranges(E.SYMBOL)} THEN 'symbol' WHEN {_sql_ranges(E.DINGBATS)} THEN 'dingbats' ELSE 'none' END"


@query("p11_glyph_repertoire", f"WITH {CHARS_SQL}, c AS (SELECT ord(ch) + 768 AS cp, count(*) AS n FROM chars GROUP BY ch) SELECT CAST(cp AS INTEGER) AS cp, {REPERTOIRE_SQL} AS repertoire, n FROM c")
def glyph_repertoire(spark, sf_dir):
    """Every character of the corpus, moved up into the Greek and symbol blocks."""
    d = load_spread(spark, sf_dir, "documents", "doc_id")
    c = d.select(F.explode(F.filter(F.split("text", ""), lambda ch: ch != "")).alias("ch")).groupBy((F.ascii("ch") + 768).alias("cp")).agg(F.count(F.lit(1)).alias("n"))
    return c.select("cp", E.glyph_repertoire(F.col("cp")).alias("repertoire"), "n")


DIRTY = """m AS (SELECT doc_id, replace(replace(replace(replace(replace(text, 'the', chr(1)), 'en', 'e' || chr(769)), 'ea', chr(64257)), 'on', chr(8203) || chr(160)), 'er', chr(26085)) AS text FROM documents)"""


def dirty_text(spark, sf_dir):
    t = F.col("text")
    for a, b in (("the", "\u0001"), ("en", "é"), ("ea", "ﬁ"), ("on", "​ "), ("er", "日")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return load_spread(spark, sf_dir, "documents", "doc_id").select("doc_id", t.alias("text"))


@query(
    "p12_sanitize_text",
    f"""WITH {DIRTY} SELECT doc_id, md5(replace(replace(replace(replace(replace(replace(nfc_normalize(text), chr(160), ' '), chr(8203), ''), chr(1), ''), chr(64257), 'fi'), chr(13), ''), chr(26085), '?')) AS digest FROM m""",
)
def sanitize_text(spark, sf_dir):
    return dirty_text(spark, sf_dir).select("doc_id", F.md5(E.sanitize_text(F.col("text"))).alias("digest"))


@query(
    "p13_split_by_repertoire",
    f"""WITH {LINES}, t AS (SELECT doc_id, line, translate(text, 'aeo', 'αβ✔') AS text FROM lines),
p AS (SELECT doc_id, unnest(regexp_extract_all(text, '[αβ]+(?: +[αβ]+)*|✔+(?: +✔+)*|[^αβ✔]+')) AS part FROM t)
SELECT doc_id, CASE WHEN regexp_matches(part, '^[αβ]') THEN 'symbol' WHEN regexp_matches(part, '^✔') THEN 'dingbats' ELSE 'winansi' END AS repertoire, count(*) AS n, CAST(sum(length(part)) AS BIGINT) AS chars FROM p GROUP BY ALL""",
)
def split_by_repertoire(spark, sf_dir):
    ls = layout.doc_lines(load_spread(spark, sf_dir, "documents", "doc_id"))
    t = ls.select("doc_id", F.explode(E.split_by_repertoire(F.translate(F.array_join("words", " "), "aeo", "αβ✔"))).alias("p"))
    return t.groupBy("doc_id", "p.repertoire").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("p.text")).alias("chars"))


@query(
    "a05_char_issue_report",
    f"""WITH {DIRTY}, n AS (SELECT doc_id, nfc_normalize(text) AS text FROM m), c AS (SELECT doc_id, unnest(string_split(text, '')) AS ch, unnest(range(len(string_split(text, '')))) AS pos FROM n),
k AS (SELECT doc_id, ord(ch) AS cp, count(*) AS n, min(pos) AS first_pos FROM c GROUP BY doc_id, ch),
i AS (SELECT *, CASE WHEN (cp < 32 AND cp NOT IN (9, 10, 13)) OR cp BETWEEN 127 AND 159 THEN 'control' WHEN {REPERTOIRE_SQL} = 'none' AND cp NOT IN (9, 10, 13, 32, 160, 173, 8203) AND cp NOT BETWEEN 64256 AND 64260 THEN 'missing' END AS kind FROM k),
r AS (SELECT *, row_number() OVER w AS rk, count(*) OVER (PARTITION BY doc_id, kind) AS kinds FROM i WHERE kind IS NOT NULL WINDOW w AS (PARTITION BY doc_id, kind ORDER BY first_pos))
SELECT doc_id, kind, CAST(cp AS INTEGER) AS cp, n, kinds, CAST(rk AS INTEGER) AS rk FROM r""",
)
def char_issue_report(spark, sf_dir):
    from quireframe.operators.reports import char_issue_report as report

    return report(dirty_text(spark, sf_dir), "doc_id", "text")


@query("p14_format_bytes", """WITH b AS (SELECT l_orderkey, l_linenumber, CAST(floor(l_extendedprice) AS BIGINT) * CASE l_linenumber % 3 WHEN 0 THEN 1 WHEN 1 THEN 64 ELSE 4096 END // 128 AS n FROM lineitem)
SELECT l_orderkey, CAST(sum(n) AS BIGINT) AS n, CASE WHEN sum(n) < 1024 THEN CAST(CAST(sum(n) AS BIGINT) AS VARCHAR) || ' B' WHEN sum(n) / 1024.0::DOUBLE < 1024 THEN printf('%.1f', floor(sum(n) / 1024.0::DOUBLE * 10 + 0.5) / 10) || ' KB' ELSE printf('%.2f', floor(sum(n) / 1024.0::DOUBLE / 1024.0::DOUBLE * 100 + 0.5) / 100) || ' MB' END AS shown FROM b GROUP BY l_orderkey""")
def format_bytes(spark, sf_dir):
    n = F.expr("cast(floor(l_extendedprice) as bigint) * case l_linenumber % 3 when 0 then 1 when 1 then 64 else 4096 end div 128")
    g = load(spark, sf_dir, "lineitem").select("l_orderkey", n.alias("n")).groupBy("l_orderkey").agg(F.sum("n").alias("n"))
    return g.select("l_orderkey", "n", X.format_bytes(F.col("n")).alias("shown"))


@query(
    "p15_hex_to_rgb",
    """WITH h AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'red' ELSE '#' || left(md5(CAST(o_orderkey AS VARCHAR)), 6) END AS hex FROM orders)
SELECT o_orderkey, CASE WHEN hex = 'red' THEN 0 ELSE CAST('0x' || substr(hex, 2, 2) AS INTEGER) END AS r, CASE WHEN hex = 'red' THEN 0 ELSE CAST('0x' || substr(hex, 4, 2) AS INTEGER) END AS g, CASE WHEN hex = 'red' THEN 0 ELSE CAST('0x' || substr(hex, 6, 2) AS INTEGER) END AS b FROM h""",
)
def hex_to_rgb(spark, sf_dir):
    k = F.col("o_orderkey")
    df = load(spark, sf_dir, "orders").select("o_orderkey", X.hex_to_rgb(F.when(k % 5 == 0, "red").otherwise(F.concat(F.lit("#"), F.left(F.md5(k.cast("string").cast("binary")), F.lit(6))))).alias("c"))
    return df.select("o_orderkey", "c.r", "c.g", "c.b")


@query(
    "p16_expand_macros",
    """SELECT o_orderkey, 'Page ' || o_orderkey || ' of ' || o_custkey || ', ' || strftime(o_orderdate, '%d/%m/%Y') || ' ' || o_orderkey || ' <<x>> ' || o_orderpriority AS text FROM orders""",
)
def expand_macros(spark, sf_dir):
    t = F.concat(F.lit("Page <<n>> of << Total >>, <<FECHA>> <<N >> <<x>> "), F.col("o_orderpriority"))
    return load(spark, sf_dir, "orders").select("o_orderkey", X.expand_macros(t, F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderdate")).alias("text"))


def _roman_sql() -> str:
    rest, parts = "n", []
    for v, m in X.ROMAN:
        parts.append(f"repeat('{m}', CAST(({rest}) // {v} AS INTEGER))")
        rest = f"({rest}) % {v}"
    return " || ".join(parts)


@query(
    "p17_format_number",
    f"""WITH k AS (SELECT o_orderkey, o_orderkey % 40000 AS n, CASE o_custkey % 9 WHEN 0 THEN 'decimal' WHEN 1 THEN 'decimalZero' WHEN 2 THEN 'lowerLetter' WHEN 3 THEN 'upperLetter' WHEN 4 THEN 'lowerRoman' WHEN 5 THEN 'upperRoman' WHEN 6 THEN 'bullet' WHEN 7 THEN 'none' ELSE 'chicago' END AS f FROM orders),
v AS (SELECT *, CASE WHEN n < 1 THEN '' WHEN n > 32767 THEN CAST(n AS VARCHAR) ELSE {_roman_sql()} END AS ro, CASE WHEN n < 1 THEN '' ELSE repeat(chr(CAST(97 + (n - 1) % 26 AS INTEGER)), CAST((n - 1) // 26 + 1 AS INTEGER)) END AS le FROM k)
SELECT o_orderkey, CASE f WHEN 'decimal' THEN CAST(n AS VARCHAR) WHEN 'decimalZero' THEN CASE WHEN n < 10 THEN '0' ELSE '' END || n WHEN 'lowerLetter' THEN le WHEN 'upperLetter' THEN upper(le) WHEN 'lowerRoman' THEN lower(ro) WHEN 'upperRoman' THEN ro WHEN 'bullet' THEN '•' WHEN 'none' THEN '' END AS label FROM v""",
)
def format_number(spark, sf_dir):
    k = F.col("o_custkey") % 9
    names = ["decimal", "decimalZero", "lowerLetter", "upperLetter", "lowerRoman", "upperRoman", "bullet", "none"]
    f = F.when(k == 0, names[0])
    for i, n in enumerate(names[1:], 1):
        f = f.when(k == i, n)
    return load(spark, sf_dir, "orders").select("o_orderkey", X.format_number(F.col("o_orderkey") % 40000, f.otherwise("chicago")).alias("label"))


@query("p18_apply_level_template", """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN o_custkey || '.' || o_orderpriority || ')' WHEN 1 THEN 'x' || o_orderpriority || '-' || '%0' ELSE '(' || o_custkey || ')%' END AS label FROM orders""")
def apply_level_template(spark, sf_dir):
    k = F.col("o_orderkey") % 3
    t = F.when(k == 0, "%1.%2)").when(k == 1, "x%2-%3%0").otherwise("(%1)%")
    return load(spark, sf_dir, "orders").select("o_orderkey", X.apply_level_template(t, F.array(F.col("o_custkey").cast("string"), "o_orderpriority")).alias("label"))


@query("p19_slug", f"WITH {LINES} SELECT doc_id, line, replace(regexp_replace(lower(text), '[^\\pL\\pN\\pM _-]', '', 'g'), ' ', '-') AS slug FROM lines")
def slug(spark, sf_dir):
    ls = layout.doc_lines(load_spread(spark, sf_dir, "documents", "doc_id"))
    return ls.select("doc_id", "line", X.slug(F.array_join("words", " ")).alias("slug"))


@query("p20_escape_markdown", r"SELECT doc_id, md5(regexp_replace(text, '([\\`*_\[\]<>])', '\\\1', 'g')) AS digest FROM documents")
def escape_markdown(spark, sf_dir):
    return load_spread(spark, sf_dir, "documents", "doc_id").select("doc_id", F.md5(X.escape_markdown(F.col("text"))).alias("digest"))


@query("p21_normalize_note", "SELECT conv_id, turn, text AS note FROM (SELECT conv_id, turn, trim(text, ' ' || chr(10) || chr(9)) AS text FROM conversations)")
def normalize_note(spark, sf_dir):
    c = load_spread(spark, sf_dir, "conversations", "conv_id")
    messy = F.concat(F.lit("\r\n  "), F.replace("text", F.lit("\n"), F.lit("\r\n")), F.lit(" \r"))
    return c.select("conv_id", "turn", X.normalize_note(messy).alias("note"))


@query("p22_excerpt", "SELECT doc_id, CASE WHEN length(text) > 140 THEN left(text, 140) || '…' ELSE text END AS excerpt FROM documents")
def excerpt(spark, sf_dir):
    return load_spread(spark, sf_dir, "documents", "doc_id").select("doc_id", X.excerpt(F.col("text")).alias("excerpt"))


@query(
    "p24_parse_page_range",
    """WITH s AS (SELECT o_orderkey, o_orderkey % 30 + 1 AS a, o_custkey % 30 + 1 AS b, 25 AS total FROM orders),
e AS (SELECT o_orderkey, 0 AS part, a AS p, 0 AS k, total FROM s UNION ALL SELECT o_orderkey, 1, unnest(range(least(a, b), greatest(a, b) + 1)), unnest(range(greatest(a, b) - least(a, b) + 1)), total FROM s UNION ALL SELECT o_orderkey, 2, 7, 0, total FROM s),
f AS (SELECT o_orderkey, p, min(part * 1000 + k) AS o FROM e WHERE p <= total GROUP BY o_orderkey, p)
SELECT o_orderkey, string_agg(CAST(p - 1 AS VARCHAR), ',' ORDER BY o) AS pages FROM f GROUP BY o_orderkey""",
)
def parse_page_range(spark, sf_dir):
    a, b = (F.col("o_orderkey") % 30 + 1).cast("string"), (F.col("o_custkey") % 30 + 1).cast("string")
    spec = F.concat(a, F.lit(", "), b, F.lit(" - "), a, F.lit(",x,, 7"))
    return load(spark, sf_dir, "orders").select("o_orderkey", F.array_join(X.parse_page_range(spec, F.lit(25)).cast("array<string>"), ",").alias("pages"))


@query(
    "p25_resolve_bullet",
    """WITH b AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN chr(61623) WHEN 1 THEN chr(61607) WHEN 2 THEN 'o' WHEN 3 THEN '-' WHEN 4 THEN '✓' ELSE chr(61692) END AS ch, CASE p_size % 3 WHEN 0 THEN 'Symbol' WHEN 1 THEN 'Wingdings' ELSE 'Courier New' END AS font FROM part),
u AS (SELECT *, CASE font WHEN 'Symbol' THEN CASE WHEN ch = chr(61623) THEN '•' END WHEN 'Wingdings' THEN CASE WHEN ch = chr(61607) THEN '▪' WHEN ch = chr(61692) THEN '✔' END ELSE CASE WHEN ch IN ('o', '✓') THEN ch END END AS uni FROM b)
SELECT p_partkey, CASE WHEN font = 'Courier New' AND ch = '-' THEN '-' WHEN uni = '▪' THEN '■' WHEN uni IS NULL THEN '•' ELSE uni END AS text, CASE WHEN font = 'Courier New' AND ch = '-' THEN 'Helvetica' WHEN uni IN ('✔', '✓', '▪') THEN 'ZapfDingbats' WHEN uni = 'o' THEN 'Courier' ELSE 'Helvetica' END AS font,
 CASE WHEN uni = '▪' THEN 0.6 ELSE 1.0 END::DOUBLE AS scale, NOT (font = 'Courier New' AND ch = '-') AND (uni IS NULL OR uni = '▪') AS approximate, coalesce(uni, ch) AS official FROM u""",
)
def resolve_bullet(spark, sf_dir):
    k, s = F.col("p_partkey") % 6, F.col("p_size") % 3
    ch = F.when(k == 0, "").when(k == 1, "").when(k == 2, "o").when(k == 3, "-").when(k == 4, "✓").otherwise("")
    font = F.when(s == 0, "Symbol").when(s == 1, "Wingdings").otherwise("Courier New")
    b = load(spark, sf_dir, "part").select("p_partkey", ch.alias("ch"), font.alias("f")).withColumn("b", E.resolve_bullet(F.col("ch"), F.col("f")))
    return b.select("p_partkey", "b.text", "b.font", "b.scale", "b.approximate", "b.official")


@query("p26_comment_filter", "SELECT conv_id, turn FROM conversations WHERE contains(lower(text || ' ' || role || ' note'), 'user note') OR contains(lower(text), 'the')")
def comment_filter(spark, sf_dir):
    c = load_spread(spark, sf_dir, "conversations", "conv_id")
    parts = [F.col("text"), F.col("role"), F.lit("note")]
    return c.filter(X.comment_matches(F.lit(" User NOTE"), *parts) | X.comment_matches(F.lit("The "), F.col("text"))).select("conv_id", "turn")


# --- table functions --------------------------------------------------------------------------------------------------

PAGES_ASKED = """WITH s AS (SELECT o_custkey, o_orderkey, o_orderkey % 30 + 1 AS a, o_custkey % 30 + 1 AS b FROM orders),
e AS (SELECT *, 0 AS part, a AS p, 0 AS k FROM s UNION ALL SELECT *, 1, unnest(range(least(a, b), greatest(a, b) + 1)), unnest(range(greatest(a, b) - least(a, b) + 1)) FROM s UNION ALL SELECT *, 2, 7, 0 FROM s)"""


def _jobs(spark, sf_dir):
    a, b = (F.col("o_orderkey") % 30 + 1).cast("string"), (F.col("o_custkey") % 30 + 1).cast("string")
    tables.register(spark)
    return load(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("doc_id"), F.concat(a, F.lit(", "), b, F.lit(" - "), a, F.lit(",x,, 7")).alias("spec"), F.lit(25).alias("total"))


@query("f05_page_range", f"{PAGES_ASKED} SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_orderkey ORDER BY min(part * 1000 + k)) - 1 AS INTEGER) AS nth, CAST(p - 1 AS INTEGER) AS page FROM e WHERE p <= 25 GROUP BY o_orderkey, p")
def page_range(spark, sf_dir):
    return spark.sql("SELECT o_orderkey, r.nth, r.page FROM {jobs} AS j, LATERAL page_range(j.spec, j.total) AS r", jobs=_jobs(spark, sf_dir))


@query(
    "f05_pages_asked",
    f"""{PAGES_ASKED}, f AS (SELECT o_custkey, p, min(struct_pack(o := o_orderkey, k := part * 1000 + k)) AS first_at FROM e WHERE p <= 25 GROUP BY o_custkey, p)
SELECT o_custkey AS doc_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY first_at) - 1 AS INTEGER) AS nth, CAST(p - 1 AS INTEGER) AS page FROM f""",
)
def pages_asked(spark, sf_dir):
    return spark.sql("SELECT * FROM pages_asked(TABLE(SELECT doc_id, o_orderkey, spec, total FROM {jobs}) PARTITION BY doc_id ORDER BY o_orderkey)", jobs=_jobs(spark, sf_dir))
