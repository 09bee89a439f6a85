"""Column functions against hand-computed values, and small helpers against brute force."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from quireframe.functions import bidi, encoding as E, fonts, geometry as G, links as K, textcols as X
from quireframe.operators import markdown as M
from quireframe.operators import search as Q
from quireframe.operators.pages import text_diff


def values(spark, rows, expr, schema="v string"):
    df = spark.createDataFrame([(i, *((r,) if not isinstance(r, tuple) else r)) for i, r in enumerate(rows)], f"i int, {schema}")
    return [r["o"] for r in df.select("i", expr.alias("o")).orderBy("i").collect()]


def test_page_ranges(spark):
    specs = ["1-3, 5, 8-10", "3-1", "5,1,5", "0,11,99999999999999999999", "a, 2", "", "2 - 4"]
    got = values(spark, specs, X.parse_page_range(F.col("v"), F.lit(10)))
    assert got == [[0, 1, 2, 4, 7, 8, 9], [0, 1, 2], [4, 0], [], [1], [], [1, 2, 3]]


def test_numbers(spark):
    cases = [(28, "lowerLetter"), (7, "decimalZero"), (1994, "upperRoman"), (4, "lowerRoman"), (40000, "upperRoman"), (0, "lowerLetter"), (3, "bullet"), (3, "other")]
    assert values(spark, cases, X.format_number(F.col("n"), F.col("f")), "n int, f string") == ["bb", "07", "MCMXCIV", "iv", "40000", "", "•", None]


def test_templates_macros_and_bytes(spark):
    assert values(spark, ["%1.%2.", "%3x", "100%"], X.apply_level_template(F.col("v"), F.array(F.lit("1"), F.lit("%1")))) == ["1.%1.", "x", "100%"]
    assert values(spark, ["<<N>>/<< total >> <<otro>>"], X.expand_macros(F.col("v"), F.lit(3), F.lit(9), F.lit("2026-01-05").cast("date"))) == ["3/9 <<otro>>"]
    assert values(spark, [(512,), (2048,), (3 * 1024 * 1024,)], X.format_bytes(F.col("n")), "n long") == ["512 B", "2.0 KB", "3.00 MB"]


def test_slug_and_notes(spark):
    assert values(spark, ["  Hola, Mundo! ", "Año_1-b", "¿?"], X.slug(F.col("v"))) == ["hola-mundo", "año_1-b", ""]
    assert values(spark, [" a\r\nb\r "], X.normalize_note(F.col("v"))) == ["a\nb"]


def test_fonts(spark):
    assert values(spark, ["ABCDEF+Times-BoldItalic", "Consolas", "Arial,Bold", "ABC+Times"], fonts.standard_font(F.col("v"))) == ["Times-BoldItalic", "Courier", "Helvetica-Bold", "Times-Roman"]


@pytest.mark.parametrize(
    "url, action, reason, domain",
    [
        ("https://Example.com/a", "confirm", None, "example.com"),
        ("javascript:alert(1)", "blocked", "scheme", ""),
        ("http://user:pw@evil.test/", "blocked", "credentials", ""),
        ("mailto:a@b.test", "confirm", None, "b.test"),
        ("mailto:nobody", "blocked", "address", ""),
        ("mailto:a@b.test,c@d.test", "confirm", None, "b.test, d.test"),
        ("http://ñandú.test/x", "confirm", None, "xn--and-6ma2c.test"),
        ("/relative", "blocked", "scheme", ""),
    ],
)
def test_link_decisions(spark, url, action, reason, domain):
    d = values(spark, [url], K.link_decision(F.col("v")))[0]
    assert (d["action"], d["reason"], d["domain"]) == (action, reason, domain)


def test_trusted_domain_opens_unless_hidden(spark):
    d = values(spark, ["http://a.test/", "http://a.test/‮"], K.link_decision(F.col("v"), F.lit(True)))
    assert [x["action"] for x in d] == ["open", "confirm"] and d[1]["shown"].endswith("%E2%80%AE")


@pytest.mark.parametrize(
    "raw, encoding, assumed, text",
    [
        (b"\xef\xbb\xbfhola", "utf-8", False, "hola"),
        ("ño".encode("utf-16"), "utf-16le", False, "ño"),
        ("hola".encode("utf-16-be"), "utf-16be", True, "hola"),
        ("ñandú".encode(), "utf-8", False, "ñandú"),
        (b"caf\xe9 \x80", "windows-1252", True, "café €"),
        ("ab".encode("utf-16-le") + b"\x01\xd8", "utf-16le", True, "ab�"),
        (b"", "utf-8", False, ""),
    ],
)
def test_decoding(spark, raw, encoding, assumed, text):
    r = E.with_decoded(spark.createDataFrame([(bytearray(raw),)], "content binary"), "content").first()
    assert (r["encoding"], r["assumed"], r["text"]) == (encoding, assumed, text)


def test_text_corpus_reads_files_by_extension(spark, tmp_path):
    from quireframe.sources.corpus import read_text_corpus

    (tmp_path / "a.txt").write_bytes("año".encode("cp1252"))
    (tmp_path / "b.MD").write_bytes("# uno".encode())
    (tmp_path / "c.pdf").write_bytes(b"%PDF")
    got = {r["path"].rsplit("/", 1)[1]: (r["text"], r["warning"]) for r in read_text_corpus(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": ("año", "assumed-windows-1252"), "b.MD": ("# uno", None)}


def test_sanitize_and_split(spark):
    assert values(spark, ["ﬁn é​\u0007 日"], E.sanitize_text(F.col("v"))) == ["fin é ?"]
    parts = values(spark, ["ab αβ γ ✔ x"], E.split_by_repertoire(F.col("v")))[0]
    assert [(p["repertoire"], p["text"]) for p in parts] == [("winansi", "ab "), ("symbol", "αβ γ"), ("winansi", " "), ("dingbats", "✔"), ("winansi", " x")]


def test_geometry_round_trip(spark):
    rows = [(float(x), float(y), r) for x, y in ((0, 0), (10, 20), (595, 842)) for r in (0, 90, 180, 270)]
    df = spark.createDataFrame(rows, "x double, y double, r int")
    page = [F.lit(5.0), F.lit(7.0), F.lit(595.0), F.lit(842.0), F.col("r")]
    df = df.withColumn("v", G.pt_to_visual(F.col("x"), F.col("y"), *page))
    df = df.withColumn("b", G.visual_to_pt(F.col("v.x"), F.col("v.y"), *page))
    assert all(abs(r["b"]["x"] - r["x"]) < 1e-9 and abs(r["b"]["y"] - r["y"]) < 1e-9 for r in df.collect())


def test_quads(spark):
    q = F.array(*[F.lit(float(v)) for v in (0, 10, 10, 10, 0, 0, 10, 0)])
    flat = F.array(*[F.lit(float(v)) for v in (0, 0, 10, 0, 0, 0, 10, 0)])
    df = spark.createDataFrame([(5.0, 5.0), (11.0, 5.0), (10.0, 10.0)], "x double, y double")
    got = df.select(G.point_in_quad(F.col("x"), F.col("y"), q).alias("a"), G.point_in_quad(F.col("x"), F.col("y"), flat).alias("b")).collect()
    assert [r["a"] for r in got] == [True, False, True] and not any(r["b"] for r in got)


def test_bidi_known_lines(spark):
    assert bidi.visual_order(bidi.levels(["R", "R", "WS", "EN", "EN"], 1)) == [3, 4, 2, 1, 0]
    assert bidi.logical_order(["L", "WS", "R", "R"], 0) == [0, 1, 3, 2]
    df = spark.createDataFrame([("abc", 0), ("אב 12", 1), ("x אב y", 0)], "t string, b int")
    got = {r["t"]: r["p"] for r in bidi.to_visual(df, "t", "b", "p").collect()}
    assert got == {"abc": "abc", "אב 12": "12 בא", "x אב y": "x בא y"}


def test_bidi_inverse_is_verified_by_the_forward_pass():
    rng = random.Random(5)
    names = ["L", "R", "AL", "EN", "AN", "WS", "ON", "ES", "ET", "CS", "NSM"]
    for _ in range(2000):
        ks = [rng.choice(names) for _ in range(rng.randint(1, 9))]
        for base in (0, 1):
            order = bidi.logical_order(ks, base)
            if order is not None:
                assert sorted(order) == list(range(len(ks)))
                forward = bidi.visual_order(bidi.levels([ks[v] for v in order], base))
                assert [order[k] for k in forward] == list(range(len(ks)))


def test_bidi_classes_follow_unicode():
    cps = [c for c in list(range(0x41, 0x5B)) + list(range(0x5D0, 0x5EB)) + list(range(0x627, 0x63B))]
    import numpy as np

    assert list(bidi.class_of(np.array(cps))) == [unicodedata.bidirectional(chr(c)) for c in cps]


@pytest.mark.parametrize("whole, case, want", [(False, False, [(0, 2), (3, 5), (9, 11)]), (True, False, [(0, 2), (3, 5)]), (False, True, [(3, 5), (9, 11)])])
def test_find_text(spark, whole, case, want):
    u = spark.createDataFrame([(1, 0, 7, "La la x alas ñla_".replace(" ñla_", ""))], "doc_id long, page_index int, line_id int, text string")
    got = sorted((r["start"], r["end"]) for r in Q.find_text(u, "la", case, whole).collect())
    assert got == want


def test_find_is_literal_and_unicode(spark):
    u = spark.createDataFrame([(1, 0, 0, "a.b AÑO año a\\Eb")], "doc_id long, page_index int, line_id int, text string")
    assert Q.find_text(u, "año").count() == 2 and Q.find_text(u, ".").count() == 1 and Q.find_text(u, "\\E").count() == 1 and Q.find_text(u, "").count() == 0


def test_crossing_hits_count_once(spark):
    u = spark.createDataFrame([(1, 0, 0, "foo ba"), (1, 0, 1, "r bar"), (1, 0, 2, "uno")], "doc_id long, page_index int, line_id int, text string")
    assert Q.find_crossing(u, "bar").count() == 1
    assert Q.find_crossing(u, "bar uno").count() == 1


def test_replacement_is_literal(spark):
    assert values(spark, ["a a"], Q.replace_all(F.col("v"), "a", "$0\\")) == ["$0\\ $0\\"]


def test_text_diff(spark):
    df = spark.createDataFrame([("hola mundo", "hola nuevo mundo"), ("aa", "aaa"), ("x", "x"), ("", "q")], "a string, b string")
    got = [tuple(r["d"]) for r in df.select(text_diff("a", "b").alias("d")).collect()]
    assert got == [(5, 5, "", "nuevo "), (2, 0, "", "a"), (1, 0, "", ""), (0, 0, "", "q")]


def test_markdown_blocks(spark):
    text = "# a #\n~~~\n# no\n```\n~~~~\nTit\n===\n> q\n1. x\n    code\n***\n| a |\n|--|\n| 1 | 2 |\n``` open\n# masked"
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    kinds = [r["kind"] for r in M.md_blocks(d).orderBy("line_no").collect()]
    assert kinds == ["heading", "fence", "code", "code", "fence", "setext", "underline", "quote", "item", "indented", "rule", "text", "text", "text", "fence", "code"]
    t = M.md_tables(d).first()
    assert t["header"] == ["a"] and t["rows"] == [["1"]] and t["align"] == ["none"]


def test_markdown_link_forms(spark):
    text = "`[c](http://code)` \\[no\\](http://esc) [a](http://x.y/A_(b)) <me@x.org> [t][Lab  l] [Lab l] [nope][q] ![p][lab l] https://z.z.\n[" + "lab l" + "]: <http://d.e/> 't'\n[^n]: first\n    more text\n\n    and more\nout\n[" + "x" * 300 + "]: http://long"
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = [(r["kind"], r["url"]) for r in M.md_links(d).orderBy("line_no", "nth").collect()]
    assert got == [("bare", "http://esc"), ("link", "http://x.y/A_(b)"), ("auto", "mailto:me@x.org"), ("reference", "http://d.e/"), ("reference", "http://d.e/"), ("image", "http://d.e/"), ("bare", "https://z.z")]
    defs = {(r["kind"], r["label"]): r["value"] for r in M.md_definitions(d).collect()}
    assert defs == {("ref", "lab l"): "http://d.e/", ("note", "n"): "first more text", ("ref", "x" * 300): "http://long"}


def test_addresses_are_read_as_a_browser_reads_them(spark):
    from quireframe.functions.links import is_allowed_url

    good = ["http://a", " HTTPS://x.y:443/ ", "ht\ttp://a", "http://u:p@h/", "mailto:a@b", "http://[::1]:80/"]
    bad = ["http://a:99999/", "http://user@", "http://", "ftp://a", "x.html", "http://a:b/", "http://a b/"]
    assert values(spark, good + bad, is_allowed_url(F.col("v"))) == [True] * len(good) + [False] * len(bad)


def test_utf16_that_shows_late(spark):
    from quireframe.functions.encoding import with_decoded

    text = "字" * 3000 + "plain " * 4000
    d = spark.createDataFrame([(1, bytearray(text.encode("utf-16-le"))), (2, bytearray(b"abc\0defgh")), (3, bytearray("ñ".encode("cp1252")))], "k int, content binary")
    got = {r["k"]: (r["encoding"], r["text"]) for r in with_decoded(d, "content").collect()}
    assert got == {1: ("utf-16le", text), 2: ("utf-8", "abc\0defgh"), 3: ("windows-1252", "ñ")}


def test_markdown_links_and_entities(spark):
    d = spark.createDataFrame([(1, "[a](<x y>) ![i](p.png \"t\") <mailto:a@b.c> (http://e.f/g_(h)). xhttp://no")], "doc_id long, text string")
    got = sorted((r["kind"], r["url"]) for r in M.md_links(d).collect())
    assert got == [("auto", "mailto:a@b.c"), ("bare", "http://e.f/g_(h)"), ("image", "p.png"), ("link", "x y")]
    assert values(spark, ["&lt;&#x1F600;&#55296;&zzz; & &copy"], M.decode_entities(F.col("v"))) == ["<😀&#55296;&zzz; & &copy"]
