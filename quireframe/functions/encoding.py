"""Bytes to text, and text to what a standard font can draw."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

# What Windows-1252 has at 0x80..0x9F; the five unassigned bytes stay as they are.
CP1252_C1 = {0x80: "€", 0x82: "‚", 0x83: "ƒ", 0x84: "„", 0x85: "…", 0x86: "†", 0x87: "‡", 0x88: "ˆ", 0x89: "‰", 0x8A: "Š", 0x8B: "‹", 0x8C: "Œ", 0x8E: "Ž",
             0x91: "‘", 0x92: "’", 0x93: "“", 0x94: "”", 0x95: "•", 0x96: "–", 0x97: "—", 0x98: "˜", 0x99: "™", 0x9A: "š", 0x9B: "›", 0x9C: "œ", 0x9E: "ž", 0x9F: "Ÿ"}


@F.pandas_udf(T.StringType())
def _utf16(content: pd.Series, little: pd.Series) -> pd.Series:
    return pd.Series([None if c is None else bytes(c).decode("utf-16-le" if le else "utf-16-be", "replace") for c, le in zip(content, little)])


def with_decoded(df: DataFrame, content: str) -> DataFrame:
    """Adds text, encoding and ``assumed`` (guessed rather than marked or proven).

    Byte order mark, then the parity of zero bytes in the whole content, then strict UTF-8, then Windows-1252.  Only
    UTF-16 rows reach Python, because the JVM decoder stops at the first malformed pair.
    """
    c = F.col(content)
    head = F.hex(F.substring(c, 1, 3))
    # one character for each byte; contents without a zero byte, nearly all, skip the counting
    bytes_ = F.decode(c, "ISO-8859-1")
    n = F.floor(F.length(c) / 2)

    def zeros(side: str) -> Column:
        half = F.regexp_replace(F.substring(bytes_, F.lit(1), (n * 2).cast("int")), side, "$1")
        return F.when(F.contains(bytes_, F.lit("\0")), F.length(half) - F.length(F.replace(half, F.lit("\0"), F.lit("")))).otherwise(0)

    df = df.withColumn("_n", n).withColumn("_even", zeros("(?s)(.).")).withColumn("_odd", zeros("(?s).(.)"))
    sniff = (
        F.when((F.col("_n") > 0) & (F.col("_odd") >= F.col("_n") * 0.3) & (F.col("_even") <= F.col("_n") * 0.05), "utf-16le")
        .when((F.col("_n") > 0) & (F.col("_even") >= F.col("_n") * 0.3) & (F.col("_odd") <= F.col("_n") * 0.05), "utf-16be")
    )
    mark = F.when(head.startswith("EFBBBF"), "utf-8").when(head.startswith("FFFE"), "utf-16le").when(head.startswith("FEFF"), "utf-16be")
    valid = F.is_valid_utf8(c.cast("string"))
    df = df.withColumn("_mark", mark).withColumn("_sniff", sniff)
    df = df.withColumn("encoding", F.coalesce("_mark", "_sniff", F.when(valid, "utf-8").otherwise("windows-1252")))
    body = F.when(F.col("_mark") == "utf-8", F.substring(c, 4, 2**31 - 1)).when(F.col("_mark").isNotNull(), F.substring(c, 3, 2**31 - 1)).otherwise(c)
    wide = F.col("encoding").isin("utf-16le", "utf-16be")
    latin = F.translate(F.decode(body, "ISO-8859-1"), "".join(map(chr, CP1252_C1)), "".join(CP1252_C1.values()))
    df = df.withColumn("_wide", _utf16(F.when(wide, body), F.col("encoding") == "utf-16le"))
    text = F.when(wide, F.col("_wide")).when(F.col("encoding") == "utf-8", F.make_valid_utf8(body.cast("string"))).otherwise(latin)
    return (
        df.withColumn("text", text)
        .withColumn("assumed", F.col("_mark").isNull() & (F.col("encoding") != "utf-8"))
        .drop("_n", "_even", "_odd", "_mark", "_sniff", "_wide")
    )


def encoding_warning(encoding: Column, assumed: Column) -> Column:
    """Code of the warning an assumed decode carries, else null."""
    return F.when(assumed & (encoding == "windows-1252"), "assumed-windows-1252").when(assumed, "assumed-utf-16")


# The characters each of the standard fonts can draw, as code-point ranges.
WINANSI = [(0x21, 0x7E), (0xA1, 0xAC), (0xAE, 0xFF), (0x152, 0x153), (0x160, 0x161), (0x178, 0x178), (0x17D, 0x17E), (0x192, 0x192), (0x2C6, 0x2C6), (0x2DC, 0x2DC),
           (0x2013, 0x2014), (0x2018, 0x201A), (0x201C, 0x201E), (0x2020, 0x2022), (0x2026, 0x2026), (0x2030, 0x2030), (0x2039, 0x203A), (0x20AC, 0x20AC), (0x2122, 0x2122)]
SYMBOL = [(0x391, 0x3A1), (0x3A3, 0x3A9), (0x3B1, 0x3C9), (0x3D1, 0x3D2), (0x3D5, 0x3D6), (0x2032, 0x2033), (0x2044, 0x2044), (0x2111, 0x2111), (0x2118, 0x2118), (0x211C, 0x211C),
          (0x2126, 0x2126), (0x2135, 0x2135), (0x2190, 0x2194), (0x21B5, 0x21B5), (0x21D0, 0x21D4), (0x2200, 0x2200), (0x2202, 0x2203), (0x2205, 0x2209), (0x220B, 0x220B),
          (0x220F, 0x220F), (0x2211, 0x2212), (0x2217, 0x2217), (0x221A, 0x221A), (0x221D, 0x221E), (0x2220, 0x2220), (0x2227, 0x222B), (0x2234, 0x2234), (0x223C, 0x223C),
          (0x2245, 0x2245), (0x2248, 0x2248), (0x2260, 0x2261), (0x2264, 0x2265), (0x2282, 0x2284), (0x2286, 0x2287), (0x2295, 0x2295), (0x2297, 0x2297), (0x22A5, 0x22A5),
          (0x22C5, 0x22C5), (0x2320, 0x2321), (0x2329, 0x232A), (0x25CA, 0x25CA), (0x2660, 0x2660), (0x2663, 0x2663), (0x2665, 0x2666)]
DINGBATS = [(0x2195, 0x2195), (0x2460, 0x2469), (0x25A0, 0x25A0), (0x25B2, 0x25B2), (0x25BC, 0x25BC), (0x25C6, 0x25C6), (0x25CF, 0x25CF), (0x25D7, 0x25D7), (0x2605, 0x2605),
            (0x260E, 0x260E), (0x261B, 0x261B), (0x261E, 0x261E), (0x2701, 0x2704), (0x2706, 0x2709), (0x270C, 0x2727), (0x2729, 0x274B), (0x274D, 0x274D), (0x274F, 0x2752),
            (0x2756, 0x2756), (0x2758, 0x275E), (0x2761, 0x2794), (0x2798, 0x27AF), (0x27B1, 0x27BE)]


def in_ranges(cp: Column, ranges) -> Column:
    return F.exists(F.array(*[F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for lo, hi in ranges]), lambda r: (cp >= r["lo"]) & (cp <= r["hi"]))


def _char_class(ranges) -> str:
    return "".join(f"\\x{{{lo:X}}}-\\x{{{hi:X}}}" for lo, hi in ranges)


def glyph_repertoire(cp: Column) -> Column:
    """winansi, symbol, dingbats or none: the first font family that draws the code point."""
    return F.when(in_ranges(cp, WINANSI), "winansi").when(in_ranges(cp, SYMBOL), "symbol").when(in_ranges(cp, DINGBATS), "dingbats").otherwise("none")


# Characters that become a space, vanish, or expand.
UNICODE_SPACES = r"[\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
INVISIBLE = r"[\x{AD}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{2069}\x{FE00}-\x{FE0F}\x{FEFF}]"
CONTROLS = r"[\x{0}-\x{8}\x{B}\x{C}\x{E}-\x{1F}\x{7F}-\x{9F}]"
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl"}
MISSING = "?"
# Letters that the symbol font has under another code point.
SYMBOL_ALIASES = {"\u0394": "\u2206", "\u03a9": "\u2126", "\u03bc": "\u00b5"}


@F.pandas_udf(T.StringType())
def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda s: None if s is None else unicodedata.normalize("NFC", s))


def nfc(c: Column) -> Column:
    """Canonical composition; text that stays below U+0300 is already composed and does not leave the JVM."""
    may_change = c.rlike(r"[^\x{0}-\x{2FF}]")
    return F.when(may_change, _nfc(F.when(may_change, c))).otherwise(c)


def clean(c: Column) -> Column:
    """Composed text with plain spaces, no controls or invisibles and no ligatures; missing glyphs still in place."""
    out = F.regexp_replace(nfc(c), UNICODE_SPACES, " ")
    out = F.regexp_replace(F.regexp_replace(F.regexp_replace(out, "\r", ""), CONTROLS, ""), INVISIBLE, "")
    for k, v in LIGATURES.items():
        out = F.replace(out, F.lit(k), F.lit(v))
    return out


# A nested class is asked only about what the first range leaves open, and most text is ASCII.
_UNDRAWN = f"[\\x{{0}}-\\x{{10FFFF}}&&[^\\t\\n\\x{{20}}-\\x{{7E}}]&&[^{_char_class(WINANSI + SYMBOL + DINGBATS)}]]"


def _drawn(c: Column) -> Column:
    """Cleaned text as it is drawn: a mark for each missing glyph, symbol letters under the symbol font's code points."""
    shown = F.translate(F.regexp_replace(c, _UNDRAWN, MISSING), "".join(SYMBOL_ALIASES), "".join(SYMBOL_ALIASES.values()))
    return F.when(c.rlike(r"[^\t\n\x{20}-\x{7E}]"), shown).otherwise(c)


def sanitize_text(c: Column) -> Column:
    """What a standard font can draw of a text; plain ASCII, most text, is left as it is."""
    return F.when(c.rlike(r"[^\t\n\x{20}-\x{7E}]"), _drawn(clean(c))).otherwise(c)


def split_by_repertoire(c: Column) -> Column:
    """array<struct<repertoire, text, original, missing>> of cleaned text: what is drawn, what stood there, and whether a
    glyph is missing; spaces join their neighbours only if both sides agree."""
    # no range lies across another one's end, so a range is drawn by the first font as a whole
    drawn = lambda ranges, *before: _char_class([r for r in ranges if not any(a <= r[0] <= b for one in before for a, b in one)])
    sym, din = drawn(SYMBOL, WINANSI), drawn(DINGBATS, SYMBOL, WINANSI)
    first = min(lo for lo, _ in SYMBOL + DINGBATS)
    other = f"[\\x{{0}}-\\x{{{first - 1:X}}}[^{sym}{din}]]"
    parts = F.regexp_extract_all(c, F.lit(f"{other}++|[{sym}]+(?: +[{sym}]+)*|[{din}]+(?: +[{din}]+)*"), F.lit(0))
    return F.transform(parts, lambda p: F.struct(F.when(p.rlike(f"^[{sym}]"), "symbol").when(p.rlike(f"^[{din}]"), "dingbats").otherwise("winansi").alias("repertoire"), _drawn(p).alias("text"), p.alias("original"), p.rlike(_UNDRAWN).alias("missing")))


def char_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, cp, n, first_pos: occurrences of every character, counted on the map side before the shuffle."""
    chars = df.select(key, F.posexplode(F.filter(F.split(text, ""), lambda ch: ch != "")).alias("pos", "ch"))
    return chars.groupBy(key, F.ascii("ch").alias("cp")).agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"))


def issue_kind(cp: Column) -> Column:
    """missing (no glyph) or control for a character of composed text, else null."""
    control = (cp < 0x20) & ~cp.isin(9, 10, 13) | (cp == 0x7F) | cp.between(0x80, 0x9F)
    space = cp.isin(0x20, 0xA0, 0x1680, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000) | cp.between(0x2000, 0x200A)
    unseen = (cp == 0xAD) | cp.between(0x200B, 0x200F) | cp.between(0x202A, 0x202E) | cp.between(0x2060, 0x2064) | cp.between(0x2066, 0x2069) | cp.between(0xFE00, 0xFE0F) | (cp == 0xFEFF)
    fine = cp.isin(9, 10, 13) | space | unseen | cp.between(0xFB00, 0xFB04)
    return F.when(control, "control").when(~fine & (glyph_repertoire(cp) == "none"), "missing")


# Symbol-font codes with a Unicode twin, and the glyph a standard font has for it.
BULLET_UNICODE = {("symbol", 0xB7): "•", ("wingdings", 0xA7): "▪", ("wingdings", 0xA8): "◻", ("wingdings", 0xD8): "⮚", ("wingdings", 0xFC): "✔", ("wingdings", 0x76): "❖"}
BULLET_GLYPH = {
    "•": ("•", "Helvetica", 1.0, True), "✔": ("✔", "ZapfDingbats", 1.0, True), "✓": ("✓", "ZapfDingbats", 1.0, True), "➢": ("➢", "ZapfDingbats", 1.0, True),
    "❖": ("❖", "ZapfDingbats", 1.0, True), "▪": ("■", "ZapfDingbats", 0.6, False), "⮚": ("➢", "ZapfDingbats", 1.0, False), "o": ("o", "Courier", 1.0, True),
}


def resolve_bullet(level_text: Column, font: Column) -> Column:
    """struct<text, font, scale, approximate, official> for a list bullet given in a symbol font."""
    ch = F.substring(level_text, 1, 1)
    cp = F.ascii(ch)
    family = F.lower(F.trim(F.coalesce(font, F.lit(""))))
    code = F.when(cp.between(0xF020, 0xF0FF), cp - 0xF000).when(cp <= 0xFF, cp)
    private = cp.between(0xE000, 0xF8FF)
    table = None
    for (fam, k), u in BULLET_UNICODE.items():
        cond = (family == fam) & (code == k)
        table = F.when(cond, u) if table is None else table.when(cond, u)
    known = family.isin("symbol", "wingdings")
    plain = ~known & ~((family == "courier new") & (ch == "o")) & ~private & (cp.between(0x20, 0x7E) | cp.between(0xA1, 0xFF) | cp.isin(0x2022, 0x2013, 0x2014))
    uni = F.when(known, table).when((family == "courier new") & (ch == "o"), "o").when(~private, ch)

    def glyph(k: int) -> Column:
        out = None
        for u, g in BULLET_GLYPH.items():
            out = F.when(uni == u, F.lit(g[k])) if out is None else out.when(uni == u, F.lit(g[k]))
        return out

    none = (F.coalesce(level_text, F.lit("")) == "")
    return F.struct(
        F.when(none, "•").when(plain, ch).otherwise(F.coalesce(glyph(0), F.lit("•"))).alias("text"),
        F.when(none | plain, "Helvetica").otherwise(F.coalesce(glyph(1), F.lit("Helvetica"))).alias("font"),
        F.when(none | plain, F.lit(1.0)).otherwise(F.coalesce(glyph(2), F.lit(1.0))).alias("scale"),
        F.when(none | plain, F.lit(False)).otherwise(~F.coalesce(glyph(3), F.lit(False))).alias("approximate"),
        F.when(none, "•").otherwise(F.coalesce(uni, ch)).alias("official"),
    )
