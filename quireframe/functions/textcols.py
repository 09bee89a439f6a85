"""Text column expressions: escaping, slugs, numbers, page ranges, macros."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# White space as ECMAScript's \s sees it (Java's \s is ASCII only).
JS_SPACE = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def js_round(c: Column) -> Column:
    """Round half up, also for negative halves."""
    return F.floor(c + 0.5)


def starts_blank(c: Column) -> Column:
    return c.rlike(f"^[{JS_SPACE}]")


def ends_blank(c: Column) -> Column:
    return c.rlike(f"[{JS_SPACE}]\\z")


def js_trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{JS_SPACE}]+|[{JS_SPACE}]+\\z", "")


def escape_markdown(c: Column) -> Column:
    """Backslash before each character Markdown would read as inline markup."""
    return F.regexp_replace(c, r"([\\`*_\[\]<>])", r"\\$1")


def escape_line_start(c: Column) -> Column:
    return F.when(F.startswith(c, F.lit("#")), F.concat(F.lit("\\"), c)).otherwise(c)


def is_bold(font: Column) -> Column:
    return font.rlike("(?i)Bold|Black|Heavy")


# List markers recognised at the start of a line.
BULLET_MARK = f"^[•\\-–*][{JS_SPACE}]*"
NUMBER_MARK = f"^(\\d+)[.)][{JS_SPACE}]*"


def list_prefix(text: Column) -> Column:
    """``- `` for a bullet, ``N. `` for a number, else empty."""
    return (
        F.when(text.rlike(BULLET_MARK), F.lit("- "))
        .when(text.rlike(NUMBER_MARK), F.concat(F.regexp_extract(text, NUMBER_MARK, 1), F.lit(". ")))
        .otherwise(F.lit(""))
    )


def without_list_mark(text: Column) -> Column:
    return F.when(text.rlike(BULLET_MARK), F.regexp_replace(text, BULLET_MARK, "")).otherwise(F.regexp_replace(text, NUMBER_MARK, ""))


def heading_level(size: Column, body: Column) -> Column:
    """0 for body text, else 1..3 by how much larger the line is than the body size."""
    ratio = size / F.when(body > 0, body)
    return F.when(ratio >= 1.6, 1).when(ratio >= 1.3, 2).when(ratio >= 1.15, 3).otherwise(0)


def slug(c: Column) -> Column:
    kept = F.regexp_replace(js_trim(F.lower(c)), r"[^\p{L}\p{N}\p{M} _-]", "")
    return F.replace(kept, F.lit(" "), F.lit("-"))


def normalize_note(c: Column) -> Column:
    return js_trim(F.regexp_replace(c, "\r\n?", "\n"))


def excerpt(c: Column, limit: int = 140) -> Column:
    return F.when(F.length(c) > limit, F.concat(F.left(c, F.lit(limit)), F.lit("…"))).otherwise(c)


def format_bytes(n: Column) -> Column:
    kb = n / 1024.0
    return (
        F.when(n < 1024, F.concat(n.cast("long").cast("string"), F.lit(" B")))
        .when(kb < 1024, F.concat(F.format_string("%.1f", kb.cast("double")), F.lit(" KB")))
        .otherwise(F.concat(F.format_string("%.2f", (kb / 1024.0).cast("double")), F.lit(" MB")))
    )


def hex_to_rgb(c: Column) -> Column:
    """struct<r,g,b>; black for anything that is not six hex digits."""
    digits = F.regexp_extract(F.trim(c), "(?i)^#?([0-9a-f]{6})\\z", 1)

    def part(k: int) -> Column:
        return F.when(digits == "", F.lit(0)).otherwise(F.conv(F.substring(digits, 2 * k + 1, 2), 16, 10).cast("int"))

    return F.struct(part(0).alias("r"), part(1).alias("g"), part(2).alias("b"))


def expand_macros(text: Column, n: Column, total: Column, date: Column) -> Column:
    """Page number, page count and date placeholders, in any case and with inner blanks."""
    out = text
    for name, value in (("n", n.cast("string")), ("total", total.cast("string")), ("fecha", F.date_format(date, "dd/MM/yyyy"))):
        out = F.regexp_replace(out, F.lit(f"(?i)<<[{JS_SPACE}]*{name}[{JS_SPACE}]*>>"), value)
    return out


# Subtractive Roman numerals, largest first.
ROMAN = [(1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")]
ROMAN_MAX = 32767


def to_roman(n: Column) -> Column:
    parts, rest = [], n
    for value, mark in ROMAN:
        parts.append(F.repeat(F.lit(mark), F.floor(rest / value).cast("int")))
        rest = rest % value
    return F.when(n < 1, "").when(n > ROMAN_MAX, n.cast("string")).otherwise(F.concat(*parts))


def to_letters(n: Column) -> Column:
    """a..z, then aa..zz, aaa..."""
    times = (F.floor((n - 1) / 26) + 1).cast("int")
    return F.when(n < 1, "").otherwise(F.repeat(F.char((F.lit(97) + (n - 1) % 26).cast("long")), times))


def format_number(n: Column, fmt: Column) -> Column:
    """A list number in one of the word-processor formats; null for an unknown format."""
    return (
        F.when(fmt == "decimal", n.cast("string"))
        .when(fmt == "decimalZero", F.when((n >= 0) & (n < 10), F.concat(F.lit("0"), n.cast("string"))).otherwise(n.cast("string")))
        .when(fmt == "lowerLetter", to_letters(n))
        .when(fmt == "upperLetter", F.upper(to_letters(n)))
        .when(fmt == "lowerRoman", F.lower(to_roman(n)))
        .when(fmt == "upperRoman", to_roman(n))
        .when(fmt == "bullet", F.lit("•"))
        .when(fmt == "none", F.lit(""))
    )


def apply_level_template(template: Column, values: Column) -> Column:
    """``%1``..``%9`` replaced by the array's values, missing ones by nothing; values are not expanded again."""
    pieces = F.split(template, "(?=%[1-9])")

    def fill(p: Column) -> Column:
        k = F.substring(p, 2, 1).try_cast("int")
        v = F.coalesce(F.try_element_at(values, k), F.lit(""))
        return F.when(p.rlike("^%[1-9]"), F.concat(v, F.substr(p, F.lit(3)))).otherwise(p)

    return F.array_join(F.transform(pieces, fill), "")


def parse_page_range(spec: Column, total: Column) -> Column:
    """``1-3, 5`` to 0-based page numbers in the order given, without repeats and within the document."""

    def expand(part: Column) -> Column:
        lo = F.regexp_extract(part, r"^(\d+)(?:\s*-\s*\d+)?$", 1)
        hi = F.regexp_extract(part, r"^(\d+)\s*-\s*(\d+)$", 2)

        def number(digits: Column) -> Column:
            n = F.regexp_replace(digits, "^0+(?=.)", "")
            return F.when(F.length(n) > 18, F.lit(2**62)).otherwise(n.try_cast("long"))  # more digits than any page count has

        a = number(lo)
        b = F.coalesce(number(hi), a)
        first = F.greatest(F.least(a, b), F.lit(1))
        last = F.least(F.greatest(a, b), total.cast("long"))
        return F.when(a.isNull() | (first > last), F.array().cast("array<bigint>")).otherwise(F.sequence(first, last))

    parts = F.transform(F.split(spec, ","), lambda p: js_trim(p))
    pages = F.array_distinct(F.flatten(F.transform(parts, expand)))
    return F.transform(pages, lambda p: (p - 1).cast("int"))


def comment_matches(q: Column, *parts: Column) -> Column:
    return F.contains(F.lower(F.concat_ws(" ", *parts)), F.lower(js_trim(q)))


def is_word_char(ch: Column) -> Column:
    return ch.rlike(r"^[\p{L}\p{N}_]$")
