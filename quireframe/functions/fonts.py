"""Font names: subset prefixes, family and style, and the nearest standard font."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The fonts every reader has.
STANDARD_FONTS = [
    "Helvetica", "Helvetica-Bold", "Helvetica-Oblique", "Helvetica-BoldOblique",
    "Times-Roman", "Times-Bold", "Times-Italic", "Times-BoldItalic",
    "Courier", "Courier-Bold", "Courier-Oblique", "Courier-BoldOblique",
    "Symbol", "ZapfDingbats",
]
# Name parts that give a family away.
SERIF = "(?i)times|serif|georgia|garamond|cambria|minion"
MONO = "(?i)courier|mono|consolas|menlo|consola"


def strip_subset(font: Column) -> Column:
    return F.regexp_replace(font, r"^[A-Z]{6}\+", "")


def classify_font(font: Column) -> Column:
    bare = strip_subset(font)
    family = F.when(bare.rlike(SERIF), "serif").when(bare.rlike(MONO), "monospace").otherwise("sans-serif")
    return F.struct(family.alias("family"), bare.rlike("(?i)bold").alias("bold"), bare.rlike("(?i)italic|oblique").alias("italic"))


def standard_font(font: Column) -> Column:
    c = classify_font(font)
    stem = F.when(c["family"] == "serif", "Times").when(c["family"] == "monospace", "Courier").otherwise("Helvetica")
    slant = F.when(c["family"] == "serif", "Italic").otherwise("Oblique")
    plain = F.when(c["family"] == "serif", "Times-Roman").otherwise(stem)
    style = F.concat(F.when(c["bold"], "Bold").otherwise(""), F.when(c["italic"], slant).otherwise(""))
    return F.when(style == "", plain).otherwise(F.concat(stem, F.lit("-"), style))
