"""Classes of text by one regex each, against the classes of single characters."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from quireframe.functions import bidi, encoding as E


def edge_texts(ranges, seed=3, n=3000):
    cps = sorted({cp + d for lo, hi in ranges for cp in (lo, hi) for d in (-1, 0, 1) if cp + d >= 0 and not 0xD800 <= cp + d < 0xE000} | {0x10FFFF, 0x65E5})
    rng = random.Random(seed)
    return ["".join(chr(rng.choice(cps)) for _ in range(rng.choice([1, 2, 5]))) for _ in range(n)] + [chr(c) for c in cps] + ["", None]


def test_text_class_is_a_regex_of_the_characters_classes(spark):
    df = spark.createDataFrame([(t,) for t in edge_texts([r for _, rs in bidi.CLASS_RANGES for r in rs])], "t string")
    classes = F.transform(F.filter(F.split("t", ""), lambda ch: ch != ""), lambda ch: bidi.char_class(F.ascii(ch)))
    first = F.try_element_at(F.filter(classes, lambda k: k.isin("L", "R", "AL")), F.lit(1))
    slow = F.when(first == "L", "L").when(first.isNotNull(), "R").when(F.exists(classes, lambda k: k.isin("EN", "AN")), "EN").otherwise("WS")
    rtl = F.col("t").rlike(bidi._java_class("R", ("NSM",)) + "|" + bidi._AL)
    fast = df.select(bidi.text_class(F.col("t")).alias("c"), bidi.has_rtl(F.col("t")).alias("r"))
    assert "lambda" not in fast._jdf.queryExecution().optimizedPlan().toString()
    assert df.where(~slow.eqNullSafe(bidi.text_class(F.col("t"))) | ~rtl.eqNullSafe(bidi.has_rtl(F.col("t")))).count() == 0


def test_parts_by_repertoire_hold_one_font_each(spark):
    texts = edge_texts(E.WINANSI + E.SYMBOL + E.DINGBATS) + ["a" * 200_000 + "α", "α  β ✔ ✔x\r\n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    inside = lambda c, ranges: any(a <= c <= b for a, b in ranges)

    def font(ch):
        c = ord(ch)
        return "winansi" if inside(c, E.WINANSI) else "symbol" if inside(c, E.SYMBOL) else "dingbats" if inside(c, E.DINGBATS) else "winansi"

    def parts(t):
        out, i = [], 0
        while i < len(t):
            f, j = font(t[i]), i + 1
            while j < len(t):
                k = j
                while f != "winansi" and k < len(t) and t[k] == " ":
                    k += 1
                if k < len(t) and font(t[k]) == f:
                    j = k + 1
                else:
                    break
            known = lambda c: c in "\t\n " or any(inside(ord(c), r) for r in (E.WINANSI, E.SYMBOL, E.DINGBATS))
            shown = "".join(E.SYMBOL_ALIASES.get(c, c) if known(c) else "?" for c in t[i:j])
            out.append((f, shown, t[i:j], not all(map(known, t[i:j]))))
            i = j
        return out

    for t, got in df.select("t", E.split_by_repertoire(F.col("t"))).collect():
        assert got is None if t is None else [tuple(p) for p in got] == parts(t)


def test_lines_of_a_batch_are_ordered_as_one_by_one():
    rng = np.random.default_rng(4)
    alphabet = list("abאבגاب12٣٤ +-#$,.:/́\u0651\u200f\u200e!?(é") + ["𐤀", "𝒳"]
    texts = ["".join(rng.choice(alphabet, rng.integers(0, 14))) for _ in range(4000)]
    lines = bidi.Lines(texts)
    kinds = [list(bidi.class_of(bidi._codes(t))) for t in texts]
    bounds = list(zip(lines.edges[:-1], lines.edges[1:]))
    for base in (np.zeros(len(texts), int), np.ones(len(texts), int), lines.base_of()):
        levels = lines.levels(base)
        painted = lines.visual_order(levels)
        order, sure = lines.logical_order(base)
        for k, (a, z) in enumerate(bounds):
            lv = bidi.levels(kinds[k], int(base[k]))
            assert levels[a:z].tolist() == lv, texts[k]
            assert (painted[a:z] - a).tolist() == bidi.visual_order(lv)
            one = bidi.logical_order(kinds[k], int(base[k]))
            assert bool(sure[k]) == (one is not None) and (one is None or (order[a:z] - a).tolist() == one), texts[k]
    assert lines.base_of().tolist() == [bidi.base_of(k) for k in kinds]
    assert lines.texts(lines.here) == texts and 500 < sure.sum() < 4000
