"""Widths by a glyph table and by a function, and lines wrapped by them."""

import random
import sys

import pandas as pd
import pytest
from pyspark import cloudpickle

from quireframe.operators import metrics

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers do not see this folder

EM = {c: 0.2 + (ord(c) % 9) / 10 for c in "abcdefghij "}


def em(font, text):
    return sum(EM.get(c, 0.6) * (1.5 if font == "Wide" else 1) for c in text)


def table(spark):
    return spark.createDataFrame([(f, c, w * (1.5 if f == "Wide" else 1)) for f in ("Text", "Wide") for c, w in EM.items()], "font string, glyph string, em double")


def function(fonts: pd.Series, texts: pd.Series) -> pd.Series:
    return pd.Series([em(f, t) for f, t in zip(fonts, texts)])


def lines(words, width):
    """(line, word, piece, text) one word after the other."""
    out, line, used, first, blank = [], 0, 0.0, True, 0.0
    for k, (font, size, text) in enumerate(words):
        pieces, cur = [], ""
        for c in text:
            if cur and em(font, text) * size > width + 1e-9 and em(font, cur + c) * size > width + 1e-9:
                pieces.append(cur)
                cur = ""
            cur += c
        pieces.append(cur)
        for p, piece in enumerate(pieces):
            w = em(font, piece) * size
            gap = blank if p == 0 else 0.0
            if not first and used + gap + w > width + 1e-9:
                line, used, gap = line + 1, 0.0, 0.0
            out.append((line, k, p, piece))
            used, first, blank = used + (gap if used else 0.0) + w, False, em(font, " ") * size
    return out


@pytest.mark.parametrize("kind", ["table", "function"])
def test_widths(spark, kind):
    rng = random.Random(3)
    rows = [(i, rng.choice(["Text", "Wide"]), rng.choice([9.0, 12.0]), rng.choice(["the"] * 5 + ["abc", "badge", "a?z", ""])) for i in range(3000)] + [(3000, None, 9.0, "abc"), (3001, "Text", 9.0, None)]
    metric = table(spark) if kind == "table" else function
    want = {i: None if f is None or t is None else sum((EM.get(c, 0.6) * (1.5 if f == "Wide" and c in EM else 1)) for c in t) * s for i, f, s, t in rows}
    if kind == "function":
        want = {i: None if f is None or t is None else em(f, t) * s for i, f, s, t in rows}
    got = {r["i"]: r["width"] for r in metrics.with_widths(spark.createDataFrame(rows, "i long, font string, size double, text string").repartition(3), metric).collect()}
    assert got.keys() == want.keys()
    assert all(got[i] is None if want[i] is None else abs(got[i] - want[i]) < 1e-9 for i in want)


def test_wrapped_lines(spark):
    rng = random.Random(5)
    docs = {d: [(("Text", "Wide")[d % 2], 10.0, "".join(rng.choices("abcdefghij", k=rng.choice([1, 2, 4, 7, 30 if rng.random() < 0.1 else 3])))) for _ in range(n)] for d, n in ((1, 400), (2, 5), (3, 60))}
    rows = [(d, k, f, s, t) for d, ws in docs.items() for k, (f, s, t) in enumerate(ws)]
    got = metrics.wrap_measured(spark.createDataFrame(rows, "doc_id long, word int, font string, size double, text string"), table(spark), 100.0).collect()
    for d, ws in docs.items():
        assert sorted((r["line_no"], r["word"], r["piece"], r["text"]) for r in got if r["doc_id"] == d) == lines(ws, 100.0), d


@pytest.mark.parametrize("kind", ["table", "function"])
def test_documents_are_wrapped_in_their_rows(spark, kind):
    """The same lines as from rows, one word after the other; nothing is shuffled."""
    rng = random.Random(9)
    docs = [(d, ("Text", "Wide")[d % 2], (10.0, 7.0)[d % 3 % 2], ["".join(rng.choices("abcdefghij" if d % 2 else "abcdefghijé𝒳", k=rng.choice([1, 2, 4, 7, 30 if rng.random() < 0.1 else 3]))) for _ in range(n)]) for d, n in ((1, 400), (2, 5), (3, 60), (4, 0), (5, 1), (6, 300))]
    df = spark.createDataFrame([*docs, (7, None, 9.0, ["a"]), (8, "Text", 9.0, None)], "doc_id long, font string, size double, words array<string>").coalesce(2)
    got = metrics.wrap_documents(df, table(spark) if kind == "table" else function, 100.0)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    got = got.collect()
    for d, font, size, ws in docs:
        assert [(r["line_no"], i["word"], i["piece"], i["text"]) for r in sorted(got, key=lambda r: r["line_no"]) if r["doc_id"] == d for i in r["items"]] == lines([(font, size, w) for w in ws], 100.0), d
    assert {r["doc_id"] for r in got} == {1, 2, 3, 5, 6}


def test_page_range_functions(spark):
    from quireframe.functions import tables

    tables.register(spark)
    q = lambda spec, total: [r["page"] for r in spark.sql(f"SELECT page FROM page_range({spec}, {total}) ORDER BY nth").collect()]
    assert q("'3, 1-2,2, 9-4,x,,0,12-20'", 10) == [2, 0, 1, 3, 4, 5, 6, 7, 8]
    assert q("NULL", 10) == q("'1'", "NULL") == q("''", 10) == []
    spark.createDataFrame([(1, 1, "2-3", 5), (1, 2, "3,1", 5), (2, 1, "9", 5), (None, 1, "1", 1)], "doc_id long, seq int, spec string, total int").createOrReplaceTempView("jobs")
    got = spark.sql("SELECT * FROM pages_asked(TABLE(jobs) PARTITION BY doc_id ORDER BY seq)").collect()
    assert sorted(((r["doc_id"] or -1), r["nth"], r["page"]) for r in got) == [(-1, 0, 0), (1, 0, 1), (1, 1, 2), (1, 2, 0)]
