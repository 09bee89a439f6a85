"""Pages of flowing items against a plain walk over each document."""

import random

import pytest
from pyspark.sql import functions as F

from quireframe.operators import paging


def walk(items, height, gap=0.0, share=0.5):
    """Items (height, break, keep, header, notes) one after the other; heights in whole points."""
    left, room = 0, share * height
    given = []
    for h, _, _, head, notes in items:
        cap = max(0, min(room, height - h - head) - gap)
        e = min(notes + left, cap)
        left = notes + left - e
        given.append(e)
    page, used, noted, out = 0, 0, 0, []
    for k, (h, brk, keep, head, _) in enumerate(items):
        need, with_next = h + given[k], given[k]
        if keep and k + 1 < len(items):
            need, with_next = need + items[k + 1][0] + given[k + 1], with_next + given[k + 1]
        zone = noted > 0 or with_next > 0
        full = used + noted + need + (gap if zone else 0) > height or (zone and noted + given[k] + gap > room)
        if used + noted > 0 and (brk or full):
            page, used, noted = page + 1, head, 0
        used, noted = used + h, noted + given[k]
        out.append(page)
    return out


def made(rng, n, zero):
    return [(rng.choice([0] * zero + [5, 10, 17, 30]) if rng.random() < 0.98 else 250, rng.random() < 0.05, rng.random() < 0.2, rng.choice([0, 0, 8]), rng.choice([0, 0, 0, 0, 6, 40]) if rng.random() < 0.97 else 180) for _ in range(n)]


SCHEMA = "doc_id long, item int, height double, page_break boolean, keep_next boolean, header double, notes double"


@pytest.mark.parametrize("stretch, zero", [(16, 0), (1, 1), (2, 6)])
def test_pages_of_long_and_short_documents(spark, monkeypatch, stretch, zero):
    monkeypatch.setattr(paging, "STRETCH", stretch)
    monkeypatch.setattr(paging, "CHUNK", 64)
    rng = random.Random(stretch)
    docs = {1: made(rng, 1500, zero), 2: made(rng, 1, zero), 3: made(rng, 40, zero), 4: [(0, True, True, 0, 0)] * 30, 5: [(10, True, False, 0, 0)] * 25, 6: [(300, False, True, 8, 300)] * 12, 7: [(10, False, False, 0, 0)] * 200}
    rows = [(d, k, float(h), b, kp, float(hd), float(n)) for d, items in docs.items() for k, (h, b, kp, hd, n) in enumerate(items)]
    got = {}
    for r in paging.paginate(spark.createDataFrame(rows, SCHEMA).repartition(5), 100.0, 3.0).collect():
        got.setdefault(r["doc_id"], {})[r["item"]] = r["page"]
    for d, items in docs.items():
        assert [got[d][k] for k in range(len(items))] == walk(items, 100, 3), d
    assert sum(map(len, got.values())) == len(rows)


def test_pages_without_optional_columns_and_of_nothing(spark):
    df = spark.range(50).select(F.lit(9).alias("doc_id"), F.col("id").alias("item"), F.lit(30).alias("height"))
    assert [r["page"] for r in paging.paginate(df, 100.0).orderBy("item").collect()] == [k // 3 for k in range(50)]
    assert paging.paginate(df.where("item < 0"), 100.0).count() == 0


def test_a_long_document_is_spread(spark):
    """No task and no row holds a document: stretches stay of one size however long it is."""
    df = spark.range(20_000).select(F.lit(1).alias("doc_id"), F.col("id").alias("item"), F.lit(10.0).alias("height"))
    s = paging._stretches(paging._measured(df, 100_000, 0, 50_000), 100_000, 100_000)
    assert s.agg(F.max(F.size("items"))).first()[0] <= 10 * (paging.STRETCH + 1) + 2
    assert s.count() == 20_000 // (10 * paging.STRETCH)
    assert paging.paginate(df, 100.0).where("page <> item div 10").count() == 0
