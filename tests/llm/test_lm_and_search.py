"""Class-based scores, ranked lexical search and hard negatives against plain restatements of their contracts."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_llm_operators import corpus, frame, prose

from quireframe.llm import class_lm, hard_negatives, prefix_tree, shards


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    odd = spark.createDataFrame([(None, "of no id"), (3, "id again and the the the")], "doc_id long, text string")
    return frame(spark, rows).unionByName(odd, allowMissingColumns=True).cache()


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


def trained(i):
    return zlib.crc32(str(i).encode() if i is not None else b"") % 10 != 0


# ---- op11


def brute_base(data):
    count = Counter()
    for i, t in data:
        if trained(i):
            count.update(words(t) + ["</s>"])
    total, distinct = sum(count.values()), len(count)
    p = lambda w: math.log10((count[w] + 0.1) / (total + 0.1 * (distinct + 1)))
    return [(i, not trained(i), len(words(t)) + 1, sum(count[w] > 0 for w in words(t) + ["</s>"]), total, sum(map(p, words(t) + ["</s>"]))) for i, t in data]


@pytest.mark.parametrize("core, head", [(class_lm.CORE, class_lm.HEAD), (40, 100)])
def test_class_lm_base(spark, docs, rows, core, head):
    data = rows + [(None, "of no id"), (3, "id again and the the the")]
    got = sorted((tuple(r) for r in class_lm.score(docs, core, head, 3).collect()), key=lambda r: (r[0] is None, r[:1], r[5]))
    want = sorted(brute_base(data), key=lambda r: (r[0] is None, r[:1], r[5]))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-9)
    assert all(g[6] < 0 and abs(g[7] - 10 ** (-g[6] / g[2])) < 1e-6 * g[7] for g in got)


def test_class_lm_sums_to_one_and_scores_by_its_classes(spark, docs, rows):
    """Every context's probabilities add up to one, and a text's score is the plain sum over its tokens."""
    d = docs.select("doc_id", "text").where("doc_id IS NOT NULL")
    train = d.where(~class_lm.held_out(F.col("doc_id"))).select("text")
    fitted, placed, seen = class_lm.fit(train, 200, 400, 4)
    assert max(seen) > seen[0]
    rest = {r["key"] % 2**64: (r["n"], r["class"]) for r in placed.collect()}
    of = {int(k): (int(n), int(c)) for k, n, c in zip(fitted.keys, fitted.n, fitted.of)} | rest
    key = lambda w: int(class_lm.tokens(pa.array([w])).h[0])
    count = Counter(w for i, t in rows + [(3, "id again and the the the")] if trained(i) for w in words(t))
    assert {key(w): n for w, n in count.items()} == {k: n for k, (n, _) in of.items()}
    full = d.withColumn("row", F.xxhash64("doc_id", "text")).withColumn("held_out", class_lm.held_out(F.col("doc_id")))
    texts = class_lm.coded(full, fitted, placed)
    tri = class_lm.transitions(texts.where("NOT held_out"))
    # trigrams by hand
    by_hand = Counter()
    for i, t in rows + [(3, "id again and the the the")]:
        if trained(i):
            c = [class_lm.END] * 2 + [of[key(w)][1] for w in words(t)] + [class_lm.END]
            by_hand.update(zip(c, c[1:], c[2:]))
    assert {tuple(map(int, at)): int(tri[tuple(at)]) for at in np.argwhere(tri)} == by_hand
    model = class_lm.Model(fitted, tri)
    n = np.array([v for v, _ in of.values()] + [fitted.ends, 0], float)
    c = np.array([v for _, v in of.values()] + [class_lm.END, class_lm.OTHER])
    rng = random.Random(2)
    for u, v in [(class_lm.END, class_lm.END), (class_lm.END, class_lm.OTHER)] + [(rng.randrange(66), rng.randrange(66)) for _ in range(20)]:
        assert abs(model.p(np.full(n.size, u), np.full(n.size, v), c, n).sum() - 1) < 1e-9
    scores = {r["doc_id"]: r["score"] for r in class_lm.score(docs.where("doc_id IS NOT NULL"), 200, 400, 4).collect()}
    for i, t in rows[:60] + rows[-3:]:
        known = [of.get(key(w), (0, class_lm.OTHER)) for w in words(t)] + [(fitted.ends, class_lm.END)]
        u, v, total = class_lm.END, class_lm.END, 0.0
        for cnt, k in known:
            total += math.log10(model.p(np.array([u]), np.array([v]), np.array([k]), np.array([float(cnt)]))[0])
            u, v = v, k
        if i != 3:
            assert abs(scores[i] - total) < 1e-5 * max(1, abs(total))


def test_class_lm_beats_single_words_on_held_out_texts(spark):
    """Two languages: classes tell which words follow each other."""
    rng = random.Random(8)
    speech = [[prose(rng, 1) + x for _ in range(150)] for x in ("a", "o", "u")]
    data = []
    for i in range(400):
        ws = []
        for _ in range(60):
            ws += [rng.choice(speech[0]), rng.choice(speech[1]), rng.choice(speech[2])]
        data.append((i, " ".join(ws)))
    got = class_lm.score(spark.createDataFrame(data, "doc_id long, text string").repartition(3), sweeps=6).where("held_out").collect()
    assert len(got) > 20
    assert sum(r["score"] for r in got) > 0.95 * sum(r["base_score"] for r in got)


def test_class_lm_without_training_and_empty(spark):
    out = next(i for i in range(1000) if not trained(i))
    one = class_lm.score(spark.createDataFrame([(out, "a b"), (None, None)], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] is None, r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in one) == [(False, 3, 0, 0, 0.0, 0.0), (True, 1, 0, 0, 0.0, 0.0)]
    assert class_lm.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_exchange_keeps_the_likeliest_state(spark):
    rng = random.Random(1)
    data = [(" ".join(rng.choice(["x%d", "y%d"][k % 2 :][0:1]) % rng.randrange(90) for k in range(80)),) for _ in range(900)]
    train = spark.createDataFrame(data, "text string")
    keys, _ = class_lm.most_frequent(class_lm.counts(train), 500)
    near = class_lm.neighbours(train, keys)
    of, table, seen = class_lm.exchange(near, keys.size, 16)
    assert class_lm.likelihood(table) == max(seen) > seen[0]
    names = {int(class_lm.tokens(pa.array([w])).h[0]): w for w in ["%s%d" % (a, i) for a in "xy" for i in range(90)]}
    kinds = defaultdict(Counter)
    for k, c in zip(keys, of):
        kinds[c][names[int(k)][0]] += 1
    assert sum(max(v.values()) for v in kinds.values()) >= 0.9 * keys.size, kinds


# ---- op12


def brute_rank(docs, items, k=10):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(t))
    bags = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(w for _, b in bags for w in b)
    out = []
    for item, text in items:
        scored = []
        for i, bag in bags:
            m = 100 - 75 + (75 * sum(bag.values()) * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * bag[w]) // (1000 * bag[w] + 8 * m)) for w in terms(text) if w in bag)
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k], 1)]
    return out


@pytest.mark.parametrize("shard, leaf, seed, width", [(4096, 16, 32, 4096), (7, 2, 3, 5), (50, 1, 1, 30)])
def test_prefix_tree(spark, docs, rows, monkeypatch, shard, leaf, seed, width):
    for name, value in (("SHARD", shard), ("LEAF", leaf), ("SEED", seed), ("WIDTH", width)):
        monkeypatch.setattr(prefix_tree, name, value)
    data = rows + [(None, "of no id"), (3, "id again and the the the")]
    items = [(i, " ".join((t or "").split()[:40])) for i, t in rows[::4]] + [(0, "the THE the an"), (7, None), (8, ""), (9, "--- ..."), (10, "unheardof"), (11, "İstanbul ǅ ½ it's \x00 a_b"), (None, "the no id")]
    asked = spark.createDataFrame([(i, t, 1, "k") for i, t in items], "item_id long, text string, rank int, score string").repartition(3)
    order = lambda r: (r[0] is None, r[0] or 0, r[1], r[3], r[2] or 0)
    got = sorted((tuple(r) for r in prefix_tree.rank(docs, asked).collect()), key=order)
    assert got == sorted(brute_rank(data, items), key=order)
    documents, benchmark = docs.select("doc_id", "text").toPandas(), asked.select("item_id", "text").toPandas()
    documents["doc_id"], benchmark["item_id"] = documents["doc_id"].astype("Int64"), benchmark["item_id"].astype("Int64")
    con = duckdb.connect()
    con.register("documents", documents)
    con.register("benchmark", benchmark)
    assert got == sorted(con.sql(prefix_tree.sql()).fetchall(), key=order)


def test_prefix_tree_of_nothing(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert prefix_tree.rank(docs, none).count() == 0
    assert prefix_tree.rank(docs.where("doc_id < 0"), spark.createDataFrame([(1, "the")], "item_id long, text string")).count() == 0


def test_grown_tree_covers_every_document_once():
    rng = random.Random(4)
    for _ in range(30):
        vectors = sorted([tuple(sorted(rng.sample(range(12), rng.randint(0, 8)))) for _ in range(rng.randint(1, 200))])
        arrays = [np.array(v, np.int64) for v in vectors]
        tree = prefix_tree.grow(np.array([0] + [prefix_tree.common(a, b) for a, b in zip(arrays, arrays[1:])]))
        leaves = sorted((s, e) for s, e, (a, b) in zip(tree.start, tree.end, tree.children) if a == b)
        assert [i for s, e in leaves for i in range(s, e)] == list(range(len(vectors)))


# ---- op13


def brute_negatives(data, every=100):
    rows = [(i, (l + 1) % 10 if i % 7 == 0 else l, [math.floor(256 * x) for x in v]) for i, v, l in data if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, label, v) in enumerate(rows):
        if i % every:
            continue
        others = sorted((-sum(x * y for x, y in zip(v, w)), j, m) for b, (j, m, w) in enumerate(rows) if b != a and len(w) == len(v))
        for s, j, _ in [o for o in others if o[2] == label][:5]:
            fits = [(n, t) for t, n, m in others if m != label and 80 * -s <= 100 * -t <= 100 * -s][:5]
            out += [(i, j, r, n, -s, -t) for r, (n, t) in enumerate(fits, 1)]
    return sorted(out)


@pytest.mark.parametrize("shard, step", [(4096, 8), (40, 1)])
def test_hard_negatives(spark, monkeypatch, shard, step):
    monkeypatch.setattr(hard_negatives, "SHARD", shard)
    monkeypatch.setattr(hard_negatives, "STEP", step)
    rng = np.random.default_rng(3)
    data = []
    for i in range(700):
        v = [float(x) for x in rng.normal(0.05, 0.2, 6)]
        data.append((i if i % 50 else 100 * (i // 150), v, int(rng.integers(0, 10))))  # repeated ids
    data += [(800, [1.0] * 6, 1), (900, [1.0] * 6, 1), (901, [1.0] * 6, 1), (902, [1.0] * 6, 2), (1000, [-1.0] * 6, 3), (1001, [0.0] * 6, 3), (1100, [0.0] * 6, 3), (1200, [0.5] * 3, 4), (1201, [0.6] * 3, 4), (1202, [0.45] * 3, 5)]
    data += [(1300, None, 1), (1400, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (1500, [float("nan")] * 6, 1), (1600, [float("inf")] * 6, 1), (None, [1.0] * 6, 1), (1700, [1.0] * 6, None), (1800, [], 1), (1801, [], 1), (1802, [], 2)]
    df = spark.createDataFrame([(i, v, l, 7, "x", 1) for i, v, l in data], "vec_id long, embedding array<double>, label int, rid int, shard string, dims int").repartition(3)
    got = sorted(tuple(r) for r in hard_negatives.mine(df).collect())
    assert got == brute_negatives(data)
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding DOUBLE[], label INTEGER)")
    con.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", [(i, v, l) for i, v, l in data if v != []])
    assert [g for g in got if g[0] != 1800] == sorted(con.sql(hard_negatives.sql()).fetchall())
    assert hard_negatives.mine(df.where("vec_id < 0")).count() == 0


def test_hard_negatives_of_huge_components(spark):
    rng = random.Random(6)
    data = [(i, [rng.choice([-1, 1]) * rng.uniform(1e6, 2e6) for _ in range(5)], rng.randrange(3)) for i in range(300)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")
    assert sorted(tuple(r) for r in hard_negatives.mine(df).collect()) == brute_negatives(data)


def test_scan_leaves_out_what_cannot_matter():
    """The bitmap shrinks before all dimensions are read, and what is left is exact."""
    rng = np.random.default_rng(1)
    v = np.rint(rng.normal(0, 1, (2000, 32)) * 4).astype(np.int64)
    v[:5, 0], v[5:, 0] = 400, 3
    table = pa.table({"rid": np.arange(2000), "vec_id": np.arange(2000), "label": np.zeros(2000, np.int32), "v": pa.array(v.tolist(), pa.list_(pa.int64()))})
    shard, q, sizes = hard_negatives.Columns(table), np.full(32, 1), []
    q[0] = 500

    def keep(low, high):
        sizes.append(low.size)
        return high >= hard_negatives.kth(low, 5)

    rows, score = shard.scan(q, np.ones(2000, bool), keep)
    assert sorted(rows) == [0, 1, 2, 3, 4] and list(score) == list(v[rows] @ q) and sizes == [2000, 5, 5, 5]


def test_shards_hold_one_length_each(spark):
    df = spark.createDataFrame([(i, [0.5] * (2 + i % 2)) for i in range(100)], "vec_id long, embedding array<double>")
    v, sizes, count = shards.dealt(shards.integers(df), 20)
    assert count == 6 and {len({len(r["v"]) for r in v.where(f"shard = {s}").collect()}) for s in range(6)} <= {0, 1}
