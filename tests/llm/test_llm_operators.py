"""Every operator against a plain restatement of its contract, with nulls, empty and long texts, ties, repeats, empty tables and clashing extra columns."""

import hashlib
import random
import zlib

import brute
import duckdb
import numpy as np
import public_tokenizers
import pytest

from quireframe.llm import ball_tree, components, gbt, mixing, near_dedup, personal_data, pieces, quality_kernel, quality_rules, suffix_dedup, textstats, token_files, url_filters

SYLLABLES = "an the ing er on re ti st ed ha or nd é ß".split()


def prose(rng, n):
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(n))


def corpus():
    """(doc_id, text): prose, copies, near copies, shared passages, personal data and the odd cases."""
    rng = random.Random(5)
    base = [prose(rng, rng.randint(5, 300)) for _ in range(40)]
    passage = prose(rng, 120)
    texts = base + [base[0], base[0], base[1].upper().replace("É", "é").replace("SS", "ß")]
    for i in range(25):
        w = base[2].split() if i % 2 else base[3].split()
        for _ in range(rng.randint(0, max(1, len(w) // 60))):
            w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += [prose(rng, 20) + "\n" + passage + "\n" + prose(rng, rng.randint(1, 50)) for _ in range(12)]
    texts += [None, "", " \t\n", "one", "one two three four", "one two three four", "一 二\n三", "x" * 3000, "#" * 50, "a\n\n\na\nb\nb\n b", "same words here\n" * 60, "\u0130stanbul ǅ e\u0301 ½ ²\x85\xa0\u3000x <|endoftext|> it's"]
    texts += [prose(rng, 30) + " mail bob.b@x-y.co.uk, or +44 (0)20 7946 0958; host 10.0.0.255 or 1.2.3.456 1.2.3.4.5.6.7.8 card 4111 1111 1111 1111 no 4111111111111112 a@b @c.d" for _ in range(3)]
    texts += [prose(rng, 30_000), "1.2.3.4 " * 500, "+1" * 300, "9" * 5000, "a@" * 2000]
    return list(enumerate(texts))


@pytest.fixture(scope="module")
def rows():
    return corpus()


def frame(spark, rows):
    """With columns beside those needed, some of them named like the operators' own."""
    data = [(i, t, ("s%d" % (i % 5)) if i % 7 else None, "en", len(t or ""), 1, "b", 2, "k") for i, t in rows]
    return spark.createDataFrame(data, "doc_id long, text string, source string, lang string, n_chars long, size int, bucket string, row int, k1 string").repartition(3)


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return frame(spark, [(0, "")]).where("doc_id < 0")


def labels(spark, rows):
    return spark.createDataFrame([(i, int(len(t or "") > 200), 0) for i, t in rows if i % 3], "doc_id long, quality int, toxic int")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_mixing_matches_sql(spark, docs, nothing):
    got = docs.toPandas()
    con = duckdb.connect()
    con.register("documents", got[["doc_id", "text", "source"]])
    want = {r[0]: r[1:] for r in con.sql(mixing.sql()).fetchall()}
    have = {r["doc_id"]: (r["size"], r["source_size"], r["target"], r["taken"]) for r in mixing.mix(docs).collect()}
    assert have.keys() == want.keys()
    for i, x in have.items():
        assert x[:2] + x[3:] == want[i][:2] + want[i][3:] and x[2] == pytest.approx(want[i][2], rel=1e-12)
    assert all(x[3] <= 2 * x[0] for x in have.values())
    assert mixing.mix(nothing).count() == 0


def test_mixing_targets_by_rounds(spark):
    sizes = {f"s{i}": n for i, n in enumerate([10, 1000, 50, 0, 400, 7, 7])}
    df = spark.createDataFrame([(k, False, v) for k, v in sizes.items()] + [("", True, 30)], "src string, none boolean, source_size long")
    got = {(r["src"], r["none"]): r["target"] for r in mixing.targets(df).collect()}
    names = [*sorted(sizes), ""]
    size = [sizes.get(n, 30) for n in names]
    weight = [(3, 1, 2)[i % 3] for i in range(len(names))]
    goal, capped = 1.5 * sum(size), set()
    while True:  # share by weight, cap, share the excess again
        left = goal - sum(2 * size[i] for i in capped)
        open_ = [i for i in range(len(names)) if i not in capped]
        t = {i: left * weight[i] / sum(weight[j] for j in open_) for i in open_}
        over = {i for i in open_ if t[i] >= 2 * size[i]}
        if not over:
            break
        capped |= over
    for i, n in enumerate(names):
        assert got[(n, n == "")] == pytest.approx(2 * size[i] if i in capped else t[i])


def test_mixed_rows_hold_the_taken_words(spark, docs, nothing):
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(docs).collect()}
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    have = {}
    for r in out.collect():
        have[r["doc_id"]] = have.get(r["doc_id"], 0) + len(brute.words(r["text"]))
    assert have == {i: n for i, n in taken.items() if n}
    assert mixing.mixed(nothing).count() == 0


def test_near_duplicates(spark, docs, rows, nothing):
    got = {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in by_id(near_dedup.near_duplicates(docs)).items()}
    assert got == brute.near(rows)
    assert near_dedup.near_duplicates(nothing).count() == 0
    kept = near_dedup.keep_first(docs.union(docs))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, x in got.items() if x[2])


def test_near_duplicates_without_ids(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (3, "A b c d e  f"), (None, "z"), (4, None), (3, "A b c d e  f")], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(df).collect())
    assert got == [("3", 2, 3, True), ("3", 2, 3, True), ("4", 0, 4, True), ("None", 1, None, True), ("None", 2, 3, False)]


def test_large_group_of_near_copies(spark):
    """Chains of small changes: members that are far from most of the group still join it through others."""
    rng = random.Random(3)
    w = prose(rng, 150).split()
    data = []
    for i in range(120):
        data.append((i, " ".join(w)))
        w[rng.randrange(len(w))] = f"new{i}"
    assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in by_id(near_dedup.near_duplicates(spark.createDataFrame(data, "doc_id long, text string"))).items()} == brute.near(data)


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {n: n for e in edges for n in e}
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {n: c for n, c in root.items() if any(n in e for e in edges if e[0] != e[1])}


@pytest.mark.parametrize("family", [512, 1])
def test_suffix_dedup(spark, docs, rows, nothing, family):
    texts = [t for _, t in rows]
    got = by_id(suffix_dedup.dedup(docs, 100, family=family))
    for (i, _), want in zip(rows, brute.repeats(texts, 100)):
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want, i
    assert suffix_dedup.dedup(nothing, 100).count() == 0


def test_suffix_dedup_gives_spans_and_texts(spark, docs, rows):
    text = dict(rows)
    digests = by_id(suffix_dedup.dedup(docs, 100))
    for i, r in by_id(suffix_dedup.kept(docs, 100)).items():
        data, spans = (text[i] or "").encode(), [(s["a"], s["b"]) for s in r["spans"]]
        assert all(a < b for a, b in spans) and all(b < c for (_, b), (c, _) in zip(spans, spans[1:])), i
        assert bytes(r["kept"]) == bytes(c for k, c in enumerate(data) if not any(a <= k < b for a, b in spans)), i
        assert digests[i]["text"] == bytes(r["kept"]).decode("utf-8", "replace"), i


def test_interval_expansion_of_random_strings():
    rng = random.Random(1)
    for _ in range(150):
        n = rng.randint(2, 9)
        segs = [bytes(rng.choice(b"ab") if rng.random() < 0.9 else rng.choice(b"cde\0") for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(1, 8))]
        every = [x[i : i + n] for x in segs for i in range(len(x) - n + 1)]
        got = np.concatenate([np.asarray(m, bool) for m in suffix_dedup.repeated_starts(segs, n)])
        assert got.tolist() == [every.count(x) > 1 for x in every]


def urls():
    rng = random.Random(4)
    out = [None, "", "no scheme", "http://", "HTTP://X.NET", "http://x.net/", "http://net/", "http://a.example.net/en/1?x=/q#f", "http://example.net/EN/", "https://Example.COM/de/x", "http://notexample.com/de/x", "ftp://a.b.org/fr/", "http://a.org#/fr/", "x://y://z.net/a", "http://x.net:80/", "http://" + "a" * 5000 + ".net/"]
    out += [f"http{rng.choice(['', 's'])}://{rng.choice(['a.', 'm.', ''])}{rng.choice(['example.net', 'example.com', 'site.org', 'x.info'])}/{rng.choice(['en', 'de', 'fr'])}/{rng.randint(0, 999)}" for _ in range(150)]
    return list(enumerate(out))


def test_url_filters(spark):
    pages = urls()
    df = spark.createDataFrame([(i, u, "<html>", "h", "p") for i, u in pages] + [(None, "http://x.net/", "", "h", "p")], "page_id long, url string, html string, host string, s1 string")
    got = {r["page_id"]: r for r in url_filters.judge(df).collect()}
    for i, u in pages:
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
            host, rest = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
            path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
        fit = [(len(r), r, v) for r, v in url_filters.RULES if ("." + host).endswith("." + r.partition("/")[0]) and path.startswith("/" + r.partition("/")[2])]
        r = got[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, max(fit)[1] if fit else None)
        assert r["verdict"] == max(fit)[2] if fit else r["verdict"] in ("allow", "block")
    assert url_filters.judge(df.where("page_id < 0")).count() == 0


def test_near_duplicates_by_content(spark):
    rng = random.Random(21)
    one, two, three = (prose(rng, 200) for _ in range(3))
    data = [(1, one), (1, two), (1, two), (4, two + " tail"), (6, one + " tail"), (None, three), (None, three + " tail"), (8, three + " end")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(df).collect()}
    assert got == {(1, 1, True), (4, 1, False), (6, 1, False), (None, 8, False), (8, 8, True)}
    kept = sorted((r["doc_id"] or 0, r["text"]) for r in near_dedup.keep_first(df).collect())
    assert kept == sorted([(1, one), (1, two), (8, three + " end"), (0, three), (0, three + " tail")])


def test_personal_data_base(spark, docs, rows, nothing):
    got = by_id(personal_data.report(docs))
    for i, t in rows:
        want = brute.personal(t)
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), i
        assert set(want) <= set(got[i]["spans"].split(","))
        assert [got[i][f"n_{k}"] for k in personal_data.KINDS] == [sum(s.startswith(k) for s in want) for k in personal_data.KINDS]
    assert personal_data.report(nothing).count() == 0


def test_disclosing_terms_near_entities_only(spark):
    rng = random.Random(8)
    data = [(i, prose(rng, 30)) for i in range(60)] + [(100 + i, prose(rng, 20) + f" reachable p{i}@x.org " + prose(rng, 20)) for i in range(15)] + [(200, "reachable but nothing here")]
    df = spark.createDataFrame([(*r, len(r[1])) for r in data], "doc_id long, text string, n_chars long")
    got = by_id(personal_data.report(df))
    assert all("term:" in got[100 + i]["spans"] for i in range(15)) and got[200]["spans"] == "" and all(got[i]["spans"] == "" for i in range(60))
    clean = by_id(personal_data.sanitised(df.union(df.where("doc_id = 100"))))
    assert all("@" not in clean[100 + i]["text"] and "<EMAIL>" in clean[100 + i]["text"] and "reachable" not in clean[100 + i]["text"] for i in range(15))
    assert all(clean[i]["text"] == t for i, t in data if i < 100) and clean[200]["text"] == data[-1][1]
    assert all(r["n_chars"] == len(r["text"]) for r in clean.values())


def test_disclosing_terms_far_and_rare(spark):
    rng = random.Random(9)
    far = [(200 + i, "Kowalska " + prose(rng, 20) + f" p{i}@x.org " + prose(rng, 20) + " kowalska") for i in range(5)]
    data = [(i, prose(rng, 30)) for i in range(180)] + far + [(300, "once " + prose(rng, 20) + " q@x.org"), (301, "+44 20 7946 0958 " + prose(rng, 20))]
    data += [(302 + i, "common " + prose(rng, 10) + (" r@x.org" if i % 2 else "")) for i in range(6)]
    df = spark.createDataFrame([(*r, len(r[1])) for r in data], "doc_id long, text string, n_chars long")
    got = by_id(personal_data.report(df))
    assert all([s for s in got[i]["spans"].split(",") if s.startswith("term:")] == ["term:0:8", f"term:{len(t) - 8}:{len(t)}"] for i, t in far)
    assert all("term:" not in r["spans"] for i, r in got.items() if not 200 <= i < 205)
    clean = by_id(personal_data.sanitised(df))
    assert all("kowalska" not in clean[i]["text"].lower() for i, _ in far) and clean[300]["text"].startswith("once ") and clean[305]["text"].startswith("common ")


def test_quality_kernel(spark, docs, rows, nothing):
    y = labels(spark, rows)
    out = quality_kernel.score(docs, y)
    got = by_id(out)
    assert got.keys() == {i for i, _ in rows}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for i, r in got.items())
    long = [r["score"] for i, r in got.items() if len(rows[i][1] or "") > 200]
    short = [r["score"] for i, r in got.items() if len(rows[i][1] or "") <= 200]
    assert np.mean(long) > np.mean(short) + 0.3
    assert quality_kernel.score(nothing, y).count() == 0
    assert {r["score"] for r in quality_kernel.score(docs, y.where("doc_id < 0")).collect()} == {0.5}


def test_isotonic():
    x, y = quality_kernel.isotonic(np.arange(5.0), np.array([0.1, 0.4, 0.2, 0.2, 0.9]), np.ones(5))
    assert np.all(np.diff(y) >= 0) and y[2] == pytest.approx(0.8 / 3) and x.tolist() == [0, 0, 1, 3, 4, 4]


def test_pieces_equal_the_library(spark, docs, rows, nothing):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    more = list(enumerate(["  two  spaces \n\n end ", "▁▁x ▁", " ", "\n", "\x00\x07é\u0301", "😀😀 日本語テキスト", "ba" * 3000, "  \n  ", "aaaa" * 99], 10_000))
    got = by_id(pieces.encode(docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string")), path))
    for i, t in [*rows, *more]:
        want = sp.encode(t or "") + [2]
        assert got[i]["ids"] == want, i
        assert got[i]["decoded"] == sp.decode(want)
    assert pieces.digests(pieces.encode(nothing, path)).count() == 0


def test_token_files(spark, docs, rows, nothing):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    shards = token_files.write(docs, path, end=2, shard=5000)
    assert shards.count() > 3
    got, start = by_id(token_files.read(shards)), 0
    for i, text in rows:
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        r = got[i]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, ids.size, zlib.crc32(ids.tobytes())), i
        start += ids.size
    assert token_files.read(token_files.write(nothing, path, end=2)).count() == 0


def test_wavelet_matrix():
    rng = np.random.default_rng(1)
    for n, top in ((0, 1), (1, 1), (7, 3), (2000, 49408), (1500, 70000)):
        a = rng.integers(0, top, n).astype(np.uint32)
        m = token_files.WaveletMatrix.load(token_files.WaveletMatrix.build(a).dump())
        assert m.all().tolist() == a.tolist()
        for i in rng.integers(0, n, 20) if n else []:
            i, v = int(i), int(a[i])
            assert m.access(i) == v and m.rank(v, i) == int((a[:i] == v).sum()) and m.select(v, m.rank(v, i)) == i
        assert m.select(5, n + 1) == -1 and m.rank(1 << 20, n) == 0


def test_top_k(spark, monkeypatch):
    rng = np.random.default_rng(3)
    monkeypatch.setattr(ball_tree, "LEAF", 8)
    vecs = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(300)] + [(300, [0.0] * 6), (350, [0.0] * 6), (351, [0.0] * 6), (400, None), (401, [float("nan")] * 6), (450, [1.0] * 3), (451, [2.0] * 3), (500, []), (None, [1.0] * 6), (0, None)]
    vecs += [(600, [1e30] * 6), (601, [-1e30] * 6)]
    df = spark.createDataFrame([(*v, 1, "x") for v in vecs], "vec_id long, embedding array<double>, label int, shard string")
    monkeypatch.setattr(ball_tree, "SHARD", 100)
    got = [tuple(r) for r in ball_tree.top_k(df).orderBy("query_id", "rank").collect()]
    use = {i: [max(min(int(np.floor(min(max(256 * x, -9.2e18), 9.2e18))), 2**63 - 1), -(2**63)) for x in v] for i, v in vecs if i is not None and v is not None and not any(np.isnan(v))}
    want = []
    for q in sorted(i for i in use if i % 50 == 0):
        s = sorted((-max(min(sum(a * b for a, b in zip(use[q], v)), 2**63 - 1), -(2**63)), i) for i, v in use.items() if i != q and len(v) == len(use[q]))[:5]
        want += [(q, r, i, -x) for r, (x, i) in enumerate(s, 1)]
    assert got == want
    assert ball_tree.top_k(df.where("vec_id < 0")).count() == 0


@pytest.mark.parametrize("shard", [8192, 3])
def test_top_k_keeps_every_row_of_an_id(spark, monkeypatch, shard):
    monkeypatch.setattr(ball_tree, "SHARD", shard)
    rng = random.Random(1)
    vecs = [(0, [1.0, 0.0]), (1, [5.0, 0.0]), (1, [9.0, 0.0]), (2, [3.0, 0.0])] + [(rng.choice([50, 51, 52, 100]), [float(rng.randint(-3, 3)), 1.0]) for _ in range(40)]
    got = sorted(tuple(r) for r in ball_tree.top_k(spark.createDataFrame(vecs, "vec_id long, embedding array<double>").repartition(3)).collect())
    want = []
    for a, (i, v) in enumerate(vecs):
        if i % 50 == 0:
            s = sorted((-int(65536 * sum(x * y for x, y in zip(v, w))), j) for b, (j, w) in enumerate(vecs) if b != a)[:5]
            want += [(i, r, j, -x) for r, (x, j) in enumerate(s, 1)]
    assert got == sorted(want)
    assert got[0] == (0, 1, 1, 589824)
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding DOUBLE[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", vecs)
    assert got == sorted(con.sql(ball_tree.sql()).fetchall())


def test_quality_rules(spark, docs, rows, nothing):
    model = quality_rules.train(docs, labels(spark, rows))
    got = by_id(quality_rules.judge(docs, model))
    for i, t in rows:
        want = brute.base_counts(t)
        r = got[i]
        assert tuple(r[c] for c in textstats.COUNTS) == want, i
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and (not r["kept"] or not r["base_failed"])
    kept = quality_rules.keep(docs, model)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, r in got.items() if r["kept"])
    assert quality_rules.judge(nothing, model).count() == 0
    assert quality_rules.train(nothing, labels(spark, rows)).roots.size == 0


def test_trees_learn_and_stay_monotone():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3) | (x[:, 2] > 1)).astype(float)
    model = gbt.fit(x, y, monotone={2: 1})
    assert ((model.score(x) > 0.5) == (y > 0.5)).mean() > 0.95
    grid = np.repeat(rng.normal(size=(50, 4)), 30, axis=0)
    grid[:, 2] = np.tile(np.linspace(-3, 3, 30), 50)
    assert np.all(np.diff(model.margin(grid).reshape(50, 30), axis=1) >= -1e-12)
    # the flat arrays against a walk through each tree
    for row in x[:50]:
        m = model.bias
        for at in model.roots:
            while model.threshold[at] < np.inf:
                at = model.child[at] + int(row[model.feature[at]] > model.threshold[at])
            m += model.value[at]
        assert model.margin(row[None])[0] == pytest.approx(m)
