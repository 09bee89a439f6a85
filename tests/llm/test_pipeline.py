"""The corpus pipeline stage by stage against plain restatements, and the registration of its queries."""

import hashlib
import importlib
import os
import subprocess
import sys
from collections import Counter

import brute
import corpus_pipeline
import public_tokenizers
import pytest
from test_llm_operators import corpus, frame, labels

import __spark_entry__
from quireframe.llm import mixing, quality_rules
from quireframe.llm.queries import QUERIES


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rows = corpus()
    at = str(tmp_path_factory.mktemp("sf"))
    frame(spark, rows).write.parquet(f"{at}/documents.parquet")
    labels(spark, rows).write.parquet(f"{at}/labels.parquet")
    return at


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(k)))
        columns, docs = docs.columns, spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert docs.columns == columns
        kept[name] = docs
        after = Counter((r["doc_id"], r["text"]) for r in docs.collect()) if k < 4 else None
        if name == "quality rules":
            assert set(after) <= set(before)
            counts = {i: brute.base_counts(t) for i, t in before}
            assert all(counts[i][0] >= 20 and 100 * counts[i][4] <= 30 * counts[i][0] for i, _ in after)
        if name == "near-duplicates":
            assert sorted(i for i, _ in after) == sorted(i for i, x in brute.near(before).items() if x[2])
        if name == "personal data":
            texts = dict(after.keys())
            assert texts.keys() == dict(before).keys()
            for i, t in before:
                assert texts[i] == t if not brute.personal(t) else not brute.personal(texts[i])
        if name == "mixing":
            sizes = {i: len(brute.words(t)) for i, t in before}
            words = Counter()
            for (i, t), n in after.items():
                words[i] += n * len(brute.words(t))
            taken = {r["doc_id"]: r["taken"] for r in mixing.mix(spark.read.parquet(str(tmp_path / str(k - 1)))).collect()}
            assert words == Counter({i: n for i, n in taken.items() if n}) and all(words[i] <= 2 * sizes[i] for i in words)
        if name == "encoding":
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
            want = Counter()
            for i, t in before:
                ids = sp.encode(t) + [2]
                want[i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()] += 1
            assert Counter(map(tuple, docs.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())) == want
    assert Counter(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) == Counter(map(tuple, docs.collect()))


def test_stages_on_an_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == 0


def test_quality_rules_keep_labelled_documents(spark):
    """Held-out accuracy on the generated corpus: trained on ids that are not divisible by five."""
    base = "/root/testdata/sf0.01"
    if not os.path.isdir(base):
        pytest.skip("no generated tables here")
    docs, y = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    model = quality_rules.train(docs, y.where("doc_id % 5 <> 0"))
    got = quality_rules.judge(docs, model).where("NOT base_failed").join(y.where("doc_id % 5 = 0"), "doc_id").selectExpr("avg(int(kept = (quality = 1)))").first()[0]
    assert got > 0.95


def test_registered():
    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in QUERIES}
    assert QUERIES.keys() <= __spark_entry__.queries().keys() and "pipeline" in __spark_entry__.queries()


def test_the_rest_stands_without_this_package(tmp_path):
    root = os.path.dirname(os.path.abspath(__spark_entry__.__file__))
    code = "import sys, importlib.abc\nclass No(importlib.abc.MetaPathFinder):\n def find_spec(self, n, p=None, t=None):\n  if n.startswith(('quireframe.llm', 'corpus_pipeline')): raise ModuleNotFoundError(n, name=n)\nsys.meta_path.insert(0, No())\nimport __spark_entry__ as e\nassert e.queries() and not any(q.startswith('op') or q == 'pipeline' for q in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, capture_output=True)
    importlib.import_module("quireframe.plans")
