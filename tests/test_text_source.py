"""The text_corpus data source: listing, packing, pruning, decoding and writing."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, LessThanOrEqual

from quireframe.sources import text_source as S


@pytest.fixture
def corpus(spark, tmp_path):
    S.register(spark)
    root = tmp_path / "corpus"
    (root / "sub").mkdir(parents=True)
    (root / "_log").mkdir()
    for name, data in {"a.txt": b"plain", "b.MD": b"\xef\xbb\xbfmarked", "sub/c.txt": "über".encode("latin-1"), "sub/d.pdf": b"%PDF", "empty.txt": b"", "bare": b"x", ".hidden.txt": b"no", "_log/e.txt": b"no"}.items():
        (root / name).write_bytes(data)
    return root


def names(reader):
    return sorted(e.path.rsplit("/", 1)[1] for p in reader.partitions() for e in p.entries)


def test_reads_every_file_once(spark, corpus):
    got = {r["path"].rsplit("/", 1)[1]: (r["extension"], r["length"], bytes(r["content"])) for r in spark.read.format("text_corpus").load(str(corpus)).collect()}
    assert got == {"a.txt": ("txt", 5, b"plain"), "b.MD": ("md", 9, b"\xef\xbb\xbfmarked"), "c.txt": ("txt", 4, b"\xfcber"), "d.pdf": ("pdf", 4, b"%PDF"), "empty.txt": ("txt", 0, b""), "bare": ("", 1, b"x")}


def test_decodes_with_warnings(spark, corpus):
    df = S.decoded(spark.read.format("text_corpus").option("extensions", "txt, .md").load(str(corpus)))
    got = {r["path"].rsplit("/", 1)[1]: (r["text"], r["encoding"], r["warning"]) for r in df.collect()}
    assert got == {"a.txt": ("plain", "utf-8", None), "b.MD": ("marked", "utf-8", None), "c.txt": ("über", "windows-1252", "assumed-windows-1252"), "empty.txt": ("", "utf-8", None)}


def test_conditions_reach_the_listing(spark, corpus):
    reader = S.TextCorpusReader({"path": str(corpus)})
    kept = IsNotNull(("extension",))
    assert list(reader.pushFilters([EqualTo(("extension",), "txt"), kept, GreaterThan(("length",), 0), EqualTo(("content",), b"x")])) == [kept, EqualTo(("content",), b"x")]
    assert names(reader) == ["a.txt", "c.txt"]
    df = spark.read.format("text_corpus").load(str(corpus))
    some = df.filter(F.col("extension").isin("md", "pdf") & (F.col("length") <= 4))
    assert [r["extension"] for r in some.collect()] == ["pdf"]
    assert "In(" not in some._jdf.queryExecution().executedPlan().toString().split("BatchScan")[0]
    assert df.filter(F.col("extension").isin("md", "pdf")).count() == 2
    assert df.filter("extension = 'docx'").count() == 0


def test_null_conditions_fit_nothing(corpus):
    for f in (EqualTo(("extension",), None), LessThanOrEqual(("length",), None)):
        reader = S.TextCorpusReader({"path": str(corpus)})
        assert list(reader.pushFilters([f])) == [] and names(reader) == []
    reader = S.TextCorpusReader({"path": str(corpus)})
    assert list(reader.pushFilters([In(("extension",), ("md", None))])) == [] and names(reader) == ["b.MD"]


def test_partitions_are_bounded_by_size():
    entries = [S.Entry(f"/f{i}", "txt", (i * 37) % 101) for i in range(500)] + [S.Entry("/large", "txt", 5000)]
    parts = S.packed(entries, 400, 10)
    assert sorted(e.path for p in parts for e in p.entries) == sorted(e.path for e in entries)
    for p in parts:
        assert len(p.entries) == 1 or sum(e.length + 10 for e in p.entries) <= 400


def test_round_trip_and_names(spark, tmp_path):
    S.register(spark)
    rows = [("x/1.txt", b"one"), ("x/y/2.txt", None), ("3.txt", "drei ü".encode())]
    df = spark.createDataFrame(rows, "path string, content binary").repartition(3)
    out = tmp_path / "out"
    df.write.format("text_corpus").mode("append").save(str(out))
    got = {r["path"][len(str(out)) + 1 :]: bytes(r["content"]) for r in spark.read.format("text_corpus").load(f"file:{out}").collect()}
    assert got == {p: c or b"" for p, c in rows}
    with pytest.raises(Exception, match="outside the folder"):
        spark.createDataFrame([("../4.txt", b"")], "path string, content binary").write.format("text_corpus").mode("append").save(str(out))
    (tmp_path / "none").mkdir()
    assert spark.read.format("text_corpus").load(str(tmp_path / "none")).count() == 0


def test_tasks_list_the_folders(spark, corpus):
    (corpus / "sub" / "deep").mkdir()
    (corpus / "sub" / "deep" / "f.txt").write_bytes(b"far")
    (corpus / "sub" / ".no").mkdir()
    (corpus / "sub" / ".no" / "g.txt").write_bytes(b"no")
    reader = S.TextCorpusReader({"path": str(corpus), "listing": "tasks"})
    assert [p.folders for p in reader.partitions() if isinstance(p, S.Folders)] == [[str(corpus / "sub")]]
    read = lambda **options: spark.read.format("text_corpus").options(**options).load(str(corpus))
    cols = ["path", "extension", "length", "content"]
    assert sorted(read(listing="tasks").select(cols).collect()) == sorted(read().select(cols).collect())
    assert sorted(r["content"] for r in read(listing="tasks").filter(F.col("extension").isin("txt", "md") & (F.col("length") <= 4)).collect()) == [b"", b"far", "über".encode("latin-1")]
    reader = S.TextCorpusReader({"path": str(corpus), "listing": "tasks"})
    list(reader.pushFilters([EqualTo(("extension",), "pdf")]))
    assert [e[0].rsplit("/", 1)[1] for p in reader.partitions() for e in reader.read(p)] == ["d.pdf"]


def test_small_files_share_a_task():
    assert len(S.packed([S.Entry(f"/{k}", "txt", 2000) for k in range(10_000)], S.TextCorpusReader({"path": "/"}).most, S.TextCorpusReader({"path": "/"}).cost)) < 10
