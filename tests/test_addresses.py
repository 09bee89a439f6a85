"""Canonical addresses against a table of fixed pairs."""

import pytest
from pyspark.sql import functions as F

from quireframe.functions.addresses import canonical_url

PAIRS = [
    ("http://Example.COM", "http://example.com/"), (" HTTPS://x.y:443/a ", "https://x.y/a"), ("http://x.y:0080/", "http://x.y/"), ("http://x.y:8080", "http://x.y:8080/"), ("https://x.y:80/", "https://x.y:80/"),
    ("ht\ntp:\\\\x.y\\a\\..\\b", "http://x.y/b"), ("http:x.y", "http://x.y/"), ("http:////x.y//a", "http://x.y//a"), ("http://x.y/a/./b/../c/.", "http://x.y/a/c/"), ("http://x.y/a/%2E%2e/b/..", "http://x.y/"),
    ("http://x.y/..", "http://x.y/"), ("http://x.y/../../z", "http://x.y/z"), ("http://x.y/a b\"<>`{}^|'~", "http://x.y/a%20b%22%3C%3E%60%7B%7D%5E|'~"), ("http://x.y?a b'\"<>#c d`", "http://x.y/?a%20b%27%22%3C%3E#c%20d%60"),
    ("http://x.y/ñ?ü#é", "http://x.y/%C3%B1?%C3%BC#%C3%A9"), ("http://x.y/%41%zz", "http://x.y/%41%zz"), ("http://bücher.de/", "http://xn--bcher-kva.de/"), ("http://%65xample.com", "http://example.com/"),
    ("http://127.1", "http://127.0.0.1/"), ("http://0x7f.0.0.1/", "http://127.0.0.1/"), ("http://0177.0.0.01/", "http://127.0.0.1/"), ("http://2130706433/", "http://127.0.0.1/"), ("http://1.2.3.4./", "http://1.2.3.4/"),
    ("http://256.1.1.1/", None), ("http://1.2.3.4.5/", None), ("http://1.2.3.08/", None), ("http://4294967296/", None), ("http://a.b.0x", None),
    ("http://[::1]:80/", "http://[::1]/"), ("http://[2001:DB8:0:0:1:0:0:1]", "http://[2001:db8::1:0:0:1]/"), ("http://[1:0:0:2:0:0:0:3]", "http://[1:0:0:2::3]/"), ("http://[::ffff:1.2.3.4]/", "http://[::ffff:102:304]/"),
    ("http://[0:0:0:0:0:0:0:0]/", "http://[::]/"), ("http://[1:2:3]/", None), ("http://[1::2::3]/", None), ("http://[12345::]/", None), ("http://[::1.2.3.400]/", None),
    ("http://u:p@x.y/", "http://u:p@x.y/"), ("http://u@:p@x.y", "http://u%40:p@x.y/"), ("http://:@x.y/", "http://x.y/"), ("http://u:@x.y/", "http://u@x.y/"),
    ("http://x.y:99999/", None), ("http://a b/", None), ("http://a%20b/", None), ("http:///", None), ("ftp://x.y", None), ("x.y", None), ("", None), (None, None),
    ("MAILTO:A b@X.org?subject=a b\"", "mailto:A b@X.org?subject=a%20b%22"), ("mailto:ñ@x", "mailto:%C3%B1@x"), ("http://x.y/‮", "http://x.y/%E2%80%AE"), ("http://x.y/?#", "http://x.y/?#"), ("http://x.y#\\a", "http://x.y/#\\a"),
]


def test_canonical_addresses(spark):
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(PAIRS)], "i int, u string")
    got = {r["i"]: r["c"] for r in df.select("i", canonical_url(F.col("u")).alias("c")).collect()}
    assert [(a, got[i]) for i, (a, _) in enumerate(PAIRS) if got[i] != PAIRS[i][1]] == []


def test_canonical_addresses_stay(spark):
    df = spark.createDataFrame([(b,) for _, b in PAIRS if b], "u string")
    assert df.where(canonical_url(F.col("u")) != F.col("u")).count() == 0


@pytest.mark.parametrize("url", ["http://x.y/a/../b", "HTTP://X.y"])
def test_what_is_shown_is_what_opens(spark, url):
    from quireframe.functions.links import link_decision

    d = spark.createDataFrame([(url,)], "u string").select(link_decision(F.col("u")).alias("d"), canonical_url(F.col("u")).alias("c")).first()
    assert d["d"]["shown"] == d["c"] == d["d"]["url"]
