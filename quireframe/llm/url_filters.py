"""URL filters: host rules first, boosted trees on lexical features for the URLs that no rule decides.

The trees (``gbt``) are trained on URLs that the rules label, a bounded sample of them (``SAMPLE``, by hash of the URL).
Features are measured on whole URLs in Arrow batches: length, depth, digit ratio, entropy, parameter counts and the like,
and statistics of the host's suffixes (last label, last two labels) counted over all rows: how common a suffix is and
how often the rules block it.

Defined cases: a null URL or one without ``://`` has an empty host and path and no rule; without labelled URLs every
undecided URL is allowed; rows are judged one by one; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quireframe.llm import bytesops as B
from quireframe.llm import gbt
from quireframe.llm.tables import stored

#: (rule, verdict), as the filter list states them (fixed values).
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
SAMPLE = 20_000
THRESHOLD = 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEXICAL = ("length", "host_length", "depth", "digit_ratio", "entropy", "parameters", "labels", "hyphens", "longest_part", "other_ratio", "secure", "fragment")
SUFFIX = ("s1_rows", "s1_blocked", "s2_rows", "s2_blocked")


def split(url: Column) -> tuple[Column, Column]:
    """(host, path)."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; both null where none does."""
    found, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, says in sorted(rules, key=lambda r: len(r[0])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")
        found, verdict = F.when(fits, rule).otherwise(found), F.when(fits, says).otherwise(verdict)
    return found, verdict


def lexical(url: pa.Array, host: pa.Array) -> np.ndarray:
    """LEXICAL features of whole URLs."""
    buf, off = B.buffers(url)
    rows = off.size - 1
    size = np.maximum(np.diff(off), 1).astype(float)
    _, host_off = B.buffers(host)
    host_size = np.diff(host_off)
    count = lambda mask: B.per_row(mask, off)
    row = np.repeat(np.arange(rows), np.diff(off))
    hist = np.zeros((rows, 128))
    np.add.at(hist, (row, buf & 127), 1)
    p = hist / size[:, None]
    entropy = -(p * np.log2(np.where(p > 0, p, 1))).sum(1)
    letter = ((buf | 32) >= 97) & ((buf | 32) <= 122)
    digit = (buf >= 48) & (buf <= 57)
    # longest run of letters and digits
    word = letter | digit
    edge = np.zeros(buf.size + 1, bool)
    edge[off] = True
    longest = np.zeros(rows)
    if buf.size:
        a = word.copy()
        a[1:] &= ~word[:-1] | edge[1 : buf.size]
        b = word.copy()
        b[:-1] &= ~word[1:] | edge[1 : buf.size]
        start = np.flatnonzero(a)
        np.maximum.at(longest, row[start], np.flatnonzero(b) + 1 - start)
    head = np.array([u is not None and u[:6].lower() == "https:" for u in url.to_pylist()], float)
    labels = B.per_row(B.buffers(host)[0] == 46, host_off)
    return np.stack([size, host_size, count(buf == 47), count(digit) / size, entropy, count(buf == 61) + count(buf == 38), labels, count(buf == 45), longest, count(~word) / size, head, count(buf == 35)], 1).astype(float)


def parsed(pages: DataFrame) -> DataFrame:
    """(page_id, url, host, path, rule, said, and the statistics of the host's suffixes)."""
    host, path = split(F.col("url").cast("string"))
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), host.alias("host"), path.alias("path"))
    rule, said = rule_of(F.col("host"), F.col("path"))
    p = stored(p.select("*", rule.alias("rule"), said.alias("said"), F.regexp_extract("host", r"[^.]*$", 0).alias("s1"), F.regexp_extract("host", r"([^.]*\.)?[^.]*$", 0).alias("s2")), "parsed")
    for s in ("s1", "s2"):
        stats = p.groupBy(s).agg(F.log1p(F.count("*")).alias(f"{s}_rows"), ((F.count_if(F.col("said") == "block") + 1) / (F.count("said") + 2)).alias(f"{s}_blocked"))
        p = p.join(stored(stats, f"suffix-{s}"), s)
    return p.drop("s1", "s2")


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.concatenate([lexical(batch.column("url"), batch.column("host")), np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in SUFFIX], 1)], 1)


def train(p: DataFrame, rows: int = SAMPLE) -> gbt.Trees | None:
    """Trees that score how likely a URL is to be blocked; None without labelled URLs."""
    some = p.where("said IS NOT NULL").orderBy(F.xxhash64("url"), "page_id").limit(rows).select("url", "host", "said", *SUFFIX).toPandas()
    if not len(some):
        return None
    batch = pa.RecordBatch.from_pandas(some, preserve_index=False)
    return gbt.fit(_matrix(batch), (some["said"] == "block").to_numpy(float))


def judge(pages: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every row."""
    p = parsed(pages)
    model = train(p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                score = np.zeros(part.num_rows) if model is None else model.score(_matrix(part))
                own = np.where(score >= threshold, "block", "allow")
                verdict = [s or o for s, o in zip(part.column("said").to_pylist(), own)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("page_id", "host", "path", "rule")), pa.array(verdict, pa.string()), pa.array(score)], names=["page_id", "host", "path", "rule", "verdict", "score"])

    return p.select("page_id", "url", "host", "path", "rule", "said", *SUFFIX).mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, score double")
