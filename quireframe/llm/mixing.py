"""Mixing sources to target weights by Efraimidis-Spirakis sampling, with DataFrame functions only.

Each source has a target in words.  Whole passes over the source (epochs) come first; what then remains of the target is
filled in the order of the sampling keys ``-ln(u) / w`` (u: a hash of the document's id, w: its quality weight), by a
running sum of sizes up to the target; the document at the boundary is taken in part.

The running sum is done in two levels, so that one source with a third of all rows is not one task: keys are cut into
logarithmic buckets, sums per (source, bucket) give each bucket its offset, and only rows inside a bucket are ordered.
The per-source table (one narrow row for each source) is the only thing that is ordered as a whole.

Defined cases: a null text has size 0; a null source is a source of its own, ranked last; a null ``doc_id`` hashes like
the empty string; equal keys are ordered by id, then size; repeated rows count each; sources without words get target 0;
an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quireframe.llm.tables import WORD, stored

#: Weights of the sources in code point order, repeating (fixed values).
WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
#: Characters that lower a document's quality weight.
NOISE = "#*$%&|<>!0123456789{}[]=_~^\\"
#: Buckets for each doubling of the sampling key.
RESOLUTION = 64


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """1 for plain prose, towards 0.05 as noise characters take over: a document of low weight is sampled late."""
    n = F.length(text)
    noise = (n - F.length(F.translate(text, NOISE, ""))).cast("double") / F.greatest(n, F.lit(1))
    return F.coalesce(F.greatest(F.lit(1.0) - F.lit(4.0) * noise, F.lit(0.05)), F.lit(0.05))


def uniform(doc_id: Column, seed: int) -> Column:
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(2.0**52)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(src, none, source_size, target) from (src, none, source_size): shares by weight, none above ``cap`` times its size.

    Ordered by cap / weight, the capped sources come first; the level of the others follows from running sums.
    """
    by_name, by_ratio, whole = Window.orderBy("none", "src"), Window.orderBy("ratio", "none", "src"), Window.partitionBy()
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")).cast("double")
    t = sizes.withColumn("w", w).withColumn("most", F.col("source_size").cast("double") * cap).withColumn("ratio", F.col("most") / F.col("w"))
    t = t.withColumn("level", (F.sum(F.col("source_size")).over(whole).cast("double") * share - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    t = t.withColumn("at", F.row_number().over(by_ratio)).withColumn("full", F.col("ratio") <= F.col("level"))
    t = t.withColumn("fit", F.min(F.when(~F.col("full"), F.struct("at", "level"))).over(whole))
    return t.select("src", "none", "source_size", F.when(F.col("full") | F.col("fit").isNull(), F.col("most")).otherwise(F.col("fit.level") * F.col("w")).alias("target"))


def mix(docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP, seed: int = 17, resolution: int = RESOLUTION, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row, and the columns to ``carry``."""
    d = docs.select(F.col("doc_id"), *carry, F.coalesce(F.col("source"), F.lit("")).alias("src"), F.col("source").isNull().alias("none"), size_of(F.col("text")).alias("size"),
                    (-F.log(uniform(F.col("doc_id"), seed)) / quality_weight(F.col("text"))).alias("key"))
    d = stored(d.withColumn("bucket", F.floor(F.log2(F.col("key") * 1048576.0 + 1.0) * resolution).cast("int")), "mix")
    buckets = d.groupBy("src", "none", "bucket").agg(F.sum("size").alias("words"))
    plan = targets(buckets.groupBy("src", "none").agg(F.sum("words").alias("source_size")), weights, share, cap)
    plan = plan.withColumn("goal", F.round("target").cast("long")).withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("goal DIV source_size")).otherwise(0).cast("long"))
    plan = plan.withColumn("rest", F.col("goal") - F.col("epochs") * F.col("source_size"))
    ahead = Window.partitionBy("src", "none").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.withColumn("ahead", F.coalesce(F.sum("words").over(ahead), F.lit(0))).join(plan, ["src", "none"])
    inside = Window.partitionBy("src", "none", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = d.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(offsets.drop("words"), ["src", "none", "bucket"])
    part = F.least(F.greatest(F.col("rest") - F.col("ahead") - F.col("inner"), F.lit(0)), F.col("size"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"), *carry)


def sql(weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP, seed: int = 17) -> str:
    """The same rows in DuckDB."""
    noise = NOISE.replace("'", "''")
    return rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS src, source IS NULL AS none, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
  -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':{seed}'), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496::DOUBLE)
   / coalesce(greatest(1::DOUBLE - 4::DOUBLE * ((length(text) - length(translate(text, '{noise}', '')))::DOUBLE / greatest(length(text), 1)), 0.05::DOUBLE), 0.05::DOUBLE) AS key FROM documents),
s AS (SELECT src, none, sum(size)::BIGINT AS source_size FROM d GROUP BY ALL),
w AS (SELECT *, [{', '.join(f'{x}' for x in weights)}][((row_number() OVER (ORDER BY none, src) - 1) % {len(weights)})::INT + 1]::DOUBLE AS w FROM s),
r AS (SELECT *, source_size::DOUBLE * {cap} AS most, source_size::DOUBLE * {cap} / w AS ratio FROM w),
l AS (SELECT *, row_number() OVER o AS pos, ((sum(source_size) OVER ())::DOUBLE * {share}::DOUBLE - coalesce(sum(most) OVER (ORDER BY ratio, none, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / ((sum(w) OVER ()) - coalesce(sum(w) OVER (ORDER BY ratio, none, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM r WINDOW o AS (ORDER BY ratio, none, src)),
f AS (SELECT arg_min(level, pos) FILTER (WHERE NOT ratio <= level) AS level FROM l),
p AS (SELECT src, none, source_size, CASE WHEN ratio <= l.level OR f.level IS NULL THEN most ELSE f.level * w END AS target FROM l, f),
g AS (SELECT *, round(target)::BIGINT AS goal, CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS epochs FROM p),
c AS (SELECT d.*, coalesce(sum(size) OVER (PARTITION BY src, none ORDER BY key, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d)
SELECT doc_id, size, source_size, target, (epochs * size + least(greatest(goal - epochs * source_size - before, 0), size))::BIGINT AS taken FROM c JOIN g USING (src, none)"""


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus as rows of ``docs``: a document once for each whole epoch, and its first words where a part of it is taken.

    Shares go back to the documents by a hash of id, source and text; repeated rows have one hash and share evenly.
    """
    share_id = F.xxhash64("doc_id", "source", "text").alias("share_id")
    s = mix(docs.select("doc_id", "source", "text", share_id), carry=("share_id",), **options).groupBy("share_id").agg(F.max("size").alias("size"), F.floor(F.sum("taken") / F.count("*")).cast("long").alias("share"))
    got = docs.select(F.struct("*").alias("doc"), share_id).join(stored(s.where("share > 0"), "shares"), "share_id")
    got = got.withColumn("whole", F.expr("CAST(share DIV size AS INT)")).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("whole"))))
    got = got.withColumn("left", F.when(F.col("copy") < F.col("whole"), F.col("size")).otherwise(F.col("share") - F.col("whole") * F.col("size"))).where("left > 0")
    words = F.split(F.trim(F.regexp_replace("doc.text", r"[\x20\x09-\x0D]+", " ")), " ")
    text = F.when(F.col("left") < F.col("size"), F.array_join(F.slice(words, F.lit(1), F.col("left").cast("int")), " ")).otherwise(F.col("doc.text"))
    got = got.withColumn("mixed_text", text)
    new = {"text": F.col("mixed_text"), "n_chars": F.coalesce(F.length("mixed_text").cast("long"), F.col("doc.n_chars")) if "n_chars" in docs.columns else None}
    return got.select(*[(new[c].alias(c) if c in new else F.col("doc")[c].alias(c)) for c in docs.columns])
