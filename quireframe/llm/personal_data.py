"""Personal data: exact base patterns, and terms that give protected entities away by their co-occurrence in the corpus.

One pass over whole texts finds the base spans (email, ip, card, phone) and counts, for every term, in how many documents
it stands outside them, and in how many of these that hold an entity of each kind (partial counts per task, summed by
Spark).  For an entity kind c and a term t, ``PMI = log2(p(c, t) / (p(c) p(t)))`` says how strongly t reveals that the
document holds c; ``IC = -log2 p(c)`` is all there is to reveal.  PMI is taken at the lower bound of the Wilson interval of
p(c | t), one-sided at ``Z``, so a rare term counts for what its documents can show.  A term whose bound reaches
``GENERALISE`` of IC is generalised, one that reaches ``REMOVE`` is removed: every occurrence in every document that holds
an entity of that kind, however far from it.  A document without personal data stays as it is.

Defined cases: null and empty texts have no spans; an empty table gives no rows; rows are judged one by one but counted
together, so repeated rows count each; a null ``doc_id`` is carried through; further columns are ignored; a kind that
every document holds is revealed by no term.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireframe.llm.tables import stored

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A part starts a run of digits: what begins inside a run would have begun at its start.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
WORDS = re.compile(r"[^\W\d_]+")
#: Normal quantile of the one-sided 95 % bound on p(c | t).
Z = 1.645
GENERALISE = 0.8
REMOVE = 0.95
#: Terms that a task counts before it hands its counts on.
FLUSH = 100_000

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of EMAIL, looked for around each @ only."""
    done, at = 0, text.find("@")
    while at >= 0:
        a = at
        while a > done and text[a - 1] in LOCAL:
            a -= 1
        if a < at and (m := EMAIL.match(text, a)):
            yield m.span()
            done = m.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[Span]:
    """All base spans as (start, end, kind), by start, then kind as listed."""
    out: list[Span] = [(a, b, "email") for a, b in emails(text)]
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:3] or 0) <= 255 for p in m[0].split(".")):
                out.append((*m.span(), "ip"))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((*m.span(), "card"))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= len(DIGIT.findall(m[0])) <= 15:
                    out.append((*m.span(), "phone"))
    out.sort(key=lambda s: (s[0], KINDS.index(s[2])))
    return out


def terms(text: str, spans: list[Span]) -> Iterator[tuple[str, int, int]]:
    """(term, start, end) of every word that no span touches, in order."""
    covered: list[tuple[int, int]] = []
    for a, b, _ in spans:
        if covered and a <= covered[-1][1]:
            covered[-1] = (covered[-1][0], max(b, covered[-1][1]))
        else:
            covered.append((a, b))
    ends = [b for _, b in covered]
    for m in WORDS.finditer(text):
        i = bisect_right(ends, m.start())
        if i == len(covered) or covered[i][0] >= m.end():
            yield m[0].lower(), *m.span()


MEASURED = "row long, doc_id long, base array<struct<start:int,end:int,kind:string>>, text string, terms array<string>, counted string, kind string, documents long"
_BASE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
_FIELDS = pa.schema([
    ("row", pa.int64()), ("doc_id", pa.int64()), ("base", _BASE), ("text", pa.string()), ("terms", pa.list_(pa.string())),
    ("counted", pa.string()), ("kind", pa.string()), ("documents", pa.int64()),
])


def _rows(n: int, schema: pa.Schema, **columns) -> pa.RecordBatch:
    """A batch of ``n`` rows, null where no column is given."""
    return pa.RecordBatch.from_arrays([pa.nulls(n, f.type) if (c := columns.get(f.name)) is None else c if isinstance(c, pa.Array) else pa.array(c, f.type) for f in schema], schema=schema)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[str, int] = {}
    within: dict[tuple[str, str], int] = {}

    def flush() -> pa.RecordBatch:
        n = len(seen)
        batch = _rows(n + len(within), _FIELDS, counted=[*seen, *(t for t, _ in within)], kind=[None] * n + [k for _, k in within], documents=[*seen.values(), *within.values()])
        seen.clear()
        within.clear()
        return batch

    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            part = batch.slice(a, 256)
            base, texts, stand = [], [], []
            for text in part.column("text").to_pylist():
                text = text or ""
                spans = base_spans(text)
                base.append([{"start": s, "end": e, "kind": k} for s, e, k in spans])
                texts.append(text if spans else None)
                words = {t for t, _, _ in terms(text, spans)} if spans else {w.lower() for w in set(WORDS.findall(text))}
                stand.append(list(words) if spans else None)
                for w in words:
                    seen[w] = seen.get(w, 0) + 1
                for k in {k for _, _, k in spans}:
                    for w in words:
                        within[w, k] = within.get((w, k), 0) + 1
                if len(seen) + len(within) >= FLUSH:
                    yield flush()
            yield _rows(part.num_rows, _FIELDS, row=part.column("row"), doc_id=part.column("doc_id"), base=base, text=texts, terms=stand)
    yield flush()


def measured(docs: DataFrame) -> DataFrame:
    """Rows of two kinds in one stored table: one for each document (base spans, and where it has any its text and terms), and partial term counts (over all documents, and over those with a ``kind``).

    ``row`` names a row within one reading of ``docs``: a hash of id and text, so that it is the same after a task is rerun.
    """
    d = docs.select(F.xxhash64(F.col("doc_id").cast("long"), "text").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stored(d.mapInArrow(_measure, MEASURED), "measured")


def disclosing(m: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE, z: float = Z) -> DataFrame:
    """(term, kind, drop): the terms whose disclosure of a kind exceeds the threshold; ``drop`` where they are removed outright."""
    rows = m.where("counted IS NULL")
    total = rows.agg(F.count("*").cast("double").alias("total"))
    kinds = rows.where(F.size("base") > 0).select(F.explode(F.array_distinct(F.col("base.kind"))).alias("kind")).groupBy("kind").agg(F.count("*").cast("double").alias("n_c"))
    of = lambda kind: F.sum(F.when(kind, F.col("documents"))).cast("double")
    t = m.where("counted IS NOT NULL").groupBy(F.col("counted").alias("term")).agg(of(F.col("kind").isNull()).alias("n_t"), *[of(F.col("kind") == k).alias(k) for k in KINDS])
    t = t.select("term", "n_t", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("n_ct")) for k in KINDS])).alias("c")).select("term", "n_t", "c.kind", "c.n_ct").where("n_ct > 0")
    # one row of totals and at most four of kinds: broadcast is safe at any size
    t = t.join(F.broadcast(kinds), "kind").join(F.broadcast(total))
    n, p = F.col("n_t"), F.col("n_ct") / F.col("n_t")
    sure = (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    pmi = F.log2(sure * F.col("total") / F.col("n_c"))
    ic = F.log2(F.col("total") / F.col("n_c"))
    t = t.withColumn("share", F.when(ic > 0, pmi / ic).otherwise(F.lit(0.0)))
    return t.where(F.col("share") >= generalise).select("term", "kind", (F.col("share") >= remove).alias("drop"))


FOUND = "row long, doc_id long, base array<struct<start:int,end:int,kind:string>>, added array<struct<start:int,end:int,drop:boolean>>"
_FOUND = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("base", _BASE), ("added", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("drop", pa.bool_())])))])


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        added = []
        for text, base, flagged in zip(*(batch.column(c) for c in ("text", "base", "flagged"))):
            if not flagged.is_valid:
                added.append(None)
                continue
            drop = {f["term"]: f["drop"] for f in flagged.as_py()}
            spans = [(s["start"], s["end"], s["kind"]) for s in base.as_py()]
            added.append([{"start": a, "end": b, "drop": drop[t]} for t, a, b in terms(text.as_py(), spans) if t in drop])
        yield _rows(batch.num_rows, _FOUND, row=batch.column("row"), doc_id=batch.column("doc_id"), base=batch.column("base"), added=added)


def found(docs: DataFrame) -> DataFrame:
    """(row, doc_id, base, added): all spans of every row; ``added`` are the occurrences of disclosing terms with ``drop``."""
    m = measured(docs)
    rows = m.where("counted IS NULL")
    flagged = stored(disclosing(m), "disclosing")
    hit = rows.where(F.size("terms") > 0).select("row", F.array_distinct("base.kind").alias("kinds"), F.explode("terms").alias("term")).join(flagged, "term").where(F.array_contains("kinds", F.col("kind")))
    hit = hit.groupBy("row", "term").agg(F.max("drop").alias("drop")).groupBy("row").agg(F.collect_list(F.struct("term", "drop")).alias("flagged"))
    return rows.select("row", "doc_id", "base", "text").join(stored(hit, "hits"), "row", "left").mapInArrow(_mark, FOUND)


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row."""
    f = found(docs)
    tell = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    base = F.array_join(F.transform("base", tell), ",")
    rank = lambda kind: F.array_position(F.array(*map(F.lit, (*KINDS, TERM))), kind)
    added = F.transform(F.coalesce("added", F.array().cast("array<struct<start:int,end:int,drop:boolean>>")), lambda s: F.struct(s["start"].alias("start"), rank(F.lit(TERM)).alias("rank"), s["end"].alias("end"), F.lit(TERM).alias("kind")))
    every = F.array_sort(F.concat(F.transform("base", lambda s: F.struct(s["start"].alias("start"), rank(s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))), added))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return f.select("doc_id", *map(count, KINDS), F.sha2(base, 256).alias("base_sha256"), F.array_join(F.transform(every, tell), ",").alias("spans"))


def sanitised(docs: DataFrame) -> DataFrame:
    """``docs`` with base spans replaced by their kind, disclosing terms generalised or removed, and ``n_chars`` measured anew.

    Overlapping spans are replaced as one, by the kind of the first.
    """
    f = found(docs).where((F.size("base") > 0)).select("row", "base", "added").dropDuplicates(["row"])
    kinds = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">")).alias("put")))
    terms = F.transform(F.coalesce("added", F.array().cast("array<struct<start:int,end:int,drop:boolean>>")), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(s["drop"], "").otherwise("<TERM>").alias("put")))
    f = stored(f.select("row", F.array_sort(F.concat(kinds, terms)).alias("puts")), "puts")
    got = docs.select(F.struct("*").alias("doc"), F.xxhash64(F.col("doc_id").cast("long"), "text").alias("row")).join(f, "row", "left")
    # pieces between replaced spans: a span that begins inside the one before it is merged into it
    merge = lambda s, p: F.when(p["start"] < s["at"], F.struct(F.greatest(s["at"], p["end"]).alias("at"), s["out"].alias("out"))).otherwise(
        F.struct(p["end"].alias("at"), F.concat(s["out"], F.substring(F.col("doc.text"), s["at"] + 1, p["start"] - s["at"]), p["put"]).alias("out")))
    finish = lambda s: F.concat(s["out"], F.substring(F.col("doc.text"), s["at"] + 1, F.length("doc.text")))
    text = F.when(F.col("puts").isNull(), F.col("doc.text")).otherwise(F.aggregate("puts", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), merge, finish))
    got = got.withColumn("clean_text", text)
    new = {"text": F.col("clean_text"), "n_chars": F.coalesce(F.length("clean_text").cast("long"), F.col("doc.n_chars")) if "n_chars" in docs.columns else None}
    return got.select(*[(new[c].alias(c) if c in new else F.col("doc")[c].alias(c)) for c in docs.columns])
