"""Near-duplicate documents: banded MinHash candidates, odd-sketch estimates, exact confirmation, connected components.

1. ``signatures`` measures each whole text: its set of five-word shingles (64-bit hashes), a digest of the set, MinHash
   samples in bands, and the odd sketch: every sample toggles one bit of a bitmap, so the number of ones in the XOR of
   two bitmaps estimates how many samples differ, most precisely where similarity is high.
2. Documents with one and the same set are one class and go on as one representative.
3. Within a bucket (equal band) every member meets one hub, the member with the smallest hash in one of a few orders: never all pairs.  Each
   document's two best hubs by estimate are confirmed on the full sets, and the links give first components.
4. What a hub could have missed lies between different components of one bucket: there, members outside the bucket's
   largest component meet the others in a join whose condition holds the component, size and odd-sketch tests, the last
   of them on sketches of the full sets, which no link fails: little more than links comes out.  They are confirmed in
   the same way.

Defined cases: null, empty and word-less texts have an empty set and stand alone; a text with fewer than five words is
one shingle; sets are matched, not ids: a component is named by its smallest id, so rows that share an id but not a set
are judged one by one, and a row without ``doc_id`` takes part like any other (its component is null where no row of it
has an id, and then it is kept); further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from quireframe.llm import bytesops as B
from quireframe.llm.components import components
from quireframe.llm.tables import discard, stored, text_key

SHINGLE = 5
BANDS, ROWS = 24, 5
#: Orders by which hubs are chosen: bands that share one mostly share their hubs too, so a member meets few different ones.
ORDERS = 4
SAMPLES = 256
BITS = 1024
LONGS = BITS // 64
#: Shingles whose samples are drawn together: bounds the temporary matrix.
BLOCK = 2048
_rng = np.random.Generator(np.random.PCG64(85))
_MUL = (_rng.integers(0, 2**31, SAMPLES, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[None, :]
_ADD = _rng.integers(0, 2**32, SAMPLES, dtype=np.uint32)[None, :]
_COMBINE = _rng.integers(1, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _rng.integers(1, 2**63, (BANDS, ROWS), dtype=np.uint64)
_TURN = _rng.integers(0, 2**32, SAMPLES, dtype=np.uint64) << np.uint64(32)


def shingles(buf: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row of a slice."""
    w = B.words(buf, off)
    h = B.span_hash(B.prefix_hash(buf, B.BYTE_HASH_LOWER), w.start, w.end)
    n = h.size
    padded = np.concatenate([h, np.zeros(SHINGLE - 1, np.uint64)])
    five = np.zeros(n, np.uint64)
    for i in range(SHINGLE):
        five += padded[i : i + n] * _COMBINE[i]
    five = B.mix(five)
    out = []
    for a, b in zip(w.first[:-1], w.first[1:]):
        if b - a >= SHINGLE:
            out.append(np.unique(five[a : b - SHINGLE + 1]))
        elif b > a:
            short = (h[a:b] * _COMBINE[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.array([b - a], np.uint64) * np.uint64(0xA0761D6478BD642F)
            out.append(B.mix(short))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def minhash(s: np.ndarray) -> np.ndarray:
    """SAMPLES minima over a non-empty set."""
    x = (s >> np.uint64(32)).astype(np.uint32)[:, None]
    low = np.full(SAMPLES, 2**32 - 1, np.uint32)
    for a in range(0, x.shape[0], BLOCK):
        m = x[a : a + BLOCK] * _MUL
        m += _ADD
        np.minimum(low, m.min(0), out=low)
    return low


def odd_sketch(m: np.ndarray) -> np.ndarray:
    """Parity bitmaps (rows by LONGS) of the samples of each row of ``m``."""
    bit = (B.mix(m.astype(np.uint64) ^ _TURN[None, :]) >> np.uint64(40)).astype(np.int64) % BITS
    rows = np.arange(m.shape[0])[:, None] * BITS
    odd = np.bincount((rows + bit).ravel(), minlength=m.shape[0] * BITS).astype(np.uint8) & 1
    return np.packbits(odd.reshape(m.shape[0], BITS), axis=1).view(np.int64)


def band_keys(m: np.ndarray) -> np.ndarray:
    x = (m[:, : BANDS * ROWS].astype(np.uint64).reshape(-1, BANDS, ROWS) + np.uint64(1)) * _BAND[None]
    return B.mix(x.sum(2, dtype=np.uint64)).view(np.int64)


SIGNATURE = "doc_id long, k1 long, k2 long, n long, g1 long, g2 long, bands array<long>, sketch array<long>"


def _lists(x: np.ndarray, empty: np.ndarray) -> pa.Array:
    """Rows of a matrix as list values; an empty list where ``empty``."""
    size = np.where(empty, 0, x.shape[1])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(x[~empty].ravel()))


def _texts(docs: DataFrame) -> DataFrame:
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.select("doc_id", *text_key(), "text")


def signatures(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: text key, set size, set digest, band keys and odd sketch (both empty for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            for a, b in B.slices(text):
                sets = shingles(*B.buffers(text.slice(a, b - a)))
                n = np.array([s.size for s in sets], np.int64)
                g1 = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64)
                g2 = np.array([np.bitwise_xor.reduce(B.mix(s + np.uint64(99))) if s.size else 0 for s in sets], np.uint64)
                m = np.stack([minhash(s) if s.size else np.zeros(SAMPLES, np.uint32) for s in sets])
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in ("doc_id", "k1", "k2")), pa.array(n), pa.array(g1.view(np.int64)), pa.array(g2.view(np.int64)), _lists(band_keys(m), n == 0), _lists(odd_sketch(m), n == 0)],
                                                 names=["doc_id", "k1", "k2", "n", "g1", "g2", "bands", "sketch"])

    return _texts(docs).mapInArrow(run, SIGNATURE)


def most_differing(similarity: float) -> int:
    """The largest number of ones in an XOR of sketches that a pair of this similarity shows but for odds below 10^-7.

    Samples differ like coin throws with probability 1 - similarity; five standard deviations more are let through, each
    differing sample toggles two bits, and two more deviations allow for the folding.
    """
    d = SAMPLES * (1 - similarity) + 5 * np.sqrt(SAMPLES * similarity * (1 - similarity))
    ones = BITS / 2 * (1 - np.exp(-4 * d / BITS))
    return int(ones + 2 * (2 * d) * np.sqrt(2 / BITS)) + 1


def _may_link(percent: int) -> Column:
    """Size and odd-sketch tests on columns n1, n2, s1, s2."""
    ones = sum((F.bit_count(F.element_at("s1", i).bitwiseXOR(F.element_at("s2", i))) for i in range(1, LONGS + 1)), F.lit(0))
    return (F.least("n1", "n2") * 100 >= F.greatest("n1", "n2") * percent) & (ones <= most_differing(percent / 100))


def set_sketches(texts: DataFrame) -> DataFrame:
    """(node, whole): an odd sketch of each full shingle set, with four bits or more for each shingle.

    A shingle toggles one bit, so the ones in the XOR of two such sketches never outnumber the sets' difference: a pair
    with more ones than a link's difference may have is none, without any odds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            for a, b in B.slices(text):
                whole = []
                for s in shingles(*B.buffers(text.slice(a, b - a))):
                    bits = max(BITS, 1 << (4 * s.size - 1).bit_length())
                    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1
                    whole.append(np.packbits(odd, bitorder="little").view("<i8"))
                offsets = np.concatenate([[0], np.cumsum([x.size for x in whole])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(a, b - a), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(whole)))], names=["node", "whole"])

    return texts.mapInArrow(run, "node long, whole array<long>")


#: Ones in the XOR of w1 and w2, the longer one folded to the length of the other (sizes of a pair differ by less than twice).
_FOLD = "if(size({0}) > size({1}), zip_with(slice({0}, 1, size({1})), slice({0}, size({1}) + 1, size({1})), (x, y) -> x ^ y), {0})"
DIFFERENCE = f"aggregate(zip_with({_FOLD.format('w1', 'w2')}, {_FOLD.format('w2', 'w1')}, (x, y) -> bit_count(x ^ y)), 0, (t, x) -> t + x)"


def _linkable(percent: int) -> Column:
    """The exact bound on the difference of the sets, on columns n1, n2, w1, w2; tried where the cheaper tests pass."""
    most = F.floor((F.col("n1") + F.col("n2")) * (100 - percent) / (100 + percent))
    return F.when(_may_link(percent), F.expr(DIFFERENCE) <= most).otherwise(False)


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the threshold; ``texts`` holds (node, text) once for each node."""
    one = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
    two = one.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                left, right = shingles(*B.buffers(part.column("ta"))), shingles(*B.buffers(part.column("tb")))
                for x, y in zip(left, right):
                    both = np.intersect1d(x, y, assume_unique=True).size
                    keep.append(100 * both >= percent * (x.size + y.size - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return two.mapInArrow(run, "a long, b long")


def _judged(docs: DataFrame, percent: int) -> DataFrame:
    """(doc_id, k1, k2, g1, g2, n, component_id, kept) of every row of ``docs``."""
    sig = stored(signatures(docs), "signatures")
    # bands and sketch follow from the set: those of any row; its text is that of the row with the smallest id
    reps = sig.where("n > 0").groupBy("g1", "g2", "n").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")).alias("r"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    reps = stored(reps.select(F.xxhash64("g1", "g2", "n").alias("node"), "g1", "g2", "n", F.col("r.doc_id").alias("rep"), "r.k1", "r.k2", "bands", "sketch"), "representatives")
    banded = reps.select("node", F.posexplode("bands").alias("band", "bucket")).select("node", "bucket", F.expr(f"band DIV {BANDS // ORDERS}").alias("turn"))
    hubs = banded.groupBy("bucket").agg(F.count("*").alias("members"), F.min(F.struct(F.xxhash64("turn", "node").alias("h"), "node")).alias("hub"))
    hubs = stored(hubs.where("members > 1").select("bucket", F.col("hub.node").alias("hub")), "hubs")
    members = stored(banded.select("node", "bucket").join(hubs, "bucket"), "members")
    held = members.select("node").distinct()
    # one row's text for each node: found by id and text, so that a hot text is not gathered
    named_by = F.coalesce("doc_id", "k1").alias("by")
    held = reps.join(held, "node", "left_semi").select("node", F.coalesce("rep", "k1").alias("by"), "k1", "k2")
    texts = stored(_texts(docs).select(named_by, "k1", "k2", "text").join(held, ["by", "k1", "k2"]).select("node", "text").dropDuplicates(["node"]), "texts")
    sketches = stored(reps.select("node", "n", "sketch").join(set_sketches(texts), "node"), "sketches")

    side = lambda i, key: sketches.select(F.col("node").alias(key), F.col("n").alias(f"n{i}"), F.col("sketch").alias(f"s{i}"), F.col("whole").alias(f"w{i}"))
    met = members.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    met = met.join(side(1, "a"), "a").join(side(2, "b"), "b").where(_linkable(percent)).select("a", "b", F.expr(DIFFERENCE).alias("ones"))
    best = met.select("a", "b", F.row_number().over(Window.partitionBy("a").orderBy("ones", "b")).alias("r")).where("r <= 2").select("a", "b")
    best = stored(best, "best")
    links = stored(confirmed(best, texts, percent), "links")
    first = stored(components(links), "first")
    discard(best, links, hubs)

    lone = members.select("bucket", "node").join(first.select("node", "component"), "node", "left")
    lone = stored(lone.select("bucket", "node", F.coalesce("component", "node").alias("component")), "labelled")
    split = lone.groupBy("bucket", "component").agg(F.count("*").alias("c")).groupBy("bucket").agg(F.count("*").alias("parts"), F.max(F.struct("c", "component")).alias("top"))
    split = stored(split.where("parts > 1").select("bucket", F.col("top.component").alias("top")), "split")
    rest = stored(lone.join(split, "bucket").join(sketches, "node"), "rest")
    x = rest.where("component <> top").select("bucket", F.col("node").alias("a"), F.col("component").alias("ca"), F.col("n").alias("n1"), F.col("sketch").alias("s1"), F.col("whole").alias("w1"))
    y = rest.select("bucket", F.col("node").alias("b"), F.col("component").alias("cb"), F.col("top").alias("tb"), F.col("n").alias("n2"), F.col("sketch").alias("s2"), F.col("whole").alias("w2"))
    # a pair of two members outside the largest component is met once, from its smaller id
    again = x.join(y, (x["bucket"] == y["bucket"]) & (F.col("ca") != F.col("cb")) & ((F.col("cb") == F.col("tb")) | (F.col("a") < F.col("b"))) & _linkable(percent))
    again = again.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    again = stored(again, "again")
    more = stored(confirmed(again, texts, percent), "more")
    joined = stored(components(first.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more)), "components")

    ids = joined.join(reps.select("node", "rep"), "node").groupBy("component").agg(F.min("rep").alias("component_id"))
    ids = joined.join(stored(ids, "ids"), "component").select("node", F.lit(True).alias("linked"), "component_id")
    named = reps.select("node", "g1", "g2", "n", "rep").join(stored(ids, "linked"), "node", "left")
    named = stored(named.select("g1", "g2", "n", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("rep")).alias("component_id")), "named")
    discard(again, more, rest, split, lone, first, joined, members, sketches, texts, reps)
    out = sig.select("doc_id", "k1", "k2", "n", "g1", "g2").join(named, ["g1", "g2", "n"], "left")
    out = out.withColumn("component_id", F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs``."""
    return _judged(docs, percent).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "kept")


def keep_first(docs: DataFrame, percent: int = 85) -> DataFrame:
    """``docs`` without near-duplicates: the document with the smallest id of each component stays, rows of one id and set once.

    Rows without ``doc_id`` stay as they are.
    """
    kept = _judged(docs, percent).where("kept AND doc_id IS NOT NULL").groupBy("doc_id", "g1", "g2", "n").agg(F.min(F.struct("k1", "k2")).alias("k"))
    kept = stored(kept.select(F.col("doc_id").alias("__id"), F.col("k.k1").alias("__k1"), F.col("k.k2").alias("__k2")).distinct(), "kept")
    keys = dict(zip(("__id", "__k1", "__k2"), (F.col("doc_id").cast("long"), *text_key())))
    found = docs.withColumns(keys).join(kept, list(keys), "left_semi").dropDuplicates(list(keys))
    return found.select(*docs.columns).union(docs.where("doc_id IS NULL"))
