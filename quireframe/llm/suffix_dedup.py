"""Repeated byte strings across a corpus, found by interval expansion on Burrows-Wheeler transforms of its shards.

Which strings can meet is settled first.  Every string of ``n`` bytes is assigned to an anchor: the K-gram inside it with
the smallest hash.  Equal strings have equal anchors, so a string is judged among the segments (the bytes of all strings
of one anchor occurrence) that share its anchor's hash, its family.

1. One pass over whole texts lists the anchor occurrences: family, hash of the segment, place.  Families with one
   occurrence hold no repeat and end here.
2. A segment that occurs twice as a whole is repeated as a whole.  Of each different segment one copy goes on.
3. Families are packed into shards of bounded size.  A shard's suffixes are sorted to depth n, its Burrows-Wheeler
   transform is extended backwards breadth first from all intervals of one symbol: the boundaries between neighbouring
   suffixes get their common prefix lengths in increasing order, and the expansion stops at n.  A boundary never reached
   separates two suffixes that share n bytes or more.
4. Families of more than ``FAMILY`` different segments (a passage in very many surroundings) would not fit a shard.  Their
   segments are cut on a grid around the anchor into pieces whose strings share a longer core, pieces of one core form a
   family of their own, and these go through steps 2 to 4 again on a finer grid, down to single strings.  Nothing is dropped.
5. Repeated ranges go back to all occurrences, and from there to the texts.

Texts are named by two hashes of their content, so copies are carried once through steps 2 to 5.  Defined cases: null and
empty texts have no bytes; texts shorter than n are kept whole; repeated rows repeat each other and are removed in all
but their last n - 1 bytes at most (in full, if at least n bytes long); a null ``doc_id`` is carried through; further
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireframe.llm import bytesops as B
from quireframe.llm.tables import discard, stored, text_key

#: Bytes of an anchor's K-gram; n must be larger.
K = 48
#: Different segments of a family that one shard takes at most; bytes of a shard, unless one family is larger.
FAMILY, SHARD_BYTES = 512, 1 << 20
#: Cells of the grids on which the segments of large families are cut, one after the other; the last has one string a cell.
GRIDS = (8, 64, None)


def suffix_order(codes: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes in order, decided to ``depth`` symbols at least, by doubling; only undecided groups are sorted again."""
    n = codes.size
    c = np.concatenate([codes, np.zeros(3, codes.dtype)]).astype(np.uint64)
    key = c[:n] << np.uint64(48) | c[1 : n + 1] << np.uint64(32) | c[2 : n + 2] << np.uint64(16) | c[3 : n + 3]
    sa = np.argsort(key, kind="stable")
    k = key[sa]
    first = np.append(True, k[1:] != k[:-1])
    rank = np.empty(n, np.int64)
    group = np.flatnonzero(first)[np.cumsum(first) - 1]
    rank[sa] = group
    h = 4
    while h < depth:
        alone = first & np.append(first[1:], True)
        at = np.flatnonzero(~alone)
        if not at.size:
            break
        sub = sa[at]
        key = rank[sub] * n + rank[sub + h]
        o = np.argsort(key, kind="stable")
        sub, key = sub[o], key[o]
        sa[at] = sub
        new = np.append(True, key[1:] != key[:-1])
        first[at] = new
        rank[sub] = at[np.flatnonzero(new)[np.cumsum(new) - 1]]
        h *= 2
    return sa


def expand(codes: np.ndarray, n: int) -> np.ndarray:
    """For each position: does a string of n symbols that starts there also start elsewhere?

    ``codes`` ends with a symbol of its own, and symbols that occur once separate what must not be matched across.
    """
    size = codes.size
    sa = suffix_order(codes, n)
    place = np.empty(size, np.int64)
    place[sa] = np.arange(size)
    before = sa - 1  # the first position's symbol before is the last one
    bwt = codes[before].astype(np.int64)
    lf = place[before]
    known = np.zeros(size + 1, bool)
    known[[0, size]] = True
    heads = codes[sa]
    ends = np.append(np.flatnonzero(heads[1:] != heads[:-1]) + 1, size)
    known[ends] = True
    low, high = np.append(0, ends[:-1]), ends
    symbols = int(codes.max()) + 1
    for _ in range(1, n):
        if not low.size:
            break
        width = high - low
        one = width == 1
        new_low, new_high = lf[low[one]], lf[low[one]] + 1
        if not one.all():
            low, width = low[~one], width[~one]
            stop = np.cumsum(width)
            which = np.repeat(np.arange(low.size), width)
            rows = np.arange(stop[-1]) - np.repeat(stop - width, width) + low[which]
            key = which * symbols + bwt[rows]
            o = np.argsort(key, kind="stable")
            key, to = key[o], lf[rows[o]]
            start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            new_low = np.concatenate([new_low, np.minimum.reduceat(to, start)])
            new_high = np.concatenate([new_high, np.maximum.reduceat(to, start) + 1])
        fresh = ~known[new_high]
        low, high = new_low[fresh], new_high[fresh]
        known[high] = True
    out = np.zeros(size, bool)
    out[sa[~known[:-1] | ~known[1:]]] = True
    return out


def repeated_starts(segments: list[bytes], n: int) -> list[np.ndarray]:
    """For each segment: which of its strings of n bytes start elsewhere too."""
    m = len(segments)
    sizes = np.array([len(s) + 1 for s in segments])
    ends = np.cumsum(sizes)
    codes = np.empty(int(ends[-1]), np.int32)
    buf = np.frombuffer(b"\0".join(segments) + b"\0", np.uint8)
    codes[:] = buf
    codes += m
    codes[ends - 1] = np.arange(m)
    again = expand(codes, n)
    return [again[e - s : e - n] if s > n else np.zeros(0, bool) for s, e in zip(sizes, ends)]


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    step = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def anchors(buf: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
    """(row, family, segment hash, start, anchor, strings) of the anchor occurrences of a slice; start is counted from the
    row's first byte, anchor from the segment's."""
    none = np.zeros(0, np.int64)
    width = n - K + 1
    if buf.size < n:
        return none, none, none, none, none, none
    s = B.prefix_hash(buf)
    _, inverse = B.powers(s.size)
    at = np.arange(buf.size - K + 1)
    gram = B.mix((s[K:] - s[:-K]) * inverse[: at.size])
    packed = (gram >> np.uint64(32) << np.uint64(32)) | at.astype(np.uint64)
    count = packed.size - width + 1  # string starts of the slice, those across rows included
    blocks = -(-packed.size // width)
    p = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    p[: packed.size] = packed
    p = p.reshape(blocks, width)
    ahead = np.minimum.accumulate(p, 1).ravel()
    behind = np.minimum.accumulate(p[:, ::-1], 1)[:, ::-1].ravel()
    least = np.minimum(behind[:count], ahead[width - 1 : width - 1 + count])
    anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    begin, end = off[:-1], off[1:] - n + 1
    held = end > begin
    inside = np.zeros(count + 1, np.int8)
    np.add.at(inside, begin[held], 1)
    np.add.at(inside, np.minimum(end[held], count), -1)
    ok = np.cumsum(inside[:-1]) > 0
    first = ok.copy()
    new_row = np.zeros(count, bool)
    new_row[begin[held]] = True
    first[1:] &= ~ok[:-1] | (anchor[1:] != anchor[:-1]) | new_row[1:]
    a = np.flatnonzero(first)
    last = np.append(np.flatnonzero(ok[:-1] & (~ok[1:] | first[1:])), np.flatnonzero(ok)[-1:]) if ok[-1] else np.flatnonzero(ok[:-1] & (~ok[1:] | first[1:]))
    last = np.unique(last)
    row = np.searchsorted(off, a, "right") - 1
    return row, gram[anchor[a]].view(np.int64), B.span_hash(s, a, last + n).view(np.int64), a - off[row], anchor[a] - a, last - a + 1


OCCURRENCE = "k1 long, k2 long, family long, segment long, start long, anchor long, strings long"


def occurrences(keyed: DataFrame, n: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, k1, k2 = (batch.column(c) for c in ("text", "k1", "k2"))
            for a, b in B.slices(text):
                row, *rest = anchors(*B.buffers(text.slice(a, b - a)), n)
                i = pa.array(row + a)
                yield pa.RecordBatch.from_arrays([k1.take(i), k2.take(i), *map(pa.array, rest)], names=["k1", "k2", "family", "segment", "start", "anchor", "strings"])

    return keyed.mapInArrow(run, OCCURRENCE)


def _segments(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            data = (batch.column("text")[i].as_py() or "").encode()
            wanted = batch.column("wanted")[i].as_py()
            yield pa.RecordBatch.from_pydict({**{c: pa.array([w[c] for w in wanted], pa.int64()) for c in ("family", "segment", "anchor", "strings")}, "large": pa.array([w["large"] for w in wanted], pa.bool_()),
                                              "bytes": pa.array([data[w["start"] : w["start"] + w["strings"] + n - 1] for w in wanted], pa.binary())})


def _shards(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Families come in order; they are gathered up to the shard size and expanded."""
    names: list[tuple[int, int]] = []
    held: list[bytes] = []
    size = 0

    def done() -> pa.RecordBatch:
        out: list[tuple[int, int, int, int]] = []
        for (family, segment), mask in zip(names, repeated_starts(held, n)):
            out += [(family, segment, int(a), int(b)) for a, b in zip(*_runs(mask))]
        cols = zip(*out) if out else ([], [], [], [])
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["family", "segment", "a", "b"])

    for batch in batches:
        for family, segment, data in zip(batch.column("family").to_pylist(), batch.column("segment").to_pylist(), batch.column("bytes").to_pylist()):
            if held and (size + len(data) > SHARD_BYTES or len(held) >= 20_000) and names[-1][0] != family:
                yield done()
                names, held, size = [], [], 0
            names.append((family, segment))
            held.append(data)
            size += len(data)
    if held:
        yield done()


def _pieces(batches: Iterator[pa.RecordBatch], n: int, cells: int | None) -> Iterator[pa.RecordBatch]:
    """Segments cut on a grid of string starts, counted back from the anchor; equal strings fall into equal cells.

    All strings of a cell hold its core, so pieces can only meet where cells and cores are equal.
    """
    width = -(-(n - K + 1) // cells) if cells else 1
    names = ("family", "segment", "parent", "part", "first", "anchor", "strings")
    for batch in batches:
        rows: list[tuple] = []
        for family, segment, anchor, strings, data in zip(*(batch.column(c).to_pylist() for c in ("family", "segment", "anchor", "strings", "bytes"))):
            for cell in range((anchor - strings + 1) // width, anchor // width + 1):
                far, near = min(anchor, (cell + 1) * width - 1), max(anchor - strings + 1, cell * width)
                first, count = anchor - far, far - near + 1
                piece = data[first : first + count + n - 1]
                core = data[anchor - cell * width : anchor - (cell + 1) * width + 1 + n]
                hashes = [int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little", signed=True) for x in (struct.pack("<qqq", family, width, cell) + core, piece)]
                rows.append((*hashes, family, segment, first, far, count, piece))
        cols = list(zip(*rows)) if rows else [()] * 8
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:7]), pa.array(cols[7], pa.binary())], names=[*names, "bytes"])


RANGES = "family long, segment long, a long, b long"


def _within_families(cut: DataFrame, n: int, family: int, grids: tuple[int | None, ...]) -> DataFrame:
    """(family, segment, a, b): ranges of repeated strings among different segments of a family.

    cut(family, segment, anchor, strings, large, bytes): one row for each different segment.
    """
    small = cut.where("NOT large").select("family", "segment", "bytes").repartition("family").sortWithinPartitions("family", "segment").mapInArrow(lambda b: _shards(b, n), RANGES)
    large = cut.where("large")
    if not grids or large.isEmpty():
        return small
    schema = "family long, segment long, parent long, part long, first long, anchor long, strings long, bytes binary"
    pieces = stored(large.select("family", "segment", "anchor", "strings", "bytes").mapInArrow(lambda b: _pieces(b, n, grids[0]), schema), "pieces")
    each = pieces.groupBy("family", "segment").agg(F.count("*").alias("c"), *[F.first(c).alias(c) for c in ("anchor", "strings", "bytes")])
    each = stored(each, "different-pieces")
    sizes = stored(each.groupBy("family").agg(F.count("*").alias("m")).where("m > 1"), "piece-families")
    again = stored(each.join(sizes, "family").select("family", "segment", "anchor", "strings", (F.col("m") > family).alias("large"), "bytes"), "cut-pieces")
    whole = each.where("c > 1").select("family", "segment", F.lit(0).cast("long").alias("a"), F.col("strings").alias("b"))
    found = stored(whole.union(_within_families(again, n, family, grids[1:])), "piece-ranges")
    back = pieces.select("family", "segment", "parent", "part", "first").join(found, ["family", "segment"])
    return small.union(back.select("parent", "part", F.col("first") + F.col("a"), F.col("first") + F.col("b")))


def repeated_ranges(keyed: DataFrame, n: int, family: int = FAMILY) -> DataFrame:
    """(k1, k2, ranges): for each text with a repeat, the ranges of starts of its repeated strings."""
    every = stored(occurrences(keyed, n), "occurrences")
    many = stored(every.groupBy("family").agg(F.count("*").alias("c")).where("c > 1").select("family"), "families")
    occ = stored(every.join(many, "family"), "repeated-families")
    discard(every, many)
    seg = occ.groupBy("family", "segment").agg(F.count("*").alias("c"), F.min(F.struct("k1", "k2", "start", "anchor")).alias("at"), F.max("strings").alias("strings"))
    seg = stored(seg, "segments")
    wide = stored(seg.groupBy("family").agg(F.count("*").alias("m")).where("m > 1"), "wide-families")
    wanted = seg.join(wide, "family").select("at.k1", "at.k2", F.struct("family", "segment", F.col("at.start").alias("start"), F.col("at.anchor").alias("anchor"), "strings", (F.col("m") > family).alias("large")).alias("w"))
    wanted = stored(wanted.groupBy("k1", "k2").agg(F.collect_list("w").alias("wanted")), "wanted")
    texts = keyed.join(wanted.select("k1", "k2"), ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"])
    cut = texts.join(wanted, ["k1", "k2"]).select("text", "wanted").mapInArrow(lambda b: _segments(b, n), "family long, segment long, anchor long, strings long, large boolean, bytes binary")
    cut = stored(cut, "cut")
    whole = seg.where("c > 1").select("family", "segment", F.lit(0).cast("long").alias("a"), F.col("strings").alias("b"))
    found = whole.union(_within_families(cut, n, family, GRIDS)).groupBy("family", "segment").agg(F.collect_list(F.struct("a", "b")).alias("ranges"))
    found = stored(found, "found")
    places = occ.select("k1", "k2", "family", "segment", "start").distinct().join(found, ["family", "segment"])
    places = places.select("k1", "k2", F.transform("ranges", lambda r: F.struct((r["a"] + F.col("start")).alias("a"), (r["b"] + F.col("start")).alias("b"))).alias("ranges"))
    out = stored(places.groupBy("k1", "k2").agg(F.flatten(F.collect_list("ranges")).alias("ranges")), "ranges")
    discard(occ, seg, wide, wanted, cut, found)
    return out


def covered(size: int, ranges: list[dict] | None, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal covered runs of a text."""
    if not ranges:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a = np.array([r["a"] for r in ranges])
    b = np.array([r["b"] for r in ranges]) + n - 1
    o = np.argsort(a, kind="stable")
    a, b = a[o], np.maximum.accumulate(b[o])
    new = np.append(True, a[1:] > b[:-1])
    return a[new], b[np.append(np.flatnonzero(new)[1:] - 1, a.size - 1)]


def kept(docs: DataFrame, n: int = 400, family: int = FAMILY) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) of every row: the removed runs as (a, b) byte offsets, b exclusive, and the remaining bytes."""
    if n <= K:
        raise ValueError(f"n must be larger than {K}")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    k1, k2 = text_key()
    d = d.select("doc_id", "text", k1, k2)
    marks = repeated_ranges(d.select("text", "k1", "k2"), n, family)
    spans_type = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, spans, rest = [], [], []
            for text, ranges in zip(batch.column("text"), batch.column("ranges")):
                data = (text.as_py() or "").encode()
                a, b = covered(len(data), ranges.as_py(), n)
                cuts = list(zip(a.tolist(), b.tolist()))
                sizes.append(len(data))
                spans.append([{"a": x, "b": y} for x, y in cuts])
                rest.append(b"".join(data[y:x] for y, x in zip([0, *(y for _, y in cuts)], [*(x for x, _ in cuts), len(data)])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(spans, spans_type), pa.array(rest, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    joined = d.join(marks, ["k1", "k2"], "left").select("doc_id", "text", "ranges")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, spans array<struct<a: long, b: long>>, kept binary")


def dedup(docs: DataFrame, n: int = 400, family: int = FAMILY) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, text) of every row: bytes covered by a repeated string of n bytes are removed.

    ``text`` is what is left, read as UTF-8; where a cut goes through a character its remaining bytes stand as U+FFFD.
    """
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"])
    return kept(docs, n, family).select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), F.make_valid_utf8(F.col("kept").cast("string")).alias("text"))
