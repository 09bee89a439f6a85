"""Ranked lexical search by branch and bound over a prefix tree of documents.

Of every document only the terms that the items ask for are kept, as a vector of (term, tf) in the order of document
frequency, most frequent first.  Vectors of a shard are sorted, so that documents with a common beginning share a path of
a tree (a node is a run of documents, its depth their common beginning).  Each node knows the largest tf of every term and
the smallest m in its subtree; with these the score formula is an upper bound of every document below.  An item descends
depth first, into the child with the highest bound, and leaves out every node whose bound is below its k-th score so far.
That score is shared: a task carries it from shard to shard, and a seed of the documents, searched first, gives the score
at which the search of all the others starts.

One pass over whole texts makes the vectors and counts document frequencies (partial counts per task, summed by Spark);
documents are never shuffled.  Items are taken in blocks of ``BLOCK``, whose terms and weights go to the tasks.

A term's identity in the corpus is a 64-bit hash.  Defined cases: null and empty texts hold no term and are not counted in
N; an item without terms, or whose terms stand in no document, has no rows; rows that share a ``doc_id`` or ``item_id`` are
documents or items of their own; equal scores go by ascending doc_id, null last; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quireframe.llm import bytesops as B
from quireframe.llm.tables import stored

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BLANK = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
#: Items of a block, documents of a shard, documents of a leaf, terms in memory at once, and the share of documents (one in ...) searched first.
BLOCK, SHARD, LEAF, WIDTH, SEED = 1024, 4096, 16, 4096, 32
LAST = 2**63 - 1


def terms_of(text: str | None) -> list[str]:
    return [t.translate(_LOWER) for t in re.findall(TERM, text or "")]


_LOWER = {c: c + 32 for c in range(65, 91)}


def _hash(term: str) -> int:
    b = np.frombuffer(term.encode(), np.uint8)
    return int(B.span_hash(B.prefix_hash(b, B.BYTE_HASH_LOWER), np.array([0]), np.array([b.size]))[0])


VECTOR = "doc_id long, n long, terms array<int>, tfs array<int>, term int, docs long"


def _vectors(hashes: np.ndarray):
    """Two kinds of rows: (doc_id, n, terms, tfs) for each document, and (term, docs), a task's count of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(hashes.size, np.int64)
        names = ["doc_id", "n", "terms", "tfs", "term", "docs"]
        for batch in batches:
            for a, b in B.slices(batch.column("text")):
                buf, off = B.buffers(batch.column("text").slice(a, b - a))
                w = B.words(buf, off, BLANK)
                h = B.span_hash(B.prefix_hash(buf, B.BYTE_HASH_LOWER), w.start, w.end)
                at = np.minimum(np.searchsorted(hashes, h), hashes.size - 1)
                hit = np.flatnonzero(hashes[at] == h)
                code, tf = np.unique(w.row[hit] * np.int64(hashes.size) + at[hit], return_counts=True)
                row, term = np.divmod(code, hashes.size)
                seen += np.bincount(term, minlength=hashes.size)
                edges = pa.array(np.searchsorted(row, np.arange(b - a + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(edges, pa.array(x, pa.int32())) for x in (term, tf)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(np.diff(w.first), pa.int64()), *lists, pa.nulls(b - a, pa.int32()), pa.nulls(b - a, pa.int64())], names=names)
        some = np.flatnonzero(seen)
        lists = [pa.nulls(some.size, pa.list_(pa.int32()))] * 2
        yield pa.RecordBatch.from_arrays([pa.nulls(some.size, pa.int64())] * 2 + lists + [pa.array(some, pa.int32()), pa.array(seen[some], pa.int64())], names=names)

    return run


@dataclass
class Tree:
    """Runs of sorted documents: ``start``, ``end``, and the range of the node's children (empty: a leaf)."""

    start: list[int] = field(default_factory=list)
    end: list[int] = field(default_factory=list)
    children: list[tuple[int, int]] = field(default_factory=list)

    def add(self, a: int, b: int) -> None:
        self.start.append(a)
        self.end.append(b)
        self.children.append((0, 0))


def common(one: np.ndarray, two: np.ndarray) -> int:
    n = min(one.size, two.size)
    differ = one[:n] != two[:n]
    return int(differ.argmax()) if differ.any() else n


def grow(shared: np.ndarray) -> Tree:
    """The tree over documents of which the i-th shares its first ``shared[i]`` terms with the one before; small neighbours are one leaf."""
    tree = Tree()
    tree.add(0, shared.size)
    at = 0
    while at < len(tree.start):
        a, b = tree.start[at], tree.end[at]
        if b - a > LEAF:
            inner = shared[a + 1 : b]
            cuts = (np.flatnonzero(inner == inner.min()) + a + 1).tolist()
            begin, low = len(tree.start), a
            for i, cut in enumerate([*cuts, b]):
                # a run ends where the next document group would make it too large
                nxt = cuts[i + 1] if i + 1 < len(cuts) else b
                if cut == b or nxt - low > LEAF:
                    tree.add(low, cut)
                    low = cut
            tree.children[at] = (begin, len(tree.start)) if len(tree.start) - begin > 1 else (0, 0)
            if tree.children[at] == (0, 0):
                del tree.start[begin:], tree.end[begin:], tree.children[begin:]
        at += 1
    return tree


def parts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m[:, None])


class Shard:
    """Documents in the order of their vectors, their tree, and per node the largest tf of ``terms`` and the smallest m."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, vectors: list[np.ndarray], tfs: list[np.ndarray]) -> None:
        order = sorted(range(ids.size), key=lambda i: vectors[i].astype(">u4").tobytes())
        self.ids, self.m = ids[order], m[order]
        self.vectors, self.tfs = [vectors[i] for i in order], [tfs[i] for i in order]
        self.tree = grow(np.array([0] + [common(x, y) for x, y in zip(self.vectors, self.vectors[1:])]))
        self.start, self.end = np.array(self.tree.start), np.array(self.tree.end)
        self.least = np.zeros(self.start.size, np.int64)
        for i in range(self.start.size):
            self.least[i] = self.m[self.start[i] : self.end[i]].min()

    def fill(self, terms: np.ndarray) -> None:
        """Lay out the tf of these terms by document and by node."""
        lengths = np.array([v.size for v in self.vectors])
        flat = np.concatenate(self.vectors)
        at = np.minimum(np.searchsorted(terms, flat), terms.size - 1)
        hit = terms[at] == flat
        self.tf = np.zeros((self.ids.size, terms.size), np.int32)
        self.tf[np.repeat(np.arange(self.ids.size), lengths)[hit], at[hit]] = np.concatenate(self.tfs)[hit]
        self.most = np.zeros((self.start.size, terms.size), np.int32)
        for i in range(self.start.size - 1, -1, -1):  # children come after their parents
            a, b = self.tree.children[i]
            self.most[i] = self.most[a:b].max(0) if a < b else self.tf[self.start[i] : self.end[i]].max(0)

    def search(self, cols: np.ndarray, weights: np.ndarray, k: int, best: np.ndarray, ids: np.ndarray, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best (score, id) of ``best`` and this shard; nothing below ``floor`` is looked for."""
        bound = lambda a, b: (parts(self.most[a:b, cols].astype(np.int64), self.least[a:b]) * weights).sum(1)
        stack = [(int(bound(0, 1)[0]), 0)]
        while stack:
            above, node = stack.pop()
            kth = max(floor, int(best[-1]) if best.size == k else 1)
            if above < kth:
                continue
            a, b = self.tree.children[node]
            if a < b:
                bounds = bound(a, b)
                some = np.flatnonzero(bounds >= kth)
                some = some[np.argsort(bounds[some], kind="stable")]
                stack.extend(zip(bounds[some].tolist(), (some + a).tolist()))
                continue
            s, e = self.start[node], self.end[node]
            score = (parts(self.tf[s:e, cols].astype(np.int64), self.m[s:e]) * weights).sum(1)
            some = score >= kth
            if some.any():
                score, found = np.concatenate([best, score[some]]), np.concatenate([ids, self.ids[s:e][some]])
                o = np.lexsort((found, -score))[:k]
                best, ids = score[o], found[o]
        return best, ids


def _search(ranks: np.ndarray, items: list[tuple[int, np.ndarray, np.ndarray]], groups: list[list[int]], n_docs: int, n_terms: int, k: int, floors: list[int]):
    """Tops of every item among a task's documents: (item, doc_id, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [np.zeros(0, np.int64) for _ in items]
        ids = [np.zeros(0, np.int64) for _ in items]
        held: list[tuple[np.ndarray, np.ndarray, list, list]] = []

        def close() -> None:
            if not held:
                return
            shard = Shard(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), [v for h in held for v in h[2]], [t for h in held for t in h[3]])
            held.clear()
            present = np.unique(np.concatenate(shard.vectors)) if shard.vectors else np.zeros(0, np.int64)
            for group in groups:
                terms = np.intersect1d(np.unique(np.concatenate([items[i][1] for i in group])), present)
                if not terms.size:
                    continue
                shard.fill(terms)
                for i in group:
                    _, asked, weights = items[i]
                    cols = np.minimum(np.searchsorted(terms, asked), terms.size - 1)
                    hit = terms[cols] == asked
                    if hit.any():
                        best[i], ids[i] = shard.search(cols[hit], weights[hit], k, best[i], ids[i], floors[i])

        for batch in batches:
            for a in range(0, batch.num_rows, SHARD):
                part = batch.slice(a, SHARD)
                n = part.column("n").to_numpy()
                m = 25 + (75 * n * n_docs) // n_terms
                doc = part.column("doc_id").fill_null(LAST).to_numpy()
                terms, tfs = part.column("terms"), part.column("tfs")
                edges = terms.offsets.to_numpy()
                flat, count = ranks[terms.values.to_numpy()], tfs.values.to_numpy()[tfs.offsets[0].as_py() :]
                vectors, counts = [], []
                for x, y in zip(edges, edges[1:]):
                    o = np.argsort(flat[x:y])
                    vectors.append(flat[x:y][o])
                    counts.append(count[x - edges[0] : y - edges[0]][o])
                held.append((doc, m, vectors, counts))
                if sum(h[0].size for h in held) >= SHARD:
                    close()
        close()
        out = [(np.full(b.size, item[0]), i, b) for item, b, i in zip(items, best, ids) if b.size]
        if out:
            item, doc, score = (np.concatenate(c) for c in zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(doc, mask=doc == LAST), pa.array(score)], names=["item", "doc_id", "score"])

    return run


def _block(docs: DataFrame, asked: list[tuple[int, list[str]]], k: int) -> DataFrame | None:
    """(item, doc_id, score) of one block of (item, terms): for each item its k best at least, by task."""
    names = sorted({t for _, terms in asked for t in terms})
    by_hash = {_hash(t): t for t in names}
    hashes = np.array(sorted(by_hash), np.uint64)
    place = {by_hash[int(h)]: i for i, h in enumerate(hashes)}
    v = stored(docs.mapInArrow(_vectors(hashes), VECTOR), "term-vectors")
    rows = v.where("term IS NULL")
    n_docs, n_terms = rows.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(hashes.size, np.int64)
    for r in v.where("term IS NOT NULL").groupBy("term").agg(F.sum("docs").alias("df")).collect():  # one row for each term of the block
        df[r["term"]] = r["df"]
    if not df.any():
        return None
    weight = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
    ranks = np.empty(hashes.size, np.int64)
    ranks[np.lexsort((np.arange(hashes.size), -df))] = np.arange(hashes.size)
    items = []
    for item, terms in asked:
        times = Counter(place[t] for t in terms if df[place[t]])
        if times:
            at = np.array(list(times))
            items.append((item, ranks[at], weight[at] * np.array(list(times.values()))))
    groups: list[list[int]] = []
    held: set[int] = set()
    for i, (_, terms, _) in enumerate(items):
        more = held.union(terms.tolist())
        if not groups or len(more) > WIDTH:
            groups.append([])
            more = set(terms.tolist())
        groups[-1].append(i)
        held = more
    rows = rows.where(F.size("terms") > 0).select("doc_id", "n", "terms", "tfs")
    seed = F.pmod(F.xxhash64("doc_id", "n", "terms"), F.lit(SEED)) == 0
    find = functools.partial(_search, ranks, items, groups, n_docs, n_terms, k)
    out = "item long, doc_id long, score long"
    first = stored(rows.where(seed).mapInArrow(find([1] * len(items)), out), "seed-tops")
    top = _top(first, k)
    floors = {r["item"]: r["floor"] for r in top.groupBy("item").agg(F.count("*").alias("n"), F.min("score").alias("floor")).where(F.col("n") >= k).collect()}  # one row for each item of the block
    return first.union(rows.where(~seed).mapInArrow(find([floors.get(i, 1) for i, _, _ in items]), out))


def _top(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k)


def rank(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of every item."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    asked = stored(items.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")), "items")
    blocks = -(-asked.count() // BLOCK)
    asked = asked.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(max(blocks, 1))))
    found = d.sparkSession.createDataFrame([], "item long, doc_id long, score long")
    for b in range(blocks):
        here = [(r["item"], terms_of(r["text"])) for r in asked.where(F.col("block") == b).collect()]  # about BLOCK items
        if any(terms for _, terms in here) and (more := _block(d, here, k)) is not None:
            found = found.union(more)
    return _top(found, k).join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def sql(k: int = 10) -> str:
    """The same rows in DuckDB."""
    terms = lambda t: f"regexp_extract_all(translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {terms('text')} AS terms FROM documents WHERE text IS NOT NULL),
t AS (SELECT row, term, count(*)::BIGINT AS tf FROM (SELECT row, unnest(terms) AS term FROM d) GROUP BY row, term),
i AS (SELECT item, item_id, term, count(*)::BIGINT AS times FROM (SELECT row_number() OVER () AS item, item_id, unnest({terms('text')}) AS term FROM benchmark) GROUP BY item, item_id, term),
c AS (SELECT count(*)::BIGINT AS docs, sum(len(terms))::BIGINT AS words FROM d WHERE len(terms) > 0),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM t, c GROUP BY term, docs),
m AS (SELECT row, doc_id, 25 + (75 * len(terms)::BIGINT * docs) // words AS m FROM d, c WHERE len(terms) > 0),
s AS (SELECT item, item_id, row, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM i JOIN t USING (term) JOIN w USING (term) JOIN m USING (row) GROUP BY item, item_id, row, doc_id),
r AS (SELECT *, (row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST))::INTEGER AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= {k}"""
