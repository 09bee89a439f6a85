"""Language-model scores by a class-based trigram model whose classes come from exchange clustering.

Training documents (crc32 of the id, modulo 10, not 0) are counted whole.  Words are lower-cased (A-Z) and known by 64-bit
hashes; every text ends with one end token.

* **Counts.**  One pass counts all words.  The ``HEAD`` most frequent ones (bounded, so they go to the tasks) cover most
  tokens; all others are counted, classified and looked up by joins.
* **Exchange clustering.**  The ``CORE`` most frequent words start in ``CLASSES`` classes by turn and are exchanged: each
  sweep gives every task some words with all their neighbours; a word moves to the class that raises the class bigram
  likelihood most, given the class counts of the sweep's start and the task's own moves.  Half of the words may move in a
  sweep, so that tasks do not undo each other, and the likeliest state of all sweeps stays.
* **All other words**, down to those seen once, are placed by one exchange step of their own: the gain of the likelihood,
  linear in the classes they stand between.
* **Model.**  With u, v the classes of the two tokens before, ``P(w|u,v) = T(c|u,v) E(w|c) + rest(u,v) R(w)``.  T backs off
  from class trigrams to bigrams to unigrams by additive (Dirichlet) weights; E takes ``discount`` off every word's count;
  ``rest`` is what the discounts leave, and R gives it to unknown words (``unseen``) and to the base model of single words.
  The probabilities of all known words, the end and the unknown sum to one after every context (a test adds them up).

Only bounded tables pass through the driver: HEAD words, CORE classes, class bigrams and trigrams.  Class trigrams are
counted over all training texts with the final classes of all words.

Defined cases: a null or empty text is one end token; a null ``doc_id`` counts as the empty string, so it is held out, and
is carried through; repeated rows count each and are scored alike; without training documents every probability is 1 (base
and model, as nothing but the unknown is known); an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quireframe.llm import bytesops as B
from quireframe.llm.tables import discard, stored

FOLDS = 10
CLASSES, CORE, HEAD, SWEEPS = 64, 1 << 14, 1 << 18, 6
#: Besides the classes of words: the end (also what stands before a text), and words without a class (while clustering: not in the core; in the model: unknown).
END, OTHER = CLASSES, CLASSES + 1
ALL = CLASSES + 2
#: Weights of the lower order in class trigrams and bigrams.
BACK3, BACK2 = 50.0, 5.0
#: Pairs that a task holds before it hands its counts on.
FLUSH = 1 << 21


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == 0


@dataclass
class Tokens:
    """The words of a slice, and where they and the end tokens lie in one row of cells with two end cells before every text."""

    h: np.ndarray
    row: np.ndarray
    first: np.ndarray
    cell: np.ndarray
    ends: np.ndarray

    def laid(self, words: np.ndarray, end: int) -> np.ndarray:
        out = np.full(self.h.size + 2 * (self.first.size - 1) + 2, end, words.dtype)
        out[self.cell] = words
        return out


def cells(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of each word, cell of each word, cell of each end) for rows that begin at word ``first[i]``."""
    rows = first.size - 1
    row = np.repeat(np.arange(rows), np.diff(first))
    return row, np.arange(first[-1]) + 2 * (row + 1), first[1:] + 2 * np.arange(1, rows + 1)


def tokens(text: pa.Array) -> Tokens:
    buf, off = B.buffers(text)
    w = B.words(buf, off)
    row, cell, ends = cells(w.first)
    return Tokens(B.span_hash(B.prefix_hash(buf, B.BYTE_HASH_LOWER), w.start, w.end), row, w.first, cell, ends)


def find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, found) of each key."""
    if not sorted_keys.size:
        return np.zeros(keys.size, np.int64), np.zeros(keys.size, bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), sorted_keys.size - 1)
    return at, sorted_keys[at] == keys


class Counter:
    """Counts of 64-bit keys, merged as they come and handed on when they are many."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        self.parts.append(np.unique(keys, return_counts=True))
        self.size += self.parts[-1][0].size
        if self.size < FLUSH:
            return None
        key, n = self.take()
        if key.size < FLUSH // 2:  # mostly repeats: keep on counting
            self.parts, self.size = [(key, n)], key.size
            return None
        return key, n

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        key = np.concatenate([p[0] for p in self.parts])
        order = np.argsort(key, kind="stable")
        key, n = key[order], np.concatenate([p[1] for p in self.parts])[order]
        at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        self.parts, self.size = [], 0
        return key[at], np.add.reduceat(n, at)


def _counted(keys_of):
    """``mapInArrow`` over (text): (key, n), the counts of ``keys_of(slice)`` by task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter()
        give = lambda found: pa.RecordBatch.from_arrays([pa.array(found[0].view(np.int64)), pa.array(found[1].astype(np.int64))], names=["key", "n"])
        for batch in batches:
            text = batch.column("text")
            for a, b in B.slices(text):
                if (found := counter.add(keys_of(text.slice(a, b - a)))) is not None:
                    yield give(found)
        if counter.parts:
            yield give(counter.take())

    return run


def counts(train: DataFrame) -> DataFrame:
    """(key, n): every word of the training texts."""
    return stored(train.select("text").mapInArrow(_counted(lambda t: tokens(t).h.view(np.int64)), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "word-counts")


def most_frequent(words: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, counts), the most frequent first: at most ``most`` words, cut between two sixteenths of an octave of the count."""
    octave = F.floor(F.log2("n") * 16).cast("int")
    held, cut = 0, None
    for r in words.groupBy(octave.alias("o")).count().orderBy(F.desc("o")).collect():  # at most 16 rows for each doubling
        held += r["count"]
        if held > most:
            break
        cut = r["o"]
    if cut is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    t = words.where(octave >= cut).toArrow()
    key, n = t.column("key").to_numpy().view(np.uint64), t.column("n").to_numpy()
    order = np.lexsort((key, -n))
    return key[order], n[order]


class Lookup:
    """Keys in order with their places in the given order."""

    def __init__(self, keys: np.ndarray) -> None:
        self.place = np.argsort(keys).astype(np.int32)
        self.keys = keys[self.place]

    def __call__(self, h: np.ndarray, other: int) -> np.ndarray:
        at, hit = find(self.keys, h)
        out = np.full(h.size, other, np.int32)
        out[hit] = self.place[at[hit]]
        return out


def neighbours(train: DataFrame, core: np.ndarray) -> DataFrame:
    """(w, left, right): every core word, the end and "any other word" with all that stands before and after it; at most as many entries as the core has words."""
    lookup, k = Lookup(core), core.size + 2

    def pairs(text: pa.Array) -> np.ndarray:
        t = tokens(text)
        laid = t.laid(lookup(t.h, k - 1), k - 2).astype(np.int64)
        at = np.concatenate([t.cell, t.ends])
        return laid[at - 1] * k + laid[at]

    both = train.select("text").mapInArrow(_counted(pairs), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    both = stored(both.select(F.floor(F.col("key") / k).cast("int").alias("a"), (F.col("key") % k).cast("int").alias("b"), "n"), "pairs")
    side = lambda w, o, left: both.select(F.col(w).alias("w"), F.struct(F.col(o).alias("o"), "n").alias("e"), F.lit(left).alias("left"))
    rows = side("b", "a", True).union(side("a", "b", False)).groupBy("w").agg(*[F.collect_list(F.when(F.col("left") == x, F.col("e"))).alias(name) for x, name in ((True, "left"), (False, "right"))])
    out = stored(rows.repartition(-(-k // 256)), "neighbours")
    discard(both)
    return out


def _entries(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    edges = col.offsets.to_numpy()
    return edges, col.values.field("o").to_numpy(), col.values.field("n").to_numpy()


def entropy(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def likelihood(n: np.ndarray) -> float:
    """Log-likelihood of the class bigrams, up to what no exchange changes."""
    return float(entropy(n).sum() - entropy(n.sum(0)).sum() - entropy(n.sum(1)).sum())


def _class_pairs(of: np.ndarray):
    """A task's part of the class bigrams: (a, b, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(ALL * ALL)
        for batch in batches:
            edges, o, n = _entries(batch.column("left"))
            w = np.repeat(batch.column("w").to_numpy(), np.diff(edges))
            o, n = o[edges[0] : edges[-1]], n[edges[0] : edges[-1]]
            table += np.bincount(of[o].astype(np.int64) * ALL + of[w], weights=n, minlength=ALL * ALL)
        some = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(some // ALL, pa.int32()), pa.array(some % ALL, pa.int32()), pa.array(table[some])], names=["a", "b", "n"])

    return run


def class_pairs(near: DataFrame, of: np.ndarray) -> np.ndarray:
    table = np.zeros((ALL, ALL))
    for r in near.select("w", "left").mapInArrow(_class_pairs(of), "a int, b int, n double").groupBy("a", "b").agg(F.sum("n").alias("n")).collect():  # at most ALL x ALL
        table[r["a"], r["b"]] = r["n"]
    return table


def best_class(n: np.ndarray, x: np.ndarray, y: np.ndarray, now: int) -> int:
    """The class whose likelihood gains most by a word with left neighbours ``x`` and right neighbours ``y``; ``n`` is without the word.  Ties stay where they are."""
    li, ri = np.flatnonzero(x), np.flatnonzero(y)
    into, out = n[li, :CLASSES], n[:CLASSES, ri]
    gain = (entropy(into + x[li, None]) - entropy(into)).sum(0) + (entropy(out + y[ri]) - entropy(out)).sum(1)
    for size, more in ((n[:, :CLASSES].sum(0), x.sum()), (n[:CLASSES].sum(1), y.sum())):
        gain -= entropy(size + more) - entropy(size)
    top = int(gain.argmax())
    return top if gain[top] > gain[now] + 1e-9 else now


def _moves(of: np.ndarray, table: np.ndarray, turn: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = table.copy()
        for batch in batches:
            words, to = [], []
            sides = [_entries(batch.column(c)) for c in ("left", "right")]
            for i, w in enumerate(batch.column("w").to_numpy()):
                if w >= of.size - 2 or w % 2 != turn:
                    continue
                x, y = (np.bincount(of[o[e[i] : e[i + 1]]], weights=c[e[i] : e[i + 1]], minlength=ALL) for e, o, c in sides)
                now = int(of[w])
                n[:, now] -= x
                n[now] -= y
                np.maximum(n, 0, out=n)  # a word beside itself is taken off twice
                new = best_class(n, x, y, now)
                n[:, new] += x
                n[new] += y
                if new != now:
                    words.append(w)
                    to.append(new)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.int32()), pa.array(to, pa.int32())], names=["w", "class"])

    return run


def exchange(near: DataFrame, core: int, sweeps: int = SWEEPS) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """(class of each core word, of the end and of any other; class bigrams; likelihood at each sweep)."""
    of = np.append(np.arange(core) % CLASSES, [END, OTHER]).astype(np.uint8)
    table = class_pairs(near, of)
    best, seen = (of, table), [likelihood(table)]
    for sweep in range(sweeps):
        moves = near.mapInArrow(_moves(of, table, sweep % 2), "w int, class int").toArrow()  # at most one row for each core word
        if not moves.num_rows:
            if sweep:
                break
            continue
        of = of.copy()
        of[moves.column("w").to_numpy()] = moves.column("class").to_numpy()
        table = class_pairs(near, of)
        seen.append(likelihood(table))
        if seen[-1] >= max(seen):
            best = (of, table)
    return *best, seen


def _between(core: np.ndarray, of: np.ndarray):
    """(key, between): every word outside the core with the classes it stands between."""
    lookup = Lookup(core)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            for a, b in B.slices(text):
                t = tokens(text.slice(a, b - a))
                place = lookup(t.h, of.size - 1)
                laid = t.laid(of[place], END).astype(np.int16)
                rare = np.flatnonzero(place == of.size - 1)
                at = t.cell[rare]
                yield pa.RecordBatch.from_arrays([pa.array(t.h[rare].view(np.int64)), pa.array(laid[at - 1] * np.int16(ALL) + laid[at + 1])], names=["key", "between"])

    return run


def _place(table: np.ndarray):
    """Over (key, between) in order of key: (key, n, class)."""
    # the gain of a few more counts is linear in them: log of what stands there, less the logs of the class's sizes
    seen = np.log(table + 0.1)
    into, out = seen[:, :CLASSES], seen[:CLASSES].T
    size = np.log(table[:, :CLASSES].sum(0) + 1) + np.log(table[:CLASSES].sum(1) + 1)

    def placed(keys: np.ndarray, x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
        n = x.sum(1)
        gain = x @ into + y @ out - n[:, None] * size
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n.astype(np.int64)), pa.array(gain.argmax(1).astype(np.int32))], names=["key", "n", "class"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carried = None, None
        for batch in batches:
            for a in range(0, batch.num_rows, 1 << 15):
                part = batch.slice(a, 1 << 15)
                key, between = part.column("key").to_numpy(), part.column("between").to_numpy().astype(np.int64)
                start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                word = np.repeat(np.arange(start.size), np.diff(np.append(start, key.size)))
                x, y = (np.bincount(word * ALL + c, minlength=start.size * ALL).reshape(-1, ALL).astype(float) for c in (between // ALL, between % ALL))
                keys = key[start]
                if last is not None:
                    if keys[0] == last:
                        x[0] += carried[0]
                        y[0] += carried[1]
                    else:
                        yield placed(np.array([last]), carried[0][None], carried[1][None])
                last, carried = keys[-1], (x[-1], y[-1])
                if keys.size > 1:
                    yield placed(keys[:-1], x[:-1], y[:-1])
        if last is not None:
            yield placed(np.array([last]), carried[0][None], carried[1][None])

    return run


def place(train: DataFrame, core: np.ndarray, of: np.ndarray, table: np.ndarray) -> DataFrame:
    """(key, n, class) of every training word outside the core."""
    between = train.select("text").mapInArrow(_between(core, of), "key long, between short")
    return stored(between.repartition("key").sortWithinPartitions("key").mapInArrow(_place(table), "key long, n long, class int"), "placed")


@dataclass
class Words:
    """What is known of words before any text is scored; ``keys`` holds the head in order."""

    keys: np.ndarray
    n: np.ndarray
    of: np.ndarray
    total: int
    distinct: int
    ends: int
    size: np.ndarray  # tokens of each class
    types: np.ndarray  # words of each class
    discount: float
    unseen: float

    def base(self, n: np.ndarray) -> np.ndarray:
        return (n + 0.1) / (self.total + 0.1 * (self.distinct + 1))


CODED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, classes binary, counts binary"


def _code(words: Words):
    """Over (doc_id, held_out, text, rare): the class and count of every token, and the base score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            for a, b in B.slices(text):
                part = batch.slice(a, b - a)
                t = tokens(part.column("text"))
                at, hit = find(words.keys, t.h)
                n, of = np.zeros(t.h.size, np.int64), np.full(t.h.size, OTHER, np.uint8)
                n[hit], of[hit] = words.n[at[hit]], words.of[at[hit]]
                rare = part.column("rare")
                edges = rare.offsets.to_numpy()
                key, rn, rc = (rare.values.field(c).to_numpy()[edges[0] : edges[-1]] for c in ("key", "n", "class"))
                mark = lambda h, row: B.mix(h ^ B.mix(row.astype(np.uint64) + np.uint64(11)))
                mine = mark(key.view(np.uint64), np.repeat(np.arange(b - a), np.diff(edges)))
                order = np.argsort(mine)
                rest = np.flatnonzero(~hit)
                at, hit = find(mine[order], mark(t.h[rest], t.row[rest]))
                n[rest[hit]], of[rest[hit]] = rn[order[at[hit]]], rc[order[at[hit]]]
                laid_n, laid_of = np.zeros(t.h.size + b - a, np.int64), np.full(t.h.size + b - a, END, np.uint8)
                cell, first = np.arange(t.h.size) + t.row, t.first + np.arange(b - a + 1)
                laid_n[first[1:] - 1] = words.ends
                laid_n[cell], laid_of[cell] = n, of
                known = B.per_row(laid_n > 0, first)
                base = np.add.reduceat(np.log10(words.base(laid_n)), first[:-1])
                blob = lambda x: pa.Array.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer((first * x.itemsize).astype(np.int64)), pa.py_buffer(x)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(np.diff(first)), pa.array(known), pa.array(base), blob(laid_of), blob(laid_n.astype(np.float32))], names=CODED.replace(",", "").split()[::2])

    return run


def _rare(keys: np.ndarray):
    """(row, key): the distinct words of every text that are not in the head."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, rows = batch.column("text"), batch.column("row").to_numpy()
            for a, b in B.slices(text):
                t = tokens(text.slice(a, b - a))
                _, hit = find(keys, t.h)
                h, row = t.h[~hit], t.row[~hit]
                order = np.lexsort((h, row))
                h, row = h[order], row[order]
                new = np.append(True, (h[1:] != h[:-1]) | (row[1:] != row[:-1]))[: h.size]
                yield pa.RecordBatch.from_arrays([pa.array(rows[a:b][row[new]]), pa.array(h[new].view(np.int64))], names=["row", "key"])

    return run


def coded(docs: DataFrame, words: Words, placed: DataFrame) -> DataFrame:
    """Every document with the classes and counts of its tokens (see ``CODED``)."""
    rare = docs.select("row", "text").mapInArrow(_rare(words.keys), "row long, key long").distinct().join(placed, "key")
    rare = rare.groupBy("row").agg(F.collect_list(F.struct("key", "n", "class")).alias("rare"))  # a text's own words
    d = docs.join(rare, "row", "left").withColumn("rare", F.coalesce("rare", F.array().cast("array<struct<key:long,n:long,class:int>>")))
    return stored(d.select("doc_id", "held_out", "text", "rare").mapInArrow(_code(words), CODED), "coded")


def _views(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(from, to, first token of each row, classes, counts) of slices of a coded batch."""
    for a, b in B.slices(batch.column("classes")):
        of = batch.column("classes").slice(a, b - a).cast(pa.large_binary())
        n = batch.column("counts").slice(a, b - a).cast(pa.large_binary())
        edge = [np.frombuffer(x.buffers()[1], np.int64)[x.offset : x.offset + b - a + 1] for x in (of, n)]
        yield a, b, edge[0] - edge[0][0], np.frombuffer(of.buffers()[2], np.uint8)[edge[0][0] : edge[0][-1]], np.frombuffer(n.buffers()[2], np.uint8)[edge[1][0] : edge[1][-1]].copy().view(np.float32)


def contexts(first: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class two before, class before, class) of every token of texts that each end with the end token."""
    row = np.repeat(np.arange(first.size - 1), np.diff(first))
    cell = np.arange(of.size) + 2 * (row + 1)
    laid = np.full(of.size + 2 * first.size, END, np.int64)
    laid[cell] = of
    return laid[cell - 2], laid[cell - 1], laid[cell]


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = np.zeros(ALL**3, np.int64)
    for batch in batches:
        for _, _, first, of, _ in _views(batch):
            u, v, c = contexts(first, of)
            table += np.bincount((u * ALL + v) * ALL + c, minlength=ALL**3)
    some = np.flatnonzero(table)
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(table[some])], names=["at", "n"])


def transitions(train: DataFrame) -> np.ndarray:
    """Class trigrams of coded training texts."""
    table = np.zeros(ALL**3, np.int64)
    t = train.select("classes", "counts").mapInArrow(_trigrams, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # at most ALL^3 rows
    table[t.column("at").to_numpy()] = t.column("n").to_numpy()
    return table.reshape(ALL, ALL, ALL)


class Model:
    def __init__(self, words: Words, trigrams: np.ndarray) -> None:
        self.words = words
        n3 = trigrams.astype(float)
        n2, known = n3.sum(0), words.size.astype(float)
        t1 = known / max(known.sum(), 1)
        t2 = (n2 + BACK2 * t1) / (n2.sum(-1, keepdims=True) + BACK2)
        self.t3 = (n3 + BACK3 * t2) / (n3.sum(-1, keepdims=True) + BACK3)
        self.taken = words.discount * (np.arange(ALL) < CLASSES)
        self.rest = self.t3 @ (self.taken * words.types / np.maximum(known, 1))

    def p(self, u: np.ndarray, v: np.ndarray, c: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Probability of tokens of class ``c`` that training holds ``n`` times (0: the unknown) after classes u, v."""
        w = self.words
        if not w.total:
            return np.ones(c.size)
        known = self.t3[u, v, c] * np.maximum(n - self.taken[c], 0) / np.maximum(w.size[c], 1)
        return known + self.rest[u, v] * ((1 - w.unseen) * w.base(n) + np.where(n > 0, 0, w.unseen))


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, first, of, n in _views(batch):
                part = batch.slice(a, b - a)
                score = np.add.reduceat(np.log10(model.p(*contexts(first, of), n.astype(float))), first[:-1])
                size = np.diff(first)
                columns = [*(part.column(c) for c in ("doc_id", "held_out", "n_tokens", "n_known")), pa.array(np.full(b - a, model.words.total)), part.column("base_score"), pa.array(score), pa.array(10.0 ** np.minimum(-score / size, 300))]
                yield pa.RecordBatch.from_arrays(columns, names=SCORED.replace(",", "").split()[::2])

    return run


def fit(train: DataFrame, core: int = CORE, head: int = HEAD, sweeps: int = SWEEPS) -> tuple[Words, DataFrame, list[float]]:
    """(words, placed words outside the core, likelihoods) of training texts (text)."""
    ends = train.count()
    counted = counts(train)
    total, distinct, once, twice = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)).first()
    core_keys, core_n = most_frequent(counted, core)
    near = neighbours(train, core_keys)
    of, table, seen = exchange(near, core_keys.size, sweeps)
    placed = place(train, core_keys, of, table)
    sizes = {r["class"]: (r["n"], r["types"]) for r in placed.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("types")).collect()}  # one row for each class
    size, types = np.zeros(ALL, np.int64), np.zeros(ALL, np.int64)
    np.add.at(size, of[:-2], core_n)
    np.add.at(types, of[:-2], 1)
    for c, (n, words) in sizes.items():
        size[c] += n
        types[c] += words
    size[END], types[END] = ends, 1
    # the head: the core and the most frequent placed words
    keys, n = most_frequent(placed.select("key", "n"), max(head - core_keys.size, 0))
    if keys.size:
        t = placed.where(F.col("n") >= int(n.min())).toArrow()  # the same words: no count is both in and out
        more_keys, more_n, more_of = (t.column(c).to_numpy() for c in ("key", "n", "class"))
    else:
        more_keys, more_n, more_of = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
    keys = np.concatenate([core_keys, more_keys.view(np.uint64)])
    order = np.argsort(keys)
    discount = once / (once + 2 * twice) if once and twice else 0.5
    words = Words(keys[order], np.concatenate([core_n, more_n])[order], np.concatenate([of[:-2], more_of]).astype(np.uint8)[order], int(total) + ends, int(distinct) + (ends > 0), ends, size, types, discount,
                  float(np.clip(once / max(discount * distinct, 1), 0.1, 0.99)))
    discard(counted, near)
    return words, placed, seen


def score(docs: DataFrame, core: int = CORE, head: int = HEAD, sweeps: int = SWEEPS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) of every document."""
    d = docs.select(F.xxhash64(F.col("doc_id").cast("long"), "text").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id").cast("long")).alias("held_out"), F.col("text").cast("string").alias("text"))
    words, placed, _ = fit(d.where("NOT held_out").select("text"), core, head, sweeps)
    texts = coded(d, words, placed)
    discard(placed)
    return texts.mapInArrow(_score(Model(words, transitions(texts.where("NOT held_out")))), SCORED)
