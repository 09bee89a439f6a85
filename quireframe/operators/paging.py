"""Pages of flowing items: the next page of every item first, then the pages that are really reached.

Where a page begins decides where the next one begins, so page beginnings are a functional graph over items.  Its edges
are found for all items at once, by a search on running heights, inside *stretches* of ``STRETCH`` pages of material; paths
are followed to the end of their stretch there.  What is left is a jump from an item near the head of one stretch to one
near the head of a later stretch, with the pages passed.  Jumps are doubled (1, 2, 4, ... stretches), the first item of a
document follows them from the longest down, and every stretch that is entered numbers its pages by itself.

A document of any length is spread over its stretches.  Nothing is keyed by document alone but one row for each stretch
(its last page) and one for each chunk of items (its sums).

Where a document is one row already (``Documents``), it is one stretch: its items are measured and its pages numbered in the
task that reads the row, and nothing is shuffled or stored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from quireframe.operators import scale
from quireframe.session import checkpointed

STRETCH = 16
CHUNK = 4096
#: Heights are counted in thousandths of a point, so sums are exact.
UNIT = 1000
#: Documents that are worked on at once.
SLICE = 256


@dataclass
class Documents:
    """``read`` turns a batch of ``rows`` (doc_id, ...), one for each document, into one where every column of its items is an array in order."""

    rows: DataFrame
    read: Callable[[pa.RecordBatch], pa.RecordBatch]


def _measured(items: DataFrame, height: int, gap: int, most: int) -> DataFrame:
    """doc_id, item, h (height), e (notes that go with it), head, brk, and what comes after: need (room asked for), seen (notes asked for); running p, q (notes), c (items with notes) before the item."""
    unit = lambda c: F.round(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * UNIT).cast("long")
    has = lambda c: c in items.columns
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)) if has(c) else F.lit(False)
    d = items.select(
        "doc_id", F.col("item").cast("long").alias("item"), F.floor(F.col("item") / CHUNK).cast("long").alias("_chunk"), F.greatest(unit("height"), F.lit(0)).alias("h"),
        F.greatest(unit("need" if has("need") else "height"), unit("height") - height, F.lit(0)).alias("need"), (F.greatest(unit("header"), F.lit(0)) if has("header") else F.lit(0).cast("long")).alias("head"), (F.greatest(unit("notes"), F.lit(0)) if has("notes") else F.lit(0).cast("long")).alias("e"), flag("page_break").alias("brk"), flag("keep_next").alias("keep"),
    )
    keys, order = ["doc_id"], ["item"]
    if has("notes"):
        # what the notes of an item have beyond the room on a page of its own goes with the next one: a queue that sums empty
        d = d.withColumn("_x", F.col("e") - F.greatest(F.lit(0), F.least(F.lit(most), F.lit(height) - F.col("h") - F.col("head")) - gap))
        d = scale.running_sum(d, keys, "_chunk", order, F.col("_x"), "_s")
        d = scale.running_max(d, keys, "_chunk", order, {"_m": -F.col("_s"), "_d": F.col("_x") - F.col("_s")})
        left = F.col("_s") + F.greatest(F.col("_m"), F.lit(0))
        before = F.col("_s") - F.col("_x") + F.greatest(F.col("_d"), F.lit(0))
        d = d.withColumn("e", F.col("e") + before - left).drop("_x", "_s", "_m", "_d")
    d = scale.lag(d, keys, "_chunk", order, {"_h": "need", "_e": "e"}, back=False)
    kept = F.col("keep") & F.col("_h").isNotNull()
    d = d.withColumn("need", F.col("need") + F.col("e") + F.when(kept, F.col("h") - F.col("need") + F.col("_h") + F.col("_e")).otherwise(0)).withColumn("seen", F.greatest(F.signum("e"), F.when(kept, F.signum("_e")).otherwise(0)).cast("long"))
    d = d.drop("keep", "_h", "_e")
    for out, value in (("p", F.col("h") + F.col("e")), ("q", F.col("e")), ("c", F.signum("e").cast("long"))):
        d = scale.running_sum(d, keys, "_chunk", order, value, out, exclusive=True)
    return d


def _stretches(items: DataFrame, height: int, reach: int) -> DataFrame:
    """doc_id, stretch, own and following items in order: each stretch with the items up to ``reach`` beyond its end and one more."""
    span = STRETCH * height
    d = scale.lag(items, ["doc_id"], "_chunk", ["item"], {"_p": "p"})
    at = lambda c: F.floor(F.col(c) / span).cast("long")
    early = lambda c: F.greatest(F.floor((F.col(c) - reach) / span), F.lit(0)).cast("long")
    homes = lambda c: F.sequence(early(c), at(c))
    d = d.withColumn("stretch", F.explode(F.array_distinct(F.concat(homes("p"), F.coalesce(homes("_p"), F.array().cast("array<bigint>")))))).withColumn("own", F.col("stretch") == at("p"))
    row = F.struct("item", "h", "e", "head", "brk", "need", "seen", "p", "q", "c", "own", at("p").alias("home"))
    # a stretch holds about STRETCH + 1 pages of material, whatever the document
    return d.groupBy("doc_id", "stretch").agg(F.array_sort(F.collect_list(row)).alias("items"))


class Flow:
    """All stretches of a batch side by side: the place of the next page's first item for every item."""

    def __init__(self, items: pa.Array, height: int, gap: int, most: int) -> None:
        edges = items.offsets.to_numpy().astype(np.int64)
        flat = items.values.slice(edges[0], edges[-1] - edges[0])
        self.edges = edges - edges[0]
        of = lambda c: flat.field(c).to_numpy(zero_copy_only=False)
        self.item, self.own, self.home, self.p = of("item"), of("own"), of("home"), of("p")
        size = self.item.size
        group = np.repeat(np.arange(edges.size - 1), np.diff(self.edges))
        end = self.edges[1:][group]
        e, head, need, seen, q, c, brk = (of(x) for x in ("e", "head", "need", "seen", "q", "c", "brk"))
        head = np.where(self.item == 0, 0, head)  # nothing is repeated over the very first item
        here = np.arange(size)
        # an item turns the page only where something stands on it: places of equal running height are one
        begin = self.edges[:-1][group]
        rank = np.cumsum(np.append(0, (np.diff(self.p) != 0) | (np.diff(group) != 0)))
        last_of = np.searchsorted(rank, np.arange(rank[-1] + 1) if size else [], "right")
        low = np.where(head > 0, here + 1, np.minimum(last_of[rank], end)) if size else here

        def over(i: np.ndarray, k: np.ndarray) -> np.ndarray:
            noted = (c[k] - c[i] > 0) | (seen[k] > 0)
            full = self.p[k] + need[k] - self.p[i] + head[i] + gap * noted > height
            return full | (noted & (q[k] + e[k] - q[i] + gap > most))

        a, b = low.copy(), end.copy()
        while (open_ := a < b).any():
            i = np.flatnonzero(open_)
            mid = (a[i] + b[i]) // 2
            hit = over(i, mid)
            b[i] = np.where(hit, mid, b[i])
            a[i] = np.where(hit, a[i], mid + 1)
        breaks = np.append(np.flatnonzero(brk), size)
        self.next = np.minimum(np.minimum(a, breaks[np.searchsorted(breaks, low)]), end) if size else a
        self.last = self.next >= end  # no further page
        self.group, self.begin = group, begin

    def leave(self) -> tuple[np.ndarray, np.ndarray]:
        """(the first page of each own item's path that begins in a later stretch, pages passed); -1 where the document ends before."""
        to, steps = np.where(self.last, -1, self.next), np.ones(self.item.size, np.int64)
        while (inside := (to >= 0) & self.own[np.maximum(to, 0)]).any():
            i = np.flatnonzero(inside)
            step, on = steps[to[i]], to[to[i]]
            steps[i] += step
            to[i] = on
        return to, steps

    def numbers(self, entry: np.ndarray, page: np.ndarray) -> np.ndarray:
        """The page of every item of stretches that ``entry`` enters as ``page``; -1 before the first page of one that none enters."""
        number = np.full(self.item.size, -1, np.int64)
        at = np.flatnonzero((self.item == entry[self.group]) & self.own) if self.item.size else np.zeros(0, np.int64)
        no = page[self.group[at]]
        number[self.begin[at]] = no - 1  # what stands before is on the page before
        number[at] = no
        while at.size:
            on = ~self.last[at] & self.own[np.minimum(self.next[at], self.item.size - 1)]
            at, no = self.next[at[on]], no[on] + 1
            number[at] = no
        seen = np.maximum.accumulate(np.where(number >= 0, np.arange(self.item.size), -1)) if self.item.size else number
        return np.where(seen >= self.begin, number[np.maximum(seen, 0)], -1)


JUMP = "item long, to long, stretch long, pages long"


def _jumps(height: int, gap: int, most: int, reach: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = Flow(batch.column("items"), height, gap, most)
            to, pages = f.leave()
            first = np.zeros(f.item.size, bool)
            owned = np.flatnonzero(f.own)
            first[owned[np.unique(f.group[owned], return_index=True)[1]]] = True
            # a page that another stretch leads to begins on the first page of this one, or with its first item
            some = np.flatnonzero(f.own & (to >= 0) & (first | (f.p <= f.home * STRETCH * height + reach)))
            doc = batch.column("doc_id").take(pa.array(f.group[some]))
            yield pa.RecordBatch.from_arrays([doc, *(pa.array(x) for x in (f.item[some], f.item[to[some]], f.home[to[some]], pages[some]))], names=["doc_id", "item", "to", "stretch", "pages"])

    return run


PAGED = "stretch long, items array<long>, pages array<long>, last_page long"


def _numbered(height: int, gap: int, most: int):
    """Over stretches with the item and page that enter them: the page of every own item, null before the first page of a stretch that none enters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = Flow(batch.column("items"), height, gap, most)
            entry, page = (batch.column(c).fill_null(-1).to_numpy() for c in ("entry", "page"))
            value = f.numbers(entry, page)
            own = np.flatnonzero(f.own)
            edges = np.append(0, np.cumsum(np.bincount(f.group[own], minlength=batch.num_rows))).astype(np.int32)
            known = value[own] >= 0
            top = np.full(batch.num_rows, -1, np.int64)
            np.maximum.at(top, f.group[own], value[own])
            lists = [pa.ListArray.from_arrays(pa.array(edges), x) for x in (pa.array(f.item[own]), pa.array(value[own], mask=~known))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("stretch"), *lists, pa.array(top, mask=top < 0)], names=["doc_id", "stretch", "items", "pages", "last_page"])

    return run


def _running(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Running sums; ``first`` is the place of the first item of each item's document."""
    s = np.cumsum(value)
    return s - (s - value)[first]


def _highest(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Running maxima inside documents, by doubling."""
    value, here, step = value.copy(), np.arange(value.size), 1
    while (i := np.flatnonzero(here - step >= first)).size:
        value[i] = np.maximum(value[i], value[i - step])
        step *= 2
    return value


def _whole(b: pa.RecordBatch, height: int, gap: int, most: int) -> pa.Array:
    """:func:`_measured` for a batch of documents with arrays of items: each one a stretch of its own."""
    names = b.schema.names
    offsets = b.column("height").offsets.to_numpy().astype(np.int64)
    edges = offsets - offsets[0]
    first, end = (np.repeat(x, np.diff(edges)) for x in (edges[:-1], edges[1:]))
    here = np.arange(first.size)

    def unit(c: str) -> np.ndarray:
        if c not in names:
            return np.zeros(first.size, np.int64)
        v = pc.fill_null(b.column(c).flatten().cast(pa.float64()), 0.0).to_numpy() * UNIT
        a = np.abs(v)
        return np.copysign(np.floor(a) + (a - np.floor(a) >= 0.5), v).astype(np.int64)

    flag = lambda c: pc.fill_null(b.column(c).flatten(), False).to_numpy(zero_copy_only=False) if c in names else np.zeros(first.size, bool)
    high, head, e = unit("height"), np.maximum(unit("header"), 0), np.maximum(unit("notes"), 0)
    h, need = np.maximum(high, 0), np.maximum(np.maximum(unit("need") if "need" in names else high, high - height), 0)
    if "notes" in names:
        x = e - np.maximum(0, np.minimum(most, height - h - head) - gap)
        s = _running(x, first)
        left = s + np.maximum(_highest(-s, first), 0)
        e = e + np.where(here > first, np.append(0, left)[: left.size], 0) - left
    follows = here + 1 < end
    after = lambda v: np.where(follows, np.append(v, 0)[1:], 0)
    kept = flag("keep_next") & follows
    asked = need + e + np.where(kept, h - need + after(need) + after(e), 0)
    noted = np.sign(e)
    before = lambda v: _running(v, first) - v
    cols = {
        "item": here - first, "h": h, "e": e, "head": head, "brk": flag("page_break"), "need": asked, "seen": np.maximum(noted, np.where(kept, after(noted), 0)), "p": before(h + e), "q": before(e),
        "c": before(noted), "own": np.ones(first.size, bool), "home": np.zeros(first.size, np.int64),
    }
    return pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.StructArray.from_arrays([pa.array(v) for v in cols.values()], list(cols)))


def _paginate_rows(docs: Documents, height: int, gap: int, most: int) -> DataFrame:
    rows, read = docs.rows.where("doc_id IS NOT NULL"), docs.read

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, SLICE):
                some = read(b.slice(k, SLICE))
                f = Flow(_whole(some, height, gap, most), height, gap, most)
                none = np.zeros(some.num_rows, np.int64)
                page = f.numbers(none, none)
                yield pa.RecordBatch.from_arrays([some.column("doc_id").take(pa.array(f.group)), *(pa.array(x.astype(np.int32)) for x in (f.item, page))], names=["doc_id", "item", "page"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, item int, page int")


def paginate(items: DataFrame | Documents, height_pt: float, notes_gap_pt: float = 0.0, notes_share: float = 0.5) -> DataFrame:
    """items(doc_id, item from 0, height, page_break, keep_next, header, notes) -> doc_id, item, page (from 0).

    A page takes items until the next one does not fit.  A break is ignored while nothing stands on the page; an item kept
    with the next moves on if both do not fit; a page that begins inside a table takes the header's height first (not the
    first page of all).  ``notes`` is the height of the footnotes an item refers to: they take room on its page, under a
    gap of ``notes_gap_pt``, and no more than ``notes_share`` of the page; what does not fit even on a page of their own
    goes with the next item.  ``need`` (at most the height, and less than it by a page at most) is the room an item asks for where it is the last of its
    page (a word and the blank after it).  All columns but doc_id, item and height may be absent; null counts as nothing.  An item that
    is higher than a page has one to itself.  Items are numbered without gaps or repeats in each document.

    The same from ``Documents``, whose items have the same columns as arrays and are numbered as they stand.
    """
    height, gap, most = round(height_pt * UNIT), round(notes_gap_pt * UNIT), round(notes_share * height_pt * UNIT)
    if isinstance(items, Documents):
        return _paginate_rows(items, height, gap, most)
    doc = f"doc_id {items.schema['doc_id'].dataType.simpleString()}, "
    reach = height * (2 if "need" in items.columns else 1)  # what a page may hold beyond its height: the part of its last item that is not asked for
    s = checkpointed(_stretches(_measured(items, height, gap, most), height, reach))
    jumps = s.mapInArrow(_jumps(height, gap, most, reach), doc + JUMP)
    longest = s.agg(F.max("stretch")).first()[0] or 0
    reached = s.where("stretch = 0").select("doc_id", F.lit(0).cast("long").alias("item"), F.lit(0).cast("long").alias("stretch"), F.lit(0).cast("long").alias("page"))
    levels = [checkpointed(jumps)] if longest else []
    while 2 ** len(levels) <= longest:
        a, b = levels[-1].alias("a"), levels[-1].alias("b")
        levels.append(checkpointed(a.join(b, (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.to") == F.col("b.item"))).select("a.doc_id", "a.item", "b.to", "b.stretch", (F.col("a.pages") + F.col("b.pages")).alias("pages"))))
    for level in reversed(levels):
        on = reached.select("doc_id", "item", "page").join(level, ["doc_id", "item"]).select("doc_id", F.col("to").alias("item"), "stretch", (F.col("page") + F.col("pages")).alias("page"))
        reached = checkpointed(reached.unionByName(on))
    entered = s.join(reached.withColumnRenamed("item", "entry"), ["doc_id", "stretch"], "left").select("doc_id", "stretch", "items", "entry", "page")
    paged = entered.mapInArrow(_numbered(height, gap, most), doc + PAGED)
    ahead = W.partitionBy("doc_id").orderBy("stretch").rowsBetween(W.unboundedPreceding, -1)
    before = paged.select("doc_id", "stretch", "last_page").withColumn("before", F.max("last_page").over(ahead)).drop("last_page")
    rows = paged.join(before, ["doc_id", "stretch"]).select("doc_id", "before", F.explode(F.arrays_zip("items", "pages")).alias("x"))
    return rows.select("doc_id", F.col("x.items").cast("int").alias("item"), F.coalesce("x.pages", "before").cast("int").alias("page"))
