"""Edit histories: coalescing, locks, and what is left applied after undo and redo."""

from __future__ import annotations

import hashlib
import json
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from quireframe.operators import scale

CHUNK = 4096


def _chunked(commands: DataFrame) -> DataFrame:
    return commands.withColumn("_chunk", F.floor(F.col("seq") / CHUNK))


def coalesce_commands(commands: DataFrame) -> DataFrame:
    """commands(doc_id, seq, coalesce_key, old_value, new_value): neighbours with one key become one command with the first
    old and the last new value.  Exact where no undo or redo stands between."""
    c = scale.changes(_chunked(commands), ["doc_id"], "_chunk", ["seq"], "coalesce_key", "step")
    return c.groupBy("doc_id", "step").agg(
        F.min("seq").alias("seq"), F.first("coalesce_key").alias("coalesce_key"), F.min_by("old_value", "seq").alias("old_value"), F.max_by("new_value", "seq").alias("new_value"), F.count(F.lit(1)).alias("merged")
    )


def operation_lock(events: DataFrame) -> DataFrame:
    """events(doc_id, seq, op, owner): op is lock, unlock, undo, redo or any command; adds ``holder`` (who holds the lock before the event) and ``refused``.

    A lock is refused while one is held, and only its owner's unlock opens it.  While it is held, commands of all others
    and every undo and redo are refused; the owner's own commands pass.  Without an owner column all events are one owner's.
    Each (document, chunk) is walked in its own task from the holder that it begins with.
    """
    e = events if "owner" in events.columns else events.withColumn("owner", F.lit(None).cast("string"))
    e = e.withColumn("chunk", F.floor(F.col("seq") / CHUNK).cast("long"))
    e = e.join(_held(e).where("holder IS NOT NULL").withColumnRenamed("holder", "_from"), ["doc_id", "chunk"], "left").repartition("doc_id", "chunk").sortWithinPartitions("doc_id", "chunk", "seq")
    out = T.StructType([*events.schema.fields, T.StructField("holder", T.StringType()), T.StructField("refused", T.BooleanType())])
    return e.select(*events.columns, *([] if "owner" in events.columns else ["owner"]), "chunk", "_from").mapInPandas(_walk_locks(events.columns), out)


def _walk_locks(columns: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, holder = None, None
        for pdf in batches:
            before, refused = [], []
            for doc, chunk, start, op, owner in zip(pdf["doc_id"], pdf["chunk"], pdf["_from"], pdf["op"], pdf["owner"]):
                if (doc, chunk) != place:
                    place, holder = (doc, chunk), tuple(json.loads(start)) if isinstance(start, str) else None
                before.append(holder and holder[0])
                own = holder == (owner,)
                refused.append(holder is not None and (op in ("lock", "undo", "redo") or not own) or op == "unlock" and not own)
                if op == "lock" and holder is None:
                    holder = (owner,)
                elif op == "unlock" and own:
                    holder = None
            yield pdf[columns].assign(holder=before, refused=refused)

    return run


Holder = tuple[str | None] | None


def _holders(locks: list[tuple[str, str | None]]) -> tuple[Holder, dict[str | None, Holder]]:
    """What a chunk's locks and unlocks (op, owner) lead to: from no lock held, and from a lock of each owner who unlocks in it (that of any other stays)."""
    free: Holder = None
    opened: dict[str | None, Holder] = {}  # read backwards: who holds the lock at the end if an owner's lock is held here
    for op, owner in reversed(locks):
        if op == "lock":
            free = opened.get(owner, (owner,))
        else:
            opened[owner] = free
    return free, opened


def _lock_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pdf[["doc_id", "chunk"]].assign(sums=[json.dumps([(f := _holders([(x["op"], x["owner"]) for x in locks]))[0], list(f[1].items())]) if len(locks) else None for locks in pdf["locks"]])


def _lock_merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    doc, holder = None, None
    for pdf in batches:
        at = []
        for d, sums in zip(pdf["doc_id"].tolist(), pdf["sums"].tolist()):
            if d != doc:
                doc, holder = d, None
            at.append(holder and json.dumps(holder))
            if sums is not None:
                free, opened = json.loads(sums)
                holder = free if holder is None else dict((o, h) for o, h in opened).get(holder[0], holder)
        yield pdf[["doc_id", "chunk"]].assign(holder=at)


def _moved(moves: list[int], by: int) -> None:
    """Append a move of the cursor (undo < 0 < redo).  A turn no longer than the moves around it is cut out: wherever the
    cursor stands and the tape ends, the three moves end where their sum does.  What is left grows, then shrinks."""
    if moves and (moves[-1] < 0) == (by < 0):
        by += moves.pop()
    moves.append(by)
    while len(moves) > 2 and abs(moves[-2]) <= min(abs(moves[-3]), abs(moves[-1])):
        moves[-3:] = [sum(moves[-3:])]


class Fold:
    """A chunk as the steps it comes to, whatever stands before it: move the cursor, cut the tape there, put commands on it.

    Undo and redo stack are one tape with a cursor between them.  Only the first command of a step can meet one from before
    the step with its own key; what happens between a step's own commands is settled here.
    """

    def __init__(self) -> None:
        self.steps: list[tuple[list[int], list[tuple[int, str | None]]]] = [([], [])]
        self.since: list[int] = []

    def move(self, by: int) -> None:
        _moved(self.since, by)

    def put(self, seq: int, key: str | None) -> None:
        (moves, items), down, deepest = self.steps[-1], 0, 0
        if not items:
            self.steps[-1] = (self.since, [(seq, key)])
        else:
            for m in self.since:
                down = max(0, down - m)
                deepest = max(deepest, down)
            if deepest > len(items):
                self.steps.append((self.since, [(seq, key)]))
            elif down == len(items) and items[0][1] is not None:  # it may have taken the place of one before it
                del items[1:]
                self.steps.append(([-1], [(seq, key)]))
            else:
                del items[len(items) - down :]
                if items and key is not None and items[-1][1] == key:
                    items.pop()  # were it the step's first, the new one meets what stands before by the same key
                items.append((seq, key))
        self.since = []

    def done(self) -> list[tuple[list[int], list[tuple[int, str | None]]]]:
        return [*(s for s in self.steps if s[1]), *([(self.since, [])] if self.since else [])]


#: Commands in one row of a step; a longer step goes on in further rows without moves.
PART = 256
KEY = 16
STEPS = "doc_id long, chunk long, step int, moves array<long>, n int, keys binary, seqs array<long>"


def _key(key: str | None) -> bytes:
    return bytes(KEY) if key is None else hashlib.blake2b(str(key).encode(), digest_size=KEY).digest()


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    at, fold, holder, out = None, Fold(), None, []

    def rows() -> list[tuple]:
        parts = [(moves if i == 0 else [], items[i : i + PART]) for moves, items in fold.done() for i in range(0, max(1, len(items)), PART)]
        return [(*at, k, moves, len(items), b"".join(_key(key) for _, key in items), [s for s, _ in items]) for k, (moves, items) in enumerate(parts)]

    frame = lambda out: pd.DataFrame(out, columns=[c.split()[0] for c in STEPS.split(", ")])
    for pdf in batches:
        for d, chunk, seq, op, key, owner, held in zip(*(pdf[c].tolist() for c in ("doc_id", "chunk", "seq", "op", "coalesce_key", "owner", "holder"))):
            if (d, chunk) != at:
                if at:
                    out += rows()
                at, fold, holder = (d, chunk), Fold(), held and tuple(json.loads(held))
                if len(out) >= 1000:
                    yield frame(out)
                    out = []
            if op == "lock":
                holder = holder or (owner,)
            elif op == "unlock":
                holder = None if holder == (owner,) else holder
            elif op in ("undo", "redo"):
                if holder is None:
                    fold.move(-1 if op == "undo" else 1)
            elif holder in (None, (owner,)):
                fold.put(seq, key)
    if at:
        yield frame(out + rows())


def _merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Which part of each step's commands is left on each tape, and where.  Keys lie in a file, so that memory holds steps, not commands."""
    doc, cursor, end, blocks, out = None, 0, 0, [], []

    def rows() -> list[tuple]:
        return [(doc, chunk, step, min(n, cursor - start), start, end - cursor) for start, n, chunk, step in blocks if start < cursor]

    frame = lambda out: pd.DataFrame(out, columns=["doc_id", "chunk", "step", "left", "start", "redo_depth"])
    with tempfile.TemporaryFile() as keys:
        for pdf in batches:
            for d, chunk, step, moves, n, new in zip(*(pdf[c].tolist() for c in ("doc_id", "chunk", "step", "moves", "n", "keys"))):
                if d != doc:
                    out += rows()
                    doc, cursor, end, blocks = d, 0, 0, []
                    if len(out) >= 1000:
                        yield frame(out)
                        out = []
                for m in moves:
                    cursor = min(end, max(0, cursor + int(m)))
                if n:
                    if cursor and any(new[:KEY]):
                        keys.seek((cursor - 1) * KEY)
                        cursor -= keys.read(KEY) == new[:KEY]
                    while blocks and blocks[-1][0] >= cursor:
                        blocks.pop()
                    if blocks:
                        start, left, *of = blocks[-1]
                        blocks[-1] = (start, min(left, cursor - start), *of)
                    keys.seek(cursor * KEY)
                    keys.write(new)
                    blocks.append((cursor, n, chunk, step))
                    cursor = end = cursor + n
        yield frame(out + rows())


def _held(events: DataFrame) -> DataFrame:
    """(doc_id, chunk, holder): who holds the lock where each chunk of events(doc_id, chunk, seq, op, owner) begins."""
    locks = F.sort_array(F.collect_list(F.when(F.col("op").isin("lock", "unlock"), F.struct("seq", "op", "owner"))))
    locks = events.groupBy("doc_id", "chunk").agg(locks.alias("locks")).mapInPandas(_lock_sums, "doc_id long, chunk long, sums string")
    return locks.repartition("doc_id").sortWithinPartitions("doc_id", "chunk").mapInPandas(_lock_merge, "doc_id long, chunk long, holder string")


def undo_redo_state(commands: DataFrame) -> DataFrame:
    """The commands still applied at the end of each document's history, in order, and how many could be redone.

    commands(doc_id, seq, op, and where they matter coalesce_key and owner): op is undo, redo, lock, unlock or any command.
    A merged command goes by its last ``seq``.  Each (document, chunk) is folded in its own task, first its locks, then its
    commands under the lock it begins with; per document only these sums meet in order, and the commands that are left
    come back as rows by a join.
    """
    extra = [F.col(c) if c in commands.columns else F.lit(None).cast("string").alias(c) for c in ("coalesce_key", "owner")]
    c = commands.select("doc_id", F.floor(F.col("seq") / CHUNK).cast("long").alias("chunk"), "seq", "op", *extra)
    c = c.join(_held(c).where("holder IS NOT NULL"), ["doc_id", "chunk"], "left").repartition("doc_id", "chunk").sortWithinPartitions("doc_id", "chunk", "seq")
    steps = c.select("doc_id", "chunk", "seq", "op", "coalesce_key", "owner", "holder").mapInPandas(_fold, STEPS)
    left = steps.drop("seqs").repartition("doc_id").sortWithinPartitions("doc_id", "chunk", "step").mapInPandas(_merge, "doc_id long, chunk long, step int, left int, start long, redo_depth int")
    rows = steps.select("doc_id", "chunk", "step", "seqs").join(left, ["doc_id", "chunk", "step"])
    rows = rows.select("doc_id", "start", F.posexplode(F.slice("seqs", F.lit(1), F.col("left"))).alias("pos", "seq"), "redo_depth")
    return rows.select("doc_id", (F.col("start") + F.col("pos")).cast("int").alias("place"), "seq", "redo_depth")


def latest_pages(updates: DataFrame) -> DataFrame:
    """updates(doc_id, page_index, version, ...): the newest row of every page."""
    rest = [c for c in updates.columns if c not in ("doc_id", "page_index")]
    return updates.groupBy("doc_id", "page_index").agg(F.max_by(F.struct(*rest), "version").alias("_r")).select("doc_id", "page_index", "_r.*")
