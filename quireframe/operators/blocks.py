"""The tree of Markdown blocks: paragraphs, headings, code, tables, rules, list items and quotes in quotes.

What a line does depends on the block that is open before it, and only on that: every line is a map from the few states of
an open block to the state after it.  Maps compose, so the states of all lines come from a prefix scan of compositions (a
number of vector steps logarithmic in the lines of the longest text), not from a walk.  The patterns of lines are matched
in the JVM; what goes to Python is one small number for each line.

Quotes are containers: what they hold is stripped of its marks and read as the next level, up to ``DEPTH`` levels, each
one pass over the quotes of the level before.  Lists nest up to ``NESTED`` levels by indent.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from quireframe.functions.textcols import JS_SPACE, js_trim
from quireframe.operators.markdown import FENCE, HEADING, NOTE_MORE, QUOTE, RULE, _cells
from quireframe.session import checkpointed
from quireframe.sources.layout import let

# Limits and line patterns.
DEPTH, NESTED = 30, 3
ITEM = r"^( {0,20})([-*+]|([0-9]{1,9})[.)]) +(.*)$"
INDENTED = r"^( {4}|\t)"
NOTE_DEF = r"^ {0,3}\[\^([^\]\s]{1,64})\]:[ \t]*(.*)$"
REF_DEF = r"""^ {0,3}\[([^^\]\n][^\]\n]{0,199})\]:[ \t]*(<[^>\n]*>|\S+)(?:[ \t]+(?:"[^"]*"|'[^']*'|\([^)]*\)))?[ \t]*$"""
EQUALS, DASHES = r"^ {0,3}=+ *$", r"^ {0,3}-+ *$"
TASK = r"(?s)^\[( |x|X)\](?: +|$)(.*)$"

FLAGS = BLANK, LISTED, INDENT, LINE, TITLE, QUOTED, UNDER1, UNDER2, TABLE, OPENS, FENCED, HOLLOW = [1 << i for i in range(12)]
STATES = NONE, PARA, ROWS, LAZY, STRICT, LIST, CODE, GAP, HEAD = range(9)
SKIP, MORE, FENCE_, CODE_, RULE_, HEADING_, QUOTE_, TABLE_, ITEM_, PARA_, UNDERLINE = range(11)
KINDS = {FENCE_: "code", CODE_: "code", RULE_: "rule", HEADING_: "heading", QUOTE_: "quote", TABLE_: "table", ITEM_: "item", PARA_: "paragraph"}


def step(state: int, f: int) -> tuple[int, int]:
    """(state after, what the line is) of a line with flags ``f`` under an open block."""
    if f & FENCED:
        return NONE, FENCE_ if f & OPENS else MORE
    if state == HEAD:
        return ROWS, MORE
    if state == CODE and f & INDENT:
        return CODE, MORE
    if f & BLANK:
        return (GAP, SKIP) if state in (CODE, GAP) else (NONE, SKIP)
    rule, quote = f & LINE and not f & LISTED, f & QUOTED
    inside = STRICT if f & HOLLOW else LAZY
    if state == PARA:
        if f & (UNDER1 | UNDER2):
            return NONE, UNDERLINE
        if not (rule or quote or f & (TITLE | LISTED)):
            return PARA, MORE
    elif state == ROWS and not (f & TITLE or quote):
        return ROWS, MORE
    elif state == GAP and f & INDENT:
        return CODE, MORE
    elif state in (LAZY, STRICT) and quote:
        return inside, MORE
    elif state == LAZY and not (rule or f & (TITLE | LISTED)):
        return LAZY, MORE
    elif state == LIST and not (rule or quote or f & (TITLE | LISTED)):
        return LIST, MORE
    if f & INDENT and not f & LISTED:
        return CODE, CODE_
    if rule:
        return NONE, RULE_
    if f & TITLE:
        return NONE, HEADING_
    if quote:
        return inside, QUOTE_
    if f & TABLE:
        return HEAD, TABLE_
    return (LIST, ITEM_) if f & LISTED else (PARA, PARA_)


def _flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values of a list column in one array, and where each row begins."""
    edge = col.offsets.to_numpy().astype(np.int64)
    return col.values.slice(edge[0], edge[-1] - edge[0]).to_numpy(zero_copy_only=False).astype(np.int64), edge - edge[0]


def _lists_of(values: pa.Array, edge: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), values)


def _roles(flags: pa.Array) -> pa.Array:
    flat, edge = _flat(flags)
    seen, at = np.unique(flat, return_inverse=True)
    table = np.array([[step(s, int(f)) for s in STATES] for f in seen], np.uint8).reshape(-1, len(STATES), 2)
    maps = table[at, :, 0]
    begin = np.repeat(edge[:-1], np.diff(edge))
    width = 1
    while width < (np.diff(edge).max() if edge.size > 1 else 0):
        i = np.flatnonzero(np.arange(flat.size) - width >= begin)
        maps[i] = np.take_along_axis(maps[i], maps[i - width].astype(np.int64), 1)
        width *= 2
    before = np.zeros(flat.size, np.int64)
    inner = np.flatnonzero(np.arange(flat.size) > begin)
    before[inner] = maps[inner - 1, NONE]
    return _lists_of(pa.array(table[at, before, 1].astype(np.int32) if flat.size else np.zeros(0, np.int32)), edge)


def _kept(marks: pa.Array) -> pa.Array:
    """Lines that stay when definitions go: 1 begins a note, 2 goes on with one, 4 is a reference."""
    flat, edge = _flat(marks)
    here, begin = np.arange(flat.size), np.repeat(edge[:-1], np.diff(edge))
    last = lambda mask: np.maximum.accumulate(np.where(mask, here, -1)) if flat.size else here
    note = last(flat & 1 > 0)
    gone = (note >= begin) & (note >= last(flat & 2 == 0)) | (flat & 4 > 0)
    return _lists_of(pa.array(~gone), edge)


PLACED = T.StructType([T.StructField("depth", T.IntegerType()), T.StructField("list", T.IntegerType()), T.StructField("holders", T.ArrayType(T.IntegerType()))])


def _lists(blocks: pa.Array) -> pa.Array:
    """For every block (role, indent, ordered) that is an item: its depth, the block that begins its list, and the items it is nested in."""
    out = []
    for row in blocks.to_pylist():
        rows, stack = [], []  # open lists: (indent, ordered, first block, last item)
        for n, b in enumerate(row):
            if b["role"] != ITEM_:
                stack = []
                rows.append(None)
                continue
            key = (b["indent"], b["ordered"])
            if not (stack and len(stack) < NESTED and key[0] > stack[-1][0]):
                while stack and stack[-1][:2] != key:
                    stack.pop()
            if stack and stack[-1][:2] == key:
                stack[-1] = (*key, stack[-1][2], n)
            else:
                stack.append((*key, n, n))
            rows.append({"depth": len(stack) - 1, "list": stack[-1][2], "holders": [s[3] for s in stack[:-1]]})
        out.append(rows)
    return pa.array(out, pa.list_(pa.struct([("depth", pa.int32()), ("list", pa.int32()), ("holders", pa.list_(pa.int32()))])))


def _with(d: DataFrame, name: str, kind: T.DataType, value: Column, fn: Callable[[pa.Array], pa.Array]) -> DataFrame:
    """``d`` and ``fn`` of ``value`` (a list column): only that column is looked at, and nothing is moved across."""
    keep = d.columns
    schema = T.StructType([*d.schema.fields, T.StructField(name, T.ArrayType(kind))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), fn(b.column("_in"))], names=[*keep, name])

    return d.withColumn("_in", value).mapInArrow(run, schema)


def _fences(d: DataFrame) -> DataFrame:
    """Adds ``_spans``, the fenced stretches (from, to, closed) of ``lines``; only the lines that look like fences are folded."""
    looks = F.filter(F.transform("lines", lambda l, i: F.struct(i.alias("i"), F.regexp_extract(l["s"], FENCE, 1).alias("mark"), F.trim(F.regexp_extract(l["s"], FENCE, 2)).alias("info"))), lambda x: x["mark"] != "")
    d = d.withColumn("_looks", looks)
    return d.withColumn("_spans", F.expr("""aggregate(_looks, named_struct('mark', '', 'from', -1, 'spans', cast(array() as array<struct<from:int,to:int,closed:boolean>>)),
        (s, f) -> if(s.mark = '', named_struct('mark', f.mark, 'from', f.i, 'spans', s.spans),
            if(left(f.mark, 1) = left(s.mark, 1) and length(f.mark) >= length(s.mark) and f.info = '',
               named_struct('mark', '', 'from', -1, 'spans', concat(s.spans, array(named_struct('from', s.from, 'to', f.i, 'closed', true)))), s)),
        s -> if(s.mark = '', s.spans, concat(s.spans, array(named_struct('from', s.from, 'to', size(lines) - 1, 'closed', false)))))""")).drop("_looks")


def _flags(l: Column, i: Column, spans: Column, heads: Column, quotes: bool) -> Column:
    """The flags of the i-th line."""
    s, rest = l["s"], F.regexp_replace(l["s"], QUOTE, "")
    quoted = s.rlike(QUOTE) & F.lit(quotes)
    pairs = [(js_trim(s) == "", BLANK), (s.rlike(ITEM), LISTED), (s.rlike(INDENTED), INDENT), (s.rlike(RULE), LINE), (s.rlike(HEADING), TITLE), (quoted, QUOTED), (s.rlike(EQUALS), UNDER1), (s.rlike(DASHES), UNDER2),
             (F.coalesce(F.get(heads, i), F.lit(False)), TABLE), (F.exists(spans, lambda x: x["from"] == i), OPENS), (F.exists(spans, lambda x: (x["from"] <= i) & (x["to"] >= i)), FENCED), (quoted & ((js_trim(rest) == "") | rest.rlike(FENCE)), HOLLOW)]
    total = F.lit(0)
    for cond, bit in pairs:
        total = total + F.when(cond, bit).otherwise(0)
    return total


def _level(d: DataFrame, quotes: bool) -> DataFrame:
    """Blocks of one level of (doc_id, path, lines): doc_id, path, n, kind, role, span (lines), roles, closed, at (of items)."""
    d = _fences(d)
    head, delim = _cells("get(lines, i).s"), _cells("get(lines, i + 1).s")
    heads = F.expr(f"""transform(sequence(0, size(lines) - 1), i -> if(get(lines, i + 1).s rlike '^[ \\\\t|:-]*-[ \\\\t|:-]*$' and contains(get(lines, i + 1).s, '|') and contains(get(lines, i).s, '|'),
        transform(array(struct({head} as h, {delim} as d)), x -> size(x.h) = size(x.d) and forall(x.d, c -> c rlike '^:?-+:?$'))[0], false))""")
    d = d.where(F.size("lines") > 0).withColumn("_heads", heads)
    # let: fences and heads are found once for a text, not once for a line
    d = _with(d, "roles", T.IntegerType(), let(F.struct("_spans", "_heads"), lambda x: F.transform("lines", lambda l, i: _flags(l, i, x["_spans"], x["_heads"], quotes))), _roles).drop("_heads")
    d = d.withColumn("_starts", F.filter(F.transform("roles", lambda r, i: F.when(r.between(FENCE_, PARA_), i)), lambda i: i.isNotNull()))
    d = d.withColumn("blocks", F.expr("""transform(_starts, (b, n) -> struct(n as n, get(roles, b) as role, slice(lines, b + 1, coalesce(get(_starts, n + 1), size(lines)) - b) as span,
        slice(roles, b + 1, coalesce(get(_starts, n + 1), size(lines)) - b) as roles, exists(_spans, x -> x.from = b and x.closed) as closed))"""))
    first = lambda b: F.element_at(b["span"], 1)["s"]
    items = F.transform("blocks", lambda b: F.struct(b["role"].alias("role"), F.length(F.regexp_extract(first(b), ITEM, 1)).alias("indent"), (F.regexp_extract(first(b), ITEM, 3) != "").alias("ordered")))
    d = _with(d.select("doc_id", "path", "blocks"), "_at", PLACED, items, _lists)
    return d.select("doc_id", "path", F.explode(F.arrays_zip("blocks", "_at")).alias("b")).select("doc_id", "path", "b.blocks.*", F.col("b._at").alias("at"))


def _described(b: DataFrame) -> DataFrame:
    """The rows of the tree from the blocks of a level."""
    last = F.array_max(F.transform("roles", lambda r, i: F.when(r != SKIP, i)))
    b = b.withColumn("own", F.slice("span", 1, last + 1)).withColumn("roles", F.slice("roles", 1, last + 1))
    strings = F.transform("own", lambda l: l["s"])
    b = b.withColumn("s", strings)
    n, role, head = F.size("own"), F.col("role"), F.get("s", F.lit(0))
    under = F.element_at("roles", -1) == UNDERLINE
    join = lambda col, sep="\n": F.array_join(col, sep)
    lstrip = lambda x: F.regexp_replace(x, r"^[\s ﻿]+", "")
    para = join(F.transform("s", lambda x, i: F.when(i == n - 1, js_trim(x)).otherwise(lstrip(x))))
    setext = join(F.transform(F.slice("s", 1, F.greatest(n - 1, F.lit(0))), js_trim), " ")
    fence = join(F.slice("s", 2, F.greatest(n - 1 - F.col("closed").cast("int"), F.lit(0))))
    code = join(F.transform("s", lambda x, i: F.when(F.get("roles", i) == SKIP, "").otherwise(F.regexp_replace(x, INDENTED, ""))))
    title = F.regexp_replace(F.regexp_extract(head, HEADING, 2), r"[ \t]+#+[ \t]*$", "")
    item = F.array_join(F.concat(F.array(F.regexp_extract(head, ITEM, 4)), F.transform(F.slice("s", 2, F.greatest(n - 1, F.lit(0))), js_trim)), "\n")
    task = (role == ITEM_) & item.rlike(TASK)
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv]), role)
    kind = F.when((role == PARA_) & under, "heading").otherwise(kind)
    text = (F.when(role == FENCE_, fence).when(role == CODE_, code).when(role == HEADING_, title).when((role == PARA_) & under, setext).when(role == PARA_, para)
            .when(role == TABLE_, join("s")).when(task, F.regexp_extract(item, TASK, 2)).when(role == ITEM_, item))
    level = F.when(role == HEADING_, F.length(F.regexp_extract(head, HEADING, 1))).when((role == PARA_) & under, F.when(F.element_at("s", -1).rlike(EQUALS), 1).otherwise(2))
    marker = F.regexp_extract(head, ITEM, 3)
    holders = F.coalesce("at.holders", F.array().cast("array<int>"))
    return b.select(
        "doc_id", F.concat("path", holders, F.array("n")).alias("path"), kind.alias("kind"), F.get("own", F.lit(0))["no"].alias("from_line"), F.element_at("own", -1)["no"].alias("to_line"), level.alias("level"),
        F.when(role == FENCE_, F.nullif(js_trim(F.regexp_extract(head, FENCE, 2)), F.lit(""))).alias("lang"), F.when(role == ITEM_, marker != "").alias("ordered"), F.when((role == ITEM_) & (marker != ""), marker.cast("int")).alias("number"),
        F.when(task, F.regexp_extract(item, TASK, 1) != " ").alias("checked"), F.when(role == ITEM_, F.col("at.list")).alias("list"), text.alias("text"),
    )


def block_tree(docs: DataFrame, text: str = "text", depth: int = DEPTH) -> DataFrame:
    """doc_id, path, kind, from_line, to_line, level, lang, ordered, number, checked, list, text: every block of every text.

    ``path`` numbers the block within what holds it: blocks of a quote follow the quote's path, items of an inner list the
    path of the item they belong to.  ``list`` is the number of the block that begins an item's list.  Lines count from 0.
    Definitions of notes (with their continuation lines) and of references are taken out first; a line that looks like a
    fence is one even right after a note.  Beyond ``depth`` levels the marks of a quote are text.  A null text has no blocks.
    """
    d = docs.select("doc_id", F.lit(None).cast("array<int>").alias("path"), F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n", -1).alias("_s")).where("_s IS NOT NULL")
    d = _fences(d.select("doc_id", F.array().cast("array<int>").alias("path"), F.transform("_s", lambda s, i: F.struct(i.alias("no"), s.alias("s"))).alias("lines")))
    mark = lambda l: F.when(l["s"].rlike(NOTE_DEF), 1).otherwise(0) + F.when(l["s"].rlike(NOTE_MORE), 2).otherwise(0) + F.when(l["s"].rlike(REF_DEF), 4).otherwise(0)
    free = lambda spans, i: ~F.exists(spans, lambda x: (x["from"] <= i) & (x["to"] >= i))
    d = _with(d, "_keep", T.BooleanType(), let(F.col("_spans"), lambda spans: F.transform("lines", lambda l, i: F.when(free(spans, i), mark(l)).otherwise(0))), _kept)
    level = d.select("doc_id", "path", F.filter("lines", lambda l, i: F.get("_keep", i)).alias("lines"))
    out = None
    for k in range(depth + 1):
        blocks = checkpointed(_level(level, k < depth))
        rows = _described(blocks)
        out = rows if out is None else out.unionByName(rows)
        quotes = blocks.where(F.col("role") == QUOTE_)
        if k == depth or quotes.isEmpty():
            break
        inner = F.transform(F.slice("span", 1, F.array_max(F.transform("roles", lambda r, i: F.when(r != SKIP, i))) + 1), lambda l: F.struct(l["no"].alias("no"), F.when(l["s"].rlike(QUOTE), F.regexp_replace(l["s"], QUOTE, "")).otherwise(js_trim(l["s"])).alias("s")))
        level = quotes.select("doc_id", F.concat("path", F.array("n")).alias("path"), inner.alias("lines"))
    return out
