"""The block tree against a plain recursive reading, on made lines and on the given texts."""

import os
import random
import re

import pytest

from quireframe.operators import blocks
from quireframe.plans.text_queries import MARKS

FENCE = re.compile(r" {0,3}(`{3,}|~{3,})(.*)")
ITEM = re.compile(r"( {0,20})([-*+]|([0-9]{1,9})[.)]) +(.*)")
RULE = re.compile(r" {0,3}([-*_])( *\1){2,} *")
HEAD = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?[ \t]*")
QUOTE = re.compile(r" {0,3}>( ?)")
JS = " \t\n\v\f\r                 　﻿"


def blank(s):
    return not s.strip(JS)


def indented(s):
    return re.match(r" {4}|\t", s)


def cells(s):
    if "|" not in s:
        return None
    s = s.strip(" ")
    s = s[1:] if s.startswith("|") else s
    s = s[:-1] if s.endswith("|") and not s.endswith("\\|") else s
    return re.split(r"(?<!\\)\|", s)


def heads_table(lines, i):
    a, b = cells(lines[i][1]), cells(lines[i + 1][1]) if i + 1 < len(lines) else None
    return a and b and len(a) == len(b) and re.fullmatch(r"[ \t|:-]*-[ \t|:-]*", lines[i + 1][1]) and all(re.fullmatch(":?-+:?", c.strip(" ")) for c in b)


def breaks(s, quotes=True):
    return FENCE.fullmatch(s) or (RULE.fullmatch(s) and not ITEM.fullmatch(s)) or HEAD.fullmatch(s) or (quotes and QUOTE.match(s))


def parse(lines, path, depth, most):
    """Rows (path, kind, from, to, level, checked, list, text) of lines (no, text), block after block."""
    out, i, n, open_lists = [], 0, 0, []

    def put(kind, j, suffix=(), **more):
        last = j - 1
        while blank(lines[last][1]) and kind != "code":
            last -= 1
        out.append((path + [*suffix, n], kind, lines[i][0], lines[last][0], more.get("level"), more.get("checked"), more.get("list"), more.get("text")))

    while i < len(lines):
        s = lines[i][1]
        if blank(s):
            i += 1
            continue
        j = i + 1
        item = ITEM.fullmatch(s)
        if f := FENCE.fullmatch(s):
            close = re.compile(r" {0,3}" + re.escape(f[1][0]) + "{%d,}[ \t]*" % len(f[1]))
            while j < len(lines) and not close.fullmatch(lines[j][1]):
                j += 1
            text = "\n".join(x for _, x in lines[i + 1 : j])
            j = min(j + 1, len(lines))
            put("code", j, text=text)
        elif indented(s) and not item:
            while j < len(lines):
                if indented(lines[j][1]):
                    j += 1
                    continue
                k = j
                while k < len(lines) and blank(lines[k][1]):
                    k += 1
                if k == j or k == len(lines) or not indented(lines[k][1]):
                    break
                for q in range(j, k):
                    lines[q] = (lines[q][0], "")
                j = k
            put("code", j, text="\n".join(re.sub(r"^( {4}|\t)", "", x) for _, x in lines[i:j]))
        elif RULE.fullmatch(s) and not item:
            put("rule", j)
        elif h := HEAD.fullmatch(s):
            put("heading", j, level=len(h[1]), text=re.sub(r"[ \t]+#+[ \t]*$", "", h[2] or ""))
        elif QUOTE.match(s) and depth < most:
            inner = []
            j = i
            while j < len(lines):
                x = lines[j][1]
                if m := QUOTE.match(x):
                    inner.append((lines[j][0], x[m.end() :]))
                elif inner and not blank(x) and not blank(inner[-1][1]) and not FENCE.fullmatch(inner[-1][1]) and not breaks(x) and not ITEM.fullmatch(x):
                    inner.append((lines[j][0], x.strip(JS)))
                else:
                    break
                j += 1
            put("quote", j)
            out += parse(inner, path + [n], depth + 1, most)
        elif heads_table(lines, i):
            j = i + 2
            while j < len(lines) and not blank(lines[j][1]) and not FENCE.fullmatch(lines[j][1]) and not HEAD.fullmatch(lines[j][1]) and not (QUOTE.match(lines[j][1]) and depth < most):
                j += 1
            put("table", j, text="\n".join(x for _, x in lines[i:j]))
        elif item:
            while j < len(lines) and not blank(lines[j][1]) and not ITEM.fullmatch(lines[j][1]) and not breaks(lines[j][1], depth < most):
                j += 1
            text = "\n".join([item[4]] + [x.strip(JS) for _, x in lines[i + 1 : j]])
            t = re.fullmatch(r"(?s)\[( |x|X)\](?: +|$)(.*)", text)
            key = (len(item[1]), item[3] is not None)
            if not (open_lists and len(open_lists) < 3 and key[0] > open_lists[-1][0][0]):
                while open_lists and open_lists[-1][0] != key:
                    open_lists.pop()
            first = open_lists.pop()[1] if open_lists and open_lists[-1][0] == key else n
            put("item", j, [x[2] for x in open_lists], checked=t and t[1] != " ", list=first, text=t[2] if t else text)
            open_lists.append((key, first, n))
            n, i = n + 1, j
            continue
        else:
            level = None
            while j < len(lines) and not blank(lines[j][1]):
                x = lines[j][1]
                if re.fullmatch(r" {0,3}(=+|-+) *", x):
                    level = 1 if "=" in x else 2
                    break
                if breaks(x, depth < most) or ITEM.fullmatch(x):
                    break
                j += 1
            own = [x for _, x in lines[i:j]]
            if level:
                j += 1
                put("heading", j, level=level, text=" ".join(x.strip(JS) for x in own))
            else:
                put("paragraph", j, text="\n".join([x.lstrip(JS) for x in own[:-1]] + [own[-1].strip(JS)]))
        open_lists = []
        n, i = n + 1, j
    return out


def read(text, most=30):
    lines, out, shut, note = re.sub("\r\n?", "\n", text).split("\n"), [], None, False
    for no, s in enumerate(lines):
        f = FENCE.fullmatch(s)
        if shut:
            out.append((no, s))
            if f and f[1][0] == shut[0] and len(f[1]) >= len(shut) and not f[2].strip(" "):
                shut = None
            continue
        if f:
            shut, note = f[1], False
            out.append((no, s))
            continue
        if note and re.match(r"( {2,}|\t)\S", s):
            continue
        note = bool(re.fullmatch(r" {0,3}\[\^([^\]\s]{1,64})\]:[ \t]*(.*)", s))
        if not note and not re.fullmatch(blocks.REF_DEF[1:-1], s):
            out.append((no, s))
    return parse(out, [], 0, most)


PIECES = ["", "", " ", "    ", "\t", "text", "  more text  ", "# one", "## two ##", "####### no", "---", "--", "-", "***", "* * *", "===", "- a", "- [x] done", "- [ ] open", "  - b", "    - c", "      - d", "1. n", "2) m", "  1. k", "   * e", "> q", "> > qq", ">", "> - i", "> ```", ">> x", "```", "```py", "````", "~~~", "    code", "\tcode", "     ", "| a | b |", "|---|:-:|", "a | b", "-|-", "| a \\| b |", "lazy", "+ x", "12345. y", "[^n]: note", "  on it", "[r]: http://x", "[r] not", "-  ", "_ _ _"]


def rows_of(df):
    return sorted((list(r["path"]), r["kind"], r["from_line"], r["to_line"], r["level"], r["checked"], r["list"], r["text"]) for r in df)


def compare(spark, texts, depth=30):
    got = {}
    for r in blocks.block_tree(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), depth=depth).collect():
        got.setdefault(r["doc_id"], []).append(r)
    for i, t in enumerate(texts):
        want = sorted([tuple(r) for r in read(t, depth)] if t is not None else [], key=lambda r: r[0])
        have = sorted(rows_of(got.get(i, [])), key=lambda r: r[0])
        assert have == want, (t, [x for x in zip(have, want) if x[0] != x[1]][:2], len(have), len(want))


@pytest.mark.parametrize("depth", [30, 1])
def test_random_lines(spark, depth):
    rng = random.Random(depth)
    texts = ["\n".join(rng.choices(PIECES, k=rng.randint(0, 40))) for _ in range(250)] + [None, "", "\n\n", "a\r\nb\rc"]
    compare(spark, texts, depth)


def test_given_texts_as_they_are_and_behind_marks(spark):
    import pyarrow.parquet as pq

    path = "/root/testdata/sf0.001/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no given texts here")
    texts = pq.read_table(path, columns=["text"]).column("text").to_pylist()
    marked = ["\n".join(MARKS[i % len(MARKS)] + s for i, s in enumerate(t.split("\n"))) for t in texts if t]
    compare(spark, texts + marked)


def test_scan_equals_the_walk():
    rng = random.Random(9)
    import pyarrow as pa

    flags = [[rng.choice([0, blocks.BLANK, blocks.LISTED, blocks.INDENT, blocks.QUOTED, blocks.QUOTED | blocks.HOLLOW, blocks.TITLE, blocks.UNDER1, blocks.TABLE, blocks.LINE, blocks.BLANK | blocks.INDENT, blocks.FENCED | blocks.OPENS]) for _ in range(rng.randint(0, 300))] for _ in range(30)]
    for row, got in zip(flags, blocks._roles(pa.array(flags, pa.list_(pa.int32()))).to_pylist()):
        state, want = blocks.NONE, []
        for f in row:
            state, role = blocks.step(state, f)
            want.append(role)
        assert list(got) == want
