"""Markdown structure of a corpus: blocks, headings, tables, tasks, links, notes, entities.

A document is one text value, so all of this happens inside its row: the text is cut into lines, fenced regions are found
from the fence lines alone, and rows are only exploded at the end.  There is no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quireframe.functions.textcols import js_trim

# Line patterns.
FENCE = r"^ {0,3}(`{3,}|~{3,})(.*)$"
RULE = r"^ {0,3}([-*_])( *\1){2,} *$"
HEADING = r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?[ \t]*$"
QUOTE = r"^ {0,3}>( ?)"
ITEM = r"^( *)([-*+]|[0-9]{1,9}[.)]) +(.*)$"
SETEXT = r"^ {0,3}(=+|-+) *$"
NOTE_DEF = r"^ {0,3}\[\^([^\]\s]+)\]:[ \t]*(.*)$"
NOTE_MORE = r"^( {2,}|\t)\S"
REF_DEF = r"""^ {0,3}\[([^\]\n]+)\]:[ \t]*(<[^>\n]*>|\S+)(?:[ \t]+(?:"[^"]*"|'[^']*'|\([^)]*\)))?[ \t]*$"""
# A bare destination may hold brackets in pairs, three deep.
DEST = r"(?:[^\s()<>]|\((?:[^\s()<>]|\((?:[^\s()<>]|\([^\s()<>]*\))*\))*\))*"
INLINE_LINK = r"""(!?)\[((?:[^\[\]]|\[[^\[\]]*\])*)\]\([ \n]*(?:<([^>\n]*)>|(""" + DEST + r"""))[ \n]*(?:"[^"]*"|'[^']*')?[ \n]*\)"""
REF_LINK = r"(!?)\[([^\[\]]+)\](?:\[([^\[\]]*)\])?(?![(:])"
MAIL_LINK = r"<([A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9](?:[A-Za-z0-9.-]*[A-Za-z0-9])?)>"
CODE_SPAN = r"(?<![`\\])(`+)(?!`).+?(?<!`)\1(?!`)"
ESCAPED = r"""\\[!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]"""
AUTO_LINK = r"<([A-Za-z][A-Za-z0-9+.\-]+:[^\s<>]*)>"
BARE_URL = r"(?<![\p{L}\p{N}])https?://[^\s<]+"
HTML_TAG = r"</?[A-Za-z][A-Za-z0-9-]*(?:\s[^<>]*)?/?>|<!--"
ENTITY = r"&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]+);"
# The named entities that are understood.
ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\u00a0", "copy": "©", "reg": "®", "trade": "™", "hellip": "…", "mdash": "—", "ndash": "–", "laquo": "«", "raquo": "»",
    "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "euro": "€", "deg": "°", "plusmn": "±", "times": "×", "divide": "÷", "middot": "·", "bull": "•", "para": "¶", "sect": "§", "cent": "¢",
    "pound": "£", "yen": "¥", "iexcl": "¡", "iquest": "¿", "frac12": "½", "frac14": "¼", "frac34": "¾", "larr": "←", "rarr": "→",
}


def _sql(rx: str) -> str:
    return "'" + rx.replace("\\", "\\\\").replace("'", "\\'") + "'"


def with_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``lines`` and ``fenced``, the inclusive line ranges of fenced code.

    A fence is closed by one of the same mark, at least as long and with nothing after it; only fence lines are folded.
    """
    d = docs.withColumn("lines", F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n"))
    d = d.withColumn("_f", F.expr(f"""filter(transform(lines, (l, i) -> struct(i as i, regexp_extract(l, {_sql(FENCE)}, 1) as mark, trim(regexp_extract(l, {_sql(FENCE)}, 2)) as info)), f -> f.mark <> '')"""))
    d = d.withColumn("_s", F.expr("""aggregate(_f,
        named_struct('mark', '', 'from', -1, 'spans', cast(array() as array<struct<from:int,to:int>>)),
        (s, f) -> if(s.mark = '', named_struct('mark', f.mark, 'from', f.i, 'spans', s.spans),
            if(left(f.mark, 1) = left(s.mark, 1) and length(f.mark) >= length(s.mark) and f.info = '',
               named_struct('mark', '', 'from', -1, 'spans', concat(s.spans, array(named_struct('from', s.from, 'to', f.i)))), s)))"""))
    open_end = "if(_s.mark = '', cast(array() as array<struct<from:int,to:int>>), array(named_struct('from', _s.from, 'to', size(lines))))"
    return d.withColumn("fenced", F.expr(f"concat(_s.spans, {open_end})")).drop("_f", "_s")


def md_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, line_no, line, prev_line, next_line, code (inside a fence), fence (opens or closes one)."""
    d = with_lines(docs, text)
    row = F.expr("""transform(lines, (l, i) -> struct(i as line_no, l as line, get(lines, i - 1) as prev_line, get(lines, i + 1) as next_line,
        exists(fenced, s -> i > s.from and i < s.to) as code, exists(fenced, s -> i = s.from or i = s.to) as fence))""")
    return d.select("doc_id", F.explode(row).alias("r")).select("doc_id", "r.*")


def md_blocks(docs: DataFrame, text: str = "text") -> DataFrame:
    """The kind of every line: fence, code, blank, heading, setext, rule, quote, item, indented or text, and heading level and title."""
    ln = md_lines(docs, text)
    c = F.col("line")
    item = c.rlike(ITEM)
    para = lambda p: p.isNotNull() & (F.trim(p) != "") & ~p.rlike(FENCE) & ~p.rlike(HEADING) & ~p.rlike(QUOTE) & ~p.rlike(ITEM) & ~p.rlike(RULE) & ~p.rlike(r"^( {4}|\t)")
    under = c.rlike(SETEXT) & para(F.col("prev_line"))
    kind = (
        F.when(F.col("fence"), "fence").when(F.col("code"), "code").when(F.trim(c) == "", "blank").when(c.rlike(r"^( {4}|\t)") & ~item, "indented")
        .when(under, "underline").when(c.rlike(RULE) & ~item, "rule").when(c.rlike(HEADING), "heading").when(c.rlike(QUOTE), "quote").when(item, "item")
        .when(F.col("next_line").rlike(SETEXT) & para(c), "setext").otherwise("text")
    )
    ln = ln.withColumn("kind", kind)
    level = F.when(F.col("kind") == "heading", F.length(F.regexp_extract(c, HEADING, 1))).when(F.col("kind") == "setext", F.when(F.col("next_line").rlike("^ {0,3}=+ *$"), 1).otherwise(2))
    title = F.when(F.col("kind") == "heading", F.regexp_replace(F.regexp_extract(c, HEADING, 2), r"[ \t]+#+[ \t]*$", "")).when(F.col("kind") == "setext", F.trim(c))
    return ln.select("doc_id", "line_no", "kind", level.alias("level"), title.alias("title"), "line")


def _cells(line: str) -> str:
    """SQL: the cells of a table row, or null without a bar."""
    bare = f"regexp_replace(regexp_replace(trim({line}), '^\\\\|', ''), '(?<!\\\\\\\\)\\\\|$', '')"
    return f"if(contains({line}, '|'), transform(split({bare}, '(?<!\\\\\\\\)\\\\|'), c -> trim(replace(c, '\\\\|', '|'))), null)"


def md_tables(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, line_no, align, header, rows: a header and a delimiter line of as many cells; rows are padded or cut to them."""
    d = with_lines(docs, text)
    stop = f"trim(l) = '' or l rlike {_sql(FENCE)} or l rlike {_sql(HEADING)} or l rlike {_sql(QUOTE)}"
    d = d.withColumn("_stops", F.expr(f"filter(transform(lines, (l, i) -> if({stop}, i, null)), i -> i is not null)"))
    heads = F.expr(f"""filter(transform(lines, (l, i) -> if(not exists(fenced, s -> i >= s.from and i <= s.to) and contains(l, '|') and get(lines, i + 1) rlike '^[ \\\\t|:-]*-[ \\\\t|:-]*$' and contains(get(lines, i + 1), '|'),
        struct(i as i, {_cells('l')} as header, {_cells('get(lines, i + 1)')} as delim), null)), t -> t is not null and size(t.header) = size(t.delim) and forall(t.delim, c -> c rlike '^:?-+:?$'))""")
    # Exploded as an expression: on a column of its own Spark would infer a size filter and push it below the split.
    d = d.select("doc_id", "lines", "_stops", F.explode(heads).alias("t"))
    d = d.withColumn("_end", F.expr("coalesce(array_min(filter(_stops, s -> s > t.i + 1)), size(lines))"))
    align = "transform(t.delim, c -> if(startswith(c, ':'), if(endswith(c, ':'), 'center', 'left'), if(endswith(c, ':'), 'right', 'none')))"
    row = f"transform(array(coalesce({_cells('l')}, array(trim(l)))), cs -> transform(sequence(1, size(t.delim)), k -> coalesce(get(cs, k - 1), '')))[0]"
    return d.select("doc_id", F.col("t.i").alias("line_no"), F.expr(align).alias("align"), F.col("t.header").alias("header"), F.expr(f"transform(slice(lines, t.i + 3, greatest(_end - t.i - 2, 0)), l -> {row})").alias("rows"))


def md_tasks(docs: DataFrame, text: str = "text") -> DataFrame:
    """List items with a check box: doc_id, line_no, depth, checked, text.

    Depth counts the items still open above it in an unbroken list: each one less indented than everything after it.
    """
    d = with_lines(docs, text)
    d = d.withColumn("_i", F.expr(f"""transform(lines, (l, i) -> if(l rlike {_sql(ITEM)} and not exists(fenced, s -> i >= s.from and i <= s.to),
        struct(i as i, length(regexp_extract(l, {_sql(ITEM)}, 1)) as indent, regexp_extract(l, {_sql(ITEM)}, 3) as content), null))"""))
    d = d.withColumn("_breaks", F.expr("filter(transform(lines, (l, i) -> if(_i[i] is null and trim(l) <> '', i, null)), i -> i is not null)"))
    d = d.withColumn("_items", F.expr("filter(_i, t -> t is not null)"))
    box = r"^\[( |x|X)\](?: +|$)(.*)$"
    depth = """aggregate(reverse(filter(_items, p -> p.i < t.i and p.i > coalesce(array_max(filter(_breaks, b -> b < t.i)), -1))),
        named_struct('m', t.indent, 'd', 0), (a, p) -> if(p.indent < a.m, named_struct('m', p.indent, 'd', a.d + 1), a), a -> a.d)"""
    d = d.select("doc_id", F.explode(F.expr(f"transform(filter(_items, t -> t.content rlike {_sql(box)}), t -> struct(t.i as line_no, {depth} as depth, t.content as content))")).alias("t"))
    c = F.col("t.content")
    return d.select("doc_id", "t.line_no", "t.depth", (F.regexp_extract(c, box, 1) != " ").alias("checked"), F.regexp_extract(c, box, 2).alias("text"))


def trim_url(u: Column) -> Column:
    """Closing punctuation does not belong to a bare address, nor does a closing bracket it did not open."""
    tail = F.length(F.regexp_extract(u, r"""[).,:;!?'"*_~]+$""", 0))

    def step(s: Column, _: Column) -> Column:
        unopened = F.endswith(s, F.lit(")")) & (F.length(F.regexp_replace(s, r"[^(]", "")) < F.length(F.regexp_replace(s, r"[^)]", "")))
        return F.when(unopened | s.rlike(r"""[.,:;!?'"*_~]$"""), F.left(s, F.length(s) - 1)).otherwise(s)

    return F.when(tail > 0, F.aggregate(F.sequence(F.lit(1), tail), u, step)).otherwise(u)


def _label(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(c), r"\s+", " "))


def _definition_arrays(d: DataFrame) -> DataFrame:
    """Adds ``labels`` and ``dests``: the link definitions of each document outside code, in order, from its own row."""
    line = f"transform(filter(transform(lines, (l, i) -> if(l rlike {_sql(REF_DEF)} and not l rlike {_sql(NOTE_DEF)} and not exists(fenced, s -> i >= s.from and i <= s.to), l, null)), l -> l is not null), l -> l)"
    d = d.withColumn("_d", F.expr(line))
    return d.withColumn("labels", F.transform("_d", lambda l: _label(F.regexp_extract(l, REF_DEF, 1)))).withColumn("dests", F.transform("_d", lambda l: F.regexp_replace(F.regexp_extract(l, REF_DEF, 2), "^<|>$", ""))).drop("_d")


def md_links(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, line_no, nth, kind (link, image, auto, bare, reference), url: links outside code, in the order of the line.

    Code spans and escaped characters are no links; definition lines are none either.  A reference is one where the
    document defines its label; the first definition counts.  Addresses of mail in angle brackets become ``mailto:``.
    """
    d = _definition_arrays(with_lines(docs, text))
    row = F.expr(f"""filter(transform(lines, (l, i) -> if(exists(fenced, s -> i >= s.from and i <= s.to) or l rlike {_sql(REF_DEF)} or l rlike {_sql(NOTE_DEF)}, null, struct(i as line_no, l as line))), r -> r is not null)""")
    ln = d.select("doc_id", "labels", "dests", F.explode(row).alias("r")).select("doc_id", "labels", "dests", "r.line_no", "r.line")
    ln = ln.filter(F.col("line").rlike(r"[\[<]|https?://"))
    c = F.regexp_replace(F.regexp_replace(F.col("line"), CODE_SPAN, " "), ESCAPED, "\ue000")
    # one reading from left to right; what begins first wins
    found = F.regexp_extract_all(c, F.lit("|".join(f"(?:{rx})" for rx in (INLINE_LINK, AUTO_LINK, MAIL_LINK, REF_LINK, BARE_URL))), F.lit(0))

    def one(m: Column) -> Column:
        inline, image = m.rlike(f"^{INLINE_LINK}$"), F.startswith(m, F.lit("!"))
        label = F.coalesce(F.nullif(F.regexp_extract(m, REF_LINK, 3), F.lit("")), F.regexp_extract(m, REF_LINK, 2))
        at = F.array_position("labels", _label(label))
        reference = F.when(at > 0, F.try_element_at("dests", at.cast("int")))
        kind = F.when(inline, F.when(image, "image").otherwise("link")).when(F.startswith(m, F.lit("<")), "auto").when(F.startswith(m, F.lit("http")), "bare").when(image, "image").otherwise("reference")
        url = (
            F.when(inline, F.concat(F.regexp_extract(m, INLINE_LINK, 3), F.regexp_extract(m, INLINE_LINK, 4)))
            .when(m.rlike(f"^{MAIL_LINK}$"), F.concat(F.lit("mailto:"), F.regexp_extract(m, MAIL_LINK, 1)))
            .when(F.startswith(m, F.lit("<")), F.substr(m, F.lit(2), F.length(m) - 2)).when(F.startswith(m, F.lit("http")), trim_url(m)).otherwise(reference)
        )
        return F.struct(kind.alias("kind"), url.alias("url"))

    links = F.filter(F.transform(found, one), lambda s: s["url"].isNotNull())
    return ln.select("doc_id", "line_no", F.posexplode(links).alias("nth", "l")).select("doc_id", "line_no", "nth", "l.kind", "l.url")


def md_definitions(docs: DataFrame, text: str = "text") -> DataFrame:
    """Link definitions and note definitions outside code: doc_id, line_no, kind (ref, note), label, value.

    A note goes on over the lines right after it that begin with two blanks or a tab and have ink next; their trimmed texts
    follow after one blank each, and what looks like a definition there is part of the note.
    """
    d = with_lines(docs, text)
    # the lines that a note cannot take in; between two of them only the first may begin something
    d = d.withColumn("_stops", F.expr(f"filter(transform(lines, (l, i) -> if(l rlike {_sql(NOTE_MORE)}, null, i)), i -> i is not null)"))
    row = F.expr(f"""filter(transform(lines, (l, i) -> if((l rlike {_sql(NOTE_DEF)} or l rlike {_sql(REF_DEF)}) and not exists(fenced, s -> i >= s.from and i <= s.to),
        struct(i as line_no, l as line, l rlike {_sql(NOTE_DEF)} as note, l rlike {_sql(NOTE_MORE)} as more, coalesce(array_min(filter(_stops, s -> s > i)), size(lines)) as stop), null)), r -> r is not null)""")
    d = d.withColumn("_rows", row).select("doc_id", "lines", F.explode(F.expr("filter(_rows, r -> not r.more or not exists(_rows, q -> q.note and q.line_no < r.line_no and r.line_no < q.stop))")).alias("r"))
    d = d.select("doc_id", "r.*", F.expr("slice(lines, r.line_no + 2, greatest(r.stop - r.line_no - 1, 0))").alias("rest"))
    c = F.col("line")
    value = F.trim(F.array_join(F.concat(F.array(F.regexp_extract(c, NOTE_DEF, 2)), F.transform("rest", js_trim)), " "))
    return d.select(
        "doc_id", "line_no", F.when(F.col("note"), "note").otherwise("ref").alias("kind"),
        F.when(F.col("note"), F.regexp_extract(c, NOTE_DEF, 1)).otherwise(_label(F.regexp_extract(c, REF_DEF, 1))).alias("label"),
        F.when(F.col("note"), value).otherwise(F.regexp_replace(F.regexp_extract(c, REF_DEF, 2), "^<|>$", "")).alias("value"),
    )


def html_tag_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(HTML_TAG))


def decode_entities(c: Column) -> Column:
    """Named and numeric entities; one that is unknown or names no character stays as it is written."""
    named = F.create_map(*[F.lit(x) for kv in ENTITIES.items() for x in kv])

    def one(e: Column) -> Column:
        body = F.substr(e, F.lit(2), F.length(e) - 2)
        cp = F.when(body.rlike("^#[0-9]+$"), F.substr(body, F.lit(2)).try_cast("long")).when(body.rlike("^#[xX]"), F.conv(F.substr(body, F.lit(3)), 16, 10).try_cast("long"))
        good = (cp > 0) & (cp <= 0x10FFFF) & ~cp.between(0xD800, 0xDFFF)
        ch = F.decode(F.unhex(F.lpad(F.hex(F.when(good, cp).otherwise(63)), 8, "0")), "UTF-32")
        return F.when(cp.isNotNull(), F.when(good, ch).otherwise(e)).otherwise(F.coalesce(F.try_element_at(named, body), e))

    parts, found = F.split(c, ENTITY, -1), F.regexp_extract_all(c, F.lit(ENTITY), F.lit(0))
    decoded = F.concat(F.transform(found, one), F.array(F.lit("")))
    return F.when(F.contains(c, F.lit("&")), F.array_join(F.zip_with(parts, decoded, lambda p, e: F.concat(p, e)), "")).otherwise(c)


def plain_text(c: Column) -> Column:
    """Inline text without its marks (flat marks; nested ones need the recursive reading that is left out)."""
    out = F.regexp_replace(c, r"\[\^[^\]\s]+\]", "")
    out = F.regexp_replace(out, INLINE_LINK, "$2")
    out = F.regexp_replace(out, r"(`+)(?!`)(.+?)(?<!`)\1(?!`)", "$2")
    for rx in (r"\*\*\*(?=\S)(.+?)(?<=\S)\*\*\*", r"\*\*(?=\S)(.+?)(?<=\S)\*\*", r"\*(?=\S)(.+?)(?<=\S)\*", r"(?<![\p{L}\p{N}_])__(?=\S)(.+?)(?<=\S)__(?![\p{L}\p{N}])", r"(?<![\p{L}\p{N}_])_(?=\S)(.+?)(?<=\S)_(?![\p{L}\p{N}])", r"~~(?=\S)(.+?)(?<=\S)~~"):
        out = F.regexp_replace(out, rx, "$1")
    return F.regexp_replace(out, r"""\\([!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~])""", "$1")
