"""Outlines (bookmark trees) as tables: one row per node, ``path`` = child positions from the root.

Path arrays sort in reading order, a prefix is an ancestor, and every edit is a rewrite of paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quireframe.operators import scale
from quireframe.session import checkpointed

def outline_from_headings(headings: DataFrame, chunk: str = "page_index", max_level: int = 9, max_nodes: int | None = None) -> DataFrame:
    """headings(doc_id, pos, level, title, ...): adds parent_pos, depth and path.

    The parent is the nearest earlier heading of a smaller level; levels that are skipped are not made up.  The open
    headings at a row are, per level, the last one met, as long as no smaller level came after it: nine running maxima.
    Levels deeper than ``max_level`` (the formats know nine) count as that level; ``max_nodes`` keeps a document's first
    headings only, and by default all are kept.
    """
    h = headings
    if max_nodes is not None:
        h = scale.row_number(h, ["doc_id"], chunk, ["pos"], "_n").filter(F.col("_n") <= max_nodes).drop("_n")
    h = h.withColumn("level", F.least("level", F.lit(max_level)))

    def last_at(extra: str | None) -> dict[str, Column]:
        item = F.struct("pos") if extra is None else F.struct("pos", extra)
        return {f"_l{k}": F.when(F.col("level") == k, item) for k in range(1, max_level + 1)}

    def open_levels(prefix: str) -> list[Column]:
        out, above = [], None
        for k in range(1, max_level + 1):
            here = F.col(f"{prefix}{k}")
            alive = here.isNotNull() & (F.col("level") > k)
            if above is not None:
                alive = alive & (F.coalesce(here["pos"], F.lit(-1)) > F.coalesce(above, F.lit(-1)))
            out.append(F.when(alive, here))
            above = here["pos"] if above is None else F.greatest(above, here["pos"])
        return out

    # each step reads its input twice: what one has found is written out before the next
    h = scale.running_max(checkpointed(h), ["doc_id"], chunk, ["pos"], last_at(None), exclusive=True)
    opened = F.filter(F.array(*[o["pos"] for o in open_levels("_l")]), lambda p: p.isNotNull())
    h = h.withColumn("parent_pos", F.array_max(opened)).drop(*[f"_l{k}" for k in range(1, max_level + 1)])
    h = scale.row_number(checkpointed(h), ["doc_id", "parent_pos"], chunk, ["pos"], "_sib").withColumn("_sib", (F.col("_sib") - 1).cast("int"))
    h = scale.running_max(checkpointed(h), ["doc_id"], chunk, ["pos"], last_at("_sib"), exclusive=True)
    chain = F.filter(F.array(*open_levels("_l")), lambda p: p.isNotNull())
    path = F.concat(F.transform(chain, lambda p: p["_sib"]), F.array("_sib"))
    return h.withColumn("path", path).withColumn("depth", F.size("path")).drop("_sib", *[f"_l{k}" for k in range(1, max_level + 1)])


def subtree_stats(outline: DataFrame) -> DataFrame:
    """doc_id, path -> nodes in the subtree (itself included) and height (0 for a leaf): a node counts for each prefix."""
    up = outline.select("doc_id", F.size("path").alias("d"), F.explode(F.expr("transform(sequence(1, size(path)), k -> slice(path, 1, k))")).alias("path"))
    return up.groupBy("doc_id", "path").agg(F.count(F.lit(1)).alias("nodes"), (F.max("d") - F.size("path")).cast("int").alias("height"))


def outline_stats(outline: DataFrame, max_nodes: int = 10_000, max_depth: int = 32) -> DataFrame:
    """Nodes and depth of each outline, and whether it is within the limits that viewers have; nothing is cut."""
    g = outline.groupBy("doc_id").agg(F.count(F.lit(1)).alias("nodes"), F.max(F.size("path")).alias("max_depth"))
    return g.withColumn("within_limits", (F.col("nodes") <= max_nodes) & (F.col("max_depth") <= max_depth))


def edit_outline(outline: DataFrame, edits: DataFrame, max_nodes: int | None = None, max_depth: int | None = None) -> DataFrame:
    """edits(doc_id, op, target array<int>, title, page): one edit per document.

    op: insert_sibling, insert_child, delete, rename, retarget, move_up, move_down, indent, outdent.  An edit that cannot
    be done (no such node, at the edge, beyond ``max_nodes`` or ``max_depth`` where given) leaves its outline unchanged.
    """
    j = outline.join(edits, "doc_id", "left")
    n = F.size("target")
    under = "slice(path, 1, size(target) - 1) = slice(target, 1, size(target) - 1)"
    facts = (
        j.filter(F.col("op").isNotNull()).groupBy("doc_id").agg(
            F.count(F.lit(1)).alias("_all"),
            F.max(F.expr("path = target")).alias("_found"),
            F.count_if(F.expr(f"size(path) = size(target) and {under}")).alias("_sib"),
            F.count_if(F.expr("size(path) = size(target) + 1 and slice(path, 1, size(target)) = target")).alias("_kids"),
            F.count_if(F.expr(f"size(path) = size(target) + 1 and {under} and get(path, size(target) - 1) = element_at(target, -1) - 1")).alias("_prev_kids"),
            F.max(F.expr(f"if(size(path) >= size(target) and {under} and get(path, size(target) - 1) = element_at(target, -1), size(path) - size(target), 0)")).alias("_height"),
            F.max(F.expr(f"if(size(path) >= size(target) and {under} and get(path, size(target) - 1) > element_at(target, -1), size(path) - size(target) + 1, 0)")).alias("_later_height"),
        )
    )
    e = edits.join(facts, "doc_id")
    last, op = F.element_at("target", -1), F.col("op")

    def room(value: Column, limit: int | None) -> Column:
        return F.lit(True) if limit is None else value <= limit

    can = F.col("_found") & (
        F.when(op == "insert_sibling", room(F.col("_all") + 1, max_nodes))
        .when(op == "insert_child", room(F.col("_all") + 1, max_nodes) & room(n + 1, max_depth))
        .when(op == "move_up", last > 0)
        .when(op == "move_down", last + 1 < F.col("_sib"))
        .when(op == "indent", (last > 0) & room(n + F.col("_height"), max_depth))
        .when(op == "outdent", (n >= 2) & room(n - 1 + F.greatest("_height", "_later_height"), max_depth))
        .otherwise(F.lit(True))
    )
    e = e.filter(can)
    j = outline.join(e.select("doc_id", "op", "target", F.col("title").alias("_title"), F.col("page").alias("_page"), "_kids", "_prev_kids"), "doc_id", "left")
    # k: the node's position among the target's siblings, where it stands at or below that level
    j = j.withColumn("_n", F.size("target")).withColumn("_i", F.element_at("target", -1))
    j = j.withColumn("_k", F.expr(f"if(size(path) >= _n and {under}, get(path, _n - 1), null)"))
    j = j.withColumn("_in", F.expr("coalesce(_k = _i, false)"))
    j = j.filter(~((F.coalesce(F.col("op"), F.lit("")) == "delete") & F.col("_in")))
    at = "concat(slice(path, 1, _n - 1), array({k}), slice(path, _n + 1, size(path)))"
    new_path = F.expr(f"""case
        when op is null then path
        when op = 'delete' and _k > _i then {at.format(k='_k - 1')}
        when op = 'insert_sibling' and _k > _i then {at.format(k='_k + 1')}
        when op = 'move_up' and _k = _i then {at.format(k='_k - 1')}
        when op = 'move_up' and _k = _i - 1 then {at.format(k='_k + 1')}
        when op = 'move_down' and _k = _i then {at.format(k='_k + 1')}
        when op = 'move_down' and _k = _i + 1 then {at.format(k='_k - 1')}
        when op = 'indent' and _k = _i then concat(slice(path, 1, _n - 1), array(_i - 1, int(_prev_kids)), slice(path, _n + 1, size(path)))
        when op = 'indent' and _k > _i then {at.format(k='_k - 1')}
        when op = 'outdent' and _k = _i then concat(slice(path, 1, greatest(_n - 2, 0)), array(get(target, _n - 2) + 1), slice(path, _n + 1, size(path)))
        when op = 'outdent' and _k > _i then concat(slice(path, 1, greatest(_n - 2, 0)), array(get(target, _n - 2) + 1, int(_kids) + _k - _i - 1), slice(path, _n + 1, size(path)))
        when op = 'outdent' and size(path) >= _n - 1 and slice(path, 1, greatest(_n - 2, 0)) = slice(target, 1, greatest(_n - 2, 0)) and get(path, _n - 2) > get(target, _n - 2)
            then concat(slice(path, 1, greatest(_n - 2, 0)), array(get(path, _n - 2) + 1), slice(path, _n, size(path)))
        else path end""")
    exact = F.col("path") == F.col("target")
    j = j.withColumn("_new", new_path)
    j = j.withColumn("title", F.when((F.col("op") == "rename") & exact, F.col("_title")).otherwise(F.col("title")))
    aim = (F.col("op") == "retarget") & exact
    j = j.withColumn("page_index", F.when(aim, F.col("_page")).otherwise(F.col("page_index"))).withColumn("y_pt", F.when(aim, None).otherwise(F.col("y_pt"))).withColumn("action", F.when(aim, None).otherwise(F.col("action")))
    kept = j.withColumn("path", F.col("_new")).select("doc_id", "path", "title", "page_index", "y_pt", "action")
    grown = e.filter(op.isin("insert_sibling", "insert_child")).select(
        "doc_id",
        F.expr("if(op = 'insert_child', concat(target, array(int(_kids))), concat(slice(target, 1, size(target) - 1), array(element_at(target, -1) + 1)))").alias("path"),
        "title", F.col("page").alias("page_index"), F.lit(None).cast("double").alias("y_pt"), F.lit(None).cast("string").alias("action"),
    )
    return kept.unionByName(grown)


def without_deleted_page(outline: DataFrame, deletes: DataFrame) -> DataFrame:
    """deletes(doc_id, gone): nodes that point at the deleted page go, their children move up, later targets shift.

    An outline with an unsupported action, or with no node on that page, is left as it is.  New positions come from the
    surviving ancestors of each node (its prefixes), never from pairs of nodes.
    """
    o = outline.join(deletes, "doc_id", "left")
    hit = (F.col("page_index") == F.col("gone")) & F.col("action").isNull()
    state = o.groupBy("doc_id").agg(F.max(F.coalesce(hit, F.lit(False))).alias("_hit"), F.max(F.coalesce(F.col("action") == "unsupported", F.lit(False))).alias("_locked"))
    doc = deletes.join(state, "doc_id").filter(F.col("_hit") & ~F.col("_locked")).select("doc_id", "gone")
    o = outline.join(doc, "doc_id", "left").withColumn("_gone", F.coalesce((F.col("page_index") == F.col("gone")) & F.col("action").isNull(), F.lit(False)))
    gone = o.filter("_gone").select("doc_id", F.col("path").alias("prefix"))
    live = o.filter(~F.col("_gone"))
    up = live.select("doc_id", "path", F.explode(F.expr("transform(sequence(1, size(path)), k -> slice(path, 1, k))")).alias("prefix"))
    chain = up.join(gone, ["doc_id", "prefix"], "left_anti").groupBy("doc_id", "path").agg(F.array_sort(F.collect_list("prefix")).alias("chain"))
    chain = chain.withColumn("parent", F.expr("if(size(chain) > 1, element_at(chain, -2), cast(array() as array<int>))"))
    sib = scale.row_number(chain.withColumn("_c", F.element_at("path", 1)), ["doc_id", "parent"], "_c", ["path"], "sib").select("doc_id", F.col("path").alias("prefix"), (F.col("sib") - 1).cast("int").alias("sib"))
    steps = chain.select("doc_id", "path", F.posexplode("chain").alias("k", "prefix")).join(sib, ["doc_id", "prefix"])
    paths = steps.groupBy("doc_id", "path").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "sib"))), lambda s: s["sib"]).alias("_new"))
    shifted = F.when(F.col("page_index") > F.col("gone"), F.col("page_index") - 1).otherwise(F.col("page_index"))
    return live.join(paths, ["doc_id", "path"]).select("doc_id", F.col("_new").alias("path"), "title", shifted.alias("page_index"), "y_pt", "action")
