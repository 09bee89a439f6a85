"""Form fields: one state per field name, and setters that respect the field's kind."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def form_state(fields: DataFrame) -> DataFrame:
    """fields(doc_id, annot_index, name, kind, value, checked, read_only, export_value, options): the value of each field.

    A radio group has the export value of its checked widget, a checkbox its export value or Off, a list its selected
    labels, anything else its value.
    """
    g = fields.groupBy("doc_id", "name").agg(
        F.min_by("kind", "annot_index").alias("kind"),
        F.min_by("value", "annot_index").alias("_value"),
        F.min(F.when(F.col("checked"), F.struct("annot_index", F.coalesce("export_value", F.lit("Yes")).alias("v")))).alias("_on"),
        F.min_by("options", "annot_index").alias("_options"),
        F.max("read_only").alias("read_only"),
        F.count(F.lit(1)).alias("widgets"),
    )
    chosen = F.array_join(F.transform(F.filter("_options", lambda o: o["selected"]), lambda o: o["label"]), ",")
    value = (
        F.when(F.col("kind").isin("radio", "checkbox"), F.coalesce(F.col("_on.v"), F.lit("Off")))
        .when(F.col("kind").isin("combo", "list"), F.coalesce(chosen, F.lit("")))
        .otherwise(F.col("_value"))
    )
    return g.select("doc_id", "name", "kind", value.alias("value"), "read_only", "widgets")


def set_form_values(fields: DataFrame, edits: DataFrame) -> DataFrame:
    """edits(doc_id, annot_index, action, values array<string>): action is text, check, uncheck, radio or choose.

    Adds ``accepted``.  Refused: a read-only field, an action of the wrong kind, several values for a single-choice field.
    Choosing a radio widget clears the others of its group.
    """
    j = fields.join(edits, ["doc_id", "annot_index"], "left")
    fits = (
        ((F.col("action") == "text") & (F.col("kind") == "text"))
        | (F.col("action").isin("check", "uncheck") & (F.col("kind") == "checkbox"))
        | ((F.col("action") == "radio") & (F.col("kind") == "radio"))
        | ((F.col("action") == "choose") & F.col("kind").isin("combo", "list") & ((F.size("values") <= 1) | F.col("multi_select")))
    )
    j = j.withColumn("accepted", F.when(F.col("action").isNotNull(), F.coalesce(fits & ~F.col("read_only"), F.lit(False))))
    picked = j.filter((F.col("action") == "radio") & F.col("accepted")).groupBy("doc_id", "name").agg(F.max("annot_index").alias("_pick"))
    j = j.join(picked, ["doc_id", "name"], "left")
    ok = F.coalesce("accepted", F.lit(False))
    checked = (
        F.when((F.col("kind") == "radio") & F.col("_pick").isNotNull(), F.col("annot_index") == F.col("_pick"))
        .when(ok & (F.col("action") == "check"), F.lit(True)).when(ok & (F.col("action") == "uncheck"), F.lit(False)).otherwise(F.col("checked"))
    )
    value = F.when(ok & (F.col("action") == "text"), F.element_at("values", 1)).otherwise(F.col("value"))
    options = F.when(
        ok & (F.col("action") == "choose"),
        F.transform("options", lambda o: F.struct(o["label"].alias("label"), F.array_contains(F.col("values"), o["label"]).alias("selected"))),
    ).otherwise(F.col("options"))
    keep = [c for c in fields.columns if c not in ("checked", "value", "options")]
    return j.select(*keep, checked.alias("checked"), value.alias("value"), options.alias("options"), "accepted")


def wide(state: DataFrame, names: list[str]) -> DataFrame:
    """One row per document with a column per named field."""
    return state.groupBy("doc_id").pivot("name", names).agg(F.first("value"))
