"""Greedy wrapping, inside the row of each document."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _line_starts(lengths: pd.Series, glued: pd.Series, cap: pd.Series) -> pd.Series:
    """Where lines begin (from 1): running widths once, then one search for each line, not a step for each word."""

    def one(n, stuck, most):
        blank = 1 - np.asarray(stuck, np.int64)
        upto = np.concatenate([[0], np.cumsum(np.asarray(n, np.int64) + blank)])
        at, out = 0, []
        while at < len(n):
            out.append(at + 1)
            at = max(at + 1, int(np.searchsorted(upto, upto[at] + blank[at] + most, "right")) - 1)
        return out

    return pd.Series([one(*row) for row in zip(lengths, glued, cap)])


def wrap_words(docs: DataFrame, width_pt: float, size_pt: float, pitch_em: float = 0.6, words: str = "words") -> DataFrame:
    """doc_id, line_no, text: words packed into lines of fixed-pitch type; a word longer than a line is cut by characters.

    Only the words' lengths leave the JVM, to find where lines begin; the text is cut out afterwards.
    """
    cap = max(1, int(width_pt / (pitch_em * size_pt) + 1e-9))
    d = docs.withColumn("_atoms", F.expr(f"""flatten(transform({words}, w -> transform(sequence(0, greatest(cast(ceil(length(w) / {cap}.0D) as int) - 1, 0)),
        k -> struct(substr(w, k * {cap} + 1, {cap}) as t, k > 0 as glued))))"""))
    d = d.filter(F.size("_atoms") > 0).withColumn("_starts", _line_starts(F.expr("transform(_atoms, a -> length(a.t))"), F.expr("transform(_atoms, a -> int(a.glued))"), F.lit(cap)))
    line = """transform(_starts, (b, k) -> struct(k as line_no, array_join(transform(slice(_atoms, b, coalesce(get(_starts, k + 1), size(_atoms) + 1) - b),
        (a, j) -> if(j > 0 and not a.glued, ' ', '') || a.t), '') as text))"""
    return d.select("doc_id", F.explode(F.expr(line)).alias("l")).select("doc_id", "l.line_no", "l.text")

