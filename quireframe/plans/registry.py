"""Named queries over the given tables, each with the SQL that checks it where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


# The derived layout tables of sources.layout, said again in plain SQL for the checks.
WORDS = r"""
dw AS (SELECT doc_id, list_filter(string_split_regex(text, '[ \n]'), lambda t: t <> '') AS ws FROM documents),
words AS (SELECT doc_id, unnest(ws) AS text, CAST(unnest(range(len(ws))) AS INTEGER) AS i FROM dw)"""

RUNS = WORDS + r""",
rl AS (SELECT doc_id, i, CAST(i // 12 AS INTEGER) AS line, CAST(i // 480 AS INTEGER) AS page_index, CAST((i // 12) % 40 AS INTEGER) AS line_in_page,
       CAST(i % 480 AS INTEGER) AS run_id, CAST(i % 12 AS INTEGER) AS slot, text,
       CASE WHEN i // 12 = 0 THEN 18.0 WHEN (i // 12) % 40 = 30 THEN 15.0 WHEN (i // 12) % 20 = 10 THEN 14.0 ELSE 11.0 END::DOUBLE AS size_pt,
       CASE WHEN i % 37 = 0 THEN 'Helvetica-Bold' ELSE 'Helvetica' END AS font_name
       FROM words),
runs AS (SELECT rl.*, slot > 0 AS virtual_space_before,
         72.0::DOUBLE + coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id, line ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE * 0.6::DOUBLE * size_pt AS x,
         770.0::DOUBLE - 16.0::DOUBLE * line_in_page AS y, length(text)::DOUBLE * 0.6::DOUBLE * size_pt AS w, size_pt AS h FROM rl)"""

PAGE_META = WORDS + r""",
page_meta AS (SELECT doc_id, CAST(i // 480 AS INTEGER) AS page_index, 595.0::DOUBLE AS width_pt, 842.0::DOUBLE AS height_pt, 0.0::DOUBLE AS origin_x, 0.0::DOUBLE AS origin_y,
              1.0::DOUBLE AS user_unit, CAST((doc_id % 4) * 90 AS INTEGER) AS rotation FROM words WHERE i % 480 = 0)"""

PAGE_META_ONLY = r"""page_meta AS (SELECT doc_id, page_index, 595.0::DOUBLE AS width_pt, 842.0::DOUBLE AS height_pt, 0.0::DOUBLE AS origin_x, 0.0::DOUBLE AS origin_y,
              1.0::DOUBLE AS user_unit, CAST((doc_id % 4) * 90 AS INTEGER) AS rotation FROM runs WHERE run_id = 0)"""

LINES = RUNS + r""",
lines AS (SELECT doc_id, page_index, line, line_in_page, any_value(size_pt) AS size_pt, any_value(y) AS y, string_agg(text, ' ' ORDER BY slot) AS text, count(*) AS n_words,
          min(x) AS x0, max(x + w) AS x1 FROM runs GROUP BY doc_id, page_index, line, line_in_page)"""

COMMANDS = r"""commands AS (SELECT user_id AS doc_id, event_id AS seq, ts, CASE event_type WHEN 'error' THEN 'undo' WHEN 'signup' THEN 'redo' ELSE 'do' END AS op,
              CASE WHEN event_type NOT IN ('error', 'signup') THEN event_type END AS coalesce_key, value FROM events)"""

GRAY = r"""
mm AS (SELECT vec_id, label, embedding, list_min(embedding)::DOUBLE AS lo, list_max(embedding)::DOUBLE AS hi FROM embeddings),
gray AS (SELECT vec_id, CAST(unnest(range(len(embedding))) AS INTEGER) AS px, unnest(embedding)::DOUBLE AS v, lo, hi FROM mm),
pixels AS (SELECT vec_id, px, CAST(floor((v - lo) / (hi - lo) * 255) AS INTEGER) AS g FROM gray)"""
