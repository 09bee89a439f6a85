"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from quireframe.plans import QUERIES
from quireframe.session import get_session

HEADLINE = [
    "s09_to_markdown", "s08_to_plain_text", "s10_to_markdown_ybucket", "w02_build_line", "w05_reading_order", "a01_body_font_size",
    "x01_find_text", "x02_find_crossing", "x03_replace_all", "w13_match_cursor", "u02_extract_pages", "u07_redact_runs", "u10_outline_from_headings",
    "j01_text_under_markup", "j03_nearest_path", "p06_link_decision", "p12_sanitize_text", "a05_char_issue_report", "s02_decode_bytes",
    "x10_md_blocks", "x13_md_links", "l01_wrap_words", "a06_otsu_threshold", "i03_contrast_stretch", "a14_form_state", "q01_undo_redo_state", "w14_coalesce_commands", "q06_windowed_activity",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = get_session("bench", master=f"local[{cpus}]", shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    times: dict[str, float] = {}
    for n in names:
        t = time.time()
        QUERIES[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[n] = round(time.time() - t, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", "")}))


if __name__ == "__main__":
    main()
