"""Table functions for SQL.  ``register(spark)`` makes them known to a session."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

RANGE = re.compile(r"([0-9]+)(?:\s*-\s*([0-9]+))?")


def _pages(spec: str | None, total: int | None) -> Iterator[int]:
    for part in (spec or "").split(","):
        if total and (m := RANGE.fullmatch(part.strip())):
            a, b = int(m[1]), int(m[2] or m[1])
            yield from range(max(min(a, b), 1) - 1, min(max(a, b), total))


@udtf(returnType="nth int, page int")
class PageRange:
    """``page_range(spec, total)``: the 0-based pages of ``1-3, 5`` in the order given, without repeats and within the document; nothing for nulls.

    ``SELECT ... FROM jobs, LATERAL page_range(jobs.spec, jobs.total)`` gives the rows of ``parse_page_range``.
    """

    def eval(self, spec: str, total: int):
        yield from enumerate(dict.fromkeys(_pages(spec, total)))


@udtf(returnType="doc_id bigint, nth int, page int")
class PagesAsked:
    """``pages_asked(TABLE(jobs) PARTITION BY doc_id ORDER BY ...)``: all pages that a document's rows (doc_id, spec, total) ask for, each once, in the order of the rows.

    A partition keeps one mark for each page of its document.
    """

    def __init__(self) -> None:
        self.seen: set[int] = set()

    def eval(self, job: Row):
        for page in _pages(job["spec"], job["total"]):
            if page not in self.seen:
                self.seen.add(page)
                yield job["doc_id"], len(self.seen) - 1, page


def register(spark: SparkSession) -> None:
    spark.udtf.register("page_range", PageRange)
    spark.udtf.register("pages_asked", PagesAsked)
