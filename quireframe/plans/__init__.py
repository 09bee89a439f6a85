from quireframe.plans.registry import ORACLES, QUERIES
from quireframe.plans import layout_queries, markup_queries, page_queries, reference_queries, scalar_queries, search_queries, text_queries  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
