"""Every query of the library proper."""

from lanternq.plans import dialog_queries, index_queries, retrieval_queries, text_queries  # noqa: F401
from lanternq.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
