"""Named queries of the library's operators over a folder of tables, with SQL that gives the same rows."""

from litforge.plans import library_queries, paper_queries, stats_queries, term_queries  # noqa: F401  (they register their queries)
from litforge.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
