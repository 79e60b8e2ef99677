"""All queries outside the subpackage on texts."""

from __future__ import annotations

from twinbook.plans import book_queries, market_queries, problems

QUERIES = {**problems.QUERIES, **market_queries.QUERIES, **book_queries.QUERIES}
SQL = {**problems.SQL, **market_queries.SQL, **book_queries.SQL}
FLAGSHIP = "depth_of_ladders"
