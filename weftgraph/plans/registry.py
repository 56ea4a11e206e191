"""Named queries over the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

from weftgraph.plans import calculus, construction, decisions, iteration, solvers  # noqa: F401  they register their queries
from weftgraph.plans.base import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
