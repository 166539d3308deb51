"""All registered queries of the market operators."""

from . import desk_queries, job_queries, market, regime_queries, search_queries
from .registry import QUERIES, SQL


def all_queries() -> dict:
    return dict(QUERIES)


def all_sql() -> dict[str, str]:
    return dict(SQL)


__all__ = ["all_queries", "all_sql", "desk_queries", "job_queries", "market", "regime_queries", "search_queries"]
