"""All queries of the core, and their SQL."""

from __future__ import annotations

from quillspan.plans import evaluation_queries, log_queries, problems, series_queries, text_queries

QUERIES = {**series_queries.QUERIES, **text_queries.QUERIES, **log_queries.QUERIES, **evaluation_queries.QUERIES, **problems.QUERIES}
SQL = {**series_queries.SQL, **text_queries.SQL, **log_queries.SQL, **evaluation_queries.SQL, **problems.SQL}


def chosen(names: list[str]) -> dict:
    """The queries of these names alone; KeyError for a name that isn't known."""
    if unknown := [n for n in names if n not in QUERIES]:
        raise KeyError(f"no such query: {unknown}")
    return {n: QUERIES[n] for n in names}
