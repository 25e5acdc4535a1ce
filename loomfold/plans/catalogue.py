"""The catalogue of queries over the standard tables, and the same in SQL for DuckDB."""

from __future__ import annotations

from loomfold.plans import corpus, retrieval, work

FLAGSHIP = "h9_hybrid_search"


def queries() -> dict:
    return {**corpus.QUERIES, **retrieval.QUERIES, **work.QUERIES}


def oracle_sql() -> dict:
    """Queries without SQL run sequential parsers or draw pseudo-random vectors; tests hold them against plain Python."""
    return {**corpus.SQL, **retrieval.SQL, **work.SQL}
