"""Queries over the given tables, each with the SQL that must give the same rows."""

from sparkbrief.plans import answers, guarded, positions, reliability, search, streams, threads, traces

CATALOG = {
    **positions.QUERIES,
    **search.QUERIES,
    **threads.QUERIES,
    **reliability.QUERIES,
    **traces.QUERIES,
    **guarded.QUERIES,
    **answers.QUERIES,
    **streams.QUERIES,
}
