"""All registered queries of the analytics engine with their SQL."""

from __future__ import annotations

from quillstone.plans import evidence, filings, finance, layout, pages, search, states, streams, text

QUERIES = {**finance.QUERIES, **text.QUERIES, **search.QUERIES, **streams.QUERIES, **layout.QUERIES, **evidence.QUERIES, **filings.QUERIES, **pages.QUERIES, **states.QUERIES}
ORACLE_SQL = {**finance.ORACLE_SQL, **text.ORACLE_SQL, **search.ORACLE_SQL, **streams.ORACLE_SQL, **layout.ORACLE_SQL, **evidence.ORACLE_SQL, **filings.ORACLE_SQL, **pages.ORACLE_SQL, **states.ORACLE_SQL}
