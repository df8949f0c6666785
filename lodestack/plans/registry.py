"""All queries of the library by name, and their SQL."""

from __future__ import annotations

from lodestack.plans import datasets, ordered, retrieval, web

QUERIES = datasets.QUERIES | web.QUERIES | retrieval.QUERIES | ordered.QUERIES
SQL = datasets.SQL | web.SQL | retrieval.SQL | ordered.SQL
