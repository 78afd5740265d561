"""All registered queries of the masking operators, with their SQL oracles."""

from __future__ import annotations

from . import queries_spans, queries_streams, queries_tables

QUERIES = queries_spans.QUERIES | queries_tables.QUERIES | queries_streams.QUERIES
ORACLE = queries_spans.ORACLE | queries_tables.ORACLE | queries_streams.ORACLE
FLAGSHIP = QUERIES["sanitize_documents"]
