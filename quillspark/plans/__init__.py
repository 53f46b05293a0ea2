"""Registered queries over the driver's tables and the SQL that gives the same rows."""

from __future__ import annotations

from quillspark.plans import audits, chains, corpus, messages, records, retrieval, states

QUERIES = retrieval.QUERIES | corpus.QUERIES | audits.QUERIES | records.QUERIES | chains.QUERIES | states.QUERIES | messages.QUERIES
ORACLE_SQL = retrieval.SQL | corpus.SQL | audits.SQL | records.SQL | chains.SQL | states.SQL | messages.SQL
