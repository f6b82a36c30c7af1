"""All registered queries of the analytics library and their oracle SQL."""

from __future__ import annotations

from scorebook.plans import facts, games, library, operators, page_records, runs, sources

QUERIES = library.QUERIES | operators.QUERIES | games.QUERIES | sources.QUERIES | facts.QUERIES | page_records.QUERIES | runs.QUERIES
ORACLE_SQL = library.ORACLE_SQL | operators.ORACLE_SQL | games.ORACLE_SQL | sources.ORACLE_SQL | facts.ORACLE_SQL | page_records.ORACLE_SQL | runs.ORACLE_SQL
