"""The registered queries and the SQL that gives the same rows."""

from __future__ import annotations

from . import agreement, evaluation, operations, texts, upkeep

QUERIES: dict = agreement.QUERIES | texts.QUERIES | evaluation.QUERIES | operations.QUERIES | upkeep.QUERIES
ORACLE_SQL: dict[str, str] = agreement.ORACLE_SQL | texts.ORACLE_SQL | evaluation.ORACLE_SQL | operations.ORACLE_SQL | upkeep.ORACLE_SQL
