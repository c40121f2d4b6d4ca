"""Queries over the test tables, and the SQL that gives the same rows."""

from __future__ import annotations

from setaudit.plans import checks, composites, verdicts

QUERIES: dict = checks.QUERIES | verdicts.QUERIES | composites.QUERIES
ORACLES: dict = checks.ORACLES | verdicts.ORACLES | composites.ORACLES
