"""The registered queries of the library and their SQL."""

from __future__ import annotations

from . import corpus, more_plans, registers, search_plans, structure_plans, text_plans

QUERIES: dict = {}
SQL: dict[str, str] = {}
for module in (search_plans, corpus, registers, text_plans, structure_plans, more_plans):
    QUERIES |= module.QUERIES
    SQL |= module.SQL
