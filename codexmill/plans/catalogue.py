"""All registered queries outside the llm subpackage."""

from __future__ import annotations

from . import engine, legal, retrieval, rules, star, stateful, streams, texts

MODULES = [engine, star, retrieval, stateful, legal, rules, streams, texts]
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _module in MODULES:
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
