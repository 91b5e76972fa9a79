"""Every query by name, and its SQL."""

from __future__ import annotations

from . import q_actions, q_positions, q_words

MODULES = (q_positions, q_words, q_actions)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
