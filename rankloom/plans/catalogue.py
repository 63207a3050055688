"""All registered queries in one place."""

from __future__ import annotations

from . import queries_arms, queries_report, queries_score, queries_sources, queries_streams, queries_text  # noqa: F401
from .registry import ORACLES, QUERIES, oracle_text, runner


def queries():
    return {name: runner(name) for name in sorted(QUERIES)}


def oracle_sql():
    return {name: oracle_text(sql) for name, sql in sorted(ORACLES.items())}
