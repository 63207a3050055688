"""Named queries: a Spark job over the derived logs and its SQL counterpart."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .views import VIEWS, Views

QUERIES: dict[str, Callable[[Views], DataFrame]] = {}
ORACLES: dict[str, str] = {}
# Shared steps of the SQL counterparts, by name; they may use one another.
STEPS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def step(name: str, sql: str) -> None:
    STEPS[name] = sql


def _text(name: str) -> str:
    if name in STEPS:
        return STEPS[name]
    return re.sub(r"\{(\w+)\}", r"\1", VIEWS[name])


def oracle_text(body: str) -> str:
    """Prefix a body with the definitions it uses, dependencies first."""
    known = list(VIEWS) + list(STEPS)
    order: list[str] = []

    def visit(text: str) -> None:
        for name in known:
            if name not in order and re.search(rf"\b(from|join)\s+{name}\b", text):
                visit(_text(name))
                if name not in order:
                    order.append(name)

    visit(body)
    if not order:
        return body
    ctes = ",\n".join(f"{n} as ({_text(n)})" for n in order)
    own = body.lstrip()
    if own.startswith("with recursive "):
        return f"with recursive {ctes},\n{own[15:]}"
    if own.startswith("with "):
        return f"with {ctes},\n{own[5:]}"
    return f"with {ctes}\n{body}"


def r6(*cols: str):
    """Select helpers: doubles to six decimals, the way both engines are compared."""
    return [F.round(F.col(c).cast("double"), 6).alias(c) for c in cols]


def presented(df: DataFrame) -> DataFrame:
    """Whole numbers as BIGINT, fractions to six decimals, dates as text."""
    out = []
    for f in df.schema.fields:
        c, t = F.col(f.name), f.dataType.typeName()
        if t in ("integer", "short", "byte"):
            c = c.cast("bigint")
        elif t in ("double", "float", "decimal"):
            c = F.round(c.cast("double"), 6)
        elif t in ("date", "timestamp", "timestamp_ntz"):
            c = c.cast("string")
        out.append(c.alias(f.name))
    return df.select(*out)


def runner(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return presented(QUERIES[name](Views(spark, sf_dir)))

    run.__name__ = name
    return run
