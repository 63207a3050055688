"""Name an intermediate value inside a column rule."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterable, Iterator
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, functions as F


class Steps:
    """Intermediates of rules as columns of successive selects over one table."""

    def __init__(self, df: DataFrame, reserved: Iterable[str] = ()):
        self.df = df
        self.taken = {c.lower() for c in [*df.columns, *reserved]}
        self.names: list[str] = []

    def name(self, value: Column) -> Column:
        n = f"_let{len(self.names)}"
        while n in self.taken:
            n = f"_{n}"
        self.taken.add(n)
        self.names.append(n)
        self.df = self.df.withColumn(n, value)
        return F.col(n)


_STEPS: ContextVar[Steps | None] = ContextVar("steps", default=None)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it several times in ``body``.

    Under ``with_rules`` the value becomes a column, so the rule stays in
    generated code; it is then evaluated for every row, whatever conditions stand
    around it, and must not fail on any. Elsewhere (inside lambdas, where no
    column can be added) it is an element of an array, which is interpreted.
    """
    steps = _STEPS.get()
    if steps is not None:
        return body(steps.name(value))
    return F.element_at(F.transform(F.array(value), body), 1)


@contextlib.contextmanager
def inline() -> Iterator[None]:
    """For rules built inside a lambda: their intermediates depend on its variable."""
    token = _STEPS.set(None)
    try:
        yield
    finally:
        _STEPS.reset(token)


def with_rules(df: DataFrame, **rules: Callable[[], Column]) -> DataFrame:
    """``df`` with a column for each rule; ``rules`` build their columns when called."""
    steps = Steps(df, rules)
    token = _STEPS.set(steps)
    try:
        built = {name: rule() for name, rule in rules.items()}
    finally:
        _STEPS.reset(token)
    return steps.df.withColumns(built).drop(*steps.names)
