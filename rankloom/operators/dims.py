"""Small dimensions (providers, judges, types) and the grids over them.

These lists are configuration: every entry is a provider or judge somebody
set up by hand, so the caller declares them. A grid is an ``explode`` of such a
list, never a product of two tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def values(declared: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in declared])


def matrix(questions: DataFrame, **dims: list | Column) -> DataFrame:
    """Every question with every combination of the given small lists."""
    out = questions
    for name, values in dims.items():
        arr = values if isinstance(values, Column) else F.array(*[F.lit(v) for v in values])
        out = out.withColumn(name, F.explode(arr))
    return out


def seed_matrix(questions: DataFrame, providers: list | Column, seeds: int) -> DataFrame:
    return matrix(questions, provider=providers, seed=F.sequence(F.lit(0), F.lit(seeds - 1)))


def remaining(todo: DataFrame, done: DataFrame, keys) -> DataFrame:
    """Matrix rows whose key has not landed yet."""
    return todo.join(done.select(*keys), list(keys), "left_anti")


def belonging(log: DataFrame, todo: DataFrame, keys) -> DataFrame:
    """Log rows that are part of this run's matrix."""
    return log.join(todo.select(*keys), list(keys), "left_semi")


def with_slices(df: DataFrame, *cols: str) -> DataFrame:
    """One copy of a row per slice it is part of: the whole, and each tagged column.

    Feeds a single aggregate instead of one job per slice. An untagged row is
    simply not in that slice.
    """
    parts = [F.struct(F.lit("all").alias("slice"), F.lit("").alias("value"))]
    parts += [F.struct(F.lit(c).alias("slice"), F.col(c).alias("value")) for c in cols]
    tagged = F.filter(F.array(*parts), lambda s: s["value"].isNotNull())
    return df.withColumn("_s", F.explode(tagged)).select("*", "_s.slice", F.col("_s.value").alias("slice_value")).drop("_s")
