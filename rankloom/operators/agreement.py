"""How far judges agree, from a 4x4 table per judge pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def check_labels(judges: list[str]) -> None:
    if len(set(judges)) != len(judges):
        raise ValueError(f"two judges share a label: {judges}")


def declared_pairs(judges: list[str]) -> Column:
    """Unordered pairs of the declared panel; a label used twice is an error."""
    check_labels(judges)
    pairs = [(a, b) for i, a in enumerate(judges) for b in judges[i + 1:]]
    return F.array(*[F.struct(F.lit(a).alias("judge_a"), F.lit(b).alias("judge_b")) for a, b in pairs])


def ratings_wide(judgements: DataFrame, judges: list[str], *carry: str, order: tuple[str, ...] = ()) -> DataFrame:
    """One row per page with a column r0, r1, ... per declared judge.

    Where a page has several ratings of one judge (URL variants that read the
    same once normalised), the last by ``order`` counts.
    """
    rated = judgements.where(F.col("rung").isNotNull() & F.col("judge").isin(*judges))
    at = F.struct(*order, "rung")
    return rated.groupBy("query_id", "url", *carry).agg(
        *[F.max(F.when(F.col("judge") == j, at))["rung"].alias(f"r{i}") for i, j in enumerate(judges)]
    )


def contingency(judgements: DataFrame, judges: list[str], *by: str) -> DataFrame:
    """Count of pages per (pair, rung a, rung b), optionally within a tag.

    Pages are shuffled once for all pairs; pairs come from the declared panel.
    """
    check_labels(judges)
    n = len(judges)
    pairs = F.array(*[
        F.struct(F.lit(judges[i]).alias("judge_a"), F.lit(judges[k]).alias("judge_b"), F.col(f"r{i}").alias("a"), F.col(f"r{k}").alias("b"))
        for i in range(n) for k in range(i + 1, n)
    ])
    return (
        ratings_wide(judgements, judges, *by).select(*by, F.inline(pairs))
        .where(F.col("a").isNotNull() & F.col("b").isNotNull())
        .groupBy(*by, "judge_a", "judge_b", "a", "b")
        .agg(F.count(F.lit(1)).alias("c"))
    )


def agreement_stats(table: DataFrame, judges: list[str], *by: str, tags: DataFrame | None = None) -> DataFrame:
    """Raw agreement and Cohen's kappa; kappa is 0 when chance alone explains all.

    A pair that shares no page still gets its zero row.
    """
    keys = [*by, "judge_a", "judge_b"]
    c, a, b = F.col("c"), F.col("a"), F.col("b")
    totals = table.groupBy(*keys).agg(
        F.sum(c).alias("n"),
        F.sum(F.when(a == b, c).otherwise(0)).alias("same"),
        *[F.sum(F.when(a == k, c).otherwise(0)).alias(f"_a{k}") for k in range(4)],
        *[F.sum(F.when(b == k, c).otherwise(0)).alias(f"_b{k}") for k in range(4)],
    )
    n = F.col("n").cast("double")
    po = F.col("same") / n
    pe = sum((F.col(f"_a{k}") / n) * (F.col(f"_b{k}") / n) for k in range(4))
    kappa = F.when(pe >= 1, F.lit(0.0)).otherwise(F.try_divide(po - pe, 1 - pe))
    got = totals.select(*keys, po.alias("raw_agreement"), kappa.alias("kappa"), F.col("n"))
    spine = (tags if tags is not None else table.sparkSession.range(1).drop("id")).select(
        "*", F.inline(declared_pairs(judges))
    )
    zero = {"raw_agreement": F.lit(0.0), "kappa": F.lit(0.0), "n": F.lit(0).cast("bigint")}
    return spine.join(got, keys, "left").withColumns({k: F.coalesce(F.col(k), z) for k, z in zero.items()})


def panel_agreement(judgements: DataFrame, judges: list[str]) -> DataFrame:
    return agreement_stats(contingency(judgements, judges), judges)


def agreement_by_tag(judgements: DataFrame, tags: DataFrame, tag: str, judges: list[str]) -> DataFrame:
    """The same within each value of a question tag (one row per question in ``tags``)."""
    tagged = judgements.join(tags.select("query_id", tag), "query_id").where(F.col(tag).isNotNull())
    values = tags.select(tag).where(F.col(tag).isNotNull()).distinct()
    return agreement_stats(contingency(tagged, judges, tag), judges, tag, tags=values)
