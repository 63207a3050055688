"""What explains the variation of scores: provider, question, judge or their mix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

PARTS = ["provider", "query", "judge", "provider_by_query", "residual"]


# What a row of the grouping sets stands for: bits of (query_id, provider, judge) that it sums over.
ALL, JUDGE, PROVIDER, QUERY, SET = 7, 6, 5, 3, 1


def variance_shares(cells: DataFrame) -> DataFrame:
    """Sums-of-squares shares over (query, provider, judge) cells, one row.

    One aggregate over grouping sets gives the number, mean and centred second
    moment of every group. What a level explains is the total less the moments
    inside its groups, so nothing is a difference of large squares. The mixed
    part adds the products of a question's and a provider's distance from the
    grand mean, which vanish only where every provider has the same questions.
    """
    n = F.count("value")
    levels = cells.groupingSets([["query_id", "provider"], ["query_id"], ["provider"], ["judge"], []], "query_id", "provider", "judge").agg(
        F.grouping_id().alias("level"), n.alias("n"), F.avg("value").alias("m"), F.coalesce(F.var_pop("value") * n, F.lit(0.0)).alias("inside"))
    at, name = F.col("level"), F.when(F.col("provider").isNull(), "-").otherwise(F.concat(F.lit("+"), F.col("provider")))
    # One entry per provider, a declared list.
    providers = levels.where(at.isin(PROVIDER, ALL)).agg(
        F.map_from_entries(F.collect_list(F.when(at == PROVIDER, F.struct(name.alias("k"), F.col("m").alias("m"))))).alias("m"),
        F.max(F.when(at == ALL, F.col("m"))).alias("g"))
    known = providers.select(F.struct("g", "m")).scalar()
    grand, by_provider = known["g"], known["m"]
    of_query = F.max(F.when(at == QUERY, F.col("m"))).over(Window.partitionBy("query_id"))
    rows = levels.withColumn("_q", of_query - grand).withColumn("_p", by_provider[name] - grand)

    def inside(level: int) -> Column:
        return F.coalesce(F.sum(F.when(at == level, F.col("inside"))), F.lit(0.0))

    sums = rows.agg(
        F.coalesce(F.sum(F.when(at == ALL, F.col("n"))), F.lit(0)).alias("n_cells"), inside(ALL).alias("total"),
        *[inside(level).alias(k) for k, level in (("_query", QUERY), ("_provider", PROVIDER), ("_judge", JUDGE), ("_set", SET))],
        F.coalesce(F.sum(F.when(at == SET, F.col("n") * F.col("_q") * F.col("_p"))), F.lit(0.0)).alias("_both"))
    total = F.col("total")
    out = sums.withColumns({k: total - F.col(f"_{k}") for k in ("provider", "query", "judge")})
    mixed = (total - F.col("_set")) - F.col("query") - F.col("provider") + 2 * F.col("_both")
    out = out.withColumn("provider_by_query", F.greatest(F.lit(0.0), mixed))
    rest = total - sum(F.col(k) for k in PARTS[:-1])
    out = out.withColumn("residual", F.greatest(F.lit(0.0), rest))
    usable = (F.col("n_cells") >= 2) & (total > 0)
    return out.select(
        *[F.coalesce(F.when(usable, F.try_divide(F.col(k), total)), F.lit(0.0)).alias(k) for k in PARTS],
        "n_cells",
    )


def map_not_ranking(shares: DataFrame) -> DataFrame:
    """True when providers differ by question rather than overall."""
    flag = (
        (F.col("n_cells") > 0)
        & (F.col("provider") < 0.05)
        & (F.col("provider_by_query") > F.col("provider") * 2)
    )
    return shares.select("provider", "provider_by_query", flag.alias("map_not_ranking"))
