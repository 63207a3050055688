"""First-generation instrument: question x provider x seed arms, 0-10 scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.errors import failed, is_account, is_provider_fault
from ..functions.stats import ci95, mean0, pearson, std0
from .dims import values, with_slices
from .ranks import percentiles


def arm_judgements(arms: DataFrame) -> DataFrame:
    """One row per (arm, judge) of the arms that landed."""
    return arms.where(~failed(F.col("error"))).select(
        "query_id", "type", "provider", "seed", F.inline("judgements")
    )


def provider_stats(arms: DataFrame, by_type: bool = False, providers: list[str] = ()) -> DataFrame:
    """Mean per question first, then mean and interval over questions.

    Attempts, errors and latency are counted over every arm, scores over the
    arms that landed. With ``by_type`` every (type, provider) pair appears.
    """
    slices = ("type",) if by_type else ()
    keys = ["slice", "slice_value", "provider"]
    attempts = with_slices(arms, *slices).withColumn("_ok", ~failed(F.col("error")))
    # Scores of an arm are summed in the row, so judges are never exploded.
    j = F.col("judgements")
    zero = F.lit(0.0)

    def total(field: str) -> Column:
        return F.when(F.col("_ok"), F.aggregate(F.transform(j, lambda x: x[field]), zero, lambda acc, x: acc + x))

    n = F.when(F.col("_ok"), F.size(j)).otherwise(0)
    per_query = attempts.withColumns({"_n": n, "_r": total("retrieval_score"), "_a": total("answer_score")}).groupBy(
        *keys, "query_id"
    ).agg(
        F.sum("_n").alias("n"), F.sum("_r").alias("r"), F.sum("_a").alias("a"),
        F.count_if("_ok").alias("landed"),
        F.count(F.lit(1)).alias("arms"),
        F.count_if(is_provider_fault(F.col("error"), F.col("error_stage"))).alias("errors"),
        F.count_if(is_account(F.col("error"))).alias("account"),
        F.count("fetch_ms").alias("timed"),
    )
    measured = F.col("landed") > 0

    def query_mean(total_: str) -> Column:
        return F.when(measured, F.coalesce(F.try_divide(F.col(total_), F.col("n")), zero))

    per_query = per_query.withColumns({"retrieval": query_mean("r"), "answer": query_mean("a")})
    stats = per_query.groupBy(*keys).agg(
        F.count_if(measured).alias("n_queries"),
        mean0(F.col("retrieval")).alias("retrieval_mean"),
        ci95(F.col("retrieval")).alias("retrieval_ci95"),
        mean0(F.col("answer")).alias("answer_mean"),
        ci95(F.col("answer")).alias("answer_ci95"),
        F.sum("arms").alias("n_arms"),
        F.sum("errors").alias("n_errors"),
        F.try_divide(F.sum("errors").cast("double"), F.sum("arms")).alias("error_rate"),
        F.sum("account").alias("n_account_errors"),
        F.sum("timed").alias("n_fetch_timed"),
    )
    timing = percentiles(attempts, keys, "fetch_ms", {"fetch_ms_p50": 0.5, "fetch_ms_p95": 0.95}).drop("n")
    full = stats.join(timing, keys, "left")
    if not by_type:
        return full.drop("slice", "slice_value")
    if not providers:
        raise ValueError("a grid over types needs its providers declared")
    grid = (
        arms.select(F.lit("type").alias("slice"), F.col("type").alias("slice_value")).distinct()
        .withColumn("provider", F.explode(values(providers)))
    )
    full = grid.join(full, keys, "left")
    counted = [c for c in stats.columns if c not in keys]
    full = full.withColumns({c: F.coalesce(F.col(c), F.lit(0).cast(stats.schema[c].dataType)) for c in counted})
    return full.withColumnRenamed("slice_value", "type").drop("slice")


def _first_by(judge: str) -> Column:
    """The first judgement of one judge inside the row's own array."""
    return F.try_element_at(F.filter(F.col("judgements"), lambda x: x["judge"] == judge), F.lit(1))


def aligned_scores(arms: DataFrame, judge_a: str, judge_b: str) -> DataFrame:
    """Both judges' scores of every arm they both graded, one row per metric."""
    both = arms.where(~failed(F.col("error"))).select(
        "query_id", "provider", "seed", _first_by(judge_a).alias("x"), _first_by(judge_b).alias("y")
    ).where(F.col("x").isNotNull() & F.col("y").isNotNull())
    rows = [
        F.struct(F.lit(m).alias("metric"), F.col(f"x.{m}_score").alias("a"), F.col(f"y.{m}_score").alias("b"))
        for m in ("retrieval", "answer")
    ]
    return both.select("query_id", "provider", "seed", F.inline(F.array(*rows)))


def agreement(arms: DataFrame, judge_a: str, judge_b: str) -> DataFrame:
    gap = F.abs(F.col("a") - F.col("b"))
    spine = arms.sparkSession.range(1).select(F.explode(F.array(F.lit("retrieval"), F.lit("answer"))).alias("metric"))
    got = aligned_scores(arms, judge_a, judge_b).groupBy("metric").agg(
        pearson(F.col("a"), F.col("b")).alias("pearson"),
        F.avg(gap).alias("mean_abs_diff"),
        F.avg((gap <= 1).cast("int")).alias("within_1_rate"),
        F.count(F.lit(1)).alias("n"),
    )
    out = spine.join(got, "metric", "left")
    return out.select(
        "metric", F.lit(judge_a).alias("judge_a"), F.lit(judge_b).alias("judge_b"),
        *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in ("pearson", "mean_abs_diff", "within_1_rate")],
        F.coalesce(F.col("n"), F.lit(0)).alias("n"),
    )


def variance(arms: DataFrame, judge_a: str, judge_b: str) -> DataFrame:
    """Noise over seeds, and the mean gap of the panel's first two judges."""
    per_cell = arm_judgements(arms).groupBy("query_id", "provider", "judge").agg(
        std0(F.col("retrieval_score")).alias("seed_std")
    )
    gap = aligned_scores(arms, judge_a, judge_b).where("metric = 'retrieval'").agg(
        mean0(F.abs(F.col("a") - F.col("b"))).alias("g")
    ).scalar()
    return per_cell.agg(mean0(F.col("seed_std")).alias("seed_std_mean")).withColumn("judge_gap_mean", gap)


def counters(arms: DataFrame) -> DataFrame:
    bad = F.size(F.filter(
        F.col("judgements"),
        lambda x: x["retrieval_rationale"].contains("unparseable") | x["answer_rationale"].contains("unparseable"),
    ))
    per_query = arms.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(failed(F.col("error"))).alias("errors"), F.sum(bad).alias("bad")
    )
    return per_query.agg(
        F.sum("rows").alias("n_rows"), F.sum("errors").alias("n_errors"),
        F.count(F.lit(1)).alias("n_queries"), F.sum("bad").alias("n_unparseable_judgements"),
    )
