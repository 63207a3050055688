"""Scoring providers against pooled verdicts (0-3 rungs)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.errors import failed, is_provider_fault
from ..functions.stats import ci95, mean0, nearest_rank_of
from .dims import values, with_slices

RELEVANT_AT = 2


def panel_means(judgements: DataFrame) -> DataFrame:
    """Mean rung of each question-and-page pair over the judges that gave one.

    Key filters are spelled out so that every use of the panel plans the same
    shuffle and Spark runs it once.
    """
    return (
        judgements.where("rung is not null and query_id is not null and url is not null")
        .groupBy("query_id", "url")
        .agg(F.avg("rung").alias("mean_rung"))
    )


def relevant_counts(panel: DataFrame) -> DataFrame:
    """Pages of each question whose panel mean clears the bar."""
    return (
        panel.where(F.col("mean_rung") >= RELEVANT_AT)
        .groupBy("query_id").agg(F.count(F.lit(1)).alias("n_relevant"))
    )


def page_verdicts(returned: DataFrame, panel: DataFrame) -> DataFrame:
    """Each returned page with its panel verdict, null when never judged."""
    return returned.join(panel, ["query_id", "url"], "left")


def query_scores(fetches: DataFrame, returned: DataFrame, panel: DataFrame) -> DataFrame:
    """Score per fetch: mean rung, precision, recall, and whether it is a measurement.

    A provider's failure or an empty set scores zero; our failure, or a set
    nobody judged, is excluded; recall is null where nothing relevant is known.
    """
    per_set = page_verdicts(returned, panel).groupBy("query_id", "provider").agg(
        F.count(F.lit(1)).alias("_returned"),
        F.count("mean_rung").alias("_judged"),
        F.avg("mean_rung").alias("_mean"),
        F.count_if(F.col("mean_rung") >= RELEVANT_AT).alias("_hits"),
    )
    rows = fetches.join(per_set, ["query_id", "provider"], "left").join(
        relevant_counts(panel), "query_id", "left"
    )
    err = failed(F.col("error"))
    empty = F.coalesce(F.col("_returned"), F.lit(0)) == 0
    miss = F.when(err, is_provider_fault(F.col("error"), F.col("error_stage"))).otherwise(empty)
    excluded = F.when(err, ~miss).otherwise(~empty & (F.col("_judged") == 0))
    n_rel = F.coalesce(F.col("n_relevant"), F.lit(0))

    def scored(x: Column) -> Column:
        return F.when(~excluded, F.when(miss, F.lit(0.0)).otherwise(x))

    hits = F.col("_hits").cast("double")
    return rows.withColumns({
        "is_miss": miss,
        "is_excluded": F.coalesce(excluded, F.lit(False)),
        "mean_rung": scored(F.col("_mean")),
        "precision": scored(F.try_divide(hits, F.col("_judged"))),
        "recall": F.when(n_rel > 0, scored(F.try_divide(hits, n_rel))),
    }).drop("_returned", "_judged", "_mean", "_hits", "n_relevant")


def provider_stats(
    scores: DataFrame, slices: tuple[str, ...] = (), providers: list[str] = ()
) -> DataFrame:
    """Scoreboard per provider, and per slice when asked, zero-filled over the grid.

    All slices and the percentiles come out of one aggregate. A fetch takes a
    whole number of milliseconds up to its deadline, so the counts per distinct
    value that an exact percentile keeps of a group stay small at any number of
    fetches; for values without such a bound there is ``ranks.percentiles``.
    """
    if slices and not providers:
        raise ValueError("a grid over slices needs its providers declared")
    sliced = with_slices(scores, *slices)
    keys = ["slice", "slice_value", "provider"]
    stats = sliced.groupBy(*keys).agg(
        F.count("mean_rung").alias("n_queries"),
        mean0(F.col("mean_rung")).alias("mean_rung"),
        ci95(F.col("mean_rung")).alias("mean_rung_ci95"),
        mean0(F.col("precision")).alias("precision"),
        ci95(F.col("precision")).alias("precision_ci95"),
        mean0(F.col("recall")).alias("recall"),
        ci95(F.col("recall")).alias("recall_ci95"),
        F.count("recall").alias("n_recall_queries"),
        F.count(F.lit(1)).alias("n_attempts"),
        F.count_if("is_miss").alias("n_misses"),
        F.count_if("is_excluded").alias("n_excluded"),
        F.count("fetch_ms").alias("n_fetch_timed"),
        nearest_rank_of("fetch_ms", 0.5).alias("fetch_ms_p50"),
        nearest_rank_of("fetch_ms", 0.95).alias("fetch_ms_p95"),
    )
    full = stats
    if slices:
        grid = sliced.select("slice", "slice_value").distinct().withColumn(
            "provider", F.explode(values(providers))
        )
        full = grid.join(full, keys, "left")
    absent_is_zero = [c for c in stats.columns if c not in keys and not c.startswith("fetch_ms_p")]
    return full.withColumns({c: F.coalesce(F.col(c), F.lit(0).cast(stats.schema[c].dataType)) for c in absent_is_zero})


def set_scores(fetches: DataFrame, n_returned: Column, verdicts: DataFrame) -> DataFrame:
    """Whole-set score per fetch under the same failure rules as ``query_scores``."""
    graded = (
        verdicts.where(F.col("score").isNotNull())
        .groupBy("query_id", "provider").agg(F.avg("score").alias("_graded"))
    )
    rows = fetches.join(graded, ["query_id", "provider"], "left")
    err = failed(F.col("error"))
    empty = n_returned == 0
    miss = F.when(err, is_provider_fault(F.col("error"), F.col("error_stage"))).otherwise(empty)
    score = F.when(miss, F.lit(0.0)).when(~err, F.col("_graded"))
    return rows.withColumns({"is_miss": miss, "set_score": score}).drop("_graded")


def set_stats(scores: DataFrame) -> DataFrame:
    return scores.groupBy("provider").agg(
        F.count("set_score").alias("n_queries"),
        mean0(F.col("set_score")).alias("mean_score"),
        ci95(F.col("set_score")).alias("mean_score_ci95"),
        F.count_if("is_miss").alias("n_misses"),
        F.count_if(F.col("set_score").isNull()).alias("n_excluded"),
    )


def rung_distribution(judgements: DataFrame) -> DataFrame:
    rung = F.col("rung")
    return judgements.groupBy("judge").agg(
        *[F.count_if(rung == k).alias(f"n_rung_{k}") for k in range(4)],
        F.count_if(rung.isNull()).alias("n_null"),
    )


def judge_cells(fetches: DataFrame, returned: DataFrame, judgements: DataFrame, judges: list[str]) -> DataFrame:
    """One judge's mean rung over one provider's set on one question, for each declared judge.

    Pages meet their ratings first; a set crosses one shuffle as the sums and
    counts of all judges, and only then meets its fetch.
    """
    measured = fetches.where(~failed(F.col("error"))).select("query_id", "provider")
    rated = judgements.where(F.col("rung").isNotNull()).select("query_id", "url", "judge", "rung")
    sums = returned.join(rated, ["query_id", "url"]).groupBy("query_id", "provider").agg(
        *[F.avg(F.when(F.col("judge") == j, F.col("rung"))).alias(f"m{i}") for i, j in enumerate(judges)])
    cells = F.array(*[F.struct(F.lit(j).alias("judge"), F.col(f"m{i}").alias("value")) for i, j in enumerate(judges)])
    return sums.join(measured, ["query_id", "provider"], "left_semi").select("query_id", "provider", F.inline(cells)).where("value is not null")


def run_counters(fetches: DataFrame, judgements: DataFrame, raw_judgements: DataFrame) -> DataFrame:
    """Headline counts of a run: one aggregate per table, one row out."""
    per_pair = judgements.groupBy("query_id", "url").agg(
        F.count(F.lit(1)).alias("n"), F.count("rung").alias("rated")
    )
    pairs = per_pair.agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_judgements"),
        F.coalesce(F.sum(F.col("n") - F.col("rated")), F.lit(0)).alias("n_null_rungs"),
        F.count_if(F.col("rated") == 0).alias("n_unjudged_pairs"),
    )
    questions = fetches.select("query_id").distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    errors = raw_judgements.agg(F.count_if(failed(F.col("error"))).alias("n")).scalar()
    return pairs.select(questions.alias("n_queries"), "*", errors.alias("n_judge_errors"))
