"""The no-search baseline and judge calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.errors import failed
from ..functions.labels import order_of

# On a tie the later of these wins.
CAUTION = ["knew", "partial", "unknown", "wrong"]


def majority_verdicts(rows: DataFrame) -> DataFrame:
    """One verdict per question over its graders; ties go to the more cautious."""
    votes = rows.where(F.col("verdict").isNotNull()).groupBy("query_id", "verdict").agg(F.count(F.lit(1)).alias("n"))
    return votes.groupBy("query_id").agg(
        F.max(F.struct("n", order_of(F.col("verdict"), CAUTION).alias("c"), "verdict"))["verdict"].alias("verdict")
    )


def verdict_counts(majority: DataFrame) -> DataFrame:
    """Questions per verdict, every verdict present."""
    spine = majority.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c) for c in CAUTION])).alias("verdict"))
    n = majority.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))
    return spine.join(n, "verdict", "left").select("verdict", F.coalesce("n", F.lit(0)).alias("n_questions"))


def questions_with(majority: DataFrame, verdict: str) -> DataFrame:
    """Sorted ids of the questions whose majority is ``verdict``, as a table."""
    return majority.where(F.col("verdict") == verdict).select("query_id").orderBy("query_id")


def baseline_counters(rows: DataFrame, raw: DataFrame) -> DataFrame:
    errors = raw.agg(F.count_if(failed(F.col("error"))).alias("n")).scalar()
    graded = rows.groupBy("query_id").agg(F.count("verdict").alias("g"), F.count(F.lit(1)).alias("n"))
    return graded.agg(
        F.count_if(F.col("g") > 0).alias("n_questions"),
        F.coalesce(F.sum(F.col("n") - F.col("g")), F.lit(0)).alias("n_ungraded"),
    ).withColumn("n_errors", errors)


def attach_baseline(questions: DataFrame, rows: DataFrame) -> DataFrame:
    """Each question with its graders' verdicts and reasons (one entry per grader, sorted)."""
    rows = rows if "rationale" in rows.columns else rows.withColumn("rationale", F.lit(None).cast("string"))
    given = rows.where(F.col("verdict").isNotNull()).groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("grader", "verdict", "rationale"))).alias("baseline")
    )
    empty = F.array().cast("array<struct<grader:string,verdict:string,rationale:string>>")
    return questions.join(given, "query_id", "left").withColumn("baseline", F.coalesce("baseline", empty))


def _rated(verdicts: DataFrame, anchors: DataFrame) -> DataFrame:
    return verdicts.join(anchors.select("id", "kind", "expected_rung"), "id")


def calibration(verdicts: DataFrame, anchors: DataFrame) -> DataFrame:
    """Per judge against settled ratings: exact hits, deviation, nulls, probes rated above 0."""
    got, want = F.col("rung"), F.col("expected_rung")
    exact = F.coalesce(got == want, F.lit(False))
    return _rated(verdicts, anchors).groupBy("judge").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(got.isNull()).alias("n_null"),
        F.avg(exact.cast("int")).alias("exact_rate"),
        F.coalesce(F.avg(F.abs(got - want)), F.lit(0.0)).alias("mean_abs_dev"),
        F.count_if((F.col("kind") == "probe") & (got > 0)).alias("n_probe_failures"),
        F.count_if(~exact).alias("n_misses"),
    )


def misses(verdicts: DataFrame, anchors: DataFrame) -> DataFrame:
    """Every miss with its size; a missing rung counts as -1."""
    got, want = F.col("rung"), F.col("expected_rung")
    off = F.abs(F.coalesce(got, F.lit(-1)) - want)
    missed = _rated(verdicts, anchors).where(~F.coalesce(got == want, F.lit(False)))
    return missed.withColumn("off", off).withColumn(
        "is_probe_failure", F.coalesce((F.col("kind") == "probe") & (got > 0), F.lit(False))
    )


def worst_misses(missed: DataFrame, keep: int = 5) -> DataFrame:
    """All probe failures, then each judge's ``keep`` widest other misses (a top-k report)."""
    from pyspark.sql import Window

    w = Window.partitionBy("judge").orderBy(F.col("off").desc(), "id")
    others = missed.where("not is_probe_failure").withColumn("place", F.row_number().over(w)).where(F.col("place") <= keep)
    return missed.where("is_probe_failure").withColumn("place", F.lit(0)).unionByName(others)
