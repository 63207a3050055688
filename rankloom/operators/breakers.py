"""When a run should have stopped: a dead provider, a dead network.

A run may be one long log, so nothing here orders a whole run in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.errors import failed, is_transport

DEAD_AFTER = 8
NETWORK_DEAD_AFTER = 12
SPAN = 100_000


def dead_providers(log: DataFrame, limit: int = DEAD_AFTER) -> DataFrame:
    """First row at which a provider has ``limit`` failures and no success yet.

    Equivalently its ``limit``-th failure, when that comes before its first
    success. Spark keeps at most ``limit`` rows per key in every map task.
    """
    keys = ["run_id", "provider"]
    seen = log.where(~is_transport(F.col("error"))).select(*keys, "seq", failed(F.col("error")).alias("bad"))
    first_ok = seen.groupBy(*keys).agg(F.min(F.when(~F.col("bad"), F.col("seq"))).alias("ok_at"))
    w = Window.partitionBy(*keys).orderBy("seq")
    nth = (
        seen.where("bad").withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= limit)
        .where(F.col("nth") == limit)
    )
    return (
        nth.join(first_ok, keys).where(F.col("ok_at").isNull() | (F.col("seq") < F.col("ok_at")))
        .select(*keys, F.col("seq").alias("dead_at"))
    )


def network_streaks(
    log: DataFrame, limit: int = NETWORK_DEAD_AFTER, span: int = SPAN, before: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(first row per run that completes ``limit`` transport failures in a row, streak at the end).

    The log is cut into spans of ``seq``. Inside a span streaks are counted
    from its own start; one summary row per span then says how long a streak
    enters it from the spans before. ``before`` gives each run's streak ahead
    of this part of the log.
    """
    rows = log.select(
        "run_id", "seq", is_transport(F.col("error")).alias("hit"), F.floor(F.col("seq") / span).alias("span")
    )
    upto = Window.partitionBy("run_id", "span").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("resets", F.sum(F.when(F.col("hit"), 0).otherwise(1)).over(upto))
    since = Window.partitionBy("run_id", "span", "resets").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("streak", F.sum(F.when(F.col("hit"), 1).otherwise(0)).over(since))
    spans = rows.groupBy("run_id", "span").agg(
        F.max(F.struct("seq", "streak"))["streak"].alias("tail"), F.max("resets").alias("resets")
    )
    if before is None:
        spans = spans.withColumn("entering", F.lit(0).cast("bigint"))
    else:
        spans = spans.join(before.select("run_id", F.col("streak").alias("entering")), "run_id", "left").na.fill(0, ["entering"])
    by_run = Window.partitionBy("run_id").orderBy("span")
    # Spans without a reset extend the streak of the span before them.
    spans = spans.withColumn("isle", F.sum(F.when(F.col("resets") > 0, 1).otherwise(0)).over(
        by_run.rowsBetween(Window.unboundedPreceding, 0)))
    run_out = F.sum("tail").over(
        Window.partitionBy("run_id", "isle").orderBy("span").rowsBetween(Window.unboundedPreceding, 0))
    spans = spans.withColumn("out", run_out + F.when(F.col("isle") == 0, F.col("entering")).otherwise(0))
    carried = spans.withColumn("carry", F.coalesce(F.lag("out").over(by_run), F.col("entering"))).select("run_id", "span", "carry")
    full = rows.where("hit").join(carried, ["run_id", "span"]).withColumn(
        "whole", F.col("streak") + F.when(F.col("resets") == 0, F.col("carry")).otherwise(0)
    )
    dead = full.where(F.col("whole") >= limit).groupBy("run_id").agg(F.min("seq").alias("dead_at"))
    return dead, spans.groupBy("run_id").agg(F.max_by("out", "span").alias("streak"))


def network_dead(log: DataFrame, limit: int = NETWORK_DEAD_AFTER, span: int = SPAN) -> DataFrame:
    """First row of each run at which the network counts as gone."""
    return network_streaks(log, limit, span)[0]
