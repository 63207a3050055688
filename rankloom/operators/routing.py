"""Heatmaps, leader calls and the per-type provider recommendation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.errors import failed
from ..functions.labels import TYPE_ORDER, order_of
from ..functions.stats import ci95, half_up, mean0
from .dims import values

# Gap below which a lead is re-run noise; failure rate above which a
# provider is not recommended; difference in failure rate that matters.
NOISE_FLOOR = 1.04
MAX_ERROR_RATE = 0.2
RELIABILITY_EDGE = 0.05


def heatmap(rows: DataFrame, providers: list[str]) -> DataFrame:
    """Long form: mean retrieval per (type, provider), 0 with runs = 0 where nothing ran."""
    ok = rows.where(~failed(F.col("error")))
    cells = ok.groupBy("type", "provider").agg(
        F.round(F.avg("retrieval_score"), 2).alias("score"), F.count("retrieval_score").alias("runs")
    )
    grid = rows.select("type").distinct().withColumn("provider", F.explode(values(providers)))
    return grid.join(cells, ["type", "provider"], "left").select(
        "type", "provider",
        F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("runs", F.lit(0)).alias("runs"),
    )


def heatmap_rows(cells: DataFrame, order: list[str] = TYPE_ORDER) -> DataFrame:
    """One row per type in listing order; scores as a provider-keyed map."""
    return (
        cells.groupBy("type")
        .agg(
            F.map_from_entries(F.array_sort(F.collect_list(F.struct("provider", "score")))).alias("scores"),
            F.max("runs").alias("runs"),
        )
        .withColumn("position", order_of(F.col("type"), order))
    )


def runs_per_cell(cells: DataFrame) -> DataFrame:
    per_type = cells.groupBy("type").agg(F.max("runs").alias("runs"))
    return per_type.agg(F.coalesce(half_up(F.avg("runs")), F.lit(0)).alias("runs_per_cell"))


def leader_calls(cells: DataFrame, noise_floor: float = NOISE_FLOOR) -> DataFrame:
    """Who leads each type: a name only for a unique top whose gap clears the floor."""
    w = Window.partitionBy("type").orderBy(F.col("score").desc())
    ranked = cells.withColumn("rank", F.dense_rank().over(w))
    per_type = ranked.groupBy("type").agg(
        F.max("score").alias("best"),
        F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second"),
        F.count_if(F.col("rank") == 1).alias("winners"),
        F.min(F.when(F.col("rank") == 1, F.col("provider"))).alias("top"),
    )
    gap = F.coalesce(F.col("best") - F.col("second"), F.lit(float("inf")))
    unique = F.col("winners") == 1
    return per_type.select(
        "type", "best", "second", "winners",
        F.when(unique & (gap >= noise_floor), F.col("top")).alias("leads"),
        (unique & (gap < noise_floor)).alias("too_close"),
    )


def type_cells(rows: DataFrame) -> DataFrame:
    """Mean, interval, distinct questions and failure rate per (type, provider).

    Rounded here because the recommendation is defined on the rounded values;
    one sample has an infinite interval, not a zero one.
    """
    bad = failed(F.col("error"))
    ok_score = F.when(~bad, F.col("retrieval_score"))
    per_query = rows.groupBy("type", "provider", "query_id").agg(F.count_if(~bad).alias("ok"))
    queries = per_query.groupBy("type", "provider").agg(F.count_if(F.col("ok") > 0).alias("n_queries"))
    stats = rows.groupBy("type", "provider").agg(
        F.round(mean0(ok_score), 2).alias("retrieval_mean"),
        F.when(F.count(ok_score) < 2, F.lit(float("inf"))).otherwise(F.round(ci95(ok_score), 2)).alias("retrieval_ci95"),
        F.round(mean0(F.when(~bad, F.col("answer_score"))), 2).alias("answer_mean"),
        F.round(F.count_if(bad) / F.count(F.lit(1)), 4).alias("error_rate"),
    )
    return stats.join(queries, ["type", "provider"])


def best_per_type(cells: DataFrame) -> DataFrame:
    """The pick per type and what decided it.

    Quality decides when the leader's margin clears its own interval and the
    leader is dependable; otherwise the steadier provider goes first. A group
    is one type's providers, so each window holds a handful of rows.
    """
    by_type = Window.partitionBy("type")
    quality = [F.col("retrieval_mean").desc(), F.col("answer_mean").desc(), F.col("provider").asc()]
    ranked = (
        cells.withColumn("_q", F.row_number().over(by_type.orderBy(*quality)))
        .withColumn("_r", F.row_number().over(by_type.orderBy(F.col("error_rate").asc(), *quality)))
        .withColumn("_n", F.count(F.lit(1)).over(by_type))
    )

    def at(rank: str, k: int, field: str) -> Column:
        return F.max(F.when(F.col(rank) == k, F.col(field))).over(by_type)

    lead = at("_q", 1, "retrieval_mean") - at("_q", 2, "retrieval_mean")
    separated = lead > at("_q", 1, "retrieval_ci95")
    unfit = (at("_q", 1, "error_rate") > MAX_ERROR_RATE) & (
        at("_q", 1, "error_rate") - at("_q", 2, "error_rate") > RELIABILITY_EDGE
    )
    ranked = ranked.withColumn("_on_quality", F.coalesce(separated & ~unfit, F.lit(False)))
    ranked = ranked.withColumn("_place", F.when(F.col("_on_quality"), F.col("_q")).otherwise(F.col("_r")))
    order = by_type.orderBy("_place")
    ranked = ranked.withColumns({
        "runner_up": F.lead("provider").over(order),
        "_next_mean": F.lead("retrieval_mean").over(order),
        "_next_err": F.lead("error_rate").over(order),
    })
    decided = (
        F.when(F.col("_n") == 1, "unopposed")
        .when(F.col("_on_quality"), "retrieval")
        .when(F.col("error_rate") != F.col("_next_err"), "reliability")
        .otherwise("inconclusive")
    )
    return ranked.where("_place = 1").select(
        "type", "provider", "retrieval_mean", "retrieval_ci95", "answer_mean", "n_queries", "error_rate", "runner_up",
        F.coalesce(F.round(F.col("retrieval_mean") - F.col("_next_mean"), 2), F.lit(0.0)).alias("margin"),
        decided.alias("decided_by"),
    )


def route(requests: DataFrame, local: DataFrame, reference: DataFrame, caveat: str) -> DataFrame:
    """Recommendation per request: the user's own table first, else the reference one."""
    body = [c for c in local.columns if c != "type"]
    a = local.select("type", F.struct(*body).alias("own"))
    b = reference.select("type", F.struct(*body).alias("shipped"))
    table = a.join(b, "type", "full").select(
        "type", F.coalesce("own", "shipped").alias("pick"), F.col("own").isNotNull().alias("is_own")
    )
    return requests.join(table, "type", "left").select(
        *requests.columns, "pick.*",
        F.when(F.col("is_own"), "own runs").when(F.col("pick").isNotNull(), "reference run").alias("source"),
        F.when(~F.col("is_own"), F.lit(caveat)).alias("caveat"),
    )
