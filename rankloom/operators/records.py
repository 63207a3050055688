"""Run records of both shapes: shaping, flattening, summaries, winners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.errors import failed
from ..functions.labels import finite
from .ranks import WHOLE, medians


def to_batch_records(rows: DataFrame, batch_id: str | Column, ts: Column) -> DataFrame:
    """One record per batch row, all under the batch's id."""
    bid = F.lit(batch_id) if isinstance(batch_id, str) else batch_id
    body = [c for c in rows.columns]
    return rows.select(
        F.lit("batch").alias("mode"), bid.alias("batchId"), ts.alias("ts"), F.struct(*body).alias("row")
    )


def to_run_record(runs: DataFrame, record_id: Column, ts: Column) -> DataFrame:
    return runs.select(
        F.lit("run").alias("mode"), record_id.alias("id"), ts.alias("ts"),
        "query", "variable", "winner", "judge_model", "arms",
    )


def flatten(records: DataFrame) -> DataFrame:
    """One row per arm, whichever of the two shapes it was logged in."""
    batch = records.where("mode = 'batch'").select(
        F.col("row.provider").alias("provider"), F.coalesce("row.query", F.lit("")).alias("query"),
        finite(F.col("row.retrieval_score")).alias("retrieval"), finite(F.col("row.answer_score")).alias("answer"),
        finite(F.col("row.latency_ms")).alias("latency"), failed(F.col("row.error")).alias("failed"),
    )
    arms = records.where("mode = 'run'").select("query", F.explode("arms").alias("a"))
    single = arms.select(
        F.col("a.provider").alias("provider"), F.coalesce("query", F.lit("")).alias("query"),
        finite(F.col("a.retrieval_score")).alias("retrieval"), finite(F.col("a.score")).alias("answer"),
        finite(F.col("a.latency_ms")).alias("latency"), failed(F.col("a.error")).alias("failed"),
    )
    return batch.unionByName(single)


def summarize(flat: DataFrame) -> DataFrame:
    """Per provider, plus a row over all of them (provider '*')."""
    both = flat.withColumn("provider", F.explode(F.array(F.col("provider"), F.lit("*"))))
    base = both.groupBy("provider").agg(
        F.count(F.lit(1)).alias("arms"), F.count_if("failed").alias("fails"),
        F.avg("retrieval").alias("retrieval"), F.avg("answer").alias("answer"),
    )
    queries = both.select("provider", "query").distinct().groupBy("provider").agg(F.count(F.lit(1)).alias("queries"))
    latency = medians(both, ["provider"], "latency", rounded=True, digits=WHOLE).select("provider", F.col("median").alias("latency"))
    return base.join(queries, "provider", "left").join(latency, "provider", "left")


def pick_winners(arms: DataFrame, run: str = "id", arm: str = "arm", score: str = "retrieval_score") -> DataFrame:
    """Best-scoring arm of each run that did not fail; the earliest one on a tie."""
    ok = arms.where(~failed(F.col("error")))
    best = ok.groupBy(run).agg(F.min(F.struct((-F.col(score)).alias("s"), F.col("pos"), F.col(arm).alias("winner"))).alias("w"))
    return arms.select(run).distinct().join(best, run, "left").select(run, F.col("w.winner").alias("winner"))


def compact_runs(runs: DataFrame) -> DataFrame:
    """A run without its texts: winner by provider, distinct domains, scores."""
    arms = F.col("arms")
    won = F.try_element_at(F.filter(arms, lambda a: a["id"] == F.col("winner")), F.lit(1))

    def lean(a: Column) -> Column:
        ok = ~failed(a["error"])
        return F.struct(
            a["provider"].alias("provider"),
            F.when(~ok, a["error"]).alias("error"),
            F.when(ok, a["retrieval_score"]).alias("retrieval_score"),
            F.when(ok, a["score"]).alias("answer_score"),
            F.when(ok, a["retrieval_rationale"]).alias("retrieval_rationale"),
            F.when(ok, F.size(a["sources"])).alias("num_sources"),
            F.when(ok, F.array_distinct(F.transform(a["sources"], lambda s: s["domain"]))).alias("domains"),
            F.when(ok, a["latency_ms"]).alias("latency_ms"),
        )

    return runs.select(
        "id", "query", F.try_element_at(arms, F.lit(1))["model"].alias("answer_model"), "judge_model",
        won["provider"].alias("winner"), F.transform(arms, lean).alias("arms"),
    )


def latest_batch(records: DataFrame) -> DataFrame:
    """Rows of the batch whose first row appeared last."""
    first = records.where("mode = 'batch'").groupBy("batchId").agg(F.min("seq").alias("s"))
    last = first.agg(F.max_by("batchId", "s").alias("b")).scalar()
    return records.where((F.col("mode") == "batch") & (F.col("batchId") == last))


def recent_runs(records: DataFrame, n: int = 8) -> DataFrame:
    return records.where("mode = 'run'").orderBy(F.col("seq").desc()).limit(n)


def first_seen(rows: DataFrame, col: str) -> DataFrame:
    """Distinct values with the position at which each first appeared."""
    return rows.groupBy(col).agg(F.min("seq").alias("first_seq"))
