"""Which row of an append-only log stands for its key.

The five rules differ in what is dropped and when, so they stay five
functions. All rank rows inside a key and keep the first: Spark prunes each
map task to one row per key before the shuffle, so a key that holds a third
of the log still sends one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.errors import failed, is_account, is_transport

FETCH_KEY = ("query_id", "provider")
JUDGEMENT_KEY = ("query_id", "url", "judge")
SET_KEY = ("query_id", "provider", "judge")
ARM_KEY = ("query_id", "provider", "seed")
BASELINE_KEY = ("query_id", "grader")


def _first_by(df: DataFrame, keys, *order: Column) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def last_write(df: DataFrame, keys, order=("seq",)) -> DataFrame:
    return _first_by(df, keys, *[F.col(c).desc() for c in order])


def dedupe_fetches(log: DataFrame, order=("seq",)) -> DataFrame:
    """Last write per question and provider, then transport failures go."""
    return last_write(log, FETCH_KEY, order).where(~is_transport(F.col("error")))


def dedupe_arms(log: DataFrame, order=("seq",)) -> DataFrame:
    return last_write(log, ARM_KEY, order).where(~is_transport(F.col("error")))


def dedupe_verdicts(log: DataFrame, keys, order=("seq",)) -> DataFrame:
    """Last write, then failed calls go; a verdict without a score survives."""
    return last_write(log, keys, order).where(~failed(F.col("error")))


def best_fetches(log: DataFrame, controls=("plain",), order=("seq",)) -> DataFrame:
    """A clean row beats a failed one; among equals the newest fetch, then the later row."""
    clean = log.where(~F.col("provider").isin(*controls)) if controls else log
    return _first_by(
        clean,
        FETCH_KEY,
        failed(F.col("error")).asc(),
        F.col("fetched_at").desc_nulls_last(),
        *[F.col(c).desc() for c in order],
    )


def last_good_verdicts(log: DataFrame, keys, value: str = "rung", order=("seq",)) -> DataFrame:
    """Failed and empty verdicts go first, so an earlier good one can win."""
    good = log.where(~failed(F.col("error")) & F.col(value).isNotNull())
    return last_write(good, keys, order)


def resumable_fetches(log: DataFrame) -> DataFrame:
    """Keys with any row that is evidence: neither transport nor account failure."""
    error = F.col("error")
    return log.where(~is_transport(error) & ~is_account(error)).select(*FETCH_KEY).distinct()


def resumable_arms(log: DataFrame) -> DataFrame:
    """Here an account failure counts as done; only transport failures are retried."""
    return log.where(~is_transport(F.col("error"))).select(*ARM_KEY).distinct()


def resumable_verdicts(log: DataFrame, keys) -> DataFrame:
    return log.where(~failed(F.col("error"))).select(*keys).distinct()


def judgeable_fetches(fetches: DataFrame, n_sources: Column) -> DataFrame:
    return fetches.where(~failed(F.col("error")) & (n_sources > 0))
