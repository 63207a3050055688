"""Outcome of page extraction attempts: the text, or why there is none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.errors import failed

MIN_CHARS = 40
MAX_ATTEMPTS = 2
# Wording of an aborted call and of an HTTP refusal.
ABORTED = r"(?i)abort"
HTTP_REFUSED = r"^Unlocker \d"


def attempt_class(body: Column, error: Column) -> Column:
    return (
        F.when(~failed(error) & (F.length(body) > MIN_CHARS), "content")
        .when(~failed(error), "empty")
        .when(error.rlike(ABORTED), "timeout")
        .when(error.rlike(HTTP_REFUSED), "http_error")
        .otherwise("network")
    )


def extraction_outcomes(attempts: DataFrame) -> DataFrame:
    """One row per URL: only an empty or a network miss gets the second attempt."""
    tried = attempts.where(F.col("attempt") <= MAX_ATTEMPTS).withColumn("class", attempt_class(F.col("body"), F.col("error")))
    ends = F.col("class").isin("content", "timeout", "http_error") | (F.col("attempt") == MAX_ATTEMPTS)
    w = Window.partitionBy("url").orderBy((~ends).asc(), F.when(ends, F.col("attempt")).otherwise(-F.col("attempt")))
    first = tried.withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
    hit = F.col("class") == "content"
    return first.select(
        "url", "attempt", F.when(hit, F.col("body")).alias("content"), F.when(~hit, F.col("class")).alias("miss")
    )
