"""Table jobs over returned pages: dates with coverage, cleaned text with flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import dates as D
from ..functions import text as T
from ..functions.binding import with_rules


def date_pages(pages: DataFrame, now: Column, native: str | None = "native") -> DataFrame:
    """Publication date of each page, which rung gave it, and its age in days."""
    def ladder() -> Column:
        rungs = [("native", D.parse_published(F.col(native), now))] if native else []
        return D.date_ladder(
            *rungs, ("snippet", D.date_from_snippet(F.col("snippet"), now)),
            ("content", D.date_from_content(F.col("content"), now)), ("url", D.date_from_url(F.col("url"), now)),
        )

    dated = with_rules(pages, _d=ladder).select("*", "_d.published", "_d.dated_by").drop("_d")
    return dated.withColumn("age_days", D.age_days(F.col("published"), now))


def date_coverage(dated: DataFrame, by: str = "provider") -> DataFrame:
    return dated.groupBy(by, "dated_by").agg(F.count(F.lit(1)).alias("n"))


def clean_pages(pages: DataFrame, html: str, key: str) -> DataFrame:
    """Plain text of raw HTML pages, cleaned, with length, flags and challenge class."""
    raw = pages.select(key, F.col(html).alias("_html"))
    text = with_rules(
        raw, text=lambda: T.clean_markdown(T.strip_tags(F.col("_html"))),
        challenge=lambda: F.coalesce(T.challenge_kind(F.col("_html")), F.lit("ok")),
    )
    t = F.col("text")
    return text.select(
        key, "text", F.length(t).alias("n_chars"), T.was_truncated(t).alias("truncated"),
        T.has_headings(t).alias("headings"), T.has_links(t).alias("links"), "challenge",
    )
