"""From returned sources to pooled question-and-page pairs."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.binding import with_rules
from ..functions.errors import failed
from ..functions.urls import body_text, host, normalize_url, trim_ws
from ..session import staged


def explode_sources(fetches: DataFrame, *carry: str) -> DataFrame:
    """One row per returned source: log position, place in the set, source fields."""
    return fetches.select(
        "query_id", "provider", "seq", *carry, F.posexplode("sources").alias("pos", "source")
    ).select("query_id", "provider", "seq", "pos", *carry, "source.*")


def normalized(rows: DataFrame) -> DataFrame:
    """Rows under the normalised form of their ``url``."""
    return with_rules(rows, url=lambda: normalize_url(F.col("url")))


def canonical_pages(sources: DataFrame) -> DataFrame:
    """Normalised URL, domain and body of each source; sources without a URL go."""
    # A blank URL is the only one that normalises to nothing; testing the raw one keeps the rule out of the filter.
    named = sources.where(trim_ws(F.col("url")) != "").withColumn("raw_url", F.col("url"))
    return with_rules(
        named, url=lambda: normalize_url(F.col("raw_url")), host=lambda: host(F.col("raw_url")),
        body=lambda: body_text(F.struct("content", "snippet")),
    )


def returned_pages(sources: DataFrame) -> DataFrame:
    """Distinct pages each provider returned for a question, with their first place."""
    return (
        canonical_pages(sources)
        .groupBy("query_id", "provider", "url")
        .agg(F.min(F.struct("seq", "pos")).alias("_at"))
        .select("query_id", "provider", "url", "_at.seq", "_at.pos")
    )


#: A place in the log as one number: the fetch's position, then nine digits for the place in its set.
PLACES = 10**9
#: More than any place; a length times this sorts before all places.
TOP = Decimal(10**28)


def place(seq: Column, pos: Column) -> Column:
    return (seq.cast("decimal(19,0)") * F.lit(PLACES).cast("decimal(10,0)") + pos).cast("decimal(28,0)")


def pool_winners(pages: DataFrame) -> DataFrame:
    """One row per question and page: places of its first row, of its longest text (the earlier on equal length) and of its first date, and providers in first-seen order.

    Only places and lengths are aggregated, as numbers, so both aggregates are by
    hash and a map task sends one narrow row per page and provider.
    """
    at = place(F.col("seq"), F.col("pos"))
    longest = (F.length("body").cast("decimal(10,0)") * F.lit(TOP) - at).cast("decimal(38,0)")
    per_provider = pages.groupBy("query_id", "url", "provider").agg(
        F.min(at).alias("at"), F.max(longest).alias("longest"), F.min(F.when(F.col("published") != "", at)).alias("dated"))
    found = per_provider.groupBy("query_id", "url").agg(
        F.min("at").alias("first"), F.max("longest").alias("longest"), F.min("dated").alias("dated"),
        # at most one entry per configured provider
        F.array_sort(F.collect_list(F.struct("at", "provider"))).alias("by"),
    )
    chars = F.ceil(F.col("longest") / F.lit(TOP)).cast("decimal(10,0)")
    text_at = (chars * F.lit(TOP) - F.col("longest")).cast("decimal(28,0)")
    return found.select("query_id", "url", "first", text_at.alias("text"), "dated", F.col("by.provider").alias("returned_by"))


def build_pool(sources: DataFrame) -> DataFrame:
    """One row per question and page.

    First-seen title, domain and query; the longest text and whose it is (the
    earlier on equal length); the first known date; providers in first-seen
    order. Winners are chosen and named on narrow rows and written, so that their
    size is known when the texts are fetched by place, one row per page: where
    they are small no text is shuffled, else each crosses one shuffle.
    """
    won = pool_winners(canonical_pages(sources))
    at = place(F.col("seq"), F.col("pos"))
    names = sources.select(at.alias("first"), "query", "title", "domain")
    dates = sources.select(at.alias("dated"), "published")
    texts = sources.select(at.alias("text"), body_text(F.struct("content", "snippet")).alias("content"), F.col("provider").alias("content_from"))
    named = staged(won.join(names, "first").join(dates, "dated", "left"), "pool-winners")
    return named.join(texts, "text").select("query_id", "url", "query", "title", "domain", "published", "returned_by", "content", "content_from")


def pool_from_fetches(fetches: DataFrame) -> DataFrame:
    return build_pool(explode_sources(fetches.where(~failed(F.col("error"))), "query"))


def judged_from(sources: DataFrame) -> DataFrame:
    """Whose extracted text stood for a page: raw URL, content only, longest, first on ties."""
    chars = F.length(F.coalesce("content", F.lit("")))
    return (
        sources.groupBy("query_id", F.col("url"))
        .agg(F.max(F.struct(chars.alias("chars"), (-F.col("seq")).alias("s"), (-F.col("pos")).alias("p"), "provider")).alias("w"))
        .select("query_id", "url", F.col("w.chars").alias("judged_chars"), F.col("w.provider").alias("judged_from"))
    )


def overlap(pages: DataFrame, url: str, n_providers: int) -> DataFrame:
    """Histogram of how many providers returned a page, every count 1..N present.

    Rows of the input are deduplicated per provider before pages are counted,
    so a page returned many times costs one row per provider.
    """
    per_page = (
        pages.select("query_id", F.col(url).alias("url"), "provider").distinct()
        .groupBy("query_id", "url").agg(F.count(F.lit(1)).alias("k"))
    )
    hist = per_page.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    spine = pages.sparkSession.range(1, n_providers + 1).select(F.col("id").alias("k"))
    return spine.join(hist, "k", "left").select("k", F.coalesce("n", F.lit(0)).alias("n_pages"))


def overlap_shares(histogram: DataFrame, n_providers: int) -> DataFrame:
    n, k = F.col("n_pages"), F.col("k")
    total = F.sum(n)
    one = F.sum(F.when(k == 1, n).otherwise(0))
    return histogram.agg(
        total.alias("n_pages"),
        one.alias("from_one_provider"),
        (F.try_divide(one.cast("double"), total.cast("double")) * 100).alias("from_one_provider_pct"),
        F.sum(F.when(k >= 2, n).otherwise(0)).alias("from_two_or_more"),
        F.sum(F.when(k == n_providers, n).otherwise(0)).alias("from_all_providers"),
    )
