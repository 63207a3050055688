"""Raw provider responses to sources: one job, one layout row per provider.

A layout is a row of a table: where a provider keeps its results, how their
fields map, and which rules apply. Bodies are parsed once, as VARIANT, and read
at the paths of the layout that they are joined with, so a new provider is a new
row and responses of all providers are read in one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import dates as D
from ..functions.binding import let
from ..functions.text import clean_markdown, clip, title_key
from ..functions.urls import host

#: ``path``, ``metadata`` and ``news`` are paths in a response (the second in a result), the other fields names in a result.
#: ``dates``: native date fields in order. ``content``: a rule of ``_text``. ``slice_first``: cut to the wanted number before
#: results without a URL go. ``must_return``: a response without results is the provider failing.
LAYOUT = ("provider string, path string, url string, snippet string, dates array<string>, content string, text string, "
          "slice_first boolean, metadata string, news string, must_return boolean")

# Response layouts of the providers.
LAYOUTS = [
    ("brave", "web.results", "url", "description", ["page_age", "age"], "excerpts", "extra_snippets", False, None, None, False),
    ("exa", "results", "url", None, ["publishedDate"], "markdown", "text", False, None, None, False),
    ("firecrawl", "data.web", "url", "description", [], "markdown", "markdown", True, "metadata", "data.news", False),
    ("parallel", "results", "url", None, ["publish_date"], "joined", "excerpts", False, None, None, False),
    ("perplexity", "results", "url", None, ["date", "last_updated"], "long_text", "snippet", False, None, None, False),
    ("serper", "organic", "link", "snippet", ["date"], "none", None, False, None, None, True),
    ("tavily", "results", "url", "content", [], "markdown", "raw_content", False, None, None, False),
    ("bright_data", "organic", "link", "description", ["last_modified_date"], "fetched", None, True, None, None, False),
]
MIN_CONTENT = 40
SNIPPET_CHARS = 300


def layouts(spark: SparkSession, *more: tuple) -> DataFrame:
    """The layout table, with rows of further providers."""
    return spark.createDataFrame([*LAYOUTS, *more], LAYOUT)


def at(v: Column, path: Column, kind: str) -> Column:
    """Value at a path of names with dots between; null where it is absent or of another kind."""
    return F.try_variant_get(v, F.concat(F.lit("$."), path), kind)


def _results(v: Column) -> Column:
    return F.coalesce(at(v, F.col("path"), "array<variant>"), F.expr("cast(array() as array<variant>)"))


def _has_url(r: Column) -> Column:
    return F.coalesce(at(r, F.col("url_field"), "string"), F.lit("")) != ""


def _text(given: Column, text: Column, parts: Column) -> Column:
    """What the layout's rule takes as the text of a result, before it is cleaned; null if there is none."""
    rule, some = F.col("rule"), F.coalesce(F.size(parts), F.lit(0)) > 0
    excerpts = F.filter(F.concat(F.array(given), parts), lambda p: F.coalesce(p, F.lit("")) != "")
    return (
        F.when(rule == "markdown", F.nullif(text, F.lit("")))
        .when((rule == "excerpts") & some, F.array_join(excerpts, "\n\n"))
        .when((rule == "joined") & some, F.array_join(parts, "\n\n"))
        .when((rule == "long_text") & (F.length(text) > MIN_CONTENT), text)
    )


def last_contents(contents: DataFrame) -> DataFrame:
    """(page, fetched): the text that was fetched last for each URL, of rows (url, seq, content); of equal seq the greatest."""
    last = contents.where("url is not null and seq is not null").groupBy("url").agg(F.max(F.struct("seq", "content")).alias("last"))
    return last.select(F.col("url").alias("page"), F.col("last.content").alias("fetched"))


def normalize(responses: DataFrame, layout: DataFrame, now: Column, contents: DataFrame | None = None) -> DataFrame:
    """Landed responses of any providers to one row per source, in result order.

    ``responses`` carries provider, query_id, seq, body, num_sources and
    extraction. ``contents`` (url, seq, content) supplies page texts fetched
    separately for layouts whose rule says so; with it, finished rows are dealt
    by URL, so callers that know which responses need it pass only those. News
    dates are matched by title inside the same response, the last one winning.
    ``sent`` is false where the response left out the field that the snippet
    comes from.
    """
    layout = layout.withColumnsRenamed({"url": "url_field", "snippet": "snippet_field", "content": "rule", "text": "text_field"})
    rows = responses.join(F.broadcast(layout), "provider")
    rows = rows.withColumn("_v", F.try_parse_json("body"))
    results, n = _results(F.col("_v")), F.col("num_sources")
    picked = F.when(F.col("slice_first"), F.filter(F.slice(results, F.lit(1), n), _has_url)).otherwise(F.slice(F.filter(results, _has_url), F.lit(1), n))
    dated = F.transform(at(F.col("_v"), F.col("news"), "array<variant>"), lambda x: F.struct(
        title_key(at(x, F.lit("title"), "string")).alias("k"), D.parse_published(at(x, F.lit("date"), "string"), now).alias("d")))
    rows = rows.withColumn("_news", dated).withColumn("_picked", picked).drop("_v", "body")
    keep = ["provider", "query_id", "seq", "extraction", "rule", "snippet_field", "text_field", "url_field", "dates", "metadata", "_news"]
    # Outer, as a filter on the size of the results would parse each body once more.
    rows = rows.select(*keep, F.posexplode_outer("_picked").alias("pos", "r")).where("pos is not null")
    r = F.col("r")
    rows = rows.withColumns({
        "url": at(r, F.col("url_field"), "string"), "_title": at(r, F.lit("title"), "string"),
        "_given": at(r, F.col("snippet_field"), "string"),
        "_text": at(r, F.col("text_field"), "string"), "_parts": at(r, F.col("text_field"), "array<string>"),
    })
    given, clean, fetches, described = F.coalesce("_given", F.lit("")), F.col("extraction") == "clean", F.col("rule") == "fetched", F.col("snippet_field").isNotNull()
    rows = rows.withColumn("_clean", clean_markdown(_text(given, F.col("_text"), F.col("_parts"))))

    def rung(name, date: Column) -> Column:
        named = F.lit(name) if isinstance(name, str) else name
        return let(date, lambda d: F.when(d.isNotNull(), F.struct(d.alias("published"), named.alias("dated_by"))))

    key = title_key(F.col("_title"))
    hits = F.filter("_news", lambda x: (x["k"] == key) & (key != "") & x["d"].isNotNull())
    native = F.filter(F.transform("dates", lambda f: rung(f, D.parse_published(at(r, f, "string"), now))), lambda x: x.isNotNull())
    # Excerpts and long texts come whether or not they were asked for, so a raw call has them as its snippet only.
    raw_only = F.col("rule").isin("joined", "long_text") & ~clean
    unasked = F.when(F.col("rule") == "joined", F.col("_clean")).when(F.col("rule") == "long_text", F.col("_text"))

    def with_snippet(df: DataFrame, content: Column, *instead: Column) -> DataFrame:
        own = F.coalesce(F.when(F.coalesce("content", F.lit("")) != "", clip(F.col("content"), SNIPPET_CHARS)), *instead, F.lit(""))
        return df.withColumn("content", content).withColumn("snippet", F.when(described, given).otherwise(own))

    # All that needs the result itself or its whole text, before rows are dealt by URL.
    rows = with_snippet(rows, F.when(~fetches & ~raw_only, F.col("_clean")), unasked)
    # A rung is only tried where those before it give no date.
    rows = rows.select(
        "query_id", "provider", "seq", "pos", "extraction", "rule", "snippet_field", "_given", "url", "_title", "content", "snippet",
        F.when(described, F.col("_given").isNotNull()).when(F.col("rule") == "long_text", F.col("_text").isNotNull()).otherwise(True).alias("sent"),
        F.coalesce(
            rung("metadata", D.date_from_metadata(at(r, F.col("metadata"), "map<string,string>"), now)), rung("news", F.try_element_at(hits, F.lit(-1))["d"]),
            F.try_element_at(native, F.lit(1))).alias("_stated"))
    if contents is not None:
        rows = rows.join(last_contents(contents), fetches & (F.col("url") == F.col("page")), "left")
        rows = with_snippet(rows, F.when(fetches, F.when(clean, F.col("fetched"))).otherwise(F.col("content")), F.when(~fetches, F.col("snippet")))
    first = F.coalesce(
        "_stated", rung("snippet", D.date_from_snippet(F.col("snippet"), now)), rung("content", D.date_from_content(F.col("content"), now)),
        rung("url", D.date_from_url(F.col("url"), now)), F.struct(F.lit(None).cast("date").alias("published"), F.lit("none").alias("dated_by")))
    return rows.withColumn("_dated", first).select(
        "query_id", "provider", "seq", "pos",
        F.coalesce("_title", "url").alias("title"), "url", F.col("_dated.published").cast("string").alias("published"),
        "_dated.dated_by", host(F.col("url")).alias("domain"), "snippet", "content", "sent",
    )


def empty_responses(responses: DataFrame, layout: DataFrame) -> DataFrame:
    """Responses that must hold results and do not: the provider failing behind a 200."""
    rows = responses.join(layout.where("must_return").select("provider", "path", F.col("url").alias("url_field")), "provider")
    return rows.where(F.size(F.filter(_results(F.try_parse_json("body")), _has_url)) == 0).select("query_id", "seq", "provider")
