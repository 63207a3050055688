"""Result pages (HTML) to hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.binding import with_rules
from ..functions.text import challenge_kind, decode_entities, strip_tags

# Markers of one result and the fields inside it.
_BLOCK, _END = "<!--rs-->", "<!--re-->"
_LINK = r"(?is)<h2>\s*<a[^>]*href=\"([^\"]+)\"[^>]*>(.*?)</a>"
_SNIPPET = r"(?is)<p class=\"s\">(.*?)</p>"


def serp_hits(pages: DataFrame, html: str, *carry: str) -> DataFrame:
    """One row per http(s) hit of each page, in page order. The whole page is read."""
    blocks = F.slice(F.split(F.col(html), _BLOCK), 2, 1 << 30)
    rows = pages.select(*carry, F.posexplode(blocks).alias("pos", "block"))
    body: Column = F.element_at(F.split("block", _END), 1)
    rows = rows.select(*carry, "pos", body.alias("b")).withColumn("url", decode_entities(F.regexp_extract("b", _LINK, 1)))
    rows = rows.where(F.col("url").rlike(r"(?i)^https?://"))
    parts = rows.withColumns({"_title": F.regexp_extract("b", _LINK, 2), "_snippet": F.regexp_extract("b", _SNIPPET, 1)})
    clean = with_rules(parts, _plain=lambda: strip_tags(F.col("_title")), snippet=lambda: strip_tags(F.col("_snippet")))
    title = F.when(F.col("_plain") == "", F.col("url")).otherwise(F.col("_plain"))
    return clean.select(*carry, "pos", "url", title.alias("title"), "snippet")


def page_challenges(pages: DataFrame, html: str, *carry: str) -> DataFrame:
    return pages.select(*carry, F.coalesce(challenge_kind(F.col(html)), F.lit("ok")).alias("challenge"))
