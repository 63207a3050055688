"""Request texts built from rows. System prompts belong to the caller.

The wording below is fixed: every judge must be sent the same text.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import clip
from .urls import body_text

PAGE_EXCERPT = 1600
RETRIEVAL_EXCERPT = 500
NO_CONTENT = "(no content extracted)"
RESERVED_TOKENS = 1024


def _or(text: Column, fallback: str) -> Column:
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(fallback)).otherwise(text)


def _numbered(sources: Column, line) -> Column:
    return F.transform(
        sources, lambda s, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), line(s))
    )


def _dated_title(s: Column) -> Column:
    dated = F.when(F.coalesce(s["published"], F.lit("")) != "", F.concat(F.lit(" — "), s["published"]))
    return F.concat(s["title"], F.lit(" ("), s["domain"], F.lit(")"), F.coalesce(dated, F.lit("")))


def context(sources: Column) -> Column:
    return F.array_join(
        _numbered(
            sources,
            lambda s: F.concat(s["title"], F.lit(" ("), s["domain"], F.lit(")\n"), body_text(s)),
        ),
        "\n\n",
    )


def page_request(query: Column, title: Column, domain: Column, published: Column, content: Column) -> Column:
    return F.concat(
        F.lit("Question: "), query,
        F.lit("\n\nPage: "), title,
        F.lit("\nDomain: "), domain,
        F.lit("\nPublished: "), F.coalesce(published, F.lit("unknown date")),
        F.lit("\n\nContent:\n"), _or(clip(content, PAGE_EXCERPT), NO_CONTENT),
    )


def render_set(sources: Column) -> Column:
    """A returned set as the judge reads it: the provider is never named."""
    return _or(
        F.array_join(
            _numbered(
                sources,
                lambda s: F.concat(
                    _dated_title(s), F.lit("\n"), _or(clip(body_text(s), PAGE_EXCERPT), NO_CONTENT)
                ),
            ),
            "\n\n",
        ),
        "(no sources retrieved)",
    )


def set_request(query: Column, sources: Column) -> Column:
    return F.concat(
        F.lit("Query: "), query,
        F.lit("\n\nFetched sources (title, domain — date, then extracted content):\n"),
        render_set(sources),
    )


def retrieval_request(query: Column, sources: Column) -> Column:
    body = F.array_join(
        _numbered(
            sources,
            lambda s: F.concat(
                s["domain"], F.lit(" — "), F.coalesce(s["published"], F.lit("unknown date")), F.lit("\n"),
                _or(clip(body_text(s), RETRIEVAL_EXCERPT), NO_CONTENT),
            ),
        ),
        "\n\n",
    )
    return F.concat(
        F.lit("Query: "), query,
        F.lit("\n\nFetched sources (domain — date, then extracted content):\n"),
        _or(body, "(no sources retrieved)"),
    )


def answer_request(query: Column, answer: Column, sources: Column) -> Column:
    listed = F.array_join(_numbered(sources, _dated_title), "\n")
    return F.concat(
        F.lit("Query: "), query, F.lit("\n\nAnswer:\n"), answer,
        F.lit("\n\nSources it used:\n"), _or(listed, "(none)"),
    )


def estimate_tokens(*messages: Column) -> Column:
    chars = F.lit(0)
    for m in messages:
        chars = chars + F.length(F.coalesce(m, F.lit("")))
    return (F.ceil(chars / F.lit(4.0)) + RESERVED_TOKENS).cast("bigint")
