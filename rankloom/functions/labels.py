"""Display rules: labels, bands and steps over summary tables."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .stats import half_up

# Labs a model reference may name before its first slash.
LABS = ["openai", "fireworks", "groq", "anthropic"]
DEFAULT_LAB = "openai"
BATCH_LABS = ["openai", "anthropic"]
# The order providers are listed in; any other comes last.
PROVIDER_ORDER = [
    "bright_data", "firecrawl", "tavily", "exa", "brave", "serper", "perplexity", "parallel", "plain",
]
# The six question types in their listing order.
TYPE_ORDER = ["breaking_news", "how_to", "product_lookup", "local_geo", "recent_release", "numeric_live"]
# Freshness setting to look-back days and to the search-window code.
FRESHNESS_DAYS = {"24h": 1, "30d": 30, "1y": 365}
FRESHNESS_CODE = {"24h": "qdr:d", "30d": "qdr:m", "1y": "qdr:y", "all": ""}


def judge_label(ref: Column) -> Column:
    last = F.element_at(F.split(ref, "/"), -1)
    return F.when(last == "", ref).otherwise(last)


def model_lab(ref: Column) -> Column:
    prefix = F.element_at(F.split(ref, "/", 2), 1)
    return F.when(ref.contains("/") & prefix.isin(LABS), prefix).otherwise(F.lit(DEFAULT_LAB))


def model_name(ref: Column) -> Column:
    parts = F.split(ref, "/", 2)
    known = ref.contains("/") & F.element_at(parts, 1).isin(LABS)
    return F.when(known, F.try_element_at(parts, F.lit(2))).otherwise(ref)


def _age_text(days: Column, suffix: str) -> Column:
    months = half_up(days / F.lit(30.0)).cast("bigint")
    return F.when(days < 60, F.concat(days.cast("bigint").cast("string"), F.lit("d" + suffix))).otherwise(
        F.concat(months.cast("string"), F.lit("mo" + suffix))
    )


def age_label(days: Column) -> Column:
    return (
        F.when(days.isNull(), "undated").when(days < 1, "today").otherwise(_age_text(days, " ago"))
    )


def median_label(days: Column) -> Column:
    return F.when(days.isNull(), "—").otherwise(_age_text(days, ""))


def fresh_status(days: Column) -> Column:
    return (
        F.when(days.isNull(), "neutral")
        .when(days <= 30, "good")
        .when(days <= 180, "warning")
        .otherwise("critical")
    )


def finite(x: Column) -> Column:
    """The number itself when it is one and finite, else null."""
    d = x.try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < F.lit(float("inf"))), d)


def text_or_blank(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def score_step(score: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(10), half_up(F.coalesce(finite(score), F.lit(0.0))))).cast("int")


def order_of(value: Column, order: list[str]) -> Column:
    """Position in a fixed order, unknown values after all known ones."""
    pos = F.array_position(F.array(*[F.lit(v) for v in order]), value)
    return F.when(F.coalesce(pos, F.lit(0)) == 0, len(order)).otherwise(pos - 1).cast("int")


def freshness_code(freshness: Column) -> Column:
    code = F.lit(None).cast("string")
    for name, value in FRESHNESS_CODE.items():
        code = F.when(freshness == name, F.lit(value)).otherwise(code)
    return code


def window_start(freshness: Column, now: Column) -> Column:
    """Earliest instant a freshness setting admits; null admits everything."""
    out = F.lit(None).cast("timestamp")
    for name, days in FRESHNESS_DAYS.items():
        out = F.when(freshness == name, now - F.expr(f"interval {days} day")).otherwise(out)
    return out
