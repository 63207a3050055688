"""Publication dates from the many shapes they arrive in.

Every rule takes the run's ``now`` as a parameter and yields a DATE or null.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .binding import inline, let
from .urls import WS, trim_ws

# Seconds per unit of a relative phrase (30-day month, 365-day year).
UNIT_SECONDS = {"hour": 3600, "day": 86400, "week": 604800, "month": 2592000, "year": 31536000}
# Month keys by first three letters.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
# Metadata keys, published ones ahead of modified ones.
META_KEYS = [
    "article:published_time",
    "og:published_time",
    "publishedtime",
    "datepublished",
    "date",
    "article:modified_time",
    "og:updated_time",
    "modifiedtime",
    "datemodified",
]
# How a relative phrase, a written-out date and a dated path read.
_RELATIVE = rf"^(\d+){WS}*(hour|day|week|month|year)s?{WS}+ago"
_WORDY = rf"([A-Za-z]{{3,9}})\.?{WS}+(\d{{1,2}}),?{WS}+(\d{{4}})"
_IN_PATH = r"/(20\d{2})/(\d{1,2})(?:/(\d{1,2}))?/"
# Where a page states its own date, in order of trust.
_HTML_PATTERNS = [
    r"""(?i)<meta[^>]+property=["']article:published_time["'][^>]+content=["']([^"']+)["']""",
    r"""(?i)<meta[^>]+name=["'](?:date|pubdate|publish-date|dc\.date)["'][^>]+content=["']([^"']+)["']""",
    r"""(?i)"datePublished"\s*:\s*"([^"]+)\"""",
    r"""(?i)<time[^>]+datetime=["']([^"']+)["']""",
]


def _match(s: Column, pattern: str) -> Column:
    """What a pattern finds, null for nothing: its groups are then read off this short text, and casts of an empty one never fail."""
    return F.nullif(F.regexp_extract(s, pattern, 0), F.lit(""))


def _first_in_window(now: Column, *instants: Column) -> Column:
    """First instant from the year 2000 up to a day past now, as a DATE."""
    start, end = F.lit("2000-01-01").cast("timestamp"), now + F.expr("interval 1 day")
    return F.to_date(F.try_element_at(F.filter(F.array(*instants), lambda t: t.between(start, end)), F.lit(1)))


def _rolled(year: Column, month: Column, day: Column) -> Column:
    """First of the year plus months plus days, so month 13 or day 31 roll over."""
    first = F.make_date(year, F.lit(1), F.lit(1))
    return F.date_add(F.add_months(first, month - 1), day - 1).cast("timestamp")


def _relative(s: Column, now: Column) -> Column:
    def instant(t: Column) -> Column:
        def before(phrase: Column) -> Column:
            n = F.regexp_extract(phrase, _RELATIVE, 1).try_cast("bigint")
            units = F.create_map(*[x for k, secs in UNIT_SECONDS.items() for x in (F.lit(k), F.lit(secs))])
            secs = F.try_element_at(units, F.regexp_extract(phrase, _RELATIVE, 2))
            ago = F.try_multiply(n, secs)
            now_s = F.unix_timestamp(now)
            return F.timestamp_seconds(F.when(ago <= now_s, now_s - ago))

        return (
            F.when(t.rlike(r"^today\b"), now)
            .when(t.rlike(r"^yesterday\b"), now - F.expr("interval 1 day"))
            .otherwise(let(_match(t, _RELATIVE), before))
        )

    return let(trim_ws(F.lower(s)), instant)


def _wordy(s: Column) -> Column:
    def dated(found: Column) -> Column:
        key = F.lower(F.substring(F.regexp_extract(found, _WORDY, 1), 1, 3))
        month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), key).cast("int")
        day = F.regexp_extract(found, _WORDY, 2).try_cast("int")
        year = F.regexp_extract(found, _WORDY, 3).try_cast("int")
        return F.when((month > 0) & (year >= 1999), _rolled(year, month, day))

    return let(_match(s, _WORDY), dated)


def relative_date(s: Column, now: Column) -> Column:
    return _first_in_window(now, _relative(s, now))


def wordy_date(s: Column, now: Column) -> Column:
    return _first_in_window(now, _wordy(s))


def parse_published(raw: Column, now: Column) -> Column:
    """ISO dates as they stand; otherwise a relative phrase, else a written-out date."""
    def parse(s: Column) -> Column:
        iso = s.rlike(r"^\d{4}-\d{2}-\d{2}")
        return _first_in_window(
            now, F.when(iso, s.try_cast("timestamp")), F.when(~iso, _relative(s, now)), F.when(~iso, _wordy(s))
        )

    return let(trim_ws(raw), parse)


def _from_head(text: Column, chars: int, now: Column) -> Column:
    return let(F.substring(text, 1, chars), lambda head: _first_in_window(now, _relative(head, now), _wordy(head)))


def date_from_snippet(snippet: Column, now: Column) -> Column:
    return _from_head(snippet, 40, now)


def date_from_content(content: Column, now: Column) -> Column:
    return _from_head(content, 400, now)


def date_from_url(url: Column, now: Column) -> Column:
    def dated(path: Column) -> Column:
        year = F.regexp_extract(path, _IN_PATH, 1).try_cast("int")
        month = F.regexp_extract(path, _IN_PATH, 2).try_cast("int")
        day = F.coalesce(F.nullif(F.regexp_extract(path, _IN_PATH, 3), F.lit("")).try_cast("int"), F.lit(1))
        return _first_in_window(now, F.when(year.isNotNull(), _rolled(year, month, day)))

    return let(_match(url, _IN_PATH), dated)


def date_from_metadata(meta: Column, now: Column) -> Column:
    """Keys match in any case; a later duplicate of a key replaces an earlier one."""
    entries = F.map_entries(meta)
    found = F.transform(
        F.array(*[F.lit(k) for k in META_KEYS]),
        lambda k: F.try_element_at(F.filter(entries, lambda e: F.lower(e["key"]) == k), F.lit(-1))["value"],
    )
    with inline():
        dated = F.transform(F.filter(found, lambda x: x.isNotNull()), lambda x: parse_published(x, now))
    return F.try_element_at(F.filter(dated, lambda d: d.isNotNull()), F.lit(1))


def date_from_html(html: Column, now: Column) -> Column:
    return F.coalesce(*[parse_published(F.regexp_extract(html, p, 1), now) for p in _HTML_PATTERNS])


def date_ladder(*rungs: tuple[str, Column]) -> Column:
    """STRUCT<published, dated_by> of the first dated rung; 'none' when there is none."""
    tried = F.array(*[F.struct(d.alias("published"), F.lit(n).alias("dated_by")) for n, d in rungs])
    first = F.try_element_at(F.filter(tried, lambda r: r["published"].isNotNull()), F.lit(1))
    empty = F.struct(F.lit(None).cast("date").alias("published"), F.lit("none").alias("dated_by"))
    return F.coalesce(first, empty)


def age_days(published: Column, now: Column) -> Column:
    """Whole days between a date and now, halves up; null when undated."""
    ms = F.unix_millis(now) - F.unix_millis(published.try_cast("timestamp"))
    return F.floor(ms / F.lit(86400000.0) + F.lit(0.5))
