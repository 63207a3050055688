"""Every number a page states must be traceable to a data value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.stats import half_up
# What a number in running text looks like.
NUMBER = r"\d[\d,]*(?:\.\d+)?"


def audit_text(html: Column, not_numbers: tuple[str, ...] = ()) -> Column:
    """Running text of a page: no charts, styles, comments, tags or entities, nor what ``not_numbers`` matches (names with digits)."""
    t = F.regexp_replace(html, r"(?s)<svg.*?</svg>", " ")
    t = F.regexp_replace(t, r"(?s)<style.*?</style>", " ")
    t = F.regexp_replace(t, r"(?s)<!--.*?-->", " ")
    t = F.regexp_replace(t, r"<[a-zA-Z/][^>]*>", " ")
    for pattern in not_numbers:
        t = F.regexp_replace(t, pattern, " ")
    t = F.regexp_replace(t, r"&#x?[0-9a-fA-F]+;", " ")
    return F.regexp_replace(t, r"&[a-z]+;", " ")


def stated_numbers(pages: DataFrame, key: str, html: str, not_numbers: tuple[str, ...] = ()) -> DataFrame:
    """Distinct numbers each page's text states."""
    found = F.regexp_extract_all(audit_text(F.col(html), not_numbers), F.lit(NUMBER), F.lit(0))
    return (
        pages.select(key, F.explode(F.array_distinct(found)).alias("raw"))
        .select(key, F.regexp_replace("raw", "[.,]$", "").alias("number")).distinct()
    )


def _fixed(n: Column, places: int) -> Column:
    """Plain decimals, halves away from zero."""
    return F.regexp_replace(F.format_number(F.round(n, places), places), ",", "")


def renderings(values: DataFrame, col: str = "n") -> DataFrame:
    """Every text form a stored number may take on a page, distinct."""
    n = F.col(col)
    four = _fixed(n, 4)
    exact = n.cast("double").cast("string")
    exact = F.when(exact.contains("E"), F.regexp_replace(n.cast("decimal(38,18)").cast("string"), r"(\.\d*?)0+$", "$1")).otherwise(exact)
    exact = F.regexp_replace(exact, r"\.0?$", "")
    plain = F.regexp_replace(F.regexp_replace(four, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    grouped = F.regexp_replace(F.regexp_replace(F.format_number(n, 3), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    forms = [
        exact, plain, *[_fixed(n, d) for d in range(5)], half_up(n).cast("bigint").cast("string"),
        F.regexp_replace(plain, "^-", ""), grouped, F.format_number(half_up(n).cast("bigint"), 0),
        _fixed(n * 100, 0), _fixed(n * 100, 1), _fixed(n / 100, 3),
    ]
    return values.where(n.isNotNull()).select(F.explode(F.array_distinct(F.array(*forms))).alias("form")).distinct()


def text_numbers(values: DataFrame, col: str) -> DataFrame:
    """Numbers quoted inside stored strings count as known too."""
    found = F.regexp_extract_all(F.col(col), F.lit(r"\d[\d,.]*"), F.lit(0))
    return values.select(F.explode(found).alias("raw")).select(F.regexp_replace("raw", "[.,]$", "").alias("form")).distinct()


def ratio_forms(providers: DataFrame, key: str, col: str, declared: list[str]) -> DataFrame:
    """Rounded ratio of every ordered pair of the declared providers; a row holds its own ratios only."""
    rows = providers.where(F.col(key).isin(*declared) & (F.col(col) > 0)).select(F.col(col).cast("double").alias("x"))
    rows = rows.withColumn("others", rows.agg(F.collect_set("x")).scalar())
    ratios = F.transform("others", lambda b: half_up(F.col("x") / b).cast("bigint").cast("string"))
    return rows.select(F.explode(ratios).alias("form")).distinct()


def share_forms(parts: DataFrame, part: str, whole: str) -> DataFrame:
    """Rounded percentage of one stored number in another."""
    pct = half_up(F.try_divide(F.col(part).cast("double"), F.col(whole)) * 100).cast("bigint").cast("string")
    return parts.select(pct.alias("form")).where("form is not null").distinct()


def second_forms(latency: DataFrame, *cols: str) -> DataFrame:
    """Durations stored in ms are printed in seconds with none or one decimal."""
    forms = F.array(*[_fixed(F.col(c) / 1000, d) for c in cols for d in (0, 1)])
    return latency.select(F.explode(forms).alias("form")).distinct()


def orphans(stated: DataFrame, known: DataFrame, allowed: list[str]) -> DataFrame:
    """Stated numbers that no known form backs, commas or not."""
    bare = stated.withColumn("bare", F.regexp_replace("number", ",", ""))
    known_n = known.select(F.col("form").alias("number")).distinct()
    left = bare.where(~F.col("number").isin(*allowed)) if allowed else bare
    left = left.join(known_n, "number", "left_anti")
    return left.join(known_n.withColumnRenamed("number", "bare"), "bare", "left_anti").drop("bare")


def table_faults(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Body rows whose cell count differs from their table's header count."""
    tables = pages.select(key, F.explode(F.regexp_extract_all(F.col(html), F.lit(r"(?s)<table>(.*?)</table>"), F.lit(1))).alias("t"))
    head = F.regexp_extract("t", r"(?s)<thead>.*?<tr>(.*?)</tr>.*?</thead>", 1)
    body = F.regexp_extract("t", r"(?s)<tbody>(.*?)</tbody>", 1)
    rows = tables.where(F.col("t").rlike(r"(?s)<thead>.*?<tr>.*?</tr>.*?</thead>") & F.col("t").rlike(r"(?s)<tbody>.*?</tbody>")).select(
        key, F.regexp_count(head, F.lit(r"<th\b")).alias("n_cols"),
        F.explode(F.regexp_extract_all(body, F.lit(r"(?s)<tr>(.*?)</tr>"), F.lit(1))).alias("row"),
    )
    name = F.regexp_extract("row", r"<th[^>]*>([^<]*)<", 1)
    return rows.withColumn("n_cells", F.regexp_count("row", F.lit(r"<t[hd]\b"))).where("n_cells <> n_cols").select(
        key, F.when(F.col("row").rlike(r"<th[^>]*>[^<]*<"), name).otherwise("?").alias("row_name"), "n_cells", "n_cols"
    ).distinct()


def shared_verbatim(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    """Texts present in both sets; must be empty between question sets."""
    return a.select(col).intersect(b.select(col))
