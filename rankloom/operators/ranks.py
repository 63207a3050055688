"""Exact order statistics without holding a group in one task, and sketches of them.

Equal values are counted before anything else. A rank is narrowed to it by
digits: the first is a bucket on a logarithmic scale, each further one cuts the
range of values that the digits before it left into 65,536 equal parts. A pass
counts the values of a key by their next digit and keeps the one that holds the
rank. What is ordered in one task is the digits of a pass, or in the end the
distinct values that share all digits; doubles being finite in number, both are
bounded whatever a key holds.

Whole numbers (milliseconds) need the first digit only: below 2^22 it leaves at
most 65,536 of them. Other values take two digits more, which leave some 2^14.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

Rank = Callable[[Column], Column]
#: Digits after the first, by kind of value, and the parts that each cuts a range into.
WHOLE, ANY = 0, 2
PARTS = 1 << 16


def nearest_rank(p: float) -> Rank:
    """ceil(p*n), at least the first."""
    return lambda n: F.greatest(F.lit(1), F.ceil(F.lit(p) * n)).cast("bigint")


def floor_rank(p: float) -> Rank:
    """Zero-based floor(p*n), at most the last."""
    return lambda n: F.least(n, F.floor(F.lit(p) * n) + 1).cast("bigint")


def lower_middle(n: Column) -> Column:
    return F.floor((n + 1) / 2).cast("bigint")


def upper_middle(n: Column) -> Column:
    return (F.floor(n / 2) + 1).cast("bigint")


def _bucket(v: Column) -> Column:
    """Non-decreasing in v, at most some 90 000 distinct values for any double."""
    return F.floor(F.signum(v) * F.log1p(F.abs(v)) * 64).cast("bigint")


def _part(v: Column, low: Column, high: Column) -> Column:
    """Non-decreasing in v from low to high, 0 to PARTS - 1."""
    return F.coalesce(F.floor((v - low) * F.try_divide(F.lit(PARTS - 1.0), high - low)), F.lit(0)).cast("bigint")


def _holding(sizes: DataFrame, within: list[str], digit: str, before: Column, n: Column, picks: dict[str, Rank]) -> DataFrame:
    """Rows of ``sizes`` (a digit and how many values have it) that hold a rank; ``_before`` values come before theirs."""
    upto = before + F.sum("_size").over(Window.partitionBy(*within).orderBy(digit))
    sizes = sizes.withColumn("_n", n).withColumn("_upto", upto).withColumn("_before", F.col("_upto") - F.col("_size"))
    wanted = F.lit(False)
    for rank in picks.values():
        r = rank(F.col("_n"))
        wanted = wanted | ((r > F.col("_before")) & (r <= F.col("_upto")))
    return sizes.where(wanted).drop("_size", "_upto")


def values_at(df: DataFrame, keys: list[str], value: str, picks: dict[str, Rank], digits: int | None = None) -> DataFrame:
    """One row per key: ``n`` and the value at each named rank. Keys must not be null; null and NaN values are left out."""
    if digits is None:
        digits = WHOLE if df.schema[value].dataType.typeName() in ("byte", "short", "integer", "long") else ANY
    v = F.col(value).cast("double")
    present = v.isNotNull() & ~F.isnan(v)
    for k in keys:
        present = present & F.col(k).isNotNull()
    # All uses below carry these filters already, so they share one shuffle.
    counts = df.where(present).groupBy(*keys, v.alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    counts = counts.withColumn("_d0", _bucket(F.col("_v"))).where(F.col("_d0").isNotNull())
    size = [F.sum("_c").alias("_size"), F.min("_v").alias("_low"), F.max("_v").alias("_high")]
    sizes = counts.groupBy(*keys, "_d0").agg(*size)
    kept = _holding(sizes, keys, "_d0", F.lit(0), F.sum("_size").over(Window.partitionBy(*keys)), picks)
    at = [*keys, "_d0"]
    rest = counts.join(kept, at)
    for i in range(1, digits + 1):
        rest = rest.withColumn(f"_d{i}", _part(F.col("_v"), F.col("_low"), F.col("_high"))).drop("_low", "_high")
        sizes = rest.groupBy(*at, f"_d{i}", F.col("_before").alias("_base"), F.col("_n").alias("_all")).agg(*size)
        kept = _holding(sizes, at, f"_d{i}", F.col("_base"), F.col("_all"), picks).drop("_base", "_all")
        at = [*at, f"_d{i}"]
        rest = rest.drop("_before", "_n").join(kept, at)
    placed = rest.withColumn("_hi", F.col("_before") + F.sum("_c").over(Window.partitionBy(*at).orderBy("_v")))
    placed = placed.withColumn("_lo", F.col("_hi") - F.col("_c"))
    out = []
    for name, rank in picks.items():
        r = rank(F.col("_n"))
        hit = (r > F.col("_lo")) & (r <= F.col("_hi"))
        out.append(F.max(F.when(hit, F.col("_v"))).alias(name))
    return placed.groupBy(*keys).agg(F.max("_n").alias("n"), *out)


def percentiles(df: DataFrame, keys: list[str], value: str, ps: dict[str, float]) -> DataFrame:
    """Nearest-rank percentiles; a key with no values has no row."""
    return values_at(df, keys, value, {name: nearest_rank(p) for name, p in ps.items()})


def floor_quantiles(df: DataFrame, keys: list[str], value: str, ps: dict[str, float]) -> DataFrame:
    return values_at(df, keys, value, {name: floor_rank(p) for name, p in ps.items()})


def medians(df: DataFrame, keys: list[str], value: str, rounded: bool, digits: int | None = None) -> DataFrame:
    """Middle value; for an even count the mean of the middle pair, rounded half up or not."""
    pair = values_at(df, keys, value, {"_lo_mid": lower_middle, "_hi_mid": upper_middle}, digits)
    mid = (F.col("_lo_mid") + F.col("_hi_mid")) / F.lit(2.0)
    if rounded:
        mid = F.when(F.col("n") % 2 == 1, F.col("_lo_mid")).otherwise(F.floor(mid + F.lit(0.5)).cast("double"))
    return pair.select(*keys, "n", mid.alias("median"))


# --- sketches: approximate, mergeable, of a fixed size a key ---------------------

def sketches(df: DataFrame, keys: list[str], value: str, k: int = 400) -> DataFrame:
    """A KLL sketch of each key's values; ranks read from it are within some 1.2 % of n for k = 200, half of that for twice the k."""
    v = F.col(value).cast("double")
    return df.where(v.isNotNull() & ~F.isnan(v)).groupBy(*keys).agg(F.kll_sketch_agg_double(v, F.lit(k)).alias("sketch"), F.count(F.lit(1)).alias("n"))


def merged(parts: DataFrame, keys: list[str], k: int = 400) -> DataFrame:
    """Sketches of parts of a key (days, runs) as one a key."""
    return parts.groupBy(*keys).agg(F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"), F.sum("n").alias("n"))


def sketched_percentiles(parts: DataFrame, keys: list[str], ps: dict[str, float]) -> DataFrame:
    return parts.select(*keys, "n", *[F.kll_sketch_get_quantile_double("sketch", F.lit(p)).alias(name) for name, p in ps.items()])
