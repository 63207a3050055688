"""Rows no other row beats on cost and rating at once.

A row is beaten when something strictly cheaper is rated at least as well, or
something of the same cost is rated better. So only the best rating per cost
matters, and the test is a running maximum over costs. The costs are cut into
ranges at their own quantiles: each range runs in its own task, and one small
array of per-range maxima carries the result across ranges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

def dominance(points: DataFrame, cost: str = "cost", rating: str = "rating", ranges: int | None = None) -> DataFrame:
    """Adds ``beaten``. Points equal on both axes do not beat one another; unpriced or unrated ones take no part."""
    ranges = ranges or max(2, int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    points = points.where(F.col(cost).isNotNull() & F.col(rating).isNotNull())
    per_cost = points.groupBy(cost).agg(F.max(rating).alias("_best"))
    marks = [i / ranges for i in range(1, ranges)]
    edges = per_cost.agg(F.percentile_approx(cost, marks, 10 * ranges)).scalar()
    cut = per_cost.withColumn("_edges", edges).withColumn(
        "_range", F.coalesce(F.size(F.filter("_edges", lambda e: e < F.col(cost))), F.lit(0))
    ).drop("_edges")
    # one entry per range, and as many ranges as the session has shuffle partitions
    tops = cut.groupBy("_range").agg(F.max("_best").alias("_top"))
    carried = tops.agg(F.collect_list(F.struct("_range", "_top"))).scalar()
    before = Window.partitionBy("_range").orderBy(cost).rowsBetween(Window.unboundedPreceding, -1)
    cheaper = F.array_max(F.transform(
        F.filter("_carried", lambda t: t["_range"] < F.col("_range")), lambda t: t["_top"]
    ))
    bests = (
        cut.withColumn("_inside", F.max("_best").over(before))
        .withColumn("_carried", carried)
        .select(cost, "_best", F.greatest("_inside", cheaper).alias("_cheaper"))
    )
    beaten = (F.col("_best") > F.col(rating)) | F.coalesce(F.col("_cheaper") >= F.col(rating), F.lit(False))
    return points.join(bests, cost).withColumn("beaten", beaten).drop("_best", "_cheaper")


def frontier(points: DataFrame, cost: str = "cost", rating: str = "rating") -> DataFrame:
    """Unbeaten rows, cheapest first."""
    return dominance(points, cost, rating).where(~F.col("beaten")).drop("beaten").orderBy(cost)
