"""Connected components of a link table by alternating large-star and small-star steps.

Every step is a map-side minimum and one join of narrow rows, and its result is
a written table in the shared folder, so a lost executor costs a step. Nothing
is gathered: a vertex with very many links is a key of narrow rows only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import Scratch


def components(links: DataFrame, a: str, b: str, scratch: Scratch | None = None) -> DataFrame:
    """(vertex, component) of every vertex in ``links``: component is its smallest reachable vertex. Null ends and loops are no links.

    What it returns is read from a table that ``scratch`` owns.
    """
    spark = links.sparkSession
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    mine = Scratch(spark)
    edges = mine.keep(edges, "edges")
    state = _state(edges)
    while True:
        older, mine = mine, Scratch(spark)
        edges = mine.keep(_small_star(_large_star(edges)), "edges")
        older.clear()
        before, state = state, _state(edges)
        if state == before:
            break
    if scratch is not None:
        scratch.paths += mine.paths
    # Every edge now leads from a vertex to its component's smallest.
    roots = edges.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("vertex"), F.col("v").alias("component")).union(roots)


def _state(edges: DataFrame) -> tuple:
    sums = [F.sum(F.pmod(F.xxhash64(c, F.lit(i)), F.lit(1 << 40))) for i, c in enumerate("uv")]
    return tuple(edges.agg(F.count(F.lit(1)), *sums, F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Each vertex links its larger neighbours to the smallest vertex around it."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    out = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each vertex links itself and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    out = edges.join(least, "u").select(F.explode(F.array(F.struct(F.col("u").alias("x"), "m"), F.struct(F.col("v").alias("x"), "m"))).alias("e"))
    return out.select(F.col("e.x").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct()
