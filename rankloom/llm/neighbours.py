"""Near-duplicate embeddings by small-world graphs, one per shard.

Vectors of one label are dealt to shards of about ``shard_rows`` by a hash, so
a label that holds a third of all rows is many shards. Every shard gets a
graph; every vector is searched in every shard of its label, in blocks. Every
vector is also audited, by one product of matrices with the whole shard: those
that miss a link of their own walk again with twice the beam, and a link that no
walk reaches is added, so links are complete and the same from both ends. Hits
are kept at a cosine of at least ``least`` in double precision. Equal vectors
are one class with a weight.

Rows that leave a task: the number of links of each class, and a spanning forest
of the links it found, never the links themselves. Components are joined over
those. Null vectors, vectors with null or non-finite parts or of length zero,
and null labels link with nothing. Rows with a null vec_id take part; a
component of those alone has no id. Repeated rows link with each other.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..session import staged
from . import hnsw
from .components import components


def near_duplicates(
    vectors: DataFrame, least: float = 0.98, shard_rows: int = 8192, block_rows: int = 1024, beam: int = 24, audits: int = 32,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of (vec_id, embedding, label)."""
    e = F.col("embedding").cast("array<double>")
    rows = vectors.select("vec_id", "label", e.alias("e"))
    bad = F.exists("e", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    valid = F.col("label").isNotNull() & F.col("e").isNotNull() & (F.size("e") > 0) & ~bad & F.exists("e", lambda v: v != 0)
    plain = F.transform("e", lambda v: v + F.lit(0.0))  # -0.0 reads as 0.0
    key = F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(i), F.col("label").cast("string"), plain)), 16, "0") for i in (1, 2)])
    rows = staged(rows.select("vec_id", "label", "e", F.when(F.coalesce(valid, F.lit(False)), key).alias("class")), "vectors")
    classes = rows.where("class is not null").groupBy("class").agg(
        F.first("label").alias("label"), F.first("e").alias("e"), F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("weight"))
    classes = staged(classes.withColumn("dim", F.size("e")), "vector-classes")
    many = classes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("label").alias("_l"), F.col("dim").alias("_d"), F.ceil(F.col("n") / shard_rows).cast("int").alias("shards"),
        F.ceil(F.col("n") / block_rows).cast("int").alias("blocks"))
    dealt = classes.join(many, (F.col("label") == F.col("_l")) & (F.col("dim") == F.col("_d"))).drop("_l", "_d")
    dealt = dealt.withColumn("label", F.col("label").cast("string"))

    def build(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("class")
        graph = hnsw.Graph(hnsw.unit(group["e"].tolist()))
        first = group.iloc[0]
        return pd.DataFrame({"label": [first["label"]], "dim": [first["dim"]], "shard": [first["shard"]], "blocks": [first["blocks"]],
                             "graph": [graph.dumps()], "classes": [group["class"].tolist()], "weights": [group["weight"].tolist()]})

    shard = dealt.withColumn("shard", F.pmod(F.xxhash64("class"), F.col("shards")).cast("int"))
    graphs = shard.groupBy("label", "dim", "shard").applyInPandas(
        build, "label string, dim int, shard int, blocks int, graph binary, classes array<string>, weights array<bigint>")
    graphs = staged(graphs, "vector-graphs")

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({"class": pd.Series(dtype=str), "other": pd.Series(dtype=str), "links": pd.Series(dtype="int64")})
        if not len(left) or not len(right):
            return out
        graph, names = hnsw.Graph.loads(bytes(left["graph"].iloc[0])), list(left["classes"].iloc[0])
        weights, mine = np.array(left["weights"].iloc[0]), right["class"].tolist()
        hits, _, _ = hnsw.linked(graph, hnsw.unit(right["e"].tolist()), least, beam, audits)
        edges = ((c, names[j]) for c, found in zip(mine, hits) for j in found.tolist() if names[j] != c)
        tree = hnsw.forest(edges)
        counts = [int(weights[found].sum()) - sum(int(weights[j]) for j in found.tolist() if names[j] == c) for c, found in zip(mine, hits)]
        return pd.concat([pd.DataFrame({"class": mine, "other": None, "links": counts}),
                          pd.DataFrame({"class": [a for a, _ in tree], "other": [b for _, b in tree], "links": 0})])

    block = F.pmod(F.xxhash64("class", F.lit(9)), F.col("blocks")).cast("int")
    queries = dealt.withColumn("block", block).withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    queries = queries.select("label", "dim", "shard", "block", "class", "e")
    sides = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    at = ["label", "dim", "shard", "block"]
    found = sides.groupBy(*at).cogroup(queries.groupBy(*at)).applyInPandas(search, "class string, other string, links bigint")
    found = staged(found, "vector-links")
    parts = components(found.where("other is not null"), "class", "other")
    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    per = classes.select("class", "vec_id", "weight").join(links, "class", "left").join(
        parts.select(F.col("vertex").alias("class"), "component"), "class", "left")
    per = staged(per.withColumn("component", F.coalesce("component", "class")), "vector-parts")
    least_id = per.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    per = per.join(least_id, "component").select(
        "class", "component_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    out = rows.select("vec_id", "class").join(per, "class", "left")
    component_id = F.when(F.col("class").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component_id.alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
