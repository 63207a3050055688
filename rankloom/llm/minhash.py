"""Near-duplicate documents by a signature-coordinate inverted join.

Texts with one word sequence are a class, so copies are handled once. Each
class has a MinHash signature of ``coords`` values and is posted under each
coordinate-value pair. Two sets with Jaccard J agree in a coordinate with
probability J, so pairs that agree in at least ``matches`` coordinates are
candidates (at 64 and 38 a pair of Jaccard 0.8 is missed about once in 23,000, one of
0.85 about once in 6.5 million).

Prefix: to agree in ``matches`` of a class's coordinates, one of its rarest
coords - matches + 1 must be shared; only these are posted, and values that no
other class has need no list at all. Skip: the long lists are never merged; the
full collision count of a candidate is read off the two signatures.

Groups of near copies are not multiplied out. In each list the class whose
values are the most common (the centre of its group) is compared with all
others first: one row per member. Then the classes of lists whose members are
not yet one component are joined exactly, by the rarest of their shingles, for
pairs of different components. Pairs left out are inside one component already,
so the components are those of all links. Every candidate is confirmed on the
full shingle sets.

Null and empty texts have no shingles, are linked with nothing and kept. Rows
that share a doc_id are separate rows with their own text. Rows with a null
doc_id take part and are kept only if their whole component has no doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from . import shingles as S
from .common import Scratch
from .components import components


def signed(docs: DataFrame, k: int, coords: int, seed: int, row_key: str | None = None) -> DataFrame:
    """(doc_id, class, n_shingles, signature) of rows (doc_id, text), and their row key if one is named; empty signatures for empty sets."""
    more = [row_key] if row_key else []
    draws = S.coordinates(coords, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = S.WordHashes()
        for whole in batches:
            for start in range(0, whole.num_rows, 500):  # few texts at a time are Python objects
                batch = whole.slice(start, 500)
                names, sizes, signatures = [], [], []
                for text in batch.column(1).to_pylist():
                    words = S.words_of(text)
                    found = S.shingle_set(words, k, known)
                    names.append(xxhash.xxh3_128_digest(b" ".join(words)))
                    sizes.append(len(found))
                    signatures.append(S.signature(found, draws) if len(found) else np.empty(0, np.int64))
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in signatures])])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(signatures)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(names, pa.binary()), pa.array(sizes, pa.int64()), lists, *batch.columns[2:]],
                    names=["doc_id", "class", "n_shingles", "signature", *more])

    doc = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)
    return doc.mapInArrow(run, "doc_id long, class binary, n_shingles long, signature array<bigint>" + "".join(f", `{c}` long" for c in more))


#: Stands for a null id in joins.
NO_ID = -(2**63)


def _null_ids(docs: DataFrame) -> DataFrame:
    return docs.withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID)))


def shingle_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(class, shingles) of the wanted classes (class, doc_id of one document that has it)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = S.WordHashes()
        for batch in batches:
            out = []
            for text, want in zip(batch["text"], batch["class"]):
                words = S.words_of(text)
                if xxhash.xxh3_128_digest(b" ".join(words)) == bytes(want):
                    out.append((want, S.shingle_set(words, k, known).view(np.int64)))
            yield pd.DataFrame(out, columns=["class", "shingles"])

    of = wanted.select("class", F.coalesce("doc_id", F.lit(NO_ID)).alias("_id"))
    rows = _null_ids(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    rows = rows.join(of, F.col("doc_id") == F.col("_id")).select("text", "class")
    return rows.mapInPandas(run, "class binary, shingles array<bigint>").dropDuplicates(["class"])


def posting_lists(classes: DataFrame, coords: int, matches: int) -> DataFrame:
    """(key, class, weight, n): the lists that prefix filtering leaves, with two members or more."""
    posts = classes.select("class", F.col("n_shingles").alias("n"), F.explode("signature").alias("key"))
    often = posts.groupBy("key").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    mine = posts.join(often, "key").groupBy("class", "n").agg(
        F.sort_array(F.collect_list(F.struct("often", "key"))).alias("shared"), F.sum("often").alias("weight"))
    # Values that no other class has come first in the order and use up the prefix.
    mine = mine.where(F.size("shared") >= matches)
    shown = F.slice("shared", F.lit(1), F.size("shared") - F.lit(matches - 1))
    return mine.select("class", "n", "weight", F.explode(F.transform(shown, lambda s: s["key"])).alias("key"))


def collisions(a: Column, b: Column) -> Column:
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose shingle sets have 100 * intersection >= percent * union."""
    left = sets.select(F.col("class").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("class").alias("b"), F.col("shingles").alias("sb"))
    rows = pairs.join(right, "b").join(left, "a")
    common = F.size(F.array_intersect("sa", "sb"))
    rows = rows.withColumn("common", common)
    return rows.where(100 * F.col("common") >= percent * (F.size("sa") + F.size("sb") - F.col("common"))).select("a", "b")


def overlapping(sets: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (a, b) of different components by exact prefix and position filtering; no pair that links is lost.

    ``sets`` has class, component and shingles. Shingles are ordered rarest
    first, those that no other class has before all. A linked pair shares one
    of the first n - ceil(0.8 n) + 1 shingles of both, and what follows that
    one on the shorter side still has to make up the overlap they need.
    """
    tokens = sets.select("class", "component", F.size("shingles").alias("n"), F.explode("shingles").alias("token"))
    often = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    mine = tokens.join(often, "token").groupBy("class", "component", "n").agg(
        F.sort_array(F.collect_list(F.struct("often", "token"))).alias("common"))
    own = F.col("n") - F.size("common")
    room = F.col("n") - F.ceil(F.col("n") * percent / 100).cast("int") + 1 - own
    shown = mine.where(room > 0).withColumn("own", own).withColumn("shown", F.slice("common", F.lit(1), room))
    shown = shown.select("class", "component", "n", "own", F.posexplode("shown").alias("at", "item"))
    shown = shown.select("class", "component", "n", (F.col("own") + F.col("at")).alias("at"), "item.token")
    side = lambda x: shown.select("token", *[F.col(c).alias(f"{x}_{c}") for c in ("class", "component", "n", "at")])
    reach = F.least(F.col("a_n") - F.col("a_at"), F.col("b_n") - F.col("b_at"))
    enough = (100 + percent) * reach >= percent * (F.col("a_n") + F.col("b_n"))
    pairs = side("a").join(side("b"), "token").where(
        (F.col("a_component") < F.col("b_component")) & _lengths_fit("a_n", "b_n", percent) & enough)
    return pairs.select(F.col("a_class").alias("a"), F.col("b_class").alias("b"))


def near_duplicates(
    docs: DataFrame, k: int = 5, percent: int = 80, coords: int = 64, matches: int = 38, seed: int = 11, row_key: str | None = None,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of documents (doc_id, text).

    With ``row_key``, the name of a long column, that column is added and
    ``kept`` names one row of each component by doc_id and row key: the smallest
    doc_id, nulls last, and of its rows in the component the smallest key.
    """
    keys = [row_key] if row_key else []
    lasting, scratch = Scratch(docs.sparkSession), Scratch(docs.sparkSession)
    rows = scratch.keep(signed(docs, k, coords, seed, row_key), "minhash-docs")
    classes = rows.where("n_shingles > 0").groupBy("class").agg(
        F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"),
        *[F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(c).alias("key"))).alias("first") for c in keys])
    classes = scratch.keep(classes, "minhash-classes")
    lists = scratch.keep(posting_lists(classes, coords, matches), "minhash-lists")
    signatures = classes.select("class", "signature", F.col("n_shingles").alias("n"))

    centre = lists.groupBy("key").agg(F.max(F.struct("weight", "class")).alias("top"), F.count(F.lit(1)).alias("many")).where("many > 1")
    listed = lists.join(centre, "key")
    wanted = listed.select("class").distinct().join(classes.select("class", "doc_id"), "class")
    sets = scratch.keep(shingle_sets(docs, wanted, k), "minhash-sets")
    first = listed.where(F.col("class") != F.col("top.class")).select(F.col("top.class").alias("a"), F.col("class").alias("b")).distinct()
    left = signatures.select(F.col("class").alias("a"), F.col("signature").alias("ga"), F.col("n").alias("na"))
    right = signatures.select(F.col("class").alias("b"), F.col("signature").alias("gb"), F.col("n").alias("nb"))
    fits = _lengths_fit("na", "nb", percent) & (collisions(F.col("ga"), F.col("gb")) >= matches)
    first = first.join(right, "b").join(left, "a").where(fits).select("a", "b")
    links = scratch.keep(confirmed(first, sets, percent), "minhash-links")
    found = scratch.keep(components(links, "a", "b", scratch), "minhash-components")

    # Classes of lists that still hold several components: pairs across them, by the full sets.
    part = lists.join(found.select(F.col("vertex").alias("class"), "component"), "class", "left").withColumn(
        "component", F.coalesce("component", "class"))
    mixed = part.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    part = part.join(mixed, "key").select("class", "component").distinct()
    rest = scratch.keep(sets.join(part, "class"), "minhash-mixed")
    more = confirmed(overlapping(rest, percent).distinct(), sets, percent)
    found = components(links.union(more), "a", "b", scratch)

    first = ["first"] if row_key else []
    least = classes.select("class", "doc_id", *first).join(found, F.col("class") == F.col("vertex"), "left").withColumn(
        "component", F.coalesce("component", "class"))
    least = lasting.keep(least, "minhash-groups")
    rows = lasting.keep(rows.select("doc_id", "n_shingles", "class", *keys), "minhash-rows")
    scratch.clear()
    label = least.groupBy("component").agg(F.min("doc_id").alias("component_id"), *[F.min(c).alias("chosen") for c in first])
    label = least.select("class", "component").join(label, "component").drop("component")
    out = rows.join(label, "class", "left")
    component_id = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    if row_key:
        mine = F.col("doc_id").eqNullSafe(F.col("chosen.doc_id")) & (F.col(row_key) == F.col("chosen.key"))
        return out.select("doc_id", "n_shingles", component_id.alias("component_id"), ((F.col("n_shingles") == 0) | mine).alias("kept"), row_key)
    out = out.select("doc_id", "n_shingles", component_id.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _lengths_fit(a: str, b: str, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)
