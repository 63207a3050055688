"""Merkle manifest of a dataset, kept as every few levels; the levels between are recomputed where a proof needs them.

Each source has a tree of arity 16 over its rows in order of doc_id; the roots of
the sources, in order of the source, are the leaves of a tree above them. H is the
hexadecimal SHA-256 of inputs set one behind the other, digests as hexadecimal
text. A run of up to 16 consecutive nodes becomes their H while a level has more
than one node, so the last run of a level may be a single node.

A row's place is found by a range shuffle of narrow rows (texts are hashed where
they are read) and counts per source and range, so a source that holds most rows
spreads over all ranges. Stored levels are ``EVERY`` apart: a stored row is one
aligned subtree with the digests at its foot, 16^EVERY at most. A proof runs from
the top down: each subtree recomputes the nodes between from its stored digests,
hands every path the siblings it passes, and keeps none of them.

Null columns count as ``-``; a null doc_id comes first in its source and is never
tampered with, a null source is a source of its own and first. Rows of one doc_id
are ordered by their digest, so repeated rows are leaves side by side. An empty
table has an empty manifest and no proofs. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import Scratch, placed

ARITY = 16
#: Levels between two stored ones.
EVERY = 3
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

Siblings = "array<struct<left:string,right:string>>"


@dataclass
class Manifest:
    """``levels``: stored levels from the rows up, as (tree, subtree, height, digests); ``sources``: one row per source with its root, its path to ``root`` and the root; ``folder`` owns the tables."""

    levels: list[DataFrame]
    sources: DataFrame
    folder: Scratch


def digest(c: Column) -> Column:
    return F.sha2(c, 256)


def leaf(**changed: Column) -> Column:
    """H of the columns of a document, each with its number of bytes before it; ``changed`` columns in place of the table's own."""
    parts = []
    for name in COLUMNS:
        value = changed.get(name, F.col(name)).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return digest(F.concat(*parts))


def lower_cased() -> Column:
    """The leaf after A-Z of the text became a-z, where 5 divides the checksum of doc_id; else null."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return F.when(hit, leaf(text=F.translate("text", UPPER, LOWER)))


def height(n: Column) -> Column:
    """Levels above the leaves of a tree of n leaves: hexadecimal digits of n - 1, none for a single leaf."""
    return F.when(n > 1, F.length(F.hex(n - 1))).otherwise(0)


def _subtrees(nodes: DataFrame, every: int) -> DataFrame:
    """Aligned subtrees of a level's nodes (tree, place, digest, height and, of rows, ``of``): one row each, digests in order."""
    extra = [c for c in ("of",) if c in nodes.columns]
    entry = F.struct("place", "digest", *extra)
    out = nodes.groupBy("tree", F.shiftright("place", 4 * every).alias("subtree")).agg(
        F.first("height").alias("height"), F.array_sort(F.collect_list(entry)).alias("e"))
    return out.select("tree", "subtree", "height", F.col("e.digest").alias("digests"), *[F.col(f"e.{c}").alias(c) for c in extra])


def _runs(digests: Column) -> Column:
    """H of every run of 16."""
    n = F.floor((F.size(digests) + ARITY - 1) / ARITY).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: digest(F.array_join(F.slice(digests, i * ARITY + 1, F.lit(ARITY)), "")))


def _between(subtrees: DataFrame, base: int, every: int) -> DataFrame:
    """Adds levels ``l0`` (stored) to ``l<every>`` of each subtree; above the tree's root its single node stays."""
    out = subtrees.withColumn("l0", F.col("digests"))
    for i in range(1, every + 1):
        out = out.withColumn(f"l{i}", F.when(F.col("height") >= base + i, _runs(F.col(f"l{i - 1}"))).otherwise(F.col(f"l{i - 1}")))
    return out


def _stored(nodes: DataFrame, every: int, scratch: Scratch) -> list[DataFrame]:
    """Stored levels of all trees, the first over ``nodes``; a tree is in those up to the one that holds its root's subtree."""
    out, base, top = [], 0, None
    while True:
        out.append(scratch.keep(_subtrees(nodes, every), f"merkle-level-{base}"))
        top = top if base else out[0].agg(F.max("height")).first()[0] or 0
        if base + every >= top:
            return out
        tall = _between(out[-1].where(F.col("height") > base + every).select("tree", "subtree", "height", "digests"), base, every)
        nodes = tall.select("tree", F.col("subtree").alias("place"), "height", F.get(f"l{every}", F.lit(0)).alias("digest"))
        base += every


def _roots(levels: list[DataFrame], every: int) -> DataFrame:
    """(tree, root) of every tree, from the stored level below it."""
    out = None
    for i, level in enumerate(levels):
        here = level.where(F.col("height") <= (i + 1) * every)
        if i:
            here = here.where(F.col("height") > i * every)
        here = _between(here.select("tree", "subtree", "height", "digests"), i * every, every)
        here = here.select("tree", F.get(f"l{every}", F.lit(0)).alias("root"))
        out = here if out is None else out.unionByName(here)
    return out


def _paths(levels: list[DataFrame], above: DataFrame, every: int) -> DataFrame:
    """Every node of the first level with its siblings up to the root of its tree and on along ``above`` (tree, path and more).

    From the top stored level down: a subtree gets the path of its own top, and
    each step unfolds the nodes of one level below it, 16 at a time.
    """
    carried = [c for c in above.columns if c not in ("tree", "path")]
    handed = None
    for i in reversed(range(len(levels))):
        base, level = i * every, levels[i]
        top = level.where(F.col("height") <= base + every)
        top = (top.where(F.col("height") > base) if i else top).join(above.withColumnRenamed("tree", "_t"), F.col("tree").eqNullSafe(F.col("_t"))).drop("_t")
        rows = top
        if handed is not None:
            under = level.where(F.col("height") > base + every).join(handed, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("subtree") == F.col("_p")))
            rows = top.unionByName(under.drop("_t", "_p"))
        rows = _between(rows, base, every).withColumn("at", F.lit(0))
        has_of = "of" in level.columns
        for j in range(every, 0, -1):
            rows = _unfold(rows, j, base, carried, has_of)
        node = rows.select("tree", (F.col("subtree") * ARITY**every + F.col("at")).alias("place"), F.get("l0", F.lit(0)).alias("digest"), "path", *carried,
                           *[F.get(c, F.lit(0)).alias(c) for c in ("of",) if has_of])
        handed = node.select(F.col("tree").alias("_t"), F.col("place").alias("_p"), "path", *carried)
    return node


def _unfold(rows: DataFrame, j: int, base: int, carried: list[str], has_of: bool) -> DataFrame:
    """Rows of one node of level j and what is below it, as rows of its children; each child's path gains its siblings."""
    below = f"l{j - 1}"
    real = F.col("height") >= base + j
    kids = F.col(below)

    def child(i: Column) -> Column:
        lower = [F.slice(f"l{k}", i * ARITY**(j - 1 - k) + 1, F.lit(ARITY**(j - 1 - k))).alias(f"l{k}") for k in range(j)]
        lower += [F.slice(c, i * ARITY**(j - 1) + 1, F.lit(ARITY**(j - 1))).alias(c) for c in ("of",) if has_of]
        left = F.array_join(F.slice(kids, F.lit(1), i), "")
        right = F.array_join(F.slice(kids, i + 2, F.lit(ARITY)), "")
        path = F.when(real, F.concat(F.array(F.struct(left.alias("left"), right.alias("right"))), F.col("path"))).otherwise(F.col("path"))
        return F.struct(*lower, path.alias("path"), (F.col("at") * ARITY + i).alias("at"))

    each = F.explode(F.transform(F.sequence(F.lit(0), F.size(kids) - 1), child)).alias("c")
    return rows.select("tree", "subtree", "height", *carried, each).select("tree", "subtree", "height", *carried, "c.*")


def manifest(docs: DataFrame, every: int = EVERY, also: Column | None = None) -> Manifest:
    """Store the levels of every source's tree and of the tree above them. ``also`` is kept beside each leaf."""
    spark = docs.sparkSession
    scratch, mine = Scratch(spark), Scratch(spark)
    leaves = mine.keep(docs.select(F.col("source").cast("string").alias("tree"), "doc_id", leaf().alias("digest"),
                                   (F.lit(None).cast("string") if also is None else also).alias("also")), "merkle-leaves")
    rows = placed(leaves, "tree", ["doc_id", "digest"], mine)
    rows = rows.select("tree", "place", "digest", height(F.col("n")).alias("height"), F.struct("doc_id", "also").alias("of"))
    levels = _stored(rows, every, scratch)
    subroots = mine.keep(_roots(levels, every).withColumnRenamed("root", "subroot").withColumn("all", F.lit("all")), "merkle-subroots")
    tops = placed(subroots, "all", ["tree"], mine)
    tops = tops.select(F.col("all").alias("tree"), "place", F.col("subroot").alias("digest"), height(F.col("n")).alias("height"),
                       F.struct(F.col("tree").alias("source"), F.lit(None).cast("string").alias("also")).alias("of"))
    upper = _stored(tops, every, mine)
    ends = _roots(upper, every).withColumn("path", F.array().cast(Siblings))
    sources = _paths(upper, ends, every).select(F.col("of.source").alias("source"), F.col("digest").alias("subroot"), "path", "root")
    found = Manifest(levels, scratch.keep(sources, "merkle-sources"), scratch)
    mine.clear()
    return found


def proofs(found: Manifest, every: int = EVERY) -> DataFrame:
    """Every row's leaf, what was kept beside it, its siblings from the leaf's run up to the root, and the roots."""
    above = found.sources.select(F.col("source").alias("tree"), "path", "subroot", "root")
    rows = _paths(found.levels, above, every)
    return rows.select("of.doc_id", F.col("tree").alias("source"), F.col("digest").alias("leaf"), "of.also", "path", "subroot", "root")


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, start, lambda acc, s: digest(F.concat(s["left"], acc, s["right"])))


def siblings(path: Column) -> Column:
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def verified(docs: DataFrame, every: int = EVERY) -> DataFrame:
    """One row per document: its proof, and whether the leaf read again (after tampering where ``lower_cased`` says so) still leads to the root."""
    rows = proofs(manifest(docs, every, also=lower_cased()), every)
    rows = rows.withColumn("folded_root", folded(F.coalesce("also", "leaf"), F.col("path")))
    return rows.select("doc_id", "source", "leaf", "subroot", "root", "path", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
