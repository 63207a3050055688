"""Mix sources to target weights with a multivariate-hypergeometric splitting tree.

Every source is one stream of its documents in a random, reproducible order.
A mix reads whole passes over a stream and a prefix of one more, cut at the
word, so each source gives its target to the word. The stream is cut into
blocks; the numbers of blocks each source gives are split among output shards
by a binary tree: at each node the quotas are divided between two halves by a
multivariate-hypergeometric draw, so shards have equal numbers of blocks, every
block lands in exactly one shard, and each shard is a random draw of the mix.
Blocks are dealt by a pseudo-random permutation, and rows are shuffled inside
their shard only.

No step needs a source in one task. Positions in a stream are two-level prefix
sums over ranges of the permutation: both the number of ranges and the rows of
one range are about the square root of the source's rows. Each shard walks its
own path from the root of the tree, so the tree is never gathered either. What
the driver sees is one row per source: its name and its number of words.

Null texts have size 0, null sources are one source that comes last, repeated
rows are separate rows. An empty table gives an empty mix.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ..session import staged
from .common import WORD, partitions, whole

#: A word with the space before it.
SPACED_WORD = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0


def words(text: Column) -> Column:
    return F.regexp_count(whole(text), F.lit(WORD)).cast("long")


def targets(sizes: Sequence[int], weights: Sequence[float], share: float = SHARE, most: float = MOST) -> list[float]:
    """Words to take of each source, in the order given.

    All sources share ``share`` of all words by weight; a target stops at
    ``most`` times its source, and the excess is shared again by weight among
    the others until none is above.
    """
    size, weight = np.array(sizes, float), np.array(weights, float)
    out, open_, left = np.zeros(len(size)), np.ones(len(size), bool), share * size.sum()
    while open_.any():
        part = np.where(open_, left * weight / weight[open_].sum(), 0.0)
        over = open_ & (part > most * size)
        if not over.any():
            out[open_] = part[open_]
            break
        out[over] = most * size[over]
        left -= out[over].sum()
        open_ &= ~over
    return out.tolist()


def source_targets(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """One row per source: source, source_size, target; sources by code point, null last, take the weights in turn."""
    rows = docs.groupBy("source").agg(F.sum("size").alias("source_size")).toPandas()
    rows = sorted(rows.itertuples(index=False), key=lambda r: (r.source is None, (r.source or "").encode()))
    got = targets([r.source_size for r in rows], [weights[i % len(weights)] for i in range(len(rows))], share, most)
    schema = "source string, source_size long, target double"
    return docs.sparkSession.createDataFrame([(r.source, int(r.source_size), t) for r, t in zip(rows, got)], schema)


def streamed(docs: DataFrame, seed: int) -> DataFrame:
    """Rows with their place in the stream of their source: ``seq`` (rank) and ``pos`` (words before)."""
    total = max(1, docs.count())
    digits = max(1, min(7, int(np.ceil(np.log2(total) / 8))))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    keyed = docs.withColumn("_key", key).withColumn("_range", F.substring("_key", 1, digits))
    inside = W.partitionBy("source", "_range").orderBy("_key", "size")
    to_here = inside.rowsBetween(W.unboundedPreceding, -1)
    keyed = keyed.withColumn("_seq", F.row_number().over(inside)).withColumn("_pos", F.coalesce(F.sum("size").over(to_here), F.lit(0)))
    ranges = docs.withColumn("_range", F.substring(key, 1, digits)).groupBy("source", "_range").agg(
        F.count(F.lit(1)).alias("_rows"), F.sum("size").alias("_words"))
    before = W.partitionBy("source").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    ranges = ranges.select(
        F.col("source").alias("_source"), F.col("_range").alias("_of"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows_before"),
        F.coalesce(F.sum("_words").over(before), F.lit(0)).alias("_words_before"))
    at = F.col("source").eqNullSafe(F.col("_source")) & (F.col("_range") == F.col("_of"))
    return keyed.join(ranges, at).select(
        *docs.columns, (F.col("_rows_before") + F.col("_seq")).alias("seq"), (F.col("_words_before") + F.col("_pos")).alias("pos"))


def taken_pieces(stream: DataFrame, block_words: int) -> DataFrame:
    """A row per document and pass that the mix reads: words taken and number of the block."""
    limit = F.round("target").cast("long")
    passes = F.when(F.col("source_size") > 0, F.ceil(limit / F.col("source_size"))).otherwise(F.lit(0)).cast("int")
    each = stream.withColumn("_passes", passes).where("_passes > 0")
    each = each.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("_passes") - 1)))
    start = F.col("copy") * F.col("source_size") + F.col("pos")
    each = each.withColumn("words", F.least(F.col("size"), limit - start)).where("words > 0")
    return each.withColumn("block", F.floor(start / F.lit(block_words))).drop("_passes")


def split_path(quotas: np.ndarray, shard: int, shards: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Blocks of each source that one shard gets, and how many come before them, by walking the tree from its root.

    A node is the range of shards [lo, hi). Its draw is seeded by the node, so
    every shard below it sees the same split.
    """
    lo, hi = 0, shards
    have, before = quotas.astype(np.int64).copy(), np.zeros(len(quotas), np.int64)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        n = int(have.sum())
        draw = n * (mid - lo) // (hi - lo)
        rng = np.random.default_rng(int.from_bytes(hashlib.sha256(f"{seed}:{lo}:{hi}".encode()).digest()[:8], "big"))
        left = np.zeros(len(have), np.int64)
        rest, need = n, draw
        for i, mine in enumerate(have):  # one hypergeometric draw per source: the chain rule of the joint draw
            rest -= int(mine)
            left[i] = _draw(rng, int(mine), rest, need)
            need -= int(left[i])
        if shard < mid:
            have, hi = left, mid
        else:
            before, have, lo = before + left, have - left, mid
    return have, before


def _draw(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Hypergeometric; beyond numpy's limit of 10^9 a rounded normal with the same mean, variance and support."""
    if n == 0 or good == 0:
        return 0
    if good < 10**9 and bad < 10**9:
        return int(rng.hypergeometric(good, bad, n))
    p, all_ = good / (good + bad), good + bad
    sd = (n * p * (1 - p) * (all_ - n) / max(1, all_ - 1)) ** 0.5
    return int(min(max(round(rng.normal(n * p, sd)), n - bad, 0), min(good, n)))


def shard_quotas(blocks: DataFrame, per_shard: int, seed: int) -> DataFrame:
    """Rows (source, dealt, shard): which shard owns each place in the dealing order of a source's blocks."""
    spark = blocks.sparkSession
    rows = sorted(blocks.toPandas().itertuples(index=False), key=lambda r: (r.source is None, (r.source or "").encode()))
    quotas = np.array([r.blocks for r in rows], np.int64)
    names = [r.source for r in rows]
    shards = max(1, -(-int(quotas.sum()) // per_shard)) if len(rows) else 1

    def walk(batches):
        for batch in batches:
            for shard in batch["id"]:
                have, before = split_path(quotas, int(shard), shards, seed)
                out = [(n, int(b), int(h), int(shard)) for n, h, b in zip(names, have, before) if h]
                yield pd.DataFrame(out, columns=["source", "first", "quota", "shard"])

    schema = "source string, first long, quota long, shard long"
    ids = spark.range(0, shards, 1, max(1, min(partitions(spark), shards)))
    ranges = ids.mapInPandas(walk, schema)
    return ranges.select("source", F.explode(F.expr("sequence(first, first + quota - 1)")).alias("dealt"), "shard")


def permuted(block: Column, blocks: Column, source: Column, seed: int) -> Column:
    """Place of a block in the dealing order of its source: rank under a keyed affine permutation of [0, blocks).

    The step is prime and above every number of blocks below 2^31, so it shares no factor with it.
    """
    shift = F.pmod(F.xxhash64(source, F.lit(seed)), blocks)
    return F.pmod(F.pmod(block, blocks) * F.lit(2147483647) + shift, blocks)


def mixture(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST,
    block_words: int = 4096, blocks_per_shard: int = 1024, seed: int = 7,
) -> tuple[DataFrame, DataFrame]:
    """(plan, mix) of documents with columns doc_id, source and size.

    plan: each input row with seq, pos, source_size and target. mix: a row per
    document and pass, with source, seq, doc_id, copy, words (fewer than its
    size only where the target cuts the stream), block, shard and rank, the
    order inside the shard. Write the mix with ``repartition("shard")`` and
    ``sortWithinPartitions("shard", "rank")``.
    """
    rows = staged(docs.select("doc_id", "source", "size"), "mix-rows")
    per_source = source_targets(rows, weights, share, most)
    by_source = per_source.select(F.col("source").alias("_s"), "source_size", "target")
    plan = streamed(rows, seed).join(by_source, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    plan = staged(plan, "mix-plan")
    pieces = taken_pieces(plan, block_words)
    taken = F.round("target").cast("long")
    blocks = per_source.where((F.col("source_size") > 0) & (taken > 0)).select(
        "source", F.floor((taken - 1) / F.lit(block_words) + 1).cast("long").alias("blocks"))
    of = blocks.select(F.col("source").alias("_b"), "blocks")
    pieces = pieces.join(of, F.col("source").eqNullSafe(F.col("_b"))).drop("_b")
    pieces = pieces.withColumn("dealt", permuted(F.col("block"), F.col("blocks"), F.col("source"), seed))
    dealt = shard_quotas(blocks, blocks_per_shard, seed).select(F.col("source").alias("_d"), F.col("dealt").alias("_at"), "shard")
    mix = pieces.join(dealt, F.col("source").eqNullSafe(F.col("_d")) & (F.col("dealt") == F.col("_at")))
    rank = F.xxhash64("source", "seq", "copy", F.lit(seed))
    return plan, mix.select("source", "seq", "doc_id", "copy", "words", "block", "shard", rank.alias("rank"))


def taken(plan: DataFrame, mix: DataFrame) -> DataFrame:
    """Each input row with the words that the mix takes of it."""
    got = mix.groupBy("source", "seq").agg(F.sum("words").alias("taken")).select(
        F.col("source").alias("_s"), F.col("seq").alias("_q"), "taken")
    at = F.col("source").eqNullSafe(F.col("_s")) & (F.col("seq") == F.col("_q"))
    return plan.join(got, at, "left").select(
        "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST,
    block_words: int = 4096, blocks_per_shard: int = 1024, seed: int = 7,
) -> DataFrame:
    """The mix as documents: a row per document and pass, shuffled inside its shard, with the input's columns.

    Where the target cuts the stream inside a document, the row has the
    document's first words up to the cut, and n_chars is theirs. Rows without a
    word are in no mix. Texts cross one shuffle, to their shard.
    """
    key = F.xxhash64(*[F.coalesce(F.to_json(F.struct(F.col(c))), F.lit("")) for c in docs.columns if c != "text"], F.col("text"))
    keyed = docs.withColumn("_mix_key", key).withColumn("_mix_size", words(F.col("text")))
    rows = keyed.select("source", F.col("_mix_size").alias("size"), F.col("_mix_key").alias("doc_id"))
    _, mix = mixture(rows, weights, share, most, block_words, blocks_per_shard, seed)
    places = mix.select(*[F.col(c).alias(f"_mix_{n}") for c, n in (("doc_id", "of"), ("words", "words"), ("shard", "shard"), ("rank", "rank"))])
    # Rows equal in every column have one key and one text; each of their places reads that text.
    out = keyed.dropDuplicates(["_mix_key"]).join(places, F.col("_mix_key") == F.col("_mix_of"))
    cut = F.col("_mix_words") < F.col("_mix_size")
    first = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(SPACED_WORD), F.lit(0)), F.lit(1), F.col("_mix_words").cast("int")), "")
    out = out.withColumn("text", F.when(cut, first).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(cut, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.repartition("_mix_shard").sortWithinPartitions("_mix_shard", "_mix_rank").select(*docs.columns)
