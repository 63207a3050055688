"""SpotSigs: signatures of chains of content words after common-word anchors.

A text is lower-cased and cut into words (letters, digits, marks). Wherever one
or more common words (the anchors) stand before a content word, the anchors and
the next two content words form a signature; common words between the two are
skipped. The start of a text counts as an anchor, so every text with a word has
a signature; a text without any word is its own signature, and an empty text
has none. Where ``GAP`` content words in a row have no anchor before them (other
languages, lists, code), every further one opens a spot too, until the next
anchor; a text that begins with such a stretch, or is shorter and has no anchor,
is covered from its first word. The distinct 64-bit hashes of the signatures are the fingerprint.

Two fingerprints are compared by Jaccard. ``similar_pairs`` partitions them by
set length, so only sets whose lengths allow the threshold meet, and prunes by
the rarest signatures before any set is compared.

All of it is Spark columns: two linear regular expressions and array functions
over the words of one row. Null texts are empty; equal texts have equal
fingerprints; rows may repeat.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import staged
from .common import partitions, whole

#: Common words of English, German, French and Spanish that open a spot.
ANCHORS = """
a an and are as at be been but by can do for from had has have he her his i if in is it its not of on or our she so that the their
them there they this to was we were what when which who will with you your
der die das den dem des ein eine einer einem einen und oder ist im auf mit von zu für nicht sich als auch es er sie wir
le la les un une des du de et est dans en que qui pour par sur pas au aux ce il elle nous vous se ne
el los las una del al y o que es por para con se su lo como más no si
""".split()

#: Fixed value: content words without an anchor after which every word opens a spot.
GAP = 8


def _pattern(anchors: list[str]) -> str:
    """A run of anchors and the content word after it; anchors are tried by first letter."""
    by_letter: dict[str, list[str]] = {}
    for word in sorted(set(anchors)):
        by_letter.setdefault(word[0], []).append(word[1:])
    choice = "|".join(f"{k}(?:{'|'.join(v)})" for k, v in sorted(by_letter.items()))
    return f"(?:(?:{choice}) )*+[^ ]++"


def with_signatures(rows: DataFrame, text: str, name: str, anchors: list[str] = ANCHORS) -> DataFrame:
    """Add the sorted distinct signature hashes of a text column."""
    plain = F.regexp_replace(F.lower(F.col(text)), r"[^\p{L}\p{N}\p{M}]+", " ")
    rows = rows.withColumn("_groups", F.regexp_extract_all(plain, F.lit(_pattern(anchors)), F.lit(0)))
    following = F.slice("_groups", 2, 2147483647)
    rows = rows.withColumn("_spots", F.arrays_zip(F.col("_groups").alias("g"), following.alias("n")))
    spot = F.transform("_spots", lambda p, i: F.when(
        (i == 0) | F.contains(p["g"], F.lit(" ")), F.xxhash64(p["g"], F.substring_index(p["n"], " ", -1))))
    bare = F.when(F.col(text) == "", F.array().cast("array<bigint>")).otherwise(F.array(F.xxhash64(text)))
    rows = rows.withColumn("_at", F.array_compact(F.transform("_groups", lambda g, i: F.when(F.contains(g, F.lit(" ")), i))))
    n = F.size("_groups")
    # Stretches between anchors; the one before the first anchor counts from its first word if it is long or the whole text.
    ends = F.arrays_zip(F.concat(F.array(F.lit(-GAP)), F.col("_at")).alias("a"), F.concat(F.col("_at"), F.array(n)).alias("b"))
    bounds = F.transform(ends, lambda e: F.struct((e["a"] + GAP).alias("lo"), F.least(e["b"] - 1, n - 2).alias("hi"), e["b"].alias("b")))
    bounds = F.filter(bounds, lambda e: (e["lo"] <= e["hi"]) & ((e["lo"] > 0) | (e["b"] >= F.least(F.lit(GAP), n))))
    rows = rows.withColumn("_gaps", bounds)
    word = lambda i: F.get("_groups", i)
    within = F.flatten(F.transform("_gaps", lambda e: F.transform(
        F.sequence(e["lo"], e["hi"]), lambda i: F.xxhash64(word(i), F.substring_index(word(i + 1), " ", -1)))))
    found = F.array_sort(F.array_distinct(F.concat(F.array_compact(spot), within)))
    return rows.withColumn(name, F.when(F.size("_groups") == 0, bare).otherwise(found)).drop("_groups", "_spots", "_at", "_gaps")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard of two signature sets; two empty sets are alike, an empty and a full one are not.

    Only an empty set is decided without comparing.
    """
    common = F.size(F.array_intersect(a, b))
    both = F.size(a) + F.size(b)
    return F.when(both == 0, F.lit(1.0)).when(F.least(F.size(a), F.size(b)) == 0, F.lit(0.0)).otherwise(common / (both - common))


def digest(signature_set: Column) -> Column:
    """Set length and MD5 of the sorted set: equal sets have equal strings."""
    return F.concat_ws(":", F.size(signature_set).cast("string"), F.md5(F.array_join(signature_set.cast("array<string>"), ",")))


def with_next(docs: DataFrame, per_partition: int = 8, anchors: list[str] = ANCHORS) -> DataFrame:
    """Add ``signatures``, ``next_text`` and ``next_signatures`` to rows of (doc_id, text).

    The next row is the one after in descending doc_id, rows of one id by text,
    null ids last; after the last row comes the first. Rows are dealt to ranges
    of ids cut at quantiles, several for each shuffle partition, so a range is
    small; the top row of each range is also sent to the range above it as a
    ghost. Texts cross one shuffle.
    """
    n = min(1024, per_partition * partitions(docs.sparkSession))
    at = [i / n for i in range(1, n)]
    cuts = docs.agg(F.percentile_approx("doc_id", at, 10_000).alias("c")).first()["c"] if at else None
    cuts = sorted(set(cuts or []))

    def place(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col("doc_id") <= F.lit(cuts[mid]), place(lo, mid)).otherwise(place(mid + 1, hi))

    ranged = docs.withColumn("_range", F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(place(0, len(cuts))))
    heads = ranged.groupBy("_range").agg(F.max("doc_id").alias("_head"))
    order = W.orderBy("_range")  # one row per range
    heads = heads.select("_head", F.coalesce(
        F.lead("_range").over(order), F.min("_range").over(W.partitionBy(F.lit(0)))).alias("_above"))
    ghosts = ranged.join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("_head")), "left")
    both = F.array_compact(F.array(
        F.struct(F.col("_range").alias("r"), F.lit(False).alias("ghost")),
        F.when(F.col("_above").isNotNull(), F.struct(F.col("_above").alias("r"), F.lit(True).alias("ghost")))))
    rows = ghosts.withColumn("_to", F.explode(both)).select("doc_id", whole(F.col("text")).alias("text"), "_to.r", "_to.ghost")
    rows = with_signatures(rows.repartition("r"), "text", "signatures", anchors)
    after = W.partitionBy("r").orderBy("ghost", F.col("doc_id").desc_nulls_last(), "text")
    rows = rows.withColumn("next_text", F.lead("text").over(after)).withColumn("next_signatures", F.lead("signatures").over(after))
    return rows.where(~F.col("ghost")).drop("r", "ghost")


def fingerprints(docs: DataFrame, anchors: list[str] = ANCHORS) -> DataFrame:
    """Fingerprint of every text beside that of its edited text, and their likenesses.

    The edited text has its last floor(n_chars / 2) code points replaced by the
    first as many of the next document.
    """
    rows = with_next(docs.select("doc_id", "text"), anchors=anchors).withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.expr("left(text, int(n_chars - floor(n_chars / 2)))"), F.left("next_text", half)))
    rows = with_signatures(rows, "edited", "edited_signatures", anchors)
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        digest(F.col("signatures")).alias("fingerprint"), digest(F.col("edited_signatures")).alias("edited_fingerprint"),
        likeness(F.col("signatures"), F.col("edited_signatures")).alias("near_edited"),
        likeness(F.col("signatures"), F.col("next_signatures")).alias("near_next"),
        F.size("signatures").cast("long").alias("n_signatures"))


def similar_pairs(docs: DataFrame, threshold: float = 0.8, anchors: list[str] = ANCHORS) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): fingerprints with Jaccard of at least ``threshold``, and the documents of each fingerprint.

    Documents with one fingerprint are a class, so copies are compared once.
    Sets meet only within a length band or its neighbour (the bands grow by
    1 / threshold), and only through one of their rarest signatures: a set of n
    shows its first n - ceil(threshold * n) + 1, which is enough to lose no pair.
    Documents without signatures are in no class.
    """
    rows = with_signatures(docs.select("doc_id", whole(F.col("text")).alias("text")), "text", "signatures", anchors)
    members = staged(rows.where(F.size("signatures") > 0).select("doc_id", digest(F.col("signatures")).alias("fingerprint"), "signatures"), "spot-sets")
    sets = members.groupBy("fingerprint").agg(F.first("signatures").alias("s"))
    sets = staged(sets.withColumn("n", F.size("s")), "spot-classes")
    posts = sets.select("fingerprint", "n", F.explode("s").alias("sig"))
    often = posts.groupBy("sig").agg(F.count(F.lit(1)).alias("often"))
    ranked = posts.join(often, "sig").withColumn(
        "rank", F.row_number().over(W.partitionBy("fingerprint").orderBy("often", "sig")))
    shown = ranked.where((F.col("often") > 1) & (F.col("rank") <= F.col("n") - F.ceil(F.col("n") * F.lit(threshold) - 1e-9) + 1))
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(-math.log(threshold)) + 1e-9).cast("int")
    shown = shown.select("fingerprint", "n", "sig", band.alias("band"))
    low = shown.select(F.col("fingerprint").alias("a"), F.col("n").alias("na"), "sig", F.explode(F.array("band", F.col("band") + 1)).alias("band"))
    high = shown.select(F.col("fingerprint").alias("b"), F.col("n").alias("nb"), "sig", "band")
    fits = (F.col("na") >= F.col("nb") * F.lit(threshold) - 1e-9) & (
        (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b"))))
    pairs = low.join(high, ["sig", "band"]).where(fits).select("a", "b").distinct()
    left = sets.select(F.col("fingerprint").alias("a"), F.col("s").alias("sa"))
    right = sets.select(F.col("fingerprint").alias("b"), F.col("s").alias("sb"))
    pairs = pairs.join(left, "a").join(right, "b").select("a", "b", likeness(F.col("sa"), F.col("sb")).alias("jaccard"))
    return pairs.where(F.col("jaccard") >= threshold - 1e-12), members.select("doc_id", "fingerprint")
