"""License scan: ordered signature rules behind a keyword prefilter, with containment suppression.

One pass over the texts. A text with none of the gate words is done after that
pass. The others are rewritten as words with one space between; rules whose
keyword occurs there are applied, each to the whole text. Detections are word
intervals; one that lies inside another of the same or a higher priority is
suppressed (running maxima over the intervals of a document in order of their
start, so the work grows with their number and not its square). Rows after the
scan carry no text.

All of it is Spark columns; the rules are one literal array. Null texts are
empty. Every row of the input gives one row; rows may repeat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import whole
from .license_rules import GATES, PHRASES, PRIORITIES, RULES, Rule

#: Between words: ASCII that is no digit or letter. Words: 0-9, a-z after lower-casing, and what is not ASCII.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def spaces(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def as_words(text: Column) -> Column:
    """`` w0 w1 ... wn `` with a space at either end, A-Z lower-cased."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.translate(text, UPPER, LOWER), GAP, " ")), F.lit(" "))


def scanned(docs: DataFrame, rules: list[Rule] = RULES, gates: list[str] = GATES) -> DataFrame:
    """Rows per document and rule that occurs: words around its places; a document without any has one row.

    ``row`` is unique per input row. ``parts`` has the words of the pieces
    between the places of the rule, ``sizes`` the words of each place.
    """
    text = whole(F.col("text"))
    rows = docs.select("doc_id", text.alias("_text")).withColumn("row", F.monotonically_increasing_id())
    rows = rows.withColumn("n_words", F.regexp_count("_text", F.lit(WORD)).cast("long")).withColumn("_low", F.lower("_text"))
    gate = F.lit(False)
    for part in gates:
        gate = gate | F.contains("_low", F.lit(part))
    rows = rows.withColumn("_words", F.when(gate, as_words(F.col("_text")))).drop("_text", "_low")
    for i, phrase in enumerate(PHRASES):
        rows = rows.withColumn(f"_p{i}", F.when(F.contains("_words", F.lit(f" {phrase} ")), F.transform(
            F.split("_words", f" {phrase}(?= )", -1), spaces)))
    table = F.array(*[F.struct(F.lit(i).alias("rule"), F.lit(r.keyword).alias("keyword"), F.lit(f" {r.pattern}(?= )").alias("pattern"))
                      for i, r in enumerate(rules)])
    found = F.filter(table, lambda r: F.contains(F.col("_words"), r["keyword"]))
    rows = rows.withColumn("_r", F.explode_outer(F.when(F.col("_words").isNotNull(), found)))
    places = F.transform(F.regexp_extract_all("_words", F.col("_r.pattern"), F.lit(0)), spaces)
    rows = rows.withColumn("sizes", F.when(F.col("_r").isNotNull(), places))
    parts = F.when(F.size("sizes") > 0, F.transform(F.split("_words", F.col("_r.pattern"), -1), spaces))
    rows = rows.withColumn("parts", parts)
    bases = [f"_p{i}" for i in range(len(PHRASES))]
    return rows.select("row", "doc_id", "n_words", *bases, F.col("_r.rule").alias("rule"), "parts", "sizes")


def detections(rows: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """Scanned rows as one row per place: first word, word after the last, label, priority, and whether it is kept."""
    at = F.arrays_zip(F.slice("parts", F.lit(1), F.size("sizes")).alias("before"), F.col("sizes").alias("size"))
    rows = rows.withColumn("_at", F.when(F.size("sizes") > 0, at))
    rows = rows.select("*", F.posexplode_outer("_at").alias("_i", "_m")).drop("_at", "parts", "sizes").repartition("row")
    along = W.partitionBy("row", "rule").orderBy("_i")
    here, earlier = along.rowsBetween(W.unboundedPreceding, 0), along.rowsBetween(W.unboundedPreceding, -1)
    start = F.sum("_m.before").over(here) + F.coalesce(F.sum("_m.size").over(earlier), F.lit(0))
    rows = rows.withColumn("start", F.when(F.col("_m").isNotNull(), start))
    rows = rows.withColumn("end", F.col("start") + F.col("_m.size")).drop("_i", "_m")
    label = F.array(*[F.lit(r.label) for r in rules])
    priority = F.array(*[F.lit(r.priority) for r in rules])
    rows = rows.withColumn("label", F.get(label, F.col("rule"))).withColumn("priority", F.get(priority, F.col("rule")))
    order = W.partitionBy("row").orderBy("start", F.col("end").desc(), F.col("priority").desc(), "rule").rowsBetween(W.unboundedPreceding, -1)
    inside = F.lit(False)
    for p in sorted({r.priority for r in rules}):
        reach = F.max(F.when(F.col("priority") >= p, F.col("end"))).over(order)
        inside = F.when(F.col("priority") == p, reach >= F.col("end")).otherwise(inside)
    return rows.withColumn("kept", F.col("start").isNotNull() & ~F.coalesce(inside, F.lit(False)))


def scan(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """One row per document: words, places of the base phrases, labels, and a score (highest priority kept over the highest there is)."""
    rows = detections(scanned(docs, rules), rules)
    bases = [f"_p{i}" for i in range(len(PHRASES))]
    per = rows.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), *[F.first(b).alias(b) for b in bases],
        F.collect_set(F.when(F.col("kept"), F.col("label"))).alias("own"),
        F.count_if("kept").alias("n_detections"), F.max(F.when(F.col("kept"), F.col("priority"))).alias("top"))
    n_base, firsts, lasts, labels = F.lit(0), [], [], []
    for b, (phrase, label) in zip(bases, PHRASES.items()):
        hit = F.col(b).isNotNull()
        n_base = n_base + F.when(hit, F.size(b) - 1).otherwise(0)
        firsts.append(F.when(hit, F.get(F.col(b), F.lit(0))))
        lasts.append(F.when(hit, F.col("n_words") - (F.get(F.col(b), F.size(b) - 1) - 1) - len(phrase.split())))
        labels.append(F.when(hit, F.lit(label)))
    base = F.array_sort(F.array_compact(F.array(*labels)))
    best = F.greatest(F.coalesce("top", F.lit(0)), F.when(F.size(base) > 0, F.lit(2)).otherwise(0))
    return per.select(
        "doc_id", "n_words", n_base.cast("long").alias("n_base"), F.least(*firsts).cast("long").alias("first_word"),
        F.greatest(*lasts).cast("long").alias("last_word"), F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.col("own"))), ",").alias("labels"),
        (best / F.lit(float(max(PRIORITIES)))).alias("score"), "n_detections")
