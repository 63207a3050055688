"""Periodic runs of documents, and texts with the repeats of every run taken out.

A run is a stretch of words with smallest period q, of at least ``max(12, 2q)``
words, that no neighbouring word extends. How runs are found is told in
``convolve``. Every document is searched whole and alone; a task holds the words
of a few documents at a time (of one, if it is long), and rows cross no shuffle.

A null or empty text, and one without words, has no runs and collapses to the
empty text. Rows may repeat; every row of the input gives one. Other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import convolve
from .common import WORD, whole

#: Words that are searched together.
TOGETHER = 1 << 17
SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(pa.struct(
    [("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("collapsed", pa.string())])


def searched(texts: list[list[bytes]]) -> list[tuple[np.ndarray, bytes]]:
    """Runs (start, length, period; by start, then period) and collapsed text of each list of words."""
    numbers, starts, n = [], [], 0
    for words in texts:
        known: dict[bytes, int] = {}
        numbers.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)) + n)
        starts.append(n)
        n += len(words)
    flat, begin = np.concatenate(numbers), np.array(starts, np.int64)
    filled = np.array([len(w) > 0 for w in texts])
    found = convolve.runs(flat, begin[filled])
    order = np.lexsort((found.period, found.start))
    s, e, q = found.start[order], found.end[order], found.period[order]
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, s + q, 1)
    np.add.at(depth, e, -1)
    keep = np.cumsum(depth)[:n] == 0
    cuts = np.searchsorted(s, np.append(begin, n))
    out = []
    for i, (words, at) in enumerate(zip(texts, starts)):
        lo, hi = cuts[i], cuts[i + 1]
        kept = words if lo == hi else [w for w, k in zip(words, keep[at:at + len(words)].tolist()) if k]
        out.append((np.stack([s[lo:hi] - at, e[lo:hi] - s[lo:hi], q[lo:hi]], axis=1), b" ".join(kept)))
    return out


def _pack(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
    rows = searched(texts)
    runs = [[dict(zip(("start", "length", "period"), r)) for r in found.tolist()] for found, _ in rows]
    return pa.record_batch([pa.array(ids, pa.int64()), pa.array(map(len, texts), pa.int64()), pa.array(runs, _ARROW.field("runs").type),
                            pa.array([text.decode() for _, text in rows], pa.string())], schema=_ARROW)


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts, held = [], [], 0
        for i, text in zip(batch.column(0), batch.column(1)):
            # Bytes are cut at space and at tab to carriage return, as the words of the contract are.
            words = (text.as_py() or "").encode().split()
            if held and held + len(words) > TOGETHER:
                yield _pack(ids, texts)
                ids, texts, held = [], [], 0
            ids.append(i.as_py())
            texts.append(words)
            held += len(words)
        if ids:
            yield _pack(ids, texts)


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs and collapsed text of every row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole(F.col("text")).alias("text")).mapInArrow(_search, SCHEMA)


def repeated(docs: DataFrame) -> DataFrame:
    """Documents of which every tenth by checksum of doc_id goes on periodically from a place that the checksum names."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select("doc_id", "text", h.alias("_h"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("_w"))
    n, g = F.size("_w"), F.floor(F.col("_h") / 10)
    rows = rows.withColumn("_a", F.when(n > 0, g % n).cast("int")).withColumn("_p", (1 + F.floor((n - F.col("_a")) / (3 + g % 8))).cast("int"))

    def word(i: Column) -> Column:
        return F.when(i < F.col("_a"), F.get("_w", i)).otherwise(F.get("_w", F.col("_a") + (i - F.col("_a")) % F.col("_p")))

    changed = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), word), " ")
    return rows.select("doc_id", F.when(F.col("_a").isNotNull(), changed).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """One row per document: number of runs, the greatest one, and digests of all runs and of the collapsed text."""
    runs = F.col("runs")
    order = F.transform(runs, lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period")))
    top = F.array_min(order)
    lines = F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select("doc_id", F.size(runs).cast("long").alias("n_runs"), top, lines, "collapsed").toDF(
        "doc_id", "n_runs", "top", "lines", "collapsed").select(
        "doc_id", "n_runs", F.col("top.start").alias("start"), (-F.col("top.l")).alias("length"), F.col("top.period").alias("period"),
        F.floor(-1000 * F.col("top.l") / F.col("top.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join("lines", ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
