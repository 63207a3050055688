"""Request planning: which questions, how many calls, what they cost."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.labels import BATCH_LABS, model_lab
from ..functions.prompts import estimate_tokens
from ..session import staged

MAX_BATCH_TOKENS = 750_000
MAX_BATCH_REQUESTS = 2_000
HARD_TARGET_MULTIPLIER = 3


def select_questions(questions: DataFrame, per_type: int = 0) -> DataFrame:
    """First ``per_type`` questions of each type in set order; 0 keeps all."""
    if not per_type:
        return questions
    w = Window.partitionBy("type").orderBy("seq")
    return questions.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= per_type).drop("_rn")


# --- cost -------------------------------------------------------------------

def credits_per_call(num_sources: Column, extraction: Column) -> Column:
    """Two searches of two credits each, plus a credit per page of both when extracting."""
    return F.lit(4) + F.when(extraction == "clean", num_sources * 2).otherwise(0)


def calls_affordable(credits: Column, per_call: Column) -> tuple[Column, Column]:
    """(pessimistic, optimistic) number of calls a balance covers."""
    return (
        F.floor(credits / (per_call * HARD_TARGET_MULTIPLIER)).cast("bigint"),
        F.floor(credits / per_call).cast("bigint"),
    )


def cost_estimate(todo: DataFrame, rates: DataFrame) -> DataFrame:
    """Per provider: calls, floor and pessimistic cost against the live balance.

    ``rates`` has provider, per_call and balance; an unmetered provider has
    null for both and null costs.
    """
    calls = todo.groupBy("provider").agg(F.count(F.lit(1)).alias("calls"))
    lines = rates.join(calls, "provider", "left").withColumn("calls", F.coalesce("calls", F.lit(0)))
    low = F.col("per_call") * F.col("calls")
    return lines.select(
        "provider", "calls", low.alias("min_cost"), (low * HARD_TARGET_MULTIPLIER).alias("max_cost"), "balance",
        F.coalesce(low * HARD_TARGET_MULTIPLIER > F.col("balance"), F.lit(False)).alias("over_balance"),
    )


def cost_totals(lines: DataFrame, ceiling: int | None = None) -> DataFrame:
    """Summed costs and whether the pessimistic end crosses the caller's ceiling."""
    low, high = F.coalesce(F.sum("min_cost"), F.lit(0)), F.coalesce(F.sum("max_cost"), F.lit(0))
    blocked = (high > ceiling) if ceiling is not None else F.lit(False)
    return lines.agg(
        low.alias("total_min"), high.alias("total_max"),
        F.count_if("over_balance").alias("n_over_balance"), blocked.alias("blocked"),
    )


def budget_gate(lines: DataFrame, ceiling: int | None) -> DataFrame:
    """The estimate itself, or an error when the run could cross the ceiling."""
    if ceiling is None:
        return lines
    total = cost_totals(lines, ceiling).select(
        F.assert_true(~F.col("blocked"), F.concat(
            F.lit("this run could cost up to "), F.col("total_max").cast("string"),
            F.lit(f" credits, over the ceiling of {ceiling}; its floor is "), F.col("total_min").cast("string"),
        )).alias("ok")
    ).scalar()
    return lines.where(total.isNull())


# --- requests and chunks ------------------------------------------------------

def with_tokens(requests: DataFrame, *messages: str) -> DataFrame:
    return requests.withColumn("tokens", estimate_tokens(*[F.col(m) for m in messages]))


def with_route(requests: DataFrame, model: str = "model") -> DataFrame:
    """Lab of each request, and 'sync' where that lab takes no batches."""
    lab = model_lab(F.col(model))
    return requests.withColumn("lab", lab).withColumn("route", F.when(lab.isin(BATCH_LABS), lab).otherwise("sync"))


def with_wire_id(requests: DataFrame, *key: str) -> DataFrame:
    """A short opaque id made from the key columns; the row keeps the real key."""
    parts = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key]
    return requests.withColumn("wire_id", F.substring(F.sha2(F.concat_ws("\u0000", *parts), 256), 1, 32))


def match_outcomes(requests: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Results matched by id, never by position; a request without one is an error row."""
    got = outcomes.groupBy("wire_id").agg(F.min_by(F.struct("text", "error"), "seq").alias("o"))
    out = requests.join(got, "wire_id", "left")
    text = F.col("o.text")
    error = F.when(text.isNull(), F.coalesce(F.col("o.error"), F.lit("no batch result")))
    return out.withColumns({"text": text, "error": error}).drop("o")


def chunk_requests(
    requests: DataFrame, order: list[str], max_tokens: int = MAX_BATCH_TOKENS, max_requests: int = MAX_BATCH_REQUESTS, span_rows: int = 50_000,
) -> DataFrame:
    """(route, wire_id, tokens, chunk): chunks filled greedily in request order under both ceilings; an oversized request stands alone.

    The fill of a whole route is exact without any task seeing it. A route is
    cut into spans by position. Where the next span is entered depends on where
    this one was, but only on the first ``max_requests`` rows of it; so every
    span gives, for each such entry, the entry of the next span and the number
    of chunks begun. These small maps are composed over groups of spans and
    then over groups, which settles every span's entry and first chunk number.
    """
    span_rows = max(span_rows, max_requests)
    rows = _positions(requests, order)
    own = rows.withColumn("span", F.floor(F.col("pos") / span_rows)).withColumn("ahead", F.lit(False))
    head = own.where((F.col("span") > 0) & (F.col("pos") % span_rows < max_requests))
    seen = own.unionByName(head.withColumn("span", F.col("span") - 1).withColumn("ahead", F.lit(True)))
    longest = 512

    def ends_of(tokens: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(tokens)])
        i = np.arange(len(tokens))
        fits = np.searchsorted(total, total[:-1] + max_tokens, side="right") - 1
        return np.minimum(np.maximum(fits, i + 1), i + max_requests)

    def map_span(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        n, ends = int((~pdf["ahead"]).sum()), ends_of(pdf["tokens"].to_numpy())
        leaves, begun = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for i in range(n - 1, -1, -1):
            e = ends[i]
            leaves[i], begun[i] = (e - n, 1) if e >= n else (leaves[e], begun[e] + 1)
        k = min(n, max_requests)
        first = pdf.iloc[0]
        return pd.DataFrame({"route": [first["route"]], "span": [first["span"]], "leaves": [leaves[:k]], "begun": [begun[:k]]})

    maps = staged(seen.groupBy("route", "span").applyInPandas(
        map_span, "route string, span bigint, leaves array<bigint>, begun array<bigint>"), "chunk-maps")
    maps = maps.withColumn("grp", F.floor(F.col("span") / longest))

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("span")
        at = np.arange(len(pdf["leaves"].iloc[0]))
        begun = np.zeros(len(at), np.int64)
        for leaves, more in zip(pdf["leaves"], pdf["begun"]):
            inside = np.minimum(at, len(leaves) - 1)  # beyond the end of the last span nothing follows
            begun, at = begun + np.asarray(more)[inside], np.asarray(leaves)[inside]
        return pd.DataFrame({"route": [pdf["route"].iloc[0]], "span": [pdf["grp"].iloc[0]], "leaves": [at], "begun": [begun]})

    def enter(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("span")
        at = int(pdf["at"].iloc[0]) if "at" in pdf else 0
        chunk = int(pdf["chunk"].iloc[0]) if "chunk" in pdf else 0
        out = []
        for span, leaves, begun in zip(pdf["span"], pdf["leaves"], pdf["begun"]):
            out.append((pdf["route"].iloc[0], span, at, chunk))
            if at < len(leaves):
                at, chunk = int(leaves[at]), chunk + int(begun[at])
        return pd.DataFrame(out, columns=["route", "span", "at", "chunk"])

    where = "route string, span bigint, at bigint, chunk bigint"
    grouped = maps.groupBy("route", "grp").applyInPandas(compose, "route string, span bigint, leaves array<bigint>, begun array<bigint>")
    entered = grouped.groupBy("route").applyInPandas(enter, where).withColumnRenamed("span", "grp")
    spans = maps.join(entered, ["route", "grp"]).groupBy("route", "grp").applyInPandas(enter, where)

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos").reset_index(drop=True)
        ends, at = ends_of(pdf["tokens"].to_numpy()), int(pdf["at"].iloc[0])
        starts = np.zeros(len(pdf), np.int64)
        while at < len(pdf):
            starts[at] = 1
            at = int(ends[at])
        return pdf.assign(chunk=pdf["chunk"] + np.cumsum(starts) - 1)[["route", "wire_id", "tokens", "chunk"]]

    return own.join(spans, ["route", "span"]).groupBy("route", "span").applyInPandas(
        fill, "route string, wire_id string, tokens bigint, chunk bigint")


def _positions(requests: DataFrame, order: list[str]) -> DataFrame:
    """Rows with their place in their route: ranges of the order are ranked apart, and counts of earlier ranges added."""
    n = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = list(dict.fromkeys([*order, "wire_id"]))
    lean = requests.select("route", "wire_id", F.col("tokens").cast("bigint").alias("tokens"), *[k for k in keys if k != "wire_id"])
    dealt = staged(lean.repartitionByRange(n, "route", *keys).withColumn("part", F.spark_partition_id()), "chunk-order")
    inside = Window.partitionBy("route", "part").orderBy(*keys)
    before = Window.partitionBy("route").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("route", "part").agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.select("route", "part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    placed = dealt.withColumn("_rn", F.row_number().over(inside)).join(sizes, ["route", "part"])
    return placed.select("route", "wire_id", "tokens", (F.col("_before") + F.col("_rn") - 1).alias("pos"))
