"""Judge request tables, verdict tables, and a pluggable scorer."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import prompts as P
from ..functions import verdicts as V
from ..functions.binding import with_rules
from ..functions.labels import judge_label
from .planning import with_wire_id


def page_requests(pool: DataFrame, judges: Column, system: str = "") -> DataFrame:
    """One request per pooled page and judge; the provider is nowhere in it."""
    user = P.page_request(*[F.col(c) for c in ("query", "title", "domain", "published", "content")])
    rows = pool.select("query_id", "url", user.alias("prompt")).withColumn("model", F.explode(judges))
    rows = rows.withColumn("judge", judge_label(F.col("model")))
    return with_wire_id(rows.withColumn("tokens", P.estimate_tokens(F.lit(system), F.col("prompt"))), "query_id", "url", "judge")


def set_requests(fetches: DataFrame, judges: Column, system: str = "") -> DataFrame:
    user = P.set_request(F.col("query"), F.col("sources"))
    rows = fetches.select("query_id", "provider", user.alias("prompt")).withColumn("model", F.explode(judges))
    rows = rows.withColumn("judge", judge_label(F.col("model")))
    return with_wire_id(
        rows.withColumn("tokens", P.estimate_tokens(F.lit(system), F.col("prompt"))), "query_id", "provider", "judge"
    )


PARSERS = {
    "rung": V.parse_rung, "set": V.parse_set_score, "clamped": V.parse_clamped, "baseline": V.parse_baseline,
}


def parse_verdicts(outcomes: DataFrame, kind: str, raw: str = "raw", unfence: bool = True) -> DataFrame:
    """Typed verdict and reason per raw outcome; an empty reply reads as ``{}``."""
    text = F.when(F.coalesce(F.col(raw), F.lit("")) == "", F.lit("{}")).otherwise(F.col(raw))
    rows = with_rules(outcomes, _v=lambda: PARSERS[kind](V.unfence_json(text) if unfence else text))
    return rows.select("*", "_v.value", "_v.rationale").drop("_v")


def null_verdicts(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("judge", "rationale").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("value").isNull()).alias("n_null")
    )


Scorer = Callable[[pd.DataFrame], pd.DataFrame]


def score_with(requests: DataFrame, scorer: Scorer, key: list[str], in_flight: int | None = None) -> DataFrame:
    """Apply a caller's scorer to request batches; a failing request becomes an error row.

    The scorer maps a frame of requests to a frame with ``value`` and
    ``rationale``. A batch that fails is scored again request by request, so one
    bad request costs only its own row. ``in_flight`` caps how many batches run at once. A task that
    is retried calls the scorer again, so land results and use the resume join.
    """
    if in_flight:
        requests = requests.repartition(in_flight)
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in requests.schema.fields if f.name in key)

    def scored_part(batch: pd.DataFrame) -> pd.DataFrame:
        got, out = scorer(batch), batch[key].copy()
        out["value"] = pd.to_numeric(got["value"], errors="coerce").astype("float64").to_numpy()
        out["rationale"] = [None if pd.isna(r) else str(r) for r in got["rationale"]]
        return out.assign(error=None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                yield scored_part(batch)
            except Exception:  # noqa: BLE001 - a scorer may fail in any way; then each request stands alone
                for i in range(len(batch)):
                    one = batch.iloc[i:i + 1]
                    try:
                        yield scored_part(one)
                    except Exception as e:  # noqa: BLE001
                        yield one[key].assign(value=float("nan"), rationale="", error=str(e) or type(e).__name__)

    scored = requests.mapInPandas(run, f"{kept}, value double, rationale string, error string")
    return scored.withColumn("value", F.when(~F.isnan("value"), F.col("value")))


def landed_scores(requests: DataFrame, landed: DataFrame, key: list[str]) -> DataFrame:
    """The default scorer: the last verdict that already landed for a key, else an error row."""
    order = [c for c in ("seq", "landed_at") if c in landed.columns]
    last = landed.groupBy(*key).agg(F.max_by(F.struct("value", "rationale"), F.struct(*order, "value", "rationale")).alias("_v"))
    got = last.select(*key, "_v.value", "_v.rationale", F.lit(True).alias("_hit"))
    out = requests.select(*key).join(got, key, "left")
    return out.withColumn("error", F.when(F.col("_hit").isNull(), F.lit("no batch result"))).drop("_hit")
