"""The nested question document: question -> provider -> pages -> ratings.

Every level is bounded by the data model: one best row per (question,
provider), the sources of that one fetch, one rating per panel judge. Page
texts stay out. The documents are written by executors, one line per question.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def page_documents(sources: DataFrame, ratings: DataFrame, judged: DataFrame) -> DataFrame:
    """One row per returned source with its ratings and whose text was judged."""
    reason = F.coalesce("rationale", F.lit("")) if "rationale" in ratings.columns else F.lit("")
    per_page = ratings.groupBy("query_id", "url").agg(
        F.array_sort(F.collect_list(F.struct("judge", "rung", reason.alias("rationale")))).alias("ratings"),
        F.avg("rung").alias("mean_rung"), (F.max("rung") - F.min("rung")).alias("spread"),
    )
    lean = sources.select(
        "query_id", "provider", "pos", "url", "title", "domain", "published",
        F.length(F.coalesce("content", F.lit(""))).alias("own_chars"),
    )
    none = F.array().cast("array<struct<judge:string,rung:int,rationale:string>>")
    return (
        lean.join(judged, ["query_id", "url"], "left").join(per_page, ["query_id", "url"], "left")
        .withColumn("ratings", F.coalesce(F.col("ratings").cast("array<struct<judge:string,rung:int,rationale:string>>"), none))
        .withColumn("spread", F.coalesce("spread", F.lit(0)))
    )


def _given(df: DataFrame, name: str, kind: str):
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def question_documents(
    pages: DataFrame, fetches: DataFrame, questions: DataFrame, sets: DataFrame | None = None, costs: DataFrame | None = None,
) -> DataFrame:
    """One row per question with a provider-keyed map of its fetch, pages, set verdicts and price.

    ``sets`` has the last good set verdict per (query_id, provider, judge);
    ``costs`` has usd_per_query per provider.
    """
    page = F.struct("pos", "url", "title", "domain", "published", "own_chars", "judged_chars", "judged_from", "ratings", "mean_rung", "spread")
    per_arm = pages.groupBy("query_id", "provider").agg(
        F.array_sort(F.collect_list(page)).alias("pages"),
        F.avg("mean_rung").alias("mean_rung"), F.count(F.lit(1)).alias("_n_pages"),
    )
    arms = fetches.select(
        "query_id", "provider", "error", "error_stage", "fetch_ms", "fetched_at",
        _given(fetches, "num_sources", "bigint").alias("num_sources"), _given(fetches, "num_extracted", "bigint").alias("num_extracted"),
    ).join(per_arm, ["query_id", "provider"], "left")
    arms = arms.withColumn("num_sources", F.coalesce("num_sources", "_n_pages", F.lit(0)))
    verdict = "array<struct<judge:string,score:int,rationale:string>>"
    if sets is None:
        arms = arms.withColumn("set", F.array().cast(verdict)).withColumn("set_mean", F.lit(None).cast("double"))
    else:
        reason = F.coalesce("rationale", F.lit("")) if "rationale" in sets.columns else F.lit("")
        per_set = sets.groupBy("query_id", "provider").agg(
            F.array_sort(F.collect_list(F.struct("judge", "score", reason.alias("rationale")))).cast(verdict).alias("set"),
            F.avg("score").alias("set_mean"),
        )
        arms = arms.join(per_set, ["query_id", "provider"], "left").withColumn("set", F.coalesce("set", F.array().cast(verdict)))
    if costs is None:
        arms = arms.withColumn("usd", F.lit(None).cast("double"))
    else:
        arms = arms.join(costs.select("provider", F.col("usd_per_query").alias("usd")), "provider", "left")
    body = F.struct(
        "error", "error_stage", "fetch_ms", "num_sources", "num_extracted", "fetched_at", "mean_rung", "pages", "set", "set_mean", "usd")
    docs = arms.groupBy("query_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("provider", body.alias("arm"))))).alias("providers")
    )
    return questions.join(docs, "query_id")


def write_documents(docs: DataFrame, path: str) -> None:
    docs.write.mode("overwrite").json(path)
