"""Explicit schemas of the append-only logs (DDL). Inference is never used.

``seq`` is the append position: "last write wins" is decided by it, since
``fetched_at`` is absent on failed rows.
"""

SOURCE = "title STRING, url STRING, published STRING, domain STRING, snippet STRING, content STRING"
CONFIG = "freshness STRING, num_sources INT, extraction STRING"
JUDGEMENT = (
    "judge STRING, retrieval_score DOUBLE, retrieval_rationale STRING, "
    "answer_score DOUBLE, answer_rationale STRING"
)

FETCH_LOG = (
    "run_id STRING, seq BIGINT, queryId STRING, type STRING, query STRING, sharpness STRING, genre STRING, "
    "provider STRING, num_sources INT, num_extracted INT, urls ARRAY<STRING>, "
    f"sources ARRAY<STRUCT<{SOURCE}>>, fetch_ms BIGINT, fetched_at STRING, from_cache BOOLEAN, "
    "error STRING, error_stage STRING"
)
JUDGEMENT_LOG = (
    "run_id STRING, seq BIGINT, queryId STRING, url STRING, judge STRING, rung INT, "
    "rationale STRING, error STRING"
)
SET_VERDICT_LOG = (
    "run_id STRING, seq BIGINT, queryId STRING, provider STRING, judge STRING, score INT, "
    "rationale STRING, error STRING"
)
ARM_LOG = (
    "seq BIGINT, queryId STRING, type STRING, query STRING, provider STRING, seed INT, num_sources INT, "
    "num_sources_extracted INT, median_source_age_days INT, domains ARRAY<STRING>, latency_ms BIGINT, "
    "fetch_ms BIGINT, fetched_at STRING, from_cache BOOLEAN, "
    f"judgements ARRAY<STRUCT<{JUDGEMENT}>>, error STRING, error_stage STRING"
)
ARM = (
    f"id STRING, provider STRING, config STRUCT<{CONFIG}>, model STRING, answer STRING, "
    f"sources ARRAY<STRUCT<{SOURCE}>>, latency_ms BIGINT, retrieval_score DOUBLE, retrieval_rationale STRING, "
    "score DOUBLE, rationale STRING, error STRING, error_stage STRING, fetch_ms BIGINT, fetched_at STRING, "
    "from_cache BOOLEAN"
)
BATCH_ROW = (
    "queryId STRING, type STRING, query STRING, provider STRING, retrieval_score DOUBLE, answer_score DOUBLE, "
    "retrieval_rationale STRING, median_source_age_days INT, num_sources INT, num_sources_extracted INT, "
    "latency_ms BIGINT, fetch_ms BIGINT, error STRING, error_stage STRING"
)
RUN_LOG = (
    "mode STRING, id STRING, batchId STRING, ts STRING, query STRING, variable STRING, winner STRING, "
    f"judge_model STRING, arms ARRAY<STRUCT<{ARM}>>, row STRUCT<{BATCH_ROW}>"
)
BASELINE_LOG = (
    "seq BIGINT, queryId STRING, query STRING, model STRING, grader STRING, answer STRING, "
    "verdict STRING, rationale STRING, error STRING"
)
QUESTION = "id STRING, type STRING, query STRING, note STRING, sharpness STRING, genre STRING"
ANCHOR = (
    "id STRING, kind STRING, query STRING, "
    "page STRUCT<title STRING, domain STRING, url STRING, published STRING, content STRING>, "
    "expected_rung DOUBLE, note STRING"
)
PROVIDER_COSTS = (
    "provider STRING, usd_per_query DOUBLE, usd_for_run DOUBLE, calls BIGINT, credits_for_run BIGINT, "
    "confidence STRING"
)
FETCH_REUSE = (
    f"key STRING, provider STRING, query STRING, config STRUCT<{CONFIG}>, seed INT, fetched_at STRING, "
    f"sources ARRAY<STRUCT<{SOURCE}>>, context STRING"
)

LOGS = {
    "runs": RUN_LOG,
    "fetches": FETCH_LOG,
    "judgements": JUDGEMENT_LOG,
    "set_verdicts": SET_VERDICT_LOG,
    "arms": ARM_LOG,
    "baseline": BASELINE_LOG,
}
