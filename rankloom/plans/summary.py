"""Whole-run summaries as sets of tables, one per list of the run's results.

Shared intermediates are written once under the shared folder and read back by
every table that hangs off them, so no table recomputes another's work and a
lost executor costs one stage, not the run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.errors import failed
from ..operators import agreement, baseline, credibility, frontier, latest, pool, report, score, variance
from ..session import staged
from ..sources.logs import write_snapshot


def returned_sets(fetches: DataFrame) -> DataFrame:
    """Distinct normalised pages of each fetch that landed, from its ``urls``."""
    ok = fetches.where(~failed(F.col("error")))
    return ok.select("query_id", "provider", F.explode(F.array_distinct("urls")).alias("url"))


def pooled_summary(
    fetch_log: DataFrame, judgement_log: DataFrame, set_verdict_log: DataFrame, judges: list[str], providers: list[str]
) -> dict[str, DataFrame]:
    """Everything the pooled run reports, from its three logs (judges by label, providers as declared)."""
    fetches = staged(latest.dedupe_fetches(fetch_log.drop("sources")), "fetches")
    judgements = staged(
        latest.dedupe_verdicts(judgement_log, latest.JUDGEMENT_KEY).select("query_id", "url", "judge", "rung"), "judgements"
    )
    sets = latest.dedupe_verdicts(set_verdict_log, latest.SET_KEY)
    returned = staged(returned_sets(fetches), "returned")
    scores = staged(score.query_scores(fetches, returned, score.panel_means(judgements)), "scores")
    cells = staged(score.judge_cells(fetches, returned, judgements, judges), "cells")
    tags = fetches.where("sharpness is not null").groupBy("query_id").agg(F.max_by("sharpness", "seq").alias("sharpness"))
    shares = variance.variance_shares(cells)
    return {
        "counters": score.run_counters(fetches, judgements, judgement_log),
        "by_provider": score.provider_stats(scores).drop("slice", "slice_value"),
        "by_slice": score.provider_stats(scores, ("type", "sharpness", "genre"), providers),
        "by_provider_set": score.set_stats(score.set_scores(fetches, F.coalesce(F.size("urls"), F.lit(0)), sets)),
        "agreement": agreement.panel_agreement(judgements, judges),
        "agreement_by_sharpness": agreement.agreement_by_tag(judgements, tags, "sharpness", judges),
        "rung_distribution": score.rung_distribution(judgements),
        "variance_shares": shares,
        "map_not_ranking": variance.map_not_ranking(shares),
    }


def arm_summary(arm_log: DataFrame, judges: list[str], providers: list[str]) -> dict[str, DataFrame]:
    """The first-generation summary; variance uses the first two judges."""
    arms = staged(latest.dedupe_arms(arm_log), "arms")
    pairs = [(a, b) for i, a in enumerate(judges) for b in judges[i + 1:]]
    tables = {
        "counters": credibility.counters(arms),
        "by_provider": credibility.provider_stats(arms),
        "by_type": credibility.provider_stats(arms, by_type=True, providers=providers),
    }
    if pairs:
        agreed = [credibility.agreement(arms, a, b) for a, b in pairs]
        tables["agreement"] = agreed[0]
        for more in agreed[1:]:
            tables["agreement"] = tables["agreement"].unionByName(more)
        tables["variance"] = credibility.variance(arms, *pairs[0])
    return tables


def report_tables(
    fetch_log: DataFrame, judgement_log: DataFrame, set_means: DataFrame, groups: DataFrame, costs: DataFrame,
    judges: list[str], providers: list[str], controls: tuple[str, ...] = ("plain",),
) -> dict[str, DataFrame]:
    """The published tables, from best rows and last good ratings."""
    best = latest.best_fetches(fetch_log, controls)
    lean = staged(best.drop("sources", "urls"), "best")
    clean = fetch_log.where(~failed(F.col("error")) & ~F.col("provider").isin(*controls))
    winners = lean.where(~failed(F.col("error"))).select("query_id", "provider", "seq")
    sources = pool.explode_sources(clean.join(winners, ["query_id", "provider", "seq"], "left_semi"))
    pages = staged(pool.canonical_pages(sources).select("query_id", "provider", "url", "raw_url"), "pages")
    good = pool.normalized(latest.last_good_verdicts(judgement_log, latest.JUDGEMENT_KEY))
    rated = staged(report.rated_pages(pages, good, judges, ("seq",)), "rated")
    clean_keys = lean.where(~failed(F.col("error"))).select("query_id", "provider")
    panels = staged(report.searched(report.question_panels(pages, good, judges, providers, ("seq",)), report.clean_marks(clean_keys, groups, providers), providers), "panels")
    scored = staged(report.with_lift(report.page_scores_of(panels, providers), set_means), "page-scores")
    priced = report.attach_costs(set_means, costs)
    hist = pool.overlap(pages, "url", len(providers))
    points = priced.where("usd_per_query is not null")
    return {
        "page_scores": scored,
        "join_match": report.join_match(rated),
        "spread": report.spread(scored),
        "unanswerable_pairs": report.paired_sign_tests(report.scores_by_question(panels, "unanswerable", providers), providers),
        "overlap": hist,
        "overlap_shares": pool.overlap_shares(hist, len(providers)),
        "overlap_by_raw_url": pool.overlap(pages, "raw_url", len(providers)),
        "text_structure": report.text_structure(pool.explode_sources(clean)),
        "latency": report.latency_table(fetch_log, controls),
        "extraction_yield": report.extraction_yield(fetch_log),
        "completeness": report.completeness(lean),
        "run_window": report.run_window(fetch_log),
        "first_day": report.first_day_progress(fetch_log, controls),
        "cost_summary": report.cost_summary(priced),
        "frontier": frontier.frontier(points, "usd_per_query", "mean_score"),
    }


def baseline_summary(baseline_log: DataFrame) -> dict[str, DataFrame]:
    rows = staged(latest.dedupe_verdicts(baseline_log, latest.BASELINE_KEY), "baseline")
    majority = baseline.majority_verdicts(rows)
    return {
        "counters": baseline.baseline_counters(rows, baseline_log),
        "counts": baseline.verdict_counts(majority),
        "already_known": baseline.questions_with(majority, "knew"),
        "confidently_wrong": baseline.questions_with(majority, "wrong"),
    }


def write_summary(tables: dict[str, DataFrame], path: str) -> None:
    """One snapshot per table, replacing the last."""
    for name, table in tables.items():
        write_snapshot(table, f"{path}/{name}")
