"""Worked examples of the pooled instrument."""

import pytest
from pyspark.sql import functions as F

from rankloom.operators import agreement, dims, latest, score, variance

FETCH = "seq bigint, query_id string, type string, sharpness string, provider string, error string, error_stage string, fetch_ms bigint"


def fetches(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], FETCH)


def ok(q, p, ms=100, sharp=None):
    return (q, "t", sharp, p, None, None, ms)


def bad(q, p, error, stage="provider"):
    return (q, "t", None, p, error, stage, None)


def judged(spark, *rows):
    return spark.createDataFrame(list(rows), "query_id string, url string, judge string, rung int")


def returned(spark, *rows):
    return spark.createDataFrame(list(rows), "query_id string, provider string, url string")


def test_mean_precision_and_recall(spark, rows):
    js = judged(spark, ("q", "a", "j", 3), ("q", "b", "j", 1), ("q", "c", "j", 2))
    out = score.query_scores(fetches(spark, ok("q", "p")), returned(spark, ("q", "p", "a"), ("q", "p", "b")), score.panel_means(js))
    assert rows(out, "mean_rung", "precision", "recall", "is_miss") == [(2.0, 0.5, 0.5, False)]


def test_provider_fault_is_a_zero_and_a_miss(spark, rows):
    js = judged(spark, ("q", "a", "j", 3))
    out = score.query_scores(fetches(spark, bad("q", "p", "500 from provider")), returned(spark, ("x", "p", "a")), score.panel_means(js))
    assert rows(out, "mean_rung", "precision", "recall", "is_miss") == [(0.0, 0.0, 0.0, True)]


def test_recall_is_null_without_a_relevant_page(spark, rows):
    js = judged(spark, ("q", "a", "j", 1))
    out = score.query_scores(fetches(spark, ok("q", "p")), returned(spark, ("q", "p", "a")), score.panel_means(js))
    assert rows(out, "mean_rung", "recall") == [(1.0, None)]


def test_miss_against_exclusion(spark, rows):
    js = judged(spark, ("q", "a", "j", 2))
    f = fetches(spark, ok("q", "good"), bad("q", "broken", "500"), bad("q", "broke", "402 payment required"))
    out = score.provider_stats(score.query_scores(f, returned(spark, ("q", "good", "a")), score.panel_means(js)))
    got = {r["provider"]: (r["n_queries"], r["mean_rung"], r["n_misses"], r["n_excluded"]) for r in out.collect()}
    assert got == {"good": (1, 2.0, 0, 0), "broken": (1, 0.0, 1, 0), "broke": (0, 0.0, 0, 1)}


def test_a_failed_judge_stage_is_not_the_providers_fault(spark, rows):
    js = judged(spark, ("q", "a", "j", 2))
    f = fetches(spark, bad("q", "p", "Request timed out.", "judge"), bad("q", "r", "Request timed out.", None))
    out = score.query_scores(f, returned(spark, ("z", "p", "a")), score.panel_means(js))
    assert rows(out, "provider", "is_miss", "is_excluded") == [("p", False, True), ("r", True, False)]


def test_slices_carry_only_tagged_rows_and_fill_the_grid(spark):
    js = judged(spark, ("q1", "a", "j", 3), ("q2", "b", "j", 1))
    f = fetches(spark, ok("q1", "p", sharp="sharp"), ok("q2", "r"))
    s = score.query_scores(f, returned(spark, ("q1", "p", "a"), ("q2", "r", "b")), score.panel_means(js))
    out = score.provider_stats(s, ("type", "sharpness"), ["p", "r"])
    got = {(r["slice"], r["slice_value"], r["provider"]): r["n_queries"] for r in out.collect()}
    assert got == {
        ("all", "", "p"): 1, ("all", "", "r"): 1, ("type", "t", "p"): 1, ("type", "t", "r"): 1,
        ("sharpness", "sharp", "p"): 1, ("sharpness", "sharp", "r"): 0,
    }


def test_kappa_paradox(spark):
    pairs = [(0, 0)] * 90 + [(2, 0)] * 5 + [(0, 2)] * 5
    js = judged(spark, *[("q", f"u{i}", j, v) for i, p in enumerate(pairs) for j, v in zip(("one", "two"), p)])
    r = agreement.panel_agreement(js, ["one", "two"]).first()
    assert r["raw_agreement"] == pytest.approx(0.9) and r["kappa"] < 0 and r["n"] == 100
    assert score.rung_distribution(js).where("judge = 'one'").first()["n_rung_0"] == 95


def test_agreement_by_sharpness_and_empty_pairs(spark):
    js = judged(spark, ("s", "a", "x", 3), ("s", "a", "y", 3), ("o", "b", "x", 3), ("o", "b", "y", 0))
    tags = spark.createDataFrame([("s", "sharp"), ("o", "open")], "query_id string, sharpness string")
    split = {r["sharpness"]: r["raw_agreement"] for r in agreement.agreement_by_tag(js, tags, "sharpness", ["x", "y"]).collect()}
    assert split == {"sharp": 1.0, "open": 0.0}
    assert agreement.panel_agreement(js, ["x", "y"]).first()["raw_agreement"] == 0.5
    lone = agreement.panel_agreement(js, ["x", "ghost"]).first()
    assert (lone["n"], lone["kappa"], lone["raw_agreement"]) == (0, 0.0, 0.0)


def test_constant_judges_have_zero_kappa(spark):
    js = judged(spark, *[("q", f"u{i}", j, 2) for i in range(4) for j in "xy"])
    assert agreement.panel_agreement(js, ["x", "y"]).first()["kappa"] == 0.0


def test_shared_judge_labels_are_refused(spark):
    with pytest.raises(ValueError):
        agreement.panel_agreement(judged(spark, ("q", "u", "x", 1)), ["x", "x"])


def cells(spark, values):
    return spark.createDataFrame(values, "query_id string, provider string, judge string, value double")


def test_variance_main_effect(spark):
    v = [(f"q{q}", p, j, x) for q in range(3) for p, x in (("good", 3.0), ("bad", 1.0)) for j in "ab"]
    r = variance.variance_shares(cells(spark, v)).first()
    assert r["provider"] > 0.9 and r["provider_by_query"] < 0.05 and r["n_cells"] == 12


def test_variance_interaction(spark):
    win = {("q1", "p1"): 3.0, ("q1", "p2"): 0.0, ("q2", "p1"): 0.0, ("q2", "p2"): 3.0}
    s = variance.variance_shares(cells(spark, [(q, p, j, x) for (q, p), x in win.items() for j in "ab"]))
    r = s.first()
    assert r["provider"] < 0.05 and r["provider_by_query"] > 0.9
    assert variance.map_not_ranking(s).first()["map_not_ranking"]


def test_constant_cells_have_no_shares(spark):
    r = variance.variance_shares(cells(spark, [("q", "p", "a", 2.0), ("q", "r", "a", 2.0)])).first()
    assert [r[k] for k in variance.PARTS] == [0.0] * 5


def test_dedupe_keeps_the_last_write_then_drops_transport(spark, rows):
    log = fetches(
        spark, bad("q1", "p", "fetch failed"), ok("q1", "p"), ok("q2", "p"), bad("q2", "p", "fetch failed"), bad("q3", "p", "ECONNRESET")
    )
    assert rows(latest.dedupe_fetches(log), "query_id", "error") == [("q1", None)]


def test_null_verdict_survives_a_dedupe_but_not_a_good_one(spark, rows):
    log = spark.createDataFrame(
        [(1, "q", "u", "j", 3, None), (2, "q", "u", "j", None, None), (3, "q", "u", "k", 1, None), (4, "q", "u", "k", None, "timeout")],
        "seq bigint, query_id string, url string, judge string, rung int, error string",
    )
    assert rows(latest.dedupe_verdicts(log, latest.JUDGEMENT_KEY), "judge", "rung") == [("j", None)]
    assert rows(latest.last_good_verdicts(log, latest.JUDGEMENT_KEY), "judge", "rung") == [("j", 3), ("k", 1)]


@pytest.mark.parametrize("message", ["402", "out of credits", "quota exceeded", "403 billing issue", "this request exceeds your plan"])
def test_account_failures_are_retried(spark, rows, message):
    log = fetches(spark, bad("q", "p", message), bad("q", "r", "500"))
    assert rows(latest.resumable_fetches(log)) == [("q", "r")]


def test_resume_and_remaining_make_the_matrix(spark, rows):
    qs = spark.createDataFrame([("a",), ("b",)], "query_id string")
    todo = dims.matrix(qs, provider=["p", "r"])
    done = latest.resumable_fetches(fetches(spark, ok("a", "p"), bad("b", "r", "500"), bad("b", "p", "fetch failed")))
    left = dims.remaining(todo, done, latest.FETCH_KEY)
    assert rows(left) == [("a", "r"), ("b", "p")]
    assert left.count() + dims.belonging(todo, done, latest.FETCH_KEY).count() == todo.count()


def test_clean_row_beats_a_later_failure(spark, rows):
    log = spark.createDataFrame(
        [(1, "q", "p", None, "2026-01-01"), (2, "q", "p", "500", None), (3, "q", "r", None, "2026-01-02"), (4, "q", "r", None, "2026-01-02"),
         (5, "q", "plain", None, "2026-01-02")],
        "seq bigint, query_id string, provider string, error string, fetched_at string",
    )
    assert rows(latest.best_fetches(log), "provider", "seq") == [("p", 1), ("r", 4)]


def test_a_grid_needs_its_providers_declared(spark):
    js = judged(spark, ("q1", "a", "j", 3))
    scores = score.query_scores(fetches(spark, ok("q1", "p")), returned(spark, ("q1", "p", "a")), score.panel_means(js))
    with pytest.raises(ValueError, match="declared"):
        score.provider_stats(scores, ("type",))
