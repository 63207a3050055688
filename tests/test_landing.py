"""Bucketed logs: what they hold, and what is read from them without a shuffle."""

import random
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from rankloom.operators import latest, report
from rankloom.plans.views import Views
from rankloom.sources import landing

SMALL = "/root/testdata/sf0.001"


@pytest.fixture
def plain_plans(spark):
    """Plans as written: no adaptive replanning, nothing broadcast."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield lambda df: df._jdf.queryExecution().executedPlan().toString()
    for k, v in kept.items():
        spark.conf.set(k, v)


def exchanges(plan):
    return sum(bool(re.search(r"\bExchange ", line)) for line in plan.split("\n") if "ReusedExchange" not in line)


@pytest.mark.parametrize("name, most", [
    ("d01_fetch_dedupe", 0), ("d02_judgement_dedupe", 0), ("d05_last_good_judgement", 0), ("j02_resume_remaining", 2), ("j04_verdict_lookup", 0),
    ("j06_judge_alignment", 1), ("a13_provider_stat", 4), ("a14_sliced_provider_stat", 6), ("a35_a36_page_scores", 6), ("a41_paired_sign_test", 5), ("a19_variance_shares", 6),
])
def test_keyed_reads_shuffle_no_log(spark, plain_plans, name, most):
    plan = plain_plans(entry.queries()[name](spark, SMALL))
    assert exchanges(plan) <= most and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_a_landed_log_holds_the_same_rows(spark, rows):
    v = Views(spark, SMALL)
    for name in landing.KEYS:
        assert rows(v.landed(name), *v.view(name).columns) == rows(v.view(name))
    assert v.landed("fetch_log") is Views(spark, SMALL).landed("fetch_log")


def test_a_key_that_holds_most_rows(spark, rows):
    log = spark.range(20_000).select(
        F.when(F.col("id") % 10 < 8, "hot").otherwise(F.concat(F.lit("q"), (F.col("id") % 97).cast("string"))).alias("query_id"),
        F.concat(F.lit("p"), (F.col("id") % 3).cast("string")).alias("provider"), F.col("id").alias("seq"),
        F.when(F.col("id") % 7 == 0, "fetch failed").alias("error"))
    landed = landing.land(log, "hot", ("query_id", "provider"), ("seq",))
    assert rows(latest.dedupe_fetches(landed)) == rows(latest.dedupe_fetches(log))
    assert landing.land(log.limit(0), "none", ("query_id", "provider")).count() == 0


def test_a_changed_file_lands_anew(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(3).write.parquet(path)
    before = landing.state_of(spark, path)
    assert before == landing.state_of(spark, path)
    spark.range(4).write.mode("append").parquet(path)
    assert before != landing.state_of(spark, path)


PROVIDERS, JUDGES = ["a", "b", "c"], ["x", "y"]


@pytest.fixture(scope="module")
def run(spark):
    """Returned pages (some twice), ratings, fetches with failures and a control, and question groups."""
    draw = random.Random(3)
    pages, rated, fetches = [], [], []
    for q in range(25):
        for u in range(8):
            pages += [(f"q{q}", p, f"u{u}") for p in PROVIDERS + ["ctl"] if draw.random() < 0.5 for _ in range(draw.randint(1, 2))]
            rated += [(f"q{q}", f"u{u}", j, draw.randint(0, 3)) for j in JUDGES if draw.random() < 0.8]
        for i, p in enumerate(PROVIDERS + ["ctl"]):
            fetches += [(f"q{q}", p, 10 * i + k, draw.choice([None, None, "500 from provider"]), f"2024-01-0{draw.randint(1, 3)}", f"t{q % 4}") for k in range(draw.randint(0, 3))]
    return (spark.createDataFrame(pages, "query_id string, provider string, url string"), spark.createDataFrame(rated, "query_id string, url string, judge string, rung int"),
            spark.createDataFrame(fetches, "query_id string, provider string, seq long, error string, fetched_at string, type string"))


def test_panels_give_what_single_pages_give(spark, run):
    pages, rated, fetches = run
    rules = ("base", F.col("type") == "t0"), ("hard", F.col("type").isin("t0", "t1")), ("unanswerable", F.col("type") == "t2")
    clean = latest.best_fetches(fetches, ("ctl",)).where("error is null").select("query_id", "provider")
    groups = report.group_by_rules(fetches, *rules)
    single = report.rated_pages(pages.join(clean, ["query_id", "provider"], "left_semi"), rated, JUDGES)
    by_question = report.question_panels(pages, rated, JUDGES, PROVIDERS)
    for marks in (report.question_marks(fetches, PROVIDERS, ("ctl",), *rules), report.clean_marks(clean, groups, PROVIDERS)):
        panels = report.searched(by_question, marks, PROVIDERS)
        got, want = ({r["provider"]: r.asDict() for r in df.collect()} for df in (report.page_scores_of(panels, PROVIDERS), report.page_scores(single, groups)))
        assert got.keys() == want.keys()
        for p in want:
            assert {k: pytest.approx(x) if isinstance(x, float) else x for k, x in want[p].items()} == got[p]
        scores = report.question_scores(single, groups, "base")
        want_pairs = {(r.a, r.b): (r.n, r.al, r.bl) for r in report.provider_pairs(scores, PROVIDERS).groupBy("a", "b").agg(
            F.count(F.lit(1)).alias("n"), F.count_if(F.col("score_a") < F.col("score_b")).alias("al"), F.count_if(F.col("score_b") < F.col("score_a")).alias("bl")).collect()}
        tests = report.paired_sign_tests(report.scores_by_question(panels, "base", PROVIDERS), PROVIDERS).collect()
        assert {(r.a, r.b): (r.n_questions, r.a_lower, r.b_lower) for r in tests} == {
            (a, b): want_pairs.get((a, b), (0, 0, 0)) for i, a in enumerate(PROVIDERS) for b in PROVIDERS[i + 1:]}
        nothing = report.paired_sign_tests(report.scores_by_question(panels, "no such group", PROVIDERS), PROVIDERS).collect()
        assert [(r.n_questions, r.ties, r.p) for r in nothing] == [(0, 0, 1.0)] * 3
