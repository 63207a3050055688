"""Edge cases of the statistics, and brute force for the scale forms."""

import math
from fractions import Fraction
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from rankloom.functions import stats
from rankloom.operators import breakers, credibility, frontier, ranks, report, routing

LOOSE = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def one(spark, values, agg):
    return spark.createDataFrame([(v,) for v in values], "x double").agg(agg(F.col("x")).alias("o")).first()["o"]


def test_basic_stats(spark):
    assert one(spark, [2.0, 4.0, 6.0], stats.mean0) == 4
    assert one(spark, [2.0, 4.0, 6.0], stats.std0) == 2
    assert one(spark, [5.0] * 4, stats.ci95) == 0
    assert one(spark, [5.0], stats.ci95) == 0
    assert one(spark, [5.0], stats.std0) == 0
    assert one(spark, [], stats.mean0) == 0
    assert one(spark, [1.0, 3.0], stats.ci95) == pytest.approx(12.706 * math.sqrt(2) / math.sqrt(2))


def test_t_table_takes_the_next_key_up(spark):
    got = spark.createDataFrame([(d,) for d in (0, 1, 10, 11, 16, 29, 30, 31)], "d int").select(stats.t_crit(F.col("d"))).collect()
    assert [r[0] for r in got] == [0.0, 12.706, 2.228, 2.131, 2.086, 2.042, 2.042, 1.96]


def test_pearson(spark):
    def r(pairs):
        return spark.createDataFrame(pairs, "a double, b double").agg(stats.pearson(F.col("a"), F.col("b")).alias("r")).first()["r"]

    assert r([(1.0, 2.0), (2.0, 4.0), (3.0, 6.0)]) == pytest.approx(1)
    assert r([(1.0, 6.0), (2.0, 4.0), (3.0, 2.0)]) == pytest.approx(-1)
    assert r([(1.0, 6.0), (1.0, 4.0)]) == 0
    assert r([(1.0, 6.0)]) == 0


def test_nearest_rank_percentile(spark):
    df = spark.createDataFrame([("k", float(x)) for x in range(10, 101, 10)] + [("none", None)], "k string, x double")
    got = ranks.percentiles(df, ["k"], "x", {"p50": 0.5, "p95": 0.95}).collect()
    assert [(r["k"], r["n"], r["p50"], r["p95"]) for r in got] == [("k", 10, 50.0, 100.0)]


@LOOSE
@given(st.lists(st.one_of(st.integers(-50, 50), st.floats(-1e9, 1e9)), min_size=1, max_size=60), st.sampled_from([0.0, 0.1, 0.5, 0.9, 0.95, 1.0]))
def test_ranks_match_sorting(spark, xs, p):
    xs = [float(x) for x in xs]
    df = spark.createDataFrame([("k", x) for x in xs], "k string, x double")
    near = ranks.percentiles(df, ["k"], "x", {"v": p}).first()["v"]
    low = ranks.floor_quantiles(df, ["k"], "x", {"v": p}).first()["v"]
    mid = ranks.medians(df, ["k"], "x", rounded=False).first()["median"]
    s, n = sorted(xs), len(xs)
    assert near == s[min(max(math.ceil(p * n), 1), n) - 1]
    assert low == s[min(n - 1, math.floor(p * n))]
    assert mid == (s[n // 2] if n % 2 else (s[n // 2 - 1] + s[n // 2]) / 2)


def test_a_key_of_many_distinct_values(spark):
    n = 2_000_000
    df = spark.range(n, numPartitions=8).select(F.lit("k").alias("k"), (F.rand(7) * 1e9 - F.rand(8) * 1e3).alias("x"))
    xs = np.sort(df.select("x").toPandas()["x"].to_numpy())
    got = ranks.percentiles(df, ["k"], "x", {"low": 1e-6, "mid": 0.5, "high": 0.999}).first()
    assert [got["low"], got["mid"], got["high"]] == [xs[math.ceil(p * n) - 1] for p in (1e-6, 0.5, 0.999)] and got["n"] == n
    one_bucket = spark.range(200_000).select(F.lit("k").alias("k"), (1e6 + F.col("id") * 1e-9).alias("x"))
    assert ranks.medians(one_bucket, ["k"], "x", rounded=False).first()["median"] == (1e6 + 99_999 * 1e-9 + (1e6 + 100_000 * 1e-9)) / 2


@LOOSE
@given(st.lists(st.floats(allow_nan=False, allow_infinity=True), min_size=1, max_size=40), st.sampled_from([0.0, 0.3, 0.5, 1.0]))
def test_ranks_of_any_doubles(spark, xs, p):
    got = ranks.percentiles(spark.createDataFrame([("k", x) for x in xs + [math.nan]] + [(None, 1.0)], "k string, x double"), ["k"], "x", {"v": p}).collect()
    assert [(r.n, r.v) for r in got] == [(len(xs), sorted(xs)[min(max(math.ceil(p * len(xs)), 1), len(xs)) - 1])]


def test_digits_leave_few_values():
    """Two digits cut every bucket of doubles down to about 2^14 neighbours."""
    for low in (1.0, 1e6, 12345.678, 1e-3, 1e300):
        high = low * math.exp(1 / 64)
        part = (high - low) / (ranks.PARTS - 1) ** 2
        assert part / math.ulp(low) < 1 << 15


def test_sketches_merge_and_stay_near(spark):
    n = 200_000
    df = spark.range(n, numPartitions=8).select((F.col("id") % 2).alias("k"), (F.col("id") % 10).alias("day"), (F.hash("id") % 100_003).cast("double").alias("x"))
    parts = ranks.sketches(df.unionByName(spark.createDataFrame([(0, 0, None), (0, 0, math.nan)], "k long, day long, x double")), ["k", "day"], "x")
    assert parts.count() == 10
    got = {r.k: r for r in ranks.sketched_percentiles(ranks.merged(parts, ["k"]), ["k"], {"p1": 0.01, "p50": 0.5, "p99": 0.99}).collect()}
    for k in (0, 1):
        xs = np.sort(df.where(F.col("k") == k).select("x").toPandas()["x"].to_numpy())
        assert got[k].n == len(xs) == n // 2
        for name, p in (("p1", 0.01), ("p50", 0.5), ("p99", 0.99)):
            assert abs(np.searchsorted(xs, got[k][name]) / len(xs) - p) < 0.012


def test_median_rounds_the_middle_pair_half_up(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", -2.0), ("b", -3.0), ("c", 7.5)], "k string, x double")
    got = {r["k"]: r["median"] for r in ranks.medians(df, ["k"], "x", rounded=True).collect()}
    assert got == {"a": 2.0, "b": -2.0, "c": 7.5}


def test_sign_test(spark):
    def p(n, k):
        return spark.range(1).select(stats.sign_test_p(F.lit(n), F.lit(k)).alias("p")).first()["p"]

    assert round(p(12, 1), 4) == 0.0063
    assert p(0, 0) == 1.0
    assert p(4, 2) == 1.0
    for n, k in ((1, 0), (2, 1), (7, 2), (33, 16), (999, 470), (1001, 480), (1400, 650), (5000, 2500), (5000, 2300)):
        exact = min(1.0, float(Fraction(2 * sum(math.comb(n, i) for i in range(k + 1)), 2**n)))
        assert p(n, k) == pytest.approx(exact, rel=1e-9)


@LOOSE
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), min_size=1, max_size=40))
def test_dominance_matches_the_pairwise_definition(spark, pts):
    df = spark.createDataFrame([(i, float(c), float(r)) for i, (c, r) in enumerate(pts)], "id int, cost double, rating double")
    got = {r["id"]: r["beaten"] for r in frontier.dominance(df, ranges=4).collect()}
    want = {
        i: any(c2 <= c and r2 >= r and (c2 < c or r2 > r) for c2, r2 in pts) for i, (c, r) in enumerate(pts)
    }
    assert got == want


def test_published_frontier(spark, rows):
    # Price per query and set rating of eight providers.
    pts = [("serper", 0.001, 2.123), ("perplexity", 0.005, 2.768), ("brave", 0.005, 2.611), ("parallel", 0.005, 2.556),
           ("exa", 0.0141, 2.549), ("tavily", 0.054, 2.149), ("firecrawl", 0.0856, 2.064), ("bright_data", 0.0129, 1.95)]
    df = spark.createDataFrame(pts, "provider string, cost double, rating double")
    assert [r["provider"] for r in frontier.frontier(df).collect()] == ["serper", "perplexity"]


def _dead_by_hand(log, limit):
    tally, out = {}, {}
    for run, p, _, error in log:
        if error == "fetch failed":
            continue
        okn, badn = tally.get((run, p), (0, 0))
        tally[run, p] = okn, badn = (okn, badn + 1) if error else (okn + 1, badn)
        if okn == 0 and badn >= limit:
            out.setdefault((run, p), _)
    return out


def _network_by_hand(log, limit):
    streak, out = {}, {}
    for run, _, seq, error in log:
        streak[run] = streak.get(run, 0) + 1 if error == "fetch failed" else 0
        if streak[run] >= limit:
            out.setdefault(run, seq)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_breakers_match_a_row_by_row_walk(spark, seed):
    rng = random.Random(seed)
    log = [(rng.choice(["r1", "r1", "r2"]), f"p{rng.randrange(4)}", i, rng.choices([None, "fetch failed", "500"], [2, 4, 3])[0]) for i in range(400)]
    df = spark.createDataFrame(log, "run_id string, provider string, seq bigint, error string").repartition(5)
    dead = {(r["run_id"], r["provider"]): r["dead_at"] for r in breakers.dead_providers(df, limit=3).collect()}
    assert dead == _dead_by_hand(log, 3)
    for span in (1, 7, 1000):
        net = {r["run_id"]: r["dead_at"] for r in breakers.network_dead(df, limit=4, span=span).collect()}
        assert net == _network_by_hand(log, 4)


ARMS = "query_id string, type string, provider string, seed int, judgements array<struct<judge:string,retrieval_score:double,retrieval_rationale:string,answer_score:double,answer_rationale:string>>, error string, error_stage string, fetch_ms bigint"


def arm(q, p, seed, a, b, error=None, why="fine"):
    js = [] if error else [("ja", float(a), why, float(a), "fine"), ("jb", float(b), "fine", float(b), "fine")]
    return (q, "t", p, seed, js, error, None, 10)


def test_first_generation_summary(spark):
    arms = spark.createDataFrame([
        arm("q1", "bright_data", 0, 5, 7), arm("q1", "bright_data", 1, 5, 7), arm("q2", "bright_data", 0, 5, 7),
        arm("q1", "firecrawl", 0, 7, 9), arm("q1", "firecrawl", 1, 7, 9), arm("q2", "firecrawl", 0, 0, 0, "HTTP 500"),
    ], ARMS)
    st_ = {r["provider"]: r for r in credibility.provider_stats(arms).collect()}
    assert (st_["bright_data"]["retrieval_mean"], st_["bright_data"]["n_queries"]) == (6.0, 2)
    assert (st_["firecrawl"]["retrieval_mean"], st_["firecrawl"]["n_queries"], st_["firecrawl"]["n_errors"]) == (8.0, 1, 1)
    c = credibility.counters(arms).first()
    assert (c["n_rows"], c["n_errors"], c["n_queries"]) == (6, 1, 2)
    ag = credibility.agreement(arms, "ja", "jb").where("metric = 'retrieval'").first()
    assert (ag["mean_abs_diff"], ag["within_1_rate"], ag["n"]) == (2.0, 0.0, 5)
    v = credibility.variance(arms, "ja", "jb").first()
    assert (v["seed_std_mean"], v["judge_gap_mean"]) == (0.0, 2.0)


def cell(p, mean, ci=0.1, ans=5.0, err=0.0, t="x"):
    return (t, p, mean, ci, ans, 8, err)


@pytest.mark.parametrize("cells,pick,why", [
    ([cell("a", 8.0)], "a", "unopposed"),
    ([cell("a", 8.0, 0.5), cell("b", 7.0)], "a", "retrieval"),
    ([cell("a", 8.0, 2.0, err=0.3), cell("b", 7.9)], "b", "reliability"),
    ([cell("a", 8.0, 2.0), cell("b", 7.9)], "a", "inconclusive"),
    ([cell("a", 9.0, 0.1, err=0.3), cell("b", 7.0, err=0.01)], "b", "reliability"),
    ([cell("a", 9.0, 0.1, err=0.21), cell("b", 7.0, err=0.2)], "a", "retrieval"),
    ([cell("a", 9.0, float("inf")), cell("b", 1.0)], "a", "inconclusive"),
])
def test_routing_decisions(spark, cells, pick, why):
    df = spark.createDataFrame(cells, "type string, provider string, retrieval_mean double, retrieval_ci95 double, answer_mean double, n_queries bigint, error_rate double")
    r = routing.best_per_type(df).first()
    assert (r["provider"], r["decided_by"]) == (pick, why)


def test_leader_calls(spark):
    rows = [("clear", "a", 8.0), ("clear", "b", 6.9), ("close", "a", 8.0), ("close", "b", 7.5), ("tie", "a", 8.0), ("tie", "b", 8.0), ("tie", "c", 1.0)]
    df = spark.createDataFrame([(*r, 3) for r in rows], "type string, provider string, score double, runs bigint")
    got = {r["type"]: (r["leads"], r["too_close"]) for r in routing.leader_calls(df).collect()}
    assert got == {"clear": ("a", False), "close": (None, True), "tie": (None, False)}


def test_number_checks_have_three_states(spark):
    got = spark.createDataFrame([("a", 2.0), ("b", 62.6), ("c", 5.0), ("d", None), ("e", 62.4)], "label string, got double")
    want = spark.createDataFrame([("a", 2.0, 0.0), ("b", 62.0, 0.6), ("c", 9.0, 0.6), ("d", 1.0, 0.0), ("e", 62.0, 0.6)], "label string, want double, tolerance double")
    checks = report.check_numbers(got, want)
    assert {r["label"]: r["state"] for r in checks.collect()} == {"a": "PASS", "b": "PASS~", "c": "FAIL", "d": "FAIL", "e": "PASS"}
    with pytest.raises(Exception, match="did not reproduce"):
        report.require_all_pass(checks).collect()


def test_tie_groups_chain_through_neighbours(spark):
    df = spark.createDataFrame([("r", p, m, 0.2) for p, m in (("a", 3.0), ("b", 2.7), ("c", 2.4), ("d", 1.0))], "run string, provider string, mean double, ci95 double")
    got = {r["provider"]: (r["tie_group"], r["tied"]) for r in report.tie_groups(df, "run").collect()}
    assert got == {"a": (0, True), "b": (0, True), "c": (0, True), "d": (1, False)}
