"""Registered queries: dedupe, scoring, agreement, variance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import errors as E
from ..functions.stats import T95, T95_BEYOND, ci95, mean0, pearson, std0
from ..operators import agreement, dims, latest, ranks, score, variance
from ..sources import landing
from .registry import query, step
from .views import JUDGED_ORDER, JUDGES, PROVIDERS, Views

J_ORDER = list(JUDGED_ORDER)
_J_DESC = ", ".join(f"{c} desc" for c in J_ORDER)
_TRANSPORT = r"(?i)\b(ENOTFOUND|ECONNREFUSED|ECONNRESET)\b|fetch failed|connection error|network is (down|unreachable)"
_ACCOUNT = r"(?i)\b(401|402|403)\b|insufficient credit|quota exceeded|payment required|out of credits|billing"
TCRIT = (
    "case when {n} <= 1 then 0 " + "".join(
        f"when {{n}} - 1 <= {k} then {v} " for k, v in T95.items()
    ) + f"else {T95_BEYOND} end"
)


def sql_ci(x: str) -> str:
    n = f"count({x})"
    return f"case when {n} < 2 then 0 else ({TCRIT.format(n=n)}) * stddev_samp({x}) / sqrt({n}) end"


# --- shared SQL steps -------------------------------------------------------

step("fetch_faults", f"""
select *, case when error is null then 'none'
  when regexp_matches(error, '{_TRANSPORT}') then 'transport'
  when regexp_matches(error, '{_ACCOUNT}') then 'account'
  when coalesce(error_stage, 'provider') = 'provider' then 'provider' else 'ours' end as fault from fetch_log""")
step("fetches", """
select * exclude (rn) from (select *, row_number() over (partition by query_id, provider order by seq desc) rn
 from fetch_faults) where rn = 1 and fault <> 'transport'""")
step("judgements", f"""
select query_id, url, judge, rung from (select *, row_number() over
 (partition by query_id, url, judge order by {_J_DESC}) rn from judgement_log) where rn = 1 and error is null""")
step("set_verdicts", f"""
select query_id, provider, judge, score from (select *, row_number() over
 (partition by query_id, provider, judge order by {_J_DESC}) rn from set_verdict_log) where rn = 1 and error is null""")
step("panel", "select query_id, url, avg(rung) as mean_rung from judgements where rung is not null group by 1, 2")
step("relevant", "select query_id, count(*) as n_rel from panel where mean_rung >= 2 group by 1")
step("per_set", """
select r.query_id, r.provider, count(*) as n_ret, count(mean_rung) as judged, avg(mean_rung) as m,
 count(*) filter (mean_rung >= 2) as hits
from fetch_pages r left join panel p on r.query_id = p.query_id and r.url = p.url group by 1, 2""")
step("scores", """
select f.*, f.fault = 'provider' or (f.fault = 'none' and coalesce(n_ret, 0) = 0) as is_miss,
 f.fault in ('account', 'ours') or (f.fault = 'none' and coalesce(n_ret, 0) > 0 and judged = 0) as is_excluded,
 case when f.fault = 'provider' or (f.fault = 'none' and coalesce(n_ret, 0) = 0) then 0.0
   when f.fault = 'none' and judged > 0 then m end as mean_rung,
 case when f.fault = 'provider' or (f.fault = 'none' and coalesce(n_ret, 0) = 0) then 0.0
   when f.fault = 'none' and judged > 0 then hits / judged end as "precision",
 case when coalesce(n_rel, 0) > 0 then
   case when f.fault = 'provider' or (f.fault = 'none' and coalesce(n_ret, 0) = 0) then 0.0
     when f.fault = 'none' and judged > 0 then hits / n_rel end end as recall
from fetches f left join per_set s on f.query_id = s.query_id and f.provider = s.provider
 left join relevant r on f.query_id = r.query_id""")
step("cells", """
select r.query_id, r.provider, j.judge, avg(j.rung) as "value"
from fetch_pages r join fetches f on r.query_id = f.query_id and r.provider = f.provider and f.error is null
 join judgements j on r.query_id = j.query_id and r.url = j.url and j.rung is not null
group by 1, 2, 3""")

SCORE_COLS = f"""count(mean_rung) as n_queries, round(coalesce(avg(mean_rung), 0), 6) as mean_rung,
 round({sql_ci('mean_rung')}, 6) as mean_rung_ci95, round(coalesce(avg("precision"), 0), 6) as "precision",
 round({sql_ci('"precision"')}, 6) as precision_ci95, round(coalesce(avg(recall), 0), 6) as recall,
 round({sql_ci('recall')}, 6) as recall_ci95, count(recall) as n_recall_queries, count(*) as n_attempts,
 count(*) filter (is_miss) as n_misses, count(*) filter (is_excluded) as n_excluded,
 count(fetch_ms) as n_fetch_timed, cast(quantile_disc(fetch_ms, 0.5) as double) as fetch_ms_p50,
 cast(quantile_disc(fetch_ms, 0.95) as double) as fetch_ms_p95"""


# --- shared Spark steps -----------------------------------------------------

def fetches(v: Views):
    return latest.dedupe_fetches(v.landed("fetch_log"))


def judgements(v: Views):
    """Only the last rating of a judge lands, without the columns that order them."""
    def make():
        last = latest.last_write(v.dealt("judgement_log"), latest.JUDGEMENT_KEY, J_ORDER).select("query_id", "url", "judge", "rung", "error")
        return landing.land(last, "last_judgements", landing.KEYS["judgement_log"], buckets=v.parts("judgement_log"), dealt=True)

    last = v.once("last_judgements", "judgement_log", make)
    return last.where(~E.failed(F.col("error"))).select("query_id", "url", "judge", "rung")


def set_verdicts(v: Views):
    """Only the last rating of a judge lands: the log has many of one set."""
    def make():
        last = latest.last_write(v.dealt("set_verdict_log"), latest.SET_KEY, J_ORDER)
        return landing.land(last, "last_set_verdicts", landing.KEYS["set_verdict_log"], buckets=v.parts("set_verdict_log"), dealt=True)

    return v.once("last_set_verdicts", "set_verdict_log", make).where(~E.failed(F.col("error")))


def scores(v: Views):
    return score.query_scores(fetches(v), v.landed("fetch_pages"), score.panel_means(judgements(v)))


def cells(v: Views):
    return score.judge_cells(fetches(v), v.landed("fetch_pages"), judgements(v), JUDGES)


# --- D: dedupe --------------------------------------------------------------

_FETCH_OUT = ["seq", "query_id", "provider", "type", "error", "error_stage", "fetch_ms"]


@query("d01_fetch_dedupe", "select seq, query_id, provider, type, error, error_stage, fetch_ms from fetches")
def d01(v):
    return fetches(v).select(*_FETCH_OUT)


@query("d02_judgement_dedupe", "select query_id, url, judge, cast(rung as bigint) as rung from judgements")
def d02(v):
    return judgements(v)


@query("d03_arm_dedupe", """
select seq, query_id, provider, seed, error from (select *, row_number() over
 (partition by query_id, provider, seed order by seq desc) rn from arm_log) where rn = 1 and (error is null or error <> 'fetch failed')""")
def d03(v):
    return latest.dedupe_arms(v.arm_log).select("seq", "query_id", "provider", "seed", "error")


step("best_rows", """
select * exclude (rn) from (select *, row_number() over (partition by query_id, provider
 order by error is not null, fetched_at desc nulls last, seq desc) rn from fetch_faults where provider <> 'p7') where rn = 1""")


@query("d04_best_row", "select seq, query_id, provider, error from best_rows")
def d04(v):
    return latest.best_fetches(v.landed("fetch_log"), controls=("p7",)).select("seq", "query_id", "provider", "error")


step("good_judgements", f"""
select query_id, url, judge, rung from (select *, row_number() over (partition by query_id, url, judge order by {_J_DESC}) rn
 from judgement_log where error is null and rung is not null) where rn = 1""")


@query("d05_last_good_judgement", "select query_id, url, judge, cast(rung as bigint) as rung from good_judgements")
def d05(v):
    def make():
        good = latest.last_good_verdicts(v.dealt("judgement_log"), latest.JUDGEMENT_KEY, "rung", J_ORDER).select("query_id", "url", "judge", "rung")
        return landing.land(good, "good_judgements", landing.KEYS["judgement_log"], buckets=v.parts("judgement_log"), dealt=True)

    return v.once("good_judgements", "judgement_log", make)


@query("d06_resume_fetch_keys", "select distinct query_id, provider from fetch_faults where fault not in ('transport', 'account')")
def d06(v):
    return latest.resumable_fetches(v.landed("fetch_log"))


@query("d07_resume_arm_keys", "select distinct query_id, provider, seed from arm_log where error is null or error <> 'fetch failed'")
def d07(v):
    return latest.resumable_arms(v.arm_log)


@query("d08_resume_verdict_keys", "select distinct query_id, url, judge from judgement_log where error is null")
def d08(v):
    return latest.resumable_verdicts(v.dealt("judgement_log"), latest.JUDGEMENT_KEY)


@query("d12_judgeable_sets", "select seq, query_id, provider, num_sources from fetches where error is null and num_sources > 0")
def d12(v):
    return latest.judgeable_fetches(fetches(v), F.col("num_sources")).select("seq", "query_id", "provider", "num_sources")


# --- F5-F8: failure attribution ---------------------------------------------

@query("f05_f08_failure_attribution", """
select provider, fault, coalesce(error_stage, 'unknown') as stage, count(*) as n from fetch_faults group by 1, 2, 3""")
def f05(v):
    log = v.fetch_log.withColumns({
        "fault": E.fault_class(F.col("error"), F.col("error_stage")),
        "stage": E.stage_of(F.col("error_stage")),
    })
    return log.groupBy("provider", "fault", "stage").agg(F.count(F.lit(1)).alias("n"))


# --- A: statistics ----------------------------------------------------------

@query("a01_a03_mean_std_ci", f"""
select provider, seed, round(coalesce(avg(ret_a), 0), 6) as mean, round(coalesce(stddev_samp(ret_a), 0), 6) as std,
 round({sql_ci('ret_a')}, 6) as ci95 from arm_log group by 1, 2""")
def a01(v):
    x = F.col("ret_a")
    return v.arm_log.groupBy("provider", "seed").agg(mean0(x).alias("mean"), std0(x).alias("std"), ci95(x).alias("ci95"))


@query("a04_nearest_rank_percentile", """
select provider, count(fetch_ms) as n, cast(quantile_disc(fetch_ms, 0.5) as double) as p50,
 cast(quantile_disc(fetch_ms, 0.95) as double) as p95 from fetch_log where fetch_ms is not null group by 1""")
def a04(v):
    return ranks.percentiles(v.fetch_log, ["provider"], "fetch_ms", {"p50": 0.5, "p95": 0.95})


@query("a04_continuous_percentiles", """
select l_returnflag as judge, count(*) as n, quantile_disc(l_extendedprice, 0.01) as p01, quantile_disc(l_extendedprice, 0.5) as p50,
 quantile_disc(l_extendedprice, 0.95) as p95 from lineitem group by 1""")
def a04_continuous(v):
    """The same over values that hardly repeat."""
    rows = v.lineitem.select(F.col("l_returnflag").alias("judge"), "l_extendedprice")
    return ranks.percentiles(rows, ["judge"], "l_extendedprice", {"p01": 0.01, "p50": 0.5, "p95": 0.95})


step("ranked_ms", """
select provider, fetch_ms, row_number() over (partition by provider order by fetch_ms) as i,
 count(*) over (partition by provider) as n from fetch_log where fetch_ms is not null""")


@query("a05_floor_quantile", """
select provider, max(n) as n, cast(max(case when i = least(n, floor(0.5 * n) + 1) then fetch_ms end) as double) as p50,
 cast(max(case when i = least(n, floor(0.9 * n) + 1) then fetch_ms end) as double) as p90 from ranked_ms group by 1""")
def a05(v):
    return ranks.floor_quantiles(v.fetch_log, ["provider"], "fetch_ms", {"p50": 0.5, "p90": 0.9})


@query("a06_median_rounded", """
select provider, count(*) as n, case when count(*) % 2 = 1 then median(fetch_ms)
 else floor(median(fetch_ms) + 0.5) end as median from fetch_log where fetch_ms is not null group by 1""")
def a06(v):
    return ranks.medians(v.fetch_log, ["provider"], "fetch_ms", rounded=True)


@query("a07_median", """
select provider, count(*) as n, cast(median(fetch_ms) as double) as median from fetch_log
where fetch_ms is not null group by 1""")
def a07(v):
    return ranks.medians(v.fetch_log, ["provider"], "fetch_ms", rounded=False)


@query("a09_pearson", """
select provider, round(covar_pop(ret_a, ret_b) / (stddev_pop(ret_a) * stddev_pop(ret_b)), 6) as r, count(*) as n
from arm_log group by 1""")
def a09(v):
    return v.arm_log.groupBy("provider").agg(pearson(F.col("ret_a"), F.col("ret_b")).alias("r"), F.count(F.lit(1)).alias("n"))


@query("a10_panel_means", "select query_id, url, round(mean_rung, 6) as mean_rung from panel")
def a10(v):
    return score.panel_means(judgements(v))


@query("a11_relevant_set", "select query_id, n_rel as n_relevant from relevant")
def a11(v):
    return score.relevant_counts(score.panel_means(judgements(v)))


@query("j04_verdict_lookup", """
select r.query_id, r.provider, r.url, round(mean_rung, 6) as mean_rung
from fetch_pages r left join panel p on r.query_id = p.query_id and r.url = p.url""")
def j04(v):
    return score.page_verdicts(v.landed("fetch_pages"), score.panel_means(judgements(v)))


@query("a12_query_score", """
select query_id, provider, is_miss, is_excluded, round(mean_rung, 6) as mean_rung,
 round("precision", 6) as "precision", round(recall, 6) as recall from scores""")
def a12(v):
    return scores(v).select("query_id", "provider", "is_miss", "is_excluded", "mean_rung", "precision", "recall")


@query("a13_provider_stat", f"select provider, {SCORE_COLS} from scores group by 1")
def a13(v):
    return score.provider_stats(scores(v)).drop("slice", "slice_value")


_NO_VALUES = "count(mean_rung)"


@query("a14_sliced_provider_stat", f"""
select s.slice, s.slice_value, s.provider, coalesce(n_queries, 0) as n_queries, coalesce(mean_rung, 0) as mean_rung,
 coalesce(mean_rung_ci95, 0) as mean_rung_ci95, coalesce("precision", 0) as "precision",
 coalesce(precision_ci95, 0) as precision_ci95, coalesce(recall, 0) as recall, coalesce(recall_ci95, 0) as recall_ci95,
 coalesce(n_recall_queries, 0) as n_recall_queries, coalesce(n_attempts, 0) as n_attempts,
 coalesce(n_misses, 0) as n_misses, coalesce(n_excluded, 0) as n_excluded, coalesce(n_fetch_timed, 0) as n_fetch_timed,
 fetch_ms_p50, fetch_ms_p95
from (select slice, slice_value, provider from (select distinct slice, slice_value from sliced_scores)
 cross join (select distinct provider from scores)) s
left join (select slice, slice_value, provider, {SCORE_COLS} from sliced_scores group by 1, 2, 3) g
 on s.slice = g.slice and s.slice_value = g.slice_value and s.provider = g.provider""")
def a14(v):
    return score.provider_stats(scores(v), ("type", "sharpness", "genre"), PROVIDERS)


step("sliced_scores", """
select 'all' as slice, '' as slice_value, * from scores
union all select 'type', type, * from scores
union all select 'sharpness', sharpness, * from scores where sharpness is not null
union all select 'genre', genre, * from scores where genre is not null""")
step("graded", "select query_id, provider, avg(score) as g from set_verdicts where score is not null group by 1, 2")
step("set_scores", """
select f.*, f.fault = 'provider' or (f.fault = 'none' and f.num_sources = 0) as is_miss,
 case when f.fault = 'provider' or (f.fault = 'none' and f.num_sources = 0) then 0.0 when f.fault = 'none' then g end as set_score
from fetches f left join graded s on f.query_id = s.query_id and f.provider = s.provider""")
step("set_stats", f"""
select provider, count(set_score) as n_queries, coalesce(avg(set_score), 0) as mean_score, {sql_ci('set_score')} as mean_score_ci95,
 count(*) filter (is_miss) as n_misses, count(*) filter (set_score is null) as n_excluded from set_scores group by 1""")


def set_stats(v):
    return score.set_stats(score.set_scores(fetches(v), F.col("num_sources"), set_verdicts(v)))


@query("a15_set_stat", """
select provider, n_queries, round(mean_score, 6) as mean_score, round(mean_score_ci95, 6) as mean_score_ci95,
 n_misses, n_excluded from set_stats""")
def a15(v):
    return set_stats(v)


# --- agreement --------------------------------------------------------------

step("judge_pairs", """
select a.judge as judge_a, b.judge as judge_b from (values ('A'), ('N'), ('R')) a(judge)
join (values ('A'), ('N'), ('R')) b(judge) on a.judge < b.judge""")
step("aligned", """
select a.query_id, a.url, a.judge as judge_a, b.judge as judge_b, a.rung as ra, b.rung as rb
from judgements a join judgements b on a.query_id = b.query_id and a.url = b.url and a.judge < b.judge
where a.rung is not null and b.rung is not null""")
_KAPPA = """
select {k}judge_a, judge_b, count(*) as n, avg(case when ra = rb then 1.0 else 0 end) as po,
 sum(case when ra = 0 then 1.0 else 0 end) / count(*) * (sum(case when rb = 0 then 1.0 else 0 end) / count(*))
 + sum(case when ra = 1 then 1.0 else 0 end) / count(*) * (sum(case when rb = 1 then 1.0 else 0 end) / count(*))
 + sum(case when ra = 2 then 1.0 else 0 end) / count(*) * (sum(case when rb = 2 then 1.0 else 0 end) / count(*))
 + sum(case when ra = 3 then 1.0 else 0 end) / count(*) * (sum(case when rb = 3 then 1.0 else 0 end) / count(*)) as pe
from {src} group by all"""
step("kappas", _KAPPA.format(k="", src="aligned"))
step("question_tags", "select query_id, max(sharpness) as sharpness from fetches group by 1")
step("aligned_tagged", "select a.*, t.sharpness from aligned a join question_tags t on a.query_id = t.query_id where t.sharpness is not null")
step("kappas_tagged", _KAPPA.format(k="sharpness, ", src="aligned_tagged"))
_KAPPA_OUT = "round(coalesce(po, 0), 6) as raw_agreement, round(case when n is null or pe >= 1 then 0 else (po - pe) / (1 - pe) end, 6) as kappa, coalesce(n, 0) as n"


@query("j06_judge_alignment", "select judge_a, judge_b, cast(ra as bigint) as a, cast(rb as bigint) as b, count(*) as c from aligned group by all")
def j06(v):
    return agreement.contingency(judgements(v), JUDGES)


@query("a16_judge_agreement", f"""
select p.judge_a, p.judge_b, {_KAPPA_OUT} from judge_pairs p left join kappas k on p.judge_a = k.judge_a and p.judge_b = k.judge_b""")
def a16(v):
    return agreement.panel_agreement(judgements(v), JUDGES)


@query("a16_label_agreement", """
with w as (select quality as ra, toxic as rb from labels),
s as (select count(*) as n, avg(case when ra = rb then 1.0 else 0 end) as po,
 avg(case when ra = 0 then 1.0 else 0 end) * avg(case when rb = 0 then 1.0 else 0 end)
 + avg(case when ra = 1 then 1.0 else 0 end) * avg(case when rb = 1 then 1.0 else 0 end) as pe from w)
select 'quality' as judge_a, 'toxic' as judge_b, round(po, 6) as raw_agreement, round((po - pe) / (1 - pe), 6) as kappa, n from s""")
def a16b(v):
    rated = v.panel_labels.select(F.lit("labels").alias("query_id"), F.col("doc_id").cast("string").alias("url"), "judge", "rung")
    return agreement.panel_agreement(rated, ["quality", "toxic"])


def _question_tags(v):
    return fetches(v).groupBy("query_id").agg(F.max("sharpness").alias("sharpness"))


@query("a17_agreement_by_sharpness", f"""
select t.sharpness, p.judge_a, p.judge_b, {_KAPPA_OUT}
from (select distinct sharpness from question_tags where sharpness is not null) t cross join judge_pairs p
left join kappas_tagged k on p.judge_a = k.judge_a and p.judge_b = k.judge_b and t.sharpness = k.sharpness""")
def a17(v):
    return agreement.agreement_by_tag(judgements(v), _question_tags(v), "sharpness", JUDGES)


@query("a18_rung_distribution", """
select judge, count(*) filter (rung = 0) as n_rung_0, count(*) filter (rung = 1) as n_rung_1,
 count(*) filter (rung = 2) as n_rung_2, count(*) filter (rung = 3) as n_rung_3, count(*) filter (rung is null) as n_null
from judgements group by 1""")
def a18(v):
    return score.rung_distribution(judgements(v))


# --- variance ---------------------------------------------------------------

step("variance", """
select count(*) as n_cells, sum((value - g) * (value - g)) as total, sum((mp - g) * (mp - g)) as provider,
 sum((mq - g) * (mq - g)) as query, sum((mj - g) * (mj - g)) as judge,
 sum((mqp - mq - mp + g) * (mqp - mq - mp + g)) as provider_by_query
from (select value, avg(value) over () as g, avg(value) over (partition by provider) as mp,
 avg(value) over (partition by query_id) as mq, avg(value) over (partition by judge) as mj,
 avg(value) over (partition by query_id, provider) as mqp from cells)""")


@query("a19_variance_shares", """
select round(provider / total, 6) as provider, round(query / total, 6) as query, round(judge / total, 6) as judge,
 round(provider_by_query / total, 6) as provider_by_query,
 round(greatest(0, total - provider - query - judge - provider_by_query) / total, 6) as residual, n_cells from variance""")
def a19(v):
    return variance.variance_shares(cells(v))


@query("a20_variance_cells", 'select query_id, provider, judge, round("value", 6) as "value" from cells')
def a20(v):
    return cells(v)


@query("a21_run_counters", """
select (select count(distinct query_id) from fetches) as n_queries, count(*) as n_pairs, cast(sum(n) as bigint) as n_judgements,
 cast(sum(n - rated) as bigint) as n_null_rungs, count(*) filter (rated = 0) as n_unjudged_pairs,
 (select count(*) from judgement_log where error is not null) as n_judge_errors
from (select query_id, url, count(*) as n, count(rung) as rated from judgements group by 1, 2)""")
def a21(v):
    return score.run_counters(fetches(v), judgements(v), v.judgement_log)


@query("a50_map_not_ranking", """
select round(provider / total, 6) as provider, round(provider_by_query / total, 6) as provider_by_query,
 n_cells > 0 and provider / total < 0.05 and provider_by_query > provider * 2 as map_not_ranking from variance""")
def a50(v):
    return variance.map_not_ranking(variance.variance_shares(cells(v)))


# --- J: matrices and resume -------------------------------------------------

@query("j01_matrix", """
select id as query_id, provider, seed from (select id from questions) cross join
 (select 'p' || cast(i as varchar) as provider from range(8) t(i)) cross join (select i as seed from range(3) s(i))""")
def j01(v):
    return dims.seed_matrix(v.questions.select(F.col("id").alias("query_id")), PROVIDERS, 3)


step("todo", """
select query_id, provider from (select distinct query_id from fetch_log)
cross join (select 'p' || cast(i as varchar) as provider from range(9) t(i))""")


def _todo(v):
    return dims.matrix(v.landed("fetch_log").select("query_id").distinct(), provider=[f"p{i}" for i in range(9)])


@query("j02_resume_remaining", """
select t.* from todo t anti join (select query_id, provider from fetch_faults where fault not in ('transport', 'account')) d
 on t.query_id = d.query_id and t.provider = d.provider""")
def j02(v):
    return dims.remaining(_todo(v), latest.resumable_fetches(v.landed("fetch_log")), latest.FETCH_KEY)


@query("j03_matrix_filter", """
select seq, query_id, provider from fetch_log f where exists (select 1 from orders o
 where 'q' || cast(o.o_custkey as varchar) = f.query_id)""")
def j03(v):
    mine = v.orders.select(F.concat(F.lit("q"), F.col("o_custkey").cast("string")).alias("query_id"))
    return dims.belonging(v.fetch_log, mine, ["query_id"]).select("seq", "query_id", "provider")


@query("j09_missing_questions", """
select q.query_id from (select distinct query_id from fetch_log) q anti join
 (select query_id from (select *, row_number() over (partition by query_id order by seq desc) rn from fetch_log
   where provider = 'p3') where rn = 1 and error is null) d on q.query_id = d.query_id""")
def j09(v):
    mine = latest.last_write(v.fetch_log.where("provider = 'p3'"), latest.FETCH_KEY)
    done = mine.where(~E.failed(F.col("error")))
    return dims.remaining(v.fetch_log.select("query_id").distinct(), done, ["query_id"])


@query("u02_prior_and_fresh", """
select seq, query_id, provider from (select *, row_number() over (partition by query_id, provider order by seq desc) rn
 from fetch_faults) where rn = 1 and fault <> 'transport'""")
def u02(v):
    log = v.fetch_log
    middle = F.col("fetched_at").isNull()
    both = log.where(middle).unionByName(log.where(~middle), allowMissingColumns=True)
    return latest.dedupe_fetches(both).select("seq", "query_id", "provider")


@query("u03_distinct_values", """
select 'provider' as dim, provider as value from fetches union select 'type', type from fetches
union select 'day', cast(cast(fetched_at as date) as varchar) from fetches where fetched_at is not null""")
def u03(v):
    pairs = F.array(
        F.struct(F.lit("provider").alias("dim"), F.col("provider").alias("value")),
        F.struct(F.lit("type").alias("dim"), F.col("type").alias("value")),
        F.struct(F.lit("day").alias("dim"), F.to_date("fetched_at").cast("string").alias("value")),
    )
    return fetches(v).select(F.inline(pairs)).where("value is not null").distinct()
