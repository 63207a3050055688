"""Registered queries: first-generation arms, records, heatmaps, routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.errors import failed
from ..functions.labels import order_of
from ..operators import credibility, latest, records, routing
from .queries_score import sql_ci
from .registry import query, step
from .views import ARM_PROVIDERS, Views

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def with_judgements(log):
    """The two judges of each arm as the log's nested array."""
    def one(j, x, y):
        return F.struct(
            F.lit(j).alias("judge"), F.col(x).cast("double").alias("retrieval_score"),
            F.col("rationale_a").alias("retrieval_rationale"),
            F.col(y).cast("double").alias("answer_score"), F.lit("fine").alias("answer_rationale"),
        )

    return log.withColumn("judgements", F.array(one("ja", "ret_a", "ans_a"), one("jb", "ret_b", "ans_b")))


def arms(v: Views):
    return with_judgements(latest.dedupe_arms(v.arm_log))


def batch_rows(v: Views):
    return v.arm_log.select(
        "seq", "query_id", "type", "provider", F.concat(F.lit("query "), F.col("query_id")).alias("query"),
        F.col("ret_a").cast("double").alias("retrieval_score"), F.col("ans_a").cast("double").alias("answer_score"),
        "latency_ms", "fetch_ms", "error", "error_stage", "batch_id",
    )


def run_arms(v: Views):
    """Arms of single runs with their place in the run and an arm id."""
    from pyspark.sql import Window

    w = Window.partitionBy("id").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    return v.run_arms.withColumn("pos", F.row_number().over(w)).withColumn("arm", F.concat(F.lit("a"), F.col("pos")))


def runs(v: Views):
    """Single-run records; a run's arms are the lines of one order."""
    arm = F.struct(
        "pos", F.col("arm").alias("id"), "provider", F.lit("m").alias("model"),
        F.array(F.struct("domain"), F.struct("domain")).alias("sources"), "latency_ms",
        F.col("retrieval_score").cast("double").alias("retrieval_score"), F.lit("why").alias("retrieval_rationale"),
        F.col("score").cast("double").alias("score"), "error",
    )
    return run_arms(v).groupBy("id", "seq").agg(
        F.array_sort(F.collect_list(arm)).alias("arms"),
        F.min(F.when(~failed(F.col("error")), F.struct((-F.col("retrieval_score")).alias("s"), "pos", "arm")))["arm"].alias("winner"),
    ).select(
        "id", "seq", F.concat(F.lit("ask "), F.col("id")).alias("query"), F.lit("provider").alias("variable"), "winner",
        F.lit("judge").alias("judge_model"), "arms",
    )


def all_records(v: Views):
    body = ["query_id", "type", "query", "provider", "retrieval_score", "answer_score", "latency_ms", "fetch_ms", "error"]
    b = batch_rows(v)
    batch = records.to_batch_records(b.select(*body), F.lit("b"), F.lit("2026-08-17")).withColumn("seq", F.lit(0).cast("bigint"))
    single = records.to_run_record(runs(v), F.col("id"), F.lit("2026-08-17"))
    return batch.unionByName(single.withColumn("seq", F.lit(1).cast("bigint")), allowMissingColumns=True)


# --- A22-A26 ---------------------------------------------------------------

step("arms", """
select * exclude (rn), case when error is null then 'none' when error = 'fetch failed' then 'transport'
  when error like '402%' then 'account' when coalesce(error_stage, 'provider') = 'provider' then 'provider' else 'ours' end as fault
from (select *, row_number() over (partition by query_id, provider, seed order by seq desc) rn from arm_log)
where rn = 1 and (error is null or error <> 'fetch failed')""")
step("arm_scores", """
select query_id, type, provider, seed, 'ja' as judge, ret_a as r, ans_a as a from arms where error is null
union all select query_id, type, provider, seed, 'jb', ret_b, ans_b from arms where error is null""")


def _stat(keys: str, group: str) -> str:
    q = f"""select {keys}, query_id, avg(r) as retrieval, avg(a) as answer from arm_scores group by {group}, query_id"""
    return f"""
select {', '.join('t.' + k for k in keys.split(', '))}, n_queries, round(retrieval_mean, 6) as retrieval_mean,
 round(retrieval_ci95, 6) as retrieval_ci95, round(answer_mean, 6) as answer_mean, round(answer_ci95, 6) as answer_ci95,
 n_arms, n_errors, round(n_errors / n_arms, 6) as error_rate, n_account_errors, n_fetch_timed, fetch_ms_p50, fetch_ms_p95
from (select {keys}, count(*) as n_arms, count(*) filter (fault = 'provider') as n_errors,
  count(*) filter (fault = 'account') as n_account_errors, count(fetch_ms) as n_fetch_timed,
  cast(quantile_disc(fetch_ms, 0.5) as double) as fetch_ms_p50, cast(quantile_disc(fetch_ms, 0.95) as double) as fetch_ms_p95
  from arms group by {group}) t
join (select {keys}, count(*) as n_queries, avg(retrieval) as retrieval_mean, {sql_ci('retrieval')} as retrieval_ci95,
  avg(answer) as answer_mean, {sql_ci('answer')} as answer_ci95 from ({q}) group by {group}) s
 on {' and '.join(f't.{k} = s.{k}' for k in keys.split(', '))}"""


@query("a22_arm_provider_stat", _stat("provider", "provider"))
def a22(v):
    return credibility.provider_stats(arms(v))


@query("a23_arm_type_stat", _stat("type, provider", "type, provider"))
def a23(v):
    return credibility.provider_stats(arms(v), by_type=True, providers=ARM_PROVIDERS)


_ALIGNED = """
select 'retrieval' as metric, cast(ret_a as double) as a, cast(ret_b as double) as b, query_id, provider, seed from arms where error is null
union all select 'answer', ans_a, ans_b, query_id, provider, seed from arms where error is null"""
step("arm_aligned", _ALIGNED)


@query("j07_judges_in_row", "select * from arm_aligned")
def j07(v):
    return credibility.aligned_scores(arms(v), "ja", "jb")


@query("a24_arm_agreement", """
select metric, 'ja' as judge_a, 'jb' as judge_b, round(covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b)), 6) as pearson,
 round(avg(abs(a - b)), 6) as mean_abs_diff, round(avg(case when abs(a - b) <= 1 then 1.0 else 0 end), 6) as within_1_rate,
 count(*) as n from arm_aligned group by 1""")
def a24(v):
    return credibility.agreement(arms(v), "ja", "jb")


@query("a25_arm_variance", """
select round(avg(s), 6) as seed_std_mean, (select round(avg(abs(a - b)), 6) from arm_aligned where metric = 'retrieval') as judge_gap_mean
from (select coalesce(stddev_samp(r), 0) as s from arm_scores group by query_id, provider, judge)""")
def a25(v):
    return credibility.variance(arms(v), "ja", "jb")


@query("a26_arm_counters", """
select count(*) as n_rows, count(error) as n_errors, count(distinct query_id) as n_queries,
 2 * count(*) filter (rationale_a like '%unparseable%') as n_unparseable_judgements from arms""")
def a26(v):
    return credibility.counters(arms(v))


# --- heatmap and routing ----------------------------------------------------

step("heat", """
select g.type, g.provider, coalesce(score, 0) as score, coalesce(runs, 0) as runs from
 (select type, provider from (select distinct type from arm_log) cross join (select distinct provider from arm_log)) g
 left join (select type, provider, round(avg(ret_a), 2) as score, count(*) as runs from arm_log where error is null group by 1, 2) c
 on g.type = c.type and g.provider = c.provider""")


def heat(v):
    return routing.heatmap(batch_rows(v), ARM_PROVIDERS)


@query("a27_heatmap", "select * from heat")
def a27(v):
    return heat(v)


@query("l07_heatmap_rows", """
select type, cast(left(type, 1) as bigint) - 1 as position, max(runs) as runs,
 max(case when provider = 'p0' then score end) as p0, max(case when provider = 'p1' then score end) as p1,
 max(case when provider = 'p2' then score end) as p2, max(case when provider = 'p3' then score end) as p3 from heat group by 1, 2""")
def l07(v):
    rows = routing.heatmap_rows(heat(v), PRIORITIES)
    return rows.select("type", "position", "runs", *[F.col("scores")[p].alias(p) for p in ARM_PROVIDERS])


@query("a28_runs_per_cell", "select cast(floor(avg(r) + 0.5) as bigint) as runs_per_cell from (select max(runs) as r from heat group by type)")
def a28(v):
    return routing.runs_per_cell(heat(v))


def _leader(floor: float) -> str:
    return f"""
select type, round(best, 6) as best, round(second, 6) as second, winners,
 case when winners = 1 and best - coalesce(second, -1e308) >= {floor} then top end as leads,
 winners = 1 and best - coalesce(second, -1e308) < {floor} as too_close
from (select type, max(score) as best, max(case when dr = 2 then score end) as second, count(*) filter (dr = 1) as winners,
 min(case when dr = 1 then provider end) as top
 from (select *, dense_rank() over (partition by type order by score desc) as dr from heat) group by 1)"""


@query("a29_leader_call", _leader(1.04))
def a29(v):
    return routing.leader_calls(heat(v))


@query("w03_leader_ranks", _leader(0.05))
def w03(v):
    return routing.leader_calls(heat(v), 0.05)


step("type_cells", f"""
select type, provider, round(coalesce(avg(s), 0), 2) as retrieval_mean,
 case when count(s) < 2 then cast('inf' as double) else round({sql_ci('s')}, 2) end as retrieval_ci95,
 round(coalesce(avg(a), 0), 2) as answer_mean, round(count(error) / count(*), 4) as error_rate,
 count(distinct case when error is null then query_id end) as n_queries
from (select *, case when error is null then ret_a end as s, case when error is null then ans_a end as a from arm_log) group by 1, 2""")


@query("a30_routing_cells", "select * from type_cells")
def a30(v):
    return routing.type_cells(batch_rows(v))


step("routing_ranked", """
select *, row_number() over (partition by type order by retrieval_mean desc, answer_mean desc, provider) as q,
 row_number() over (partition by type order by error_rate, retrieval_mean desc, answer_mean desc, provider) as r,
 count(*) over (partition by type) as n from type_cells""")
step("routing_mode", """
select a.type, a.retrieval_mean - b.retrieval_mean > a.retrieval_ci95
 and not (a.error_rate > 0.2 and a.error_rate - b.error_rate > 0.05) as onq
from routing_ranked a left join routing_ranked b on a.type = b.type and b.q = 2 where a.q = 1""")
step("routing", """
select x.type, x.provider, x.retrieval_mean, x.retrieval_ci95, x.answer_mean, x.n_queries, x.error_rate,
 y.provider as runner_up, coalesce(round(x.retrieval_mean - y.retrieval_mean, 2), 0) as margin,
 case when x.n = 1 then 'unopposed' when onq then 'retrieval' when x.error_rate <> y.error_rate then 'reliability'
  else 'inconclusive' end as decided_by
from (select p.*, case when onq then q else r end as place, onq from routing_ranked p join routing_mode m on p.type = m.type) x
left join (select p.*, case when onq then q else r end as place from routing_ranked p join routing_mode m on p.type = m.type) y
 on x.type = y.type and y.place = 2 where x.place = 1""")


def own_routing(v):
    return routing.best_per_type(routing.type_cells(batch_rows(v)))


@query("w01_routing_pick", "select * from routing")
def w01(v):
    return own_routing(v)


@query("j12_routing_fallback", """
select c.c_custkey, c.type, coalesce(o.provider, s.provider) as provider,
 case when o.provider is not null then 'own runs' when s.provider is not null then 'reference run' end as source,
 case when o.provider is null and s.provider is not null then 'reference data' end as caveat
from (select c_custkey, case c_custkey % 6 when 0 then '1-URGENT' when 1 then '2-HIGH' when 2 then '3-MEDIUM'
  when 3 then '4-NOT SPECIFIED' when 4 then '5-LOW' else 'other' end as type from customer) c
left join (select * from routing where type <> '5-LOW') o on c.type = o.type left join routing s on c.type = s.type""")
def j12(v):
    names = F.array(*[F.lit(p) for p in [*PRIORITIES, "other"]])
    asks = v.customer.select("c_custkey", F.element_at(names, (F.col("c_custkey") % 6 + 1).cast("int")).alias("type"))
    table = own_routing(v)
    out = routing.route(asks, table.where("type <> '5-LOW'"), table, "reference data")
    return out.select("c_custkey", "type", "provider", "source", "caveat")


# --- records ----------------------------------------------------------------

step("flat_arms", """
select provider, 'query ' || query_id as query, cast(ret_a as double) as retrieval, cast(ans_a as double) as answer,
 cast(latency_ms as double) as latency, error is not null as failed from arm_log
union all select provider, 'ask ' || id, retrieval_score, score, latency_ms, error is not null from run_arms""")


@query("u01_flatten_records", "select provider, query, retrieval, answer, latency, failed, count(*) as copies from flat_arms group by all")
def u01(v):
    flat = records.flatten(all_records(v))
    return flat.groupBy(*flat.columns).agg(F.count(F.lit(1)).alias("copies"))


@query("a31_report_summary", """
select p as provider, count(*) as arms, count(*) filter (failed) as fails, round(avg(retrieval), 6) as retrieval,
 round(avg(answer), 6) as answer, count(distinct query) as queries,
 case when count(*) % 2 = 1 then median(latency) else floor(median(latency) + 0.5) end as latency
from (select *, unnest([provider, '*']) as p from flat_arms) group by 1""")
def a31(v):
    return records.summarize(records.flatten(all_records(v)))


step("placed_arms", """
select *, row_number() over (partition by id order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) as pos from run_arms""")


@query("l01_winner", """
select i.id, w.winner from (select distinct id from run_arms) i left join
 (select id, arg_min('a' || pos, (-retrieval_score, pos)) as winner from placed_arms where error is null group by 1) w on i.id = w.id""")
def l01(v):
    return records.pick_winners(run_arms(v))


@query("f36_compact_run", """
select id, 'ask ' || id as query, 'm' as answer_model, 'judge' as judge_model,
 arg_min(case when error is null then provider end, (-retrieval_score, pos)) filter (error is null) as winner,
 count(*) as n_arms, count(*) filter (error is not null) as n_failed,
 cast(coalesce(sum(retrieval_score) filter (error is null), 0) as double) as sum_retrieval,
 2 * count(*) filter (error is null) as n_sources, count(*) filter (error is null) as n_domains
from placed_arms group by 1""")
def f36(v):
    c = records.compact_runs(runs(v))
    landed = F.filter(F.col("arms"), lambda a: a["error"].isNull())
    return c.select(
        "id", "query", "answer_model", "judge_model", "winner", F.size("arms").alias("n_arms"),
        (F.size("arms") - F.size(landed)).alias("n_failed"),
        F.aggregate(landed, F.lit(0.0), lambda s, a: s + a["retrieval_score"]).alias("sum_retrieval"),
        F.aggregate(landed, F.lit(0), lambda s, a: s + a["num_sources"]).alias("n_sources"),
        F.aggregate(landed, F.lit(0), lambda s, a: s + F.size(a["domains"])).alias("n_domains"),
    )


@query("s06_batch_records", """
select 'batch' as mode, batch_id as "batchId", '2026-08-17' as ts, query_id, provider, cast(ret_a as double) as retrieval_score
from arm_log""")
def s06(v):
    recs = records.to_batch_records(batch_rows(v), F.col("batch_id"), F.lit("2026-08-17"))
    return recs.select("mode", "batchId", "ts", "row.query_id", "row.provider", "row.retrieval_score")


@query("s07_run_records", """
select 'run' as mode, id, '2026-08-17' as ts, 'ask ' || id as query, count(*) as n_arms,
 arg_min('a' || pos, (-retrieval_score, pos)) filter (error is null) as winner from placed_arms group by 2""")
def s07(v):
    recs = records.to_run_record(runs(v), F.col("id"), F.lit("2026-08-17"))
    return recs.select("mode", "id", "ts", "query", F.size("arms").alias("n_arms"), "winner")


@query("l03_latest_batch", """
select seq, query_id, provider from arm_log where batch_id = (select arg_max(batch_id, s) from
 (select batch_id, min(seq) as s from arm_log group by 1))""")
def l03(v):
    b = batch_rows(v)
    recs = b.select(F.lit("batch").alias("mode"), F.col("batch_id").alias("batchId"), "seq", "query_id", "provider")
    return records.latest_batch(recs).select("seq", "query_id", "provider")


@query("l04_recent_runs", "select id, seq from (select distinct id, seq from run_arms) order by seq desc limit 8")
def l04(v):
    recs = v.run_arms.select("id", "seq").distinct().withColumn("mode", F.lit("run"))
    return records.recent_runs(recs).select("id", "seq")


@query("w05_first_seen_providers", "select provider, min(seq) as first_seq from arm_log group by 1")
def w05(v):
    return records.first_seen(v.arm_log, "provider")


@query("w02_per_type_cap", """
select seq, id, type from (select *, row_number() over (partition by type order by seq) as rn from questions) where rn <= 8""")
def w02(v):
    from ..operators.planning import select_questions

    return select_questions(v.questions, 8).select("seq", "id", "type")
