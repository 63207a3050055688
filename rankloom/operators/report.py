"""Report derivation: the published tables from best rows and last good ratings.

Its dedupe, means and quantiles differ from the live summary on purpose.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T
from ..functions.errors import failed, stage_of
from ..functions.stats import percent, share, sign_test_p
from .agreement import declared_pairs, ratings_wide
from .ranks import floor_quantiles

FULL, HALF = 2.5, 1.5


# --- questions ------------------------------------------------------------------

def group_of(questions: DataFrame, *groups: tuple[str, DataFrame]) -> DataFrame:
    """Which set a question belongs to; the first named set wins, none is null."""
    ids = None
    for rank, (name, df) in enumerate(groups):
        part = df.select("query_id", F.struct(F.lit(rank).alias("r"), F.lit(name).alias("g")).alias("x"))
        ids = part if ids is None else ids.unionByName(part)
    first = ids.groupBy("query_id").agg(F.min("x").alias("x")).select("query_id", F.col("x.g").alias("group"))
    return questions.join(first, "query_id", "left")


def group_by_rules(log: DataFrame, *groups: tuple[str, Column]) -> DataFrame:
    """The same where sets are conditions on a log's rows: one aggregate; the first group any row meets wins."""
    rank = F.lit(None).cast("int")
    for i, (_, rule) in reversed(list(enumerate(groups))):
        rank = F.when(rule, i).otherwise(rank)
    first = log.groupBy("query_id").agg(F.min(rank).alias("_r"))
    return first.select("query_id", F.get(F.array(*[F.lit(name) for name, _ in groups]), F.col("_r")).alias("group"))


def group_counts(questions: DataFrame) -> DataFrame:
    return questions.groupBy(F.coalesce("group", F.lit("none")).alias("group")).agg(F.count(F.lit(1)).alias("n"))


# --- rated pages ----------------------------------------------------------------

def rated_pages(returned: DataFrame, judgements: DataFrame, judges: list[str], order: tuple[str, ...] = ()) -> DataFrame:
    """Each page a provider returned with its ratings, one row per (question, provider, url).

    Both inputs carry normalised URLs; of several ratings of one judge that
    meet there the last by ``order`` counts. The panel is declared, never inferred:
    a page counts as fully rated only when every declared judge rated it.
    """
    r = [F.col(f"r{i}") for i in range(len(judges))]
    n = sum(x.isNotNull().cast("int") for x in r)
    total = sum(F.coalesce(x, F.lit(0)) for x in r)
    widest = F.greatest(*r) - F.least(*r) if len(r) > 1 else F.lit(0)
    rated = ratings_wide(judgements, judges, order=order).select(
        "query_id", "url", n.alias("n_ratings"), (total / n).alias("page_mean"), widest.alias("spread")
    )
    out = returned.select("query_id", "provider", "url").distinct().join(rated, ["query_id", "url"], "left")
    return out.withColumn("n_ratings", F.coalesce("n_ratings", F.lit(0))).withColumn(
        "fully_rated", F.col("n_ratings") == len(judges)
    )


def join_match(pages: DataFrame) -> DataFrame:
    """Share of returned pages that carry any rating: the health of the join."""
    return pages.groupBy("provider").agg(
        F.count(F.lit(1)).alias("returned"),
        F.count_if(F.col("n_ratings") > 0).alias("matched"),
        percent(F.count_if(F.col("n_ratings") > 0), F.count(F.lit(1))).alias("join_match_pct"),
    )


def matched_by_set(pages: DataFrame) -> DataFrame:
    """Of each search the pages it returned and those that carry any rating."""
    return pages.groupBy("query_id", "provider").agg(
        F.count(F.lit(1)).alias("returned"), F.count_if(F.col("n_ratings") > 0).alias("matched"))


def join_match_of(sets: DataFrame) -> DataFrame:
    """``join_match`` from the counts of searches."""
    return sets.groupBy("provider").agg(
        F.sum("returned").alias("returned"), F.sum("matched").alias("matched"),
        percent(F.sum("matched"), F.sum("returned")).alias("join_match_pct"),
    )


def page_scores(pages: DataFrame, groups: DataFrame) -> DataFrame:
    """Flat page means per provider, overall and by question group, and both thresholds.

    All fully rated pages have the same number of ratings, so the mean of page
    means is the mean over ratings.
    """
    full = pages.where("fully_rated").join(groups.select("query_id", "group"), "query_id", "left")
    m = F.col("page_mean")

    def within(g: str) -> Column:
        return F.avg(F.when(F.col("group") == g, m))

    return full.groupBy("provider").agg(
        F.count(F.lit(1)).alias("n_pages"), F.avg(m).alias("page_mean"),
        within("base").alias("base"), within("hard").alias("hard"), within("unanswerable").alias("unanswerable"),
        (share(m >= FULL) * 100).alias("rung3_pct"), (share(m >= HALF) * 100).alias("rung2_or_3_pct"),
    ).withColumn("delta", F.col("hard") - F.col("base"))


def with_lift(scores: DataFrame, set_means: DataFrame) -> DataFrame:
    """Set mean minus page mean: what the whole set adds over its average page."""
    return scores.join(set_means.select("provider", "mean_score"), "provider", "left").withColumn(
        "lift", F.col("mean_score") - F.col("page_mean")
    )


# --- the same by question --------------------------------------------------------

def question_panels(returned: DataFrame, judgements: DataFrame, judges: list[str], providers: list[str], order: tuple[str, ...] = ()) -> DataFrame:
    """One row per question: of each declared provider its distinct pages that the whole panel rated.

    ``n0`` pages of the first provider, ``t0`` the sum of their means, ``f0`` and
    ``h0`` those at full and half relevance, and so on. Pages and ratings meet in
    one partitioning; only these sums go on.
    """
    pages = returned.select("query_id", "url", "provider").distinct()
    r = [F.col(f"r{i}") for i in range(len(judges))]
    whole = sum(r[1:], r[0])
    rated = ratings_wide(judgements, judges, order=order).select("query_id", "url", (whole / len(judges)).alias("m")).where("m is not null")
    sums, m = [], F.col("m")
    for i, p in enumerate(providers):
        mine = F.col("provider") == p
        sums += [F.count_if(mine).alias(f"n{i}"), F.sum(F.when(mine, m)).alias(f"t{i}"),
                 F.count_if(mine & (m >= FULL)).alias(f"f{i}"), F.count_if(mine & (m >= HALF)).alias(f"h{i}")]
    return pages.join(rated, ["query_id", "url"]).groupBy("query_id").agg(*sums)


def question_marks(log: DataFrame, providers: list[str], controls: tuple[str, ...], *groups: tuple[str, Column]) -> DataFrame:
    """One row per question of a fetch log: its group (the first whose rule any row meets) and, as c0, c1, ..., whether the best row of each declared provider is clean."""
    best_first = Window.partitionBy("query_id", "provider").orderBy(failed(F.col("error")).asc(), F.col("fetched_at").desc_nulls_last(), F.col("seq").desc())
    rank = F.lit(None).cast("int")
    for i, (_, rule) in reversed(list(enumerate(groups))):
        rank = F.when(rule, i).otherwise(rank)
    rows = log.select("query_id", "provider", rank.alias("_r"), (
        (F.row_number().over(best_first) == 1) & ~failed(F.col("error")) & ~F.col("provider").isin(*controls)).alias("_clean"))
    marks = rows.groupBy("query_id").agg(F.min("_r").alias("_r"), *_clean_flags(providers, F.col("_clean")))
    return marks.withColumn("group", F.get(F.array(*[F.lit(name) for name, _ in groups]), F.col("_r"))).drop("_r")


def clean_marks(clean: DataFrame, groups: DataFrame, providers: list[str]) -> DataFrame:
    """The same from clean searches (query_id, provider) and a table of groups."""
    flags = clean.groupBy("query_id").agg(*_clean_flags(providers, F.lit(True)))
    return flags.join(groups.select("query_id", "group"), "query_id", "left")


def _clean_flags(providers: list[str], clean: Column) -> list[Column]:
    return [F.bool_or(clean & (F.col("provider") == p)).alias(f"c{i}") for i, p in enumerate(providers)]


def searched(panels: DataFrame, marks: DataFrame, providers: list[str]) -> DataFrame:
    """Panels with each question's group; what a provider returned without a clean best row is emptied."""
    kept = {f"{c}{i}": F.when(F.col(f"c{i}"), F.col(f"{c}{i}")) for i in range(len(providers)) for c in "ntfh"}
    return panels.join(marks, "query_id").withColumns(kept).drop(*[f"c{i}" for i in range(len(providers))])


def scores_by_question(panels: DataFrame, group: str, providers: list[str]) -> DataFrame:
    """Of the questions of a group the score s0, s1, ... of each declared provider: the mean of its page means, null without pages."""
    scores = [F.try_divide(F.col(f"t{i}"), F.col(f"n{i}")).alias(f"s{i}") for i in range(len(providers))]
    return panels.where(F.col("group") == group).select("query_id", *scores)


def page_scores_of(panels: DataFrame, providers: list[str]) -> DataFrame:
    """``page_scores`` from the panels of questions."""
    fields = {"n": "n", "total": "t", "full": "f", "half": "h"}
    each = F.array(*[F.struct(F.lit(p).alias("provider"), *[F.col(f"{c}{i}").alias(name) for name, c in fields.items()]) for i, p in enumerate(providers)])
    rows = panels.select("group", F.inline(each)).where("n > 0")

    def within(*g: str) -> Column:
        mine = F.col("group").isin(*g) if g else F.lit(True)
        return F.try_divide(F.sum(F.when(mine, F.col("total"))), F.sum(F.when(mine, F.col("n"))))

    n = F.sum("n")
    return rows.groupBy("provider").agg(
        n.alias("n_pages"), within().alias("page_mean"), within("base").alias("base"), within("hard").alias("hard"), within("unanswerable").alias("unanswerable"),
        percent(F.sum("full"), n).alias("rung3_pct"), percent(F.sum("half"), n).alias("rung2_or_3_pct"),
    ).withColumn("delta", F.col("hard") - F.col("base"))


def spread(scores: DataFrame) -> DataFrame:
    """Best minus worst provider on easy and hard questions, from unrounded means; ties go to the first name."""
    kept = F.struct("provider", "base", "hard")
    ends = scores.where(F.col("mean_score").isNotNull()).agg(
        F.min_by(kept, F.struct(-F.col("mean_score"), "provider")).alias("top"),
        F.min_by(kept, F.struct("mean_score", "provider")).alias("low"),
    )
    out = ends.select(
        F.col("top.provider").alias("best"), F.col("low.provider").alias("worst"),
        (F.col("top.base") - F.col("low.base")).alias("base"), (F.col("top.hard") - F.col("low.hard")).alias("hard"),
    )
    widened = F.floor((F.try_divide(F.col("hard"), F.col("base")) - 1) * 100 + F.lit(0.5))
    return out.withColumn("widened_pct", widened)


def question_scores(pages: DataFrame, groups: DataFrame, group: str) -> DataFrame:
    """One score per (provider, question) of a group: the mean of its page means."""
    mine = groups.where(F.col("group") == group).select("query_id")
    return (
        pages.where("fully_rated").join(mine, "query_id", "left_semi")
        .groupBy("provider", "query_id").agg(F.avg("page_mean").alias("score"))
    )


def provider_pairs(scores: DataFrame, order: list[str]) -> DataFrame:
    """Scores of both providers of each declared pair on each question they share.

    A question holds at most one score per declared provider, gathered once
    into a map; the pairs come from the declared order, not from the rows.
    """
    per_question = (
        scores.where(F.col("provider").isin(*order)).groupBy("query_id")
        .agg(F.map_from_entries(F.collect_list(F.struct("provider", "score"))).alias("m"))
    )
    pair = per_question.withColumn("p", F.explode(declared_pairs(order)))
    return pair.select(
        "query_id", F.col("p.judge_a").alias("a"), F.col("p.judge_b").alias("b"),
        F.col("m")[F.col("p.judge_a")].alias("score_a"), F.col("m")[F.col("p.judge_b")].alias("score_b"),
    ).where(F.col("score_a").isNotNull() & F.col("score_b").isNotNull())


def pair_counts(questions: DataFrame, order: list[str]) -> DataFrame:
    """Shared questions and wins of each declared pair, from one row per question with scores s0, s1, ... in declared order.

    One aggregate without keys: a task sends one row with three counters per pair.
    """
    n = len(order)
    pairs = [(i, k) for i in range(n) for k in range(i + 1, n)]
    counters = []
    for i, k in pairs:
        x, y = F.col(f"s{i}"), F.col(f"s{k}")
        counters += [F.count_if(x.isNotNull() & y.isNotNull()).alias(f"n_{i}_{k}"), F.count_if(x < y).alias(f"a_{i}_{k}"), F.count_if(y < x).alias(f"b_{i}_{k}")]
    rows = F.array(*[
        F.struct(F.lit(order[i]).alias("a"), F.lit(order[k]).alias("b"), F.col(f"n_{i}_{k}").alias("n_questions"),
                 F.col(f"a_{i}_{k}").alias("a_lower"), F.col(f"b_{i}_{k}").alias("b_lower")) for i, k in pairs])
    return questions.agg(*counters).select(F.inline(rows))


def paired_sign_tests(questions: DataFrame, order: list[str]) -> DataFrame:
    """Head-to-head on shared questions; lower is better. Pairs sharing none get a zero row."""
    full = pair_counts(questions, order)
    decided = F.col("a_lower") + F.col("b_lower")
    full = full.withColumn("ties", F.col("n_questions") - decided).withColumn(
        "p", sign_test_p(decided, F.least("a_lower", "b_lower"))
    )
    sep = F.col("p") < 0.05
    return full.withColumns({
        "separates": sep,
        "better": F.when(sep, F.when(F.col("a_lower") > F.col("b_lower"), F.col("a")).otherwise(F.col("b"))),
    })


# --- fetch log tables -----------------------------------------------------------

def extraction_yield(log: DataFrame) -> DataFrame:
    return log.groupBy("provider").agg(
        F.try_divide(F.sum(F.coalesce("num_extracted", F.lit(0))).cast("double"),
                     F.sum(F.coalesce("num_sources", F.lit(0)))).alias("yield")
    )


def latency_table(log: DataFrame, controls=("plain",)) -> DataFrame:
    """n, p50, p90 and max of the timed clean fetches."""
    timed = log.where(~F.col("provider").isin(*controls) & ~failed(F.col("error")) & (F.col("fetch_ms") > 0))
    q = floor_quantiles(timed, ["provider"], "fetch_ms", {"p50_ms": 0.5, "p90_ms": 0.9})
    top = timed.groupBy("provider").agg(F.max("fetch_ms").alias("max_ms"))
    return q.join(top, "provider")


def control_attempts(log: DataFrame, controls=("plain",)) -> DataFrame:
    """Attempts of the control providers, which are counted but never scored."""
    return log.where(F.col("provider").isin(*controls)).groupBy("provider").agg(
        F.count(F.lit(1)).alias("attempts"), F.count_if(failed(F.col("error"))).alias("failed")
    )


def run_window(log: DataFrame) -> DataFrame:
    """First and last fetch day of the run and how many distinct days it took."""
    days = log.select(F.to_date("fetched_at").alias("day")).where("day is not null").distinct()
    return days.agg(F.min("day").alias("first_fetch"), F.max("day").alias("last_fetch"), F.count(F.lit(1)).alias("n_days"))


def first_day_progress(log: DataFrame, controls=("plain",)) -> DataFrame:
    """Rows per provider on the first day, and whether it had none later."""
    dated = log.withColumn("day", F.to_date("fetched_at")).where("day is not null")
    first = dated.agg(F.min("day").alias("d")).scalar()
    mine = dated.where(~F.col("provider").isin(*controls)).withColumn("_first", F.col("day") == first)
    return (
        mine.groupBy("provider")
        .agg(F.count_if("_first").alias("first_day_rows"), F.bool_and("_first").alias("finished_first_day"))
        .where("first_day_rows > 0")
    )


def completeness(best: DataFrame) -> DataFrame:
    """Clean and failed rows per provider, failures by the step that failed.

    The map has one entry per stage, a fixed list of four.
    """
    bad = failed(F.col("error"))
    per_stage = best.groupBy("provider", F.when(bad, stage_of(F.col("error_stage"))).alias("stage")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return per_stage.groupBy("provider").agg(
        F.sum(F.when(F.col("stage").isNull(), F.col("n")).otherwise(0)).alias("clean"),
        F.sum(F.when(F.col("stage").isNotNull(), F.col("n")).otherwise(0)).alias("failed"),
        F.map_from_entries(
            F.array_sort(F.collect_list(F.when(F.col("stage").isNotNull(), F.struct("stage", "n"))))
        ).alias("failed_by_stage"),
    )


def text_structure(pages: DataFrame, by: str = "provider") -> DataFrame:
    """Shares of markup and truncation over pages that came back with text."""
    t = F.col("content")
    with_text = pages.where(F.coalesce(F.length(t), F.lit(0)) > 0)
    flags = {
        "markdown_pct": T.has_markdown(t), "headings_pct": T.has_headings(t), "links_pct": T.has_links(t),
        "images_pct": T.has_images(t), "tables_pct": T.has_tables(t), "truncated_pct": T.was_truncated(t),
    }
    return with_text.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_pages_with_text"), *[(share(f) * 100).alias(n) for n, f in flags.items()]
    )


def arm_pages(pages: DataFrame, set_scores: DataFrame) -> DataFrame:
    """Per (question, provider): mean of rated page means, widest split, set mean."""
    per_arm = pages.groupBy("query_id", "provider").agg(
        F.count(F.lit(1)).alias("n_pages"), F.avg("page_mean").alias("mean_rung"), F.max("spread").alias("max_spread")
    )
    sets = set_scores.where(F.col("score").isNotNull()).groupBy("query_id", "provider").agg(F.avg("score").alias("set_mean"))
    return per_arm.join(sets, ["query_id", "provider"], "left")


# --- cost and headline ----------------------------------------------------------

def attach_costs(rows: DataFrame, costs: DataFrame) -> DataFrame:
    return rows.join(costs, "provider", "left")


def cost_summary(priced: DataFrame) -> DataFrame:
    """Total run cost and the middle of the field on price and rating (provider-sized input)."""
    return priced.agg(
        F.sum(F.coalesce("usd_for_run", F.lit(0.0))).alias("total_usd"),
        F.median("usd_per_query").alias("median_cost_usd"), F.median("mean_score").alias("median_set_mean"),
    )


def headline(n_pairs: Column, unique_pairs: Column, multi: Column, clean: Column, attempted: Column,
             latency: DataFrame, costs: DataFrame) -> DataFrame:
    """Savings of pooling, multi-source share, clean searches, fastest, slowest, cheapest."""
    p50 = F.col("p50_ms")
    fast = latency.agg(
        F.min_by("provider", F.struct("p50_ms", "provider")).alias("fastest"),
        F.max_by("provider", F.struct("p50_ms", "provider")).alias("slowest"),
        F.array_sort(F.collect_list(p50)).alias("p"),
    )
    cheapest = costs.where("usd_per_query is not null").agg(F.min_by("provider", F.struct("usd_per_query", "provider")).alias("c")).scalar()
    return fast.select(
        percent(n_pairs - unique_pairs, n_pairs).alias("pool_saved_pct"),
        percent(multi, unique_pairs).alias("multi_source_pct"),
        clean.alias("searches_clean"), attempted.alias("searches_attempted"),
        "fastest", "slowest", cheapest.alias("cheapest"),
        F.try_divide(F.try_element_at("p", F.lit(2)), F.try_element_at("p", F.lit(1))).alias("fastest_lead"),
    )


# --- checks over published numbers ----------------------------------------------

def tie_groups(ranking: DataFrame, by: str) -> DataFrame:
    """Runs of neighbours in the ranking whose intervals overlap, within each ``by``."""
    w = Window.partitionBy(by).orderBy(F.col("mean").desc(), "provider")
    floor_above = F.lag(F.col("mean") - F.col("ci95")).over(w)
    breaks = F.when(floor_above > F.col("mean") + F.col("ci95"), 1).otherwise(0)
    grouped = ranking.withColumn("_b", breaks).withColumn(
        "tie_group", F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0))
    )
    size = F.count(F.lit(1)).over(Window.partitionBy(by, "tie_group"))
    return grouped.drop("_b").withColumn("tied", size > 1)


def rank_moves(values: DataFrame) -> DataFrame:
    """Per metric: provider order now and before, and whether it moved.

    Input rows are (metric, provider, now, before, low_is_good); a metric has
    one row per provider.
    """
    def order(col: str) -> Column:
        v = F.when(F.col("low_is_good"), F.col(col)).otherwise(-F.col(col))
        entries = F.array_sort(F.collect_list(F.struct(v.alias("v"), "provider")))
        return F.array_join(F.transform(entries, lambda e: e["provider"]), " > ")

    out = values.groupBy("metric").agg(order("now").alias("order_now"), order("before").alias("order_before"))
    return out.withColumn("moved", F.col("order_now") != F.col("order_before"))


def check_numbers(got: DataFrame, expected: DataFrame) -> DataFrame:
    """PASS, PASS~ (within tolerance but rounding differently) or FAIL per label."""
    both = expected.join(got, "label", "left")
    g, w, tol = F.col("got"), F.col("want"), F.col("tolerance")
    ok = F.coalesce(F.abs(g - w) <= tol + 1e-9, F.lit(False))
    whole = w == F.floor(w)
    same = F.when(tol > 0, ~whole | (F.floor(g + F.lit(0.5)) == w)).otherwise(g == w)
    return both.where(w.isNotNull()).withColumn(
        "state", F.when(~ok, "FAIL").when(F.coalesce(same, F.lit(False)), "PASS").otherwise("PASS~")
    )


def require_all_pass(checks: DataFrame) -> DataFrame:
    """The checks themselves; reading them fails the job when any is FAIL."""
    broken = checks.where("state = 'FAIL'").agg(F.count(F.lit(1)).alias("n")).select(
        F.assert_true(F.col("n") == 0, F.concat(F.col("n").cast("string"), F.lit(" numbers did not reproduce"))).alias("ok")
    ).scalar()
    return checks.where(broken.isNull())
