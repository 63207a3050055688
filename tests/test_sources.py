"""Log files, sets, pools, planning, reuse, streams."""

import datetime
import json
import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from rankloom.functions.prompts import estimate_tokens
from rankloom.operators import audit, baseline, extraction, planning, pool, report, requests
from rankloom.session import staged
from rankloom.sources import logs, nested, question_sets, reuse, serp
from rankloom.streaming import streams


def write(path, *lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def fetch_line(q, p, **more):
    return json.dumps({"queryId": q, "provider": p, **more})


def test_log_scan_policies_and_append_order(spark, tmp_path, rows):
    p = write(tmp_path / "f.jsonl", fetch_line("q1", "p"), '{"queryId": "q2", "prov', "", fetch_line("q1", "p", error="500"))
    good, bad = logs.scan_log(spark, p, "fetches", "quarantine")
    assert rows(good, "query_id", "error", "seq") == [("q1", "500", 2), ("q1", None, 0)]
    assert rows(bad) == [('{"queryId": "q2", "prov',)]
    assert logs.scan_log(spark, p, "fetches", "skip").count() == 2
    with pytest.raises(Exception, match="unreadable log line"):
        logs.scan_log(spark, p, "fetches").collect()


def test_append_and_snapshot(spark, tmp_path):
    one = spark.range(3).withColumn("run_id", F.lit("r1"))
    for _ in range(2):
        logs.append(one, str(tmp_path / "log"), partition_by=("run_id",))
        logs.write_snapshot(one, str(tmp_path / "snap"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 6
    assert spark.read.json(str(tmp_path / "snap")).count() == 3
    assert staged(one, "x").count() == 3


def q(**kw):
    return json.dumps({"query": "ask", "type": "how_to", **kw})


def test_question_sets_from_both_formats(spark, tmp_path, rows):
    a = write(tmp_path / "a.json", json.dumps([json.loads(q()), json.loads(q(id=" own ", genre="sports", note="n"))]))
    b = write(tmp_path / "b.jsonl", "// a comment", "", q(), q(sharpness="open"))
    for path, want in ((a, [("own", "sports"), ("q-01", None)]), (b, [("q-01", None), ("q-02", None)])):
        good, bad = question_sets.parse_questions(question_sets.read_set(spark, path).drop("file"))
        assert rows(good, "id", "genre") == want and bad.count() == 0


def test_set_files_are_read_by_lines(spark, tmp_path, rows):
    """Entries keep their order over splits, whatever comments, blanks and line breaks lie between."""
    lines = [json.dumps({"n": i, "t": "x" * (i % 50)}) for i in range(3000)]
    a = write(tmp_path / "lines.jsonl", *[part for i, x in enumerate(lines) for part in (["// no", "  "] if i % 7 == 0 else []) + [f"  {x}  "]])
    items = [{"t": 'a, [b] {"c\\'}, [1, [2]], "text, ]", 3, None, {}, *({"n": i, "t": ["y"] * (i % 9)} for i in range(500))]
    b, c = write(tmp_path / "array.json", "", "  ", json.dumps(items, indent=2)), write(tmp_path / "one.json", json.dumps(items))
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        got = question_sets.read_set(spark, [a, b, c]).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    by = {}
    for r in got:
        by.setdefault(r.file.rsplit("/", 1)[1], {})[r.pos] = r.raw
    assert [by["lines.jsonl"][i] for i in range(3000)] == lines and len(by["lines.jsonl"]) == 3000
    for name in ("array.json", "one.json"):
        assert [json.loads(by[name][i]) for i in range(len(items))] == items and len(by[name]) == len(items)


@pytest.mark.parametrize("text,want", [
    ("[]", []), ("", []), ("[1, 2", ["1", "[2"]), ('[{"a": "x', ['[{"a": "x']), ("[1,,2]", ["1", "", "2"]), ('[1] {"query": "late"}', ["1", ']{"query": "late"}']), ("// only", []),
])
def test_arrays_that_end_badly_are_not_lost(spark, tmp_path, text, want):
    path = write(tmp_path / "s.json", text)
    assert [r.raw for r in question_sets.read_set(spark, path).orderBy("pos").collect()] == want


@pytest.mark.parametrize("entry,reason", [
    ("{oops", "is not valid JSON"), ("[1]", "is not an object"), (q(query="  "), "has no `query`"), (q(type="poem"), 'has type "poem"'),
    (q(sharpness="blunt"), 'has sharpness "blunt"'), (q(genre="food"), 'has genre "food"'), (q(genre=3), "has genre null"),
])
def test_question_rejects_name_the_entry(spark, entry, reason):
    entries = spark.createDataFrame([(0, q(id="a")), (1, entry)], "pos int, raw string")
    good, bad = question_sets.parse_questions(entries)
    assert bad.first()["reason"] == f"query 2 {reason}"
    with pytest.raises(Exception, match="query 2"):
        question_sets.require_no_rejects(good, bad).collect()


def test_reuse_reads_two_days_of_what_was_written(spark, tmp_path, rows):
    now, path = F.lit("2024-01-03 12:00:00").cast("timestamp"), str(tmp_path / "reuse")
    e = spark.createDataFrame([
        (1, "old", "2024-01-01 10:00:00"), (2, "live", "2024-01-02 13:00:00"), (3, "edge", "2024-01-02 12:00:00"), (4, "late", "2024-01-02 11:59:59"),
        (5, "live twice", "2024-01-02 14:00:00"), (6, "live twice", "2024-01-03 11:00:00"), (7, "from the future", "2024-01-03 13:00:00"),
        (8, "rewritten", "2024-01-03 01:00:00"), (9, "rewritten", "2024-01-04 09:00:00"),
    ], "seq long, query string, fetched_at string").select(F.lit("p").alias("provider"), "*", F.lit("all").alias("freshness"), F.lit(8).alias("num_sources"), F.lit("c").alias("extraction"), F.lit(0).alias("seed"))
    reuse.write_entries(e.where("seq <= 4"), path, F.col("fetched_at"))
    reuse.write_entries(e.where("seq > 4"), path, F.col("fetched_at"))
    asks = reuse.with_key(e.drop("fetched_at", "seq").distinct())
    got = reuse.lookup(asks, reuse.stored_entries(spark, path), now)
    assert rows(got, "query", "fetched_at") == rows(reuse.lookup(asks, reuse.with_key(e), now), "query", "fetched_at")
    assert rows(got.where("from_cache"), "query") == [("edge",), ("live twice",), ("live",)]
    plan = got._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(day" in plan
    assert reuse.expire(spark, path, datetime.date(2024, 1, 3)) == 1 and reuse.expire(spark, path, datetime.date(2024, 1, 3)) == 0
    assert rows(reuse.lookup(asks, reuse.stored_entries(spark, path), now), "query", "fetched_at") == rows(got, "query", "fetched_at")


def test_duplicate_ids_are_rejected(spark):
    entries = spark.createDataFrame([(0, q(id="a")), (1, q(id="a"))], "pos int, raw string")
    assert question_sets.parse_questions(entries)[1].first()["reason"] == 'query 2 reuses the id "a"'


def test_set_union_checks(spark):
    base = spark.createDataFrame([("r-1",), ("r-2",)], "id string")
    hard = spark.createDataFrame([("rh-1",)], "id string")
    assert question_sets.union_sets(("base", base, "r-", 2), ("hard", hard, "rh-", 1)).count() == 3
    for sets in ((("base", base, "r-", 3),), (("base", base, "x-", 2),), (("a", base, "r-", 2), ("b", base, "r-", 2))):
        with pytest.raises(Exception, match="do not add up"):
            question_sets.union_sets(*sets).collect()


def test_hard_factors(spark, rows):
    df = spark.createDataFrame([("a", "HARD(trap + buried) x"), ("b", "HARD(shiny)"), ("c", "plain")], "id string, note string")
    good, bad = question_sets.hard_factors(df)
    assert rows(good) == [("a", ["trap", "buried"])]
    assert rows(bad) == [("b", "unknown factors: shiny"), ("c", "note does not start with HARD(...)")]


SRC = "query_id string, query string, provider string, seq bigint, pos int, title string, url string, domain string, published string, content string, snippet string"


def test_pool_keeps_first_title_longest_text_and_first_date(spark):
    df = spark.createDataFrame([
        ("q", "ask", "b", 1, 0, "first", "https://A.com/x/", "a.com", None, None, "snip"),
        ("q", "ask", "a", 2, 0, "second", "https://a.com/x#f", "a.com", "2026-01-02", "longest text", None),
        ("q", "ask", "c", 3, 0, "third", "https://a.com/x", "a.com", "2026-03-03", "longest tex!", None),
        ("q", "ask", "c", 3, 1, "again", "https://a.com/x", "a.com", None, "", "ignored snippet that is very long"),
    ], SRC)
    r = pool.build_pool(df).collect()
    assert len(r) == 1
    assert (r[0]["title"], r[0]["content"], r[0]["content_from"], r[0]["published"], r[0]["returned_by"]) == (
        "first", "longest text", "a", "2026-01-02", ["b", "a", "c"])


def test_overlap_histogram_adds_up(spark):
    rows = [("q", f"p{p}", f"u{u}") for p in range(4) for u in range(6) if u % (p + 1) == 0] * 3
    h = pool.overlap(spark.createDataFrame(rows, "query_id string, provider string, url string"), "url", 4)
    got = {r["k"]: r["n_pages"] for r in h.collect()}
    assert sum(got.values()) == 6 and set(got) == {1, 2, 3, 4}


def test_chunks_are_the_greedy_fill_in_request_order(spark):
    rng = random.Random(7)
    reqs = [(f"id{i:04d}", route, rng.choice([10, 200, 900, 5000]), i) for i in range(700) for route in (["a", "b"] if i < 90 else ["a"])]
    df = spark.createDataFrame(reqs, "wire_id string, route string, tokens bigint, seq int")
    got = {(r["route"], r["wire_id"]): r["chunk"] for r in planning.chunk_requests(df, ["seq"], max_tokens=1000, max_requests=5, span_rows=16).collect()}
    want = {}
    for route in ("a", "b"):
        chunk, n, used = -1, 5, 0
        for i, _, tokens, _ in [r for r in reqs if r[1] == route]:
            if n + 1 > 5 or used + tokens > 1000:
                chunk, n, used = chunk + 1, 0, 0
            n, used = n + 1, used + tokens
            want[(route, i)] = chunk
    assert got == want


def test_a_strict_scan_fails_on_a_cut_line(spark):
    lines_ = spark.createDataFrame([('{"seq": 1}',), ("",), ('{"seq": 2',)], "line string")
    with pytest.raises(Exception, match="unreadable log line"):
        logs.parse_lines(lines_, "line", "seq BIGINT", "fail").collect()


@pytest.mark.parametrize("name", ["fetches", "judgements", "set_verdicts", "arms", "baseline"])
@pytest.mark.parametrize("bad", ['{"queryId": "q2", "prov', '{"queryId": "q2"}{"queryId": "q3"}', '{"queryId": "q2", "seq": "late"}', "[1]", "null", "7"])
def test_every_log_is_scanned_strictly(spark, tmp_path, rows, name, bad):
    clean = write(tmp_path / "clean.jsonl", '{"queryId": "q1", "seq": 4, "later": {"a": 1}}', "", "  ", '{"queryId": "q2", "error": "}{"}')
    assert rows(logs.scan_log(spark, clean, name), "query_id", "error", "seq")[0][:2] == ("q1", None)
    assert logs.scan_log(spark, clean, name).count() == 2
    broken = write(tmp_path / "broken.jsonl", '{"queryId": "q1"}', bad, '{"queryId": "q4"}')
    with pytest.raises(Exception, match="unreadable log line"):
        logs.scan_log(spark, broken, name).collect()
    good, lines = logs.scan_log(spark, broken, name, "quarantine")
    assert rows(good, "query_id") == [("q1",), ("q4",)] and rows(lines) == [(bad,)]


def test_one_bad_request_costs_its_own_row(spark):
    from rankloom.operators import requests

    def scorer(batch):
        if (batch["prompt"] == "bad").any():
            raise ValueError("no")
        return batch.assign(value=1.0, rationale=None)

    df = spark.createDataFrame([("a", "fine"), ("b", "bad"), ("c", "fine")], "id string, prompt string").coalesce(1)
    got = {r["id"]: (r["value"], r["rationale"], r["error"]) for r in requests.score_with(df, scorer, ["id"]).collect()}
    assert got == {"a": (1.0, None, None), "b": (None, "", "no"), "c": (1.0, None, None)}
    landed = spark.createDataFrame([("a", 1.0, "x", 1), ("a", 2.0, "y", 2)], "id string, value double, rationale string, seq int")
    out = {r["id"]: (r["value"], r["error"]) for r in requests.landed_scores(df, landed, ["id"]).collect()}
    assert out == {"a": (2.0, None), "b": (None, "no batch result"), "c": (None, "no batch result")}


def test_tokens_round_up_and_reserve_output(spark):
    assert spark.range(1).select(estimate_tokens(F.lit("abcde"), F.lit(None).cast("string"))).first()[0] == 2 + 1024


def test_cost_gate(spark):
    rates = spark.createDataFrame([("m", 20, 100), ("free", None, None)], "provider string, per_call int, balance bigint")
    todo = spark.createDataFrame([("q1", "m"), ("q2", "m"), ("q1", "free")], "query_id string, provider string")
    lines = planning.cost_estimate(todo, rates)
    got = {r["provider"]: (r["calls"], r["min_cost"], r["max_cost"], r["over_balance"]) for r in lines.collect()}
    assert got == {"m": (2, 40, 120, True), "free": (1, None, None, False)}
    assert planning.budget_gate(lines, 120).count() == 2
    with pytest.raises(Exception, match="over the ceiling of 100"):
        planning.budget_gate(lines, 100).collect()


def test_outcomes_match_by_id_and_the_first_counts(spark, rows):
    reqs = spark.createDataFrame([("a",), ("b",), ("c",)], "wire_id string")
    got = spark.createDataFrame([("b", 1, "first", None), ("b", 2, "again", None), ("c", 3, None, "expired"), ("z", 4, "stray", None)], "wire_id string, seq bigint, text string, error string")
    assert rows(planning.match_outcomes(reqs, got)) == [("a", None, "no batch result"), ("b", "first", None), ("c", None, "expired")]


def test_scorer_failure_is_an_error_row(spark):
    reqs = spark.createDataFrame([("a", "x")], "id string, prompt string")

    def broken(batch: pd.DataFrame) -> pd.DataFrame:
        raise RuntimeError("no key")

    r = requests.score_with(reqs, broken, ["id"]).first()
    assert (r["value"], r["error"]) == (None, "no key")


def test_reuse_is_valid_up_to_a_day_and_never_from_the_future(spark, rows):
    now = F.lit("2026-08-18 12:00:00").cast("timestamp")
    stamps = {"edge": "2026-08-17T12:00:00Z", "old": "2026-08-17T11:59:59Z", "future": "2026-08-18T12:00:01Z", "bad": "whenever"}
    e = spark.createDataFrame([(i, k, k, "all", 8, "clean", 0, t) for i, (k, t) in enumerate(stamps.items())],
                              "seq bigint, provider string, query string, freshness string, num_sources int, extraction string, seed int, fetched_at string")
    entries = reuse.with_key(e)
    asks = reuse.with_key(e.drop("fetched_at", "seq"))
    assert rows(reuse.lookup(asks, entries, now).where("from_cache"), "query") == [("edge",)]
    c = reuse.entry_counts(entries, now).first()
    assert (c["live"], c["expired"]) == (1, 3)
    k = spark.range(1).select(reuse.reuse_key(F.lit("a b"), F.lit("c")), reuse.reuse_key(F.lit("a"), F.lit("b c"))).first()
    assert k[0] != k[1] and len(k[0]) == 32


def test_result_pages(spark, rows):
    block = '<!--rs--><h2><a class="title" href="https://a.com/?x=1&amp;y=2">A <b>title</b></a></h2><p class="s">S &amp; T</p><!--re-->'
    other = '<!--rs--><h2><a href="http://b.com"></a></h2><!--re-->'
    relative = '<!--rs--><h2><a href="/local">no</a></h2><!--re-->'
    df = spark.createDataFrame([(1, f"<html>{block}{other}{relative}"), (2, "<title>Captcha</title>")], "id int, html string")
    assert rows(serp.serp_hits(df, "html", "id")) == [(1, 0, "https://a.com/?x=1&y=2", "A title", "S & T"), (1, 1, "http://b.com", "http://b.com", "")]
    assert rows(serp.page_challenges(df, "html", "id")) == [(1, "markup"), (2, "captcha")]


def test_extraction_outcomes(spark, rows):
    long = "x" * 41
    tries = [("ok", 1, long, None), ("retry", 1, "", None), ("retry", 2, long, None), ("empty", 1, "", None), ("empty", 2, "x" * 40, None),
             ("late", 1, "", "aborted"), ("late", 2, long, None), ("http", 1, None, "Unlocker 502: x"), ("net", 1, None, "reset"), ("net", 2, None, "reset")]
    df = spark.createDataFrame(tries, "url string, attempt int, body string, error string")
    got = extraction.extraction_outcomes(df).select("url", "attempt", "miss")
    assert rows(got) == [("empty", 2, "empty"), ("http", 1, "http_error"), ("late", 1, "timeout"), ("net", 2, "network"), ("ok", 1, None), ("retry", 2, None)]


def test_baseline_ties_go_to_caution(spark, rows):
    votes = [("a", "knew"), ("a", "wrong"), ("b", "knew"), ("b", "knew"), ("b", "wrong"), ("c", "partial"), ("c", "unknown"), ("d", None)]
    df = spark.createDataFrame([(q_, f"g{i}", v) for i, (q_, v) in enumerate(votes)], "query_id string, grader string, verdict string")
    assert rows(baseline.majority_verdicts(df)) == [("a", "wrong"), ("b", "knew"), ("c", "unknown")]


def test_calibration(spark, rows):
    anchors = spark.createDataFrame([("a", "anchor", 3), ("p", "probe", 0)], "id string, kind string, expected_rung int")
    v = spark.createDataFrame([("good", "a", 3), ("good", "p", 0), ("bad", "a", None), ("bad", "p", 1)], "judge string, id string, rung int")
    got = {r["judge"]: (r["n_null"], r["exact_rate"], r["mean_abs_dev"], r["n_probe_failures"]) for r in baseline.calibration(v, anchors).collect()}
    assert got == {"good": (0, 1.0, 0.0, 0), "bad": (1, 0.0, 1.0, 1)}
    worst = baseline.worst_misses(baseline.misses(v, anchors)).orderBy("place").collect()
    assert [r["id"] for r in worst] == ["p", "a"]


def test_number_audit(spark, rows):
    pages = spark.createDataFrame([("p", "<style>9</style><p title='7'>Cost 1,250 and 62.5% of 99 &#8599; <svg>4</svg></p>")], "id string, html string")
    known = audit.renderings(spark.createDataFrame([(1250.0,), (0.625,)], "n double"))
    left = audit.orphans(audit.stated_numbers(pages, "id", "html"), known, [])
    assert rows(left, "number") == [("99",)]


def test_renderings(spark):
    forms = {r[0] for r in audit.renderings(spark.createDataFrame([(12954.25,)], "n double")).collect()}
    assert {"12954.25", "12,954.25", "12954", "12,954", "12954.2500", "1295425", "12954.3"} <= forms


def test_ratio_forms(spark):
    got = {r[0] for r in audit.ratio_forms(spark.createDataFrame([("a", 10.0), ("b", 540.0), ("c", None)], "provider string, p50 double"), "provider", "p50", ["a", "b", "c"]).collect()}
    assert got == {"1", "54", "0"}


def test_table_shapes(spark, rows):
    html = "<table><thead><tr><th>a</th><th>b</th></tr></thead><tbody><tr><th>ok</th><td>1</td></tr><tr><th scope=x>short</th></tr></tbody></table>"
    df = spark.createDataFrame([("p", html), ("q", "<p>no table</p>")], "id string, html string")
    assert rows(audit.table_faults(df, "id", "html")) == [("p", "short", 1, 2)]


def test_rated_pages_need_the_declared_panel(spark, rows):
    returned = spark.createDataFrame([("q", "p", "u"), ("q", "p", "v"), ("q", "p", "w")], "query_id string, provider string, url string")
    js = spark.createDataFrame([("q", "u", "x", 3), ("q", "u", "y", 0), ("q", "v", "x", 2)], "query_id string, url string, judge string, rung int")
    pages = report.rated_pages(returned, js, ["x", "y"])
    assert rows(pages, "url", "n_ratings", "page_mean", "spread", "fully_rated") == [
        ("u", 2, 1.5, 3, True), ("v", 1, 2.0, 0, False), ("w", 0, None, None, False)]
    assert report.join_match(pages).first()["matched"] == 2


def test_nested_documents(spark, tmp_path):
    src = spark.createDataFrame([("q", "ask", "a", 1, 0, "t", "u", "d", None, "text", None), ("q", "ask", "b", 2, 0, "t", "u", "d", None, None, "s")], SRC)
    votes = spark.createDataFrame([("q", "u", "j1", 3), ("q", "u", "j2", 0)], "query_id string, url string, judge string, rung int")
    pages = nested.page_documents(src, votes, pool.judged_from(src))
    fetches = spark.createDataFrame([("q", "a", None, None, 5, None), ("q", "b", None, None, 6, None)], "query_id string, provider string, error string, error_stage string, fetch_ms bigint, fetched_at string")
    docs = nested.question_documents(pages, fetches, spark.createDataFrame([("q", "ask")], "query_id string, query string"))
    nested.write_documents(docs, str(tmp_path / "docs"))
    text = next((tmp_path / "docs").glob("part-*.json")).read_text()
    doc = json.loads(text)
    page = doc["providers"]["b"]["pages"][0]
    assert (page["judged_from"], page["judged_chars"], page["own_chars"], page["spread"], len(page["ratings"])) == ("a", 4, 0, 3, 2)


# --- streams against their batch forms ------------------------------------------

LOG = "run_id string, seq bigint, query_id string, provider string, error string"


def drops(tmp_path, log, n):
    """The log as n JSON files that arrive one after another."""
    size = math.ceil(len(log) / n)
    for i in range(n):
        part = [dict(zip(("run_id", "seq", "query_id", "provider", "error"), r)) for r in log[i * size:(i + 1) * size]]
        yield write(tmp_path / "in" / f"{i}.jsonl", *[json.dumps({k: v for k, v in r.items() if v is not None}) for r in part])


@pytest.fixture
def log():
    rng = random.Random(3)
    return [("r", i, f"q{rng.randrange(9)}", f"p{rng.randrange(3)}", rng.choices([None, "fetch failed", "500"], [1, 3, 4])[0]) for i in range(90)]


def test_streams_equal_batches_over_several_arrivals(spark, tmp_path, rows, log):
    from rankloom.operators import breakers, latest

    streams.use_rocksdb(spark)
    batch = spark.createDataFrame(log, LOG)
    src = str(tmp_path / "in")
    for _ in drops(tmp_path, log, 3):
        for name in ("land", "dead", "net", "view", "prog"):
            stream = streams.read_log(spark, src, LOG)
            chk, out = str(tmp_path / name / "chk"), str(tmp_path / name / "out")
            if name == "land":
                run = streams.land(stream, chk, out)
            elif name == "dead":
                run = streams.start(streams.dead_provider_alerts(stream, limit=3), chk, out)
            elif name == "net":
                run = streams.network_alerts(stream, chk, out, limit=3)
            elif name == "view":
                run = streams.upsert_stream(stream, latest.FETCH_KEY, chk, out)
            else:
                totals = spark.createDataFrame([("r", 90)], "run_id string, total bigint")
                run = streams.write_progress(streams.progress(stream, totals), chk, out)
            run.awaitTermination()

    def out(name):
        return str(tmp_path / name / "out")

    assert rows(spark.read.parquet(out("land")), "seq") == rows(batch, "seq")
    dead = spark.read.schema("run_id string, provider string, dead_at bigint").parquet(out("dead"))
    assert rows(dead) == rows(breakers.dead_providers(batch, 3))
    net = streams.network_state(spark, out("net"))
    assert rows(net, "run_id", "dead_at") == rows(breakers.network_dead(batch, 3))
    view = streams.current_view(spark, out("view"), latest.FETCH_KEY)
    streams.compact(spark, out("view"), str(tmp_path / "folded"), latest.FETCH_KEY)
    assert rows(spark.read.parquet(str(tmp_path / "folded")).drop("batch")) == rows(view)
    assert rows(view, "query_id", "provider", "seq") == rows(latest.last_write(batch, latest.FETCH_KEY), "query_id", "provider", "seq")
    assert rows(streams.latest_progress(spark, out("prog")), "landed", "total") == [(90, 90)]


def test_each_result_is_delivered_once(spark, tmp_path):
    chk, out = str(tmp_path / "chk"), str(tmp_path / "out")
    for day, ids in ((18, ["a", "b", "a"]), (19, ["b", "c"]), (28, ["a", "d"])):
        at = [{"wire_id": k, "landed_at": f"2026-08-{day}T0{i}:00:00Z"} for i, k in enumerate(ids)]
        write(tmp_path / "in" / f"{day}.jsonl", *map(json.dumps, at))
        df = streams.read_log(spark, str(tmp_path / "in"), "wire_id string, landed_at timestamp")
        streams.deliver_first(df, chk, out).awaitTermination()
    got = sorted((r["wire_id"], str(r["landed_at"])) for r in spark.read.parquet(out).collect())
    assert got == [("a", "2026-08-18 00:00:00"), ("b", "2026-08-18 01:00:00"), ("c", "2026-08-19 01:00:00"), ("d", "2026-08-28 01:00:00")]


def test_delivered_results_keep_every_field(spark, tmp_path):
    """Nulls, large numbers, microseconds, nested values and null keys pass through; equal times give one row."""
    chk, out = str(tmp_path / "chk"), str(tmp_path / "out")
    schema = "wire_id string, landed_at timestamp, n bigint, x double, a array<string>, s struct<k:bigint>"
    big = 2**62 + 1
    first = [{"wire_id": "a", "landed_at": "2026-08-18T00:00:00.000002Z", "n": big, "a": ["x", None]}, {"wire_id": "a", "landed_at": "2026-08-18T00:00:00.000001Z", "n": big + 1, "s": {"k": big}},
             {"wire_id": "b", "n": 1}, {"wire_id": "b", "landed_at": "2026-08-18T05:00:00Z", "x": 0.1}, {"landed_at": "2026-08-18T00:00:00Z", "n": 7}, {"wire_id": "c", "n": 3}, {"wire_id": "c", "n": 3}]
    for name, rows_ in (("1", first), ("2", [{"wire_id": "c", "n": 4}, {"n": 8}, {"wire_id": "d", "landed_at": "2026-08-19T00:00:00Z"}])):
        write(tmp_path / "in" / f"{name}.jsonl", *map(json.dumps, rows_))
        streams.deliver_first(streams.read_log(spark, str(tmp_path / "in"), schema), chk, out).awaitTermination()
    got = {r.wire_id: r for r in spark.read.parquet(out).collect()}
    assert spark.read.parquet(out).count() == 5 and got.keys() == {None, "a", "b", "c", "d"}
    assert (got["a"].n, got["a"].s.k, got["a"].landed_at.microsecond, got["b"].x, got[None].n, got["c"].n) == (big + 1, big, 1, 0.1, 7, 3)


def test_entries_expire_a_day_after_their_newest_fetch(spark, tmp_path):
    streams.use_rocksdb(spark)
    chk, out = str(tmp_path / "chk"), str(tmp_path / "out")
    arrivals = [[("k", "2026-08-17T00:00:00Z")], [("k", "2026-08-17T20:00:00Z"), ("other", "2026-08-18T01:00:00Z")], [("other", "2026-08-18T23:00:00Z")]]
    for i, rows_ in enumerate(arrivals):
        write(tmp_path / "in" / f"{i}.jsonl", *[json.dumps({"key": k, "fetched_at": t}) for k, t in rows_])
        df = streams.read_log(spark, str(tmp_path / "in"), "key string, fetched_at timestamp")
        streams.start(streams.expired_entries(df), chk, out).awaitTermination()
    got = spark.read.schema("key string, fetched_ms bigint").parquet(out).collect()
    assert [r["key"] for r in got] == ["k"]


def test_f15_keys_that_expire_share_few_places_of_the_state(spark, tmp_path, monkeypatch):
    """One place a key before: two calls to the state store and two for its timer for each. Here all 300 keys share one place, and only those whose time is over go."""
    streams.use_rocksdb(spark)
    chk, out = str(tmp_path / "chk"), str(tmp_path / "out")
    day = lambda d, n: f"2026-08-{d}T00:{n // 60:02}:{n % 60:02}Z"
    arrivals = [
        [(f"k{n}", day(17, n)) for n in range(300)] + [("k7", day(16, 7))],
        [(f"k{n}", day(17, 1200 + n)) for n in range(0, 300, 3)] + [("clock", day(18, 150))],
        [("k1", day(18, 200)), ("clock", day(18, 1250))],
    ]
    for i, rows_ in enumerate(arrivals):
        write(tmp_path / "in" / f"{i}.jsonl", *[json.dumps({"key": k, "fetched_at": t}) for k, t in rows_])
        df = streams.read_log(spark, str(tmp_path / "in"), "key string, fetched_at timestamp")
        streams.start(streams.expired_entries(df, buckets=1), chk, out).awaitTermination()
    got = [(r["key"], r["fetched_ms"]) for r in spark.read.schema("key string, fetched_ms bigint").parquet(out).collect()]
    base = 1786924800000
    late = {f"k{n}": base + 1000 * n for n in range(300) if n % 3}
    again = {f"k{n}": base + 1000 * (1200 + n) for n in range(0, 51, 3)}
    # k1 was over before its second fetch came.
    assert sorted(got) == sorted((late | again).items())
