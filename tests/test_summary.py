"""Whole summaries from JSON-lines logs on disk."""

import json

from pyspark.sql import functions as F

from rankloom.plans import summary
from rankloom.sources import logs

JUDGES = ["x", "y"]


def lines(path, rows):
    path.write_text("\n".join(json.dumps(r) for r in rows) + "\n")
    return str(path)


def source(url, content=None):
    return {"title": "t", "url": url, "domain": "d", "published": None, "content": content}


def run(tmp_path):
    fetches, judged, sets = [], [], []
    for i in range(4):
        q = f"q{i}"
        for p, urls in (("a", ["https://s.com/1/", "https://s.com/2?utm_source=z"]), ("b", ["https://s.com/1"])):
            fetches.append({"queryId": q, "type": "how_to", "query": "ask", "provider": p, "sharpness": "sharp" if i % 2 else "open",
                            "num_sources": len(urls), "num_extracted": 1, "urls": [u.split("?")[0].rstrip("/") for u in urls],
                            "sources": [source(u, "# text") for u in urls], "fetch_ms": 100 + i, "fetched_at": "2026-08-17T01:00:00Z"})
            for j in JUDGES:
                sets.append({"queryId": q, "provider": p, "judge": j, "score": 3 if p == "a" else 1})
        for u, r in (("https://s.com/1", 3), ("https://s.com/2", 1)):
            for j in JUDGES:
                judged.append({"queryId": q, "url": u, "judge": j, "rung": r if j == "x" else max(r - i % 2, 0)})
    fetches.append({"queryId": "q0", "type": "how_to", "query": "ask", "provider": "c", "urls": [], "sources": [], "error": "500", "error_stage": "provider"})
    return (lines(tmp_path / "f.jsonl", fetches), lines(tmp_path / "j.jsonl", judged), lines(tmp_path / "s.jsonl", sets))


def test_pooled_and_report_tables(spark, tmp_path, rows):
    f, j, s = run(tmp_path)
    fetch_log = logs.scan_log(spark, f, "fetches")
    judgement_log = logs.scan_log(spark, j, "judgements")
    pooled = summary.pooled_summary(fetch_log, judgement_log, logs.scan_log(spark, s, "set_verdicts"), JUDGES, ["a", "b", "c"])
    assert rows(pooled["by_provider"], "provider", "n_queries", "n_misses") == [("a", 4, 0), ("b", 4, 0), ("c", 1, 1)]
    assert rows(pooled["by_provider_set"], "provider", "mean_score") == [("a", 3.0), ("b", 1.0), ("c", 0.0)]
    c = pooled["counters"].first()
    assert (c["n_queries"], c["n_pairs"], c["n_judgements"], c["n_unjudged_pairs"]) == (4, 8, 16, 0)
    assert pooled["agreement"].first()["n"] == 8
    assert {r["sharpness"]: r["raw_agreement"] for r in pooled["agreement_by_sharpness"].collect()} == {"open": 1.0, "sharp": 0.0}
    summary.write_summary(pooled, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out" / "variance_shares")).count() == 1

    groups = spark.createDataFrame([("q0", "base"), ("q1", "hard"), ("q2", "unanswerable"), ("q3", "unanswerable")], "query_id string, group string")
    costs = spark.createDataFrame([("a", 0.02, 1.0), ("b", 0.01, 0.5)], "provider string, usd_per_query double, usd_for_run double")
    tables = summary.report_tables(fetch_log, judgement_log, pooled["by_provider_set"], groups, costs, JUDGES, ["a", "b"])
    scored = {r["provider"]: r for r in tables["page_scores"].collect()}
    assert scored["a"]["n_pages"] == 8 and scored["b"]["page_mean"] == 2.75 and scored["a"]["base"] == 2.0
    assert {r["k"]: r["n_pages"] for r in tables["overlap"].collect()} == {1: 4, 2: 4}
    assert {r["k"]: r["n_pages"] for r in tables["overlap_by_raw_url"].collect()} == {1: 12, 2: 0}
    assert all(r["join_match_pct"] == 100 for r in tables["join_match"].collect())
    assert [r["provider"] for r in tables["frontier"].collect()] == ["b", "a"]
    pair = tables["unanswerable_pairs"].first()
    assert (pair["n_questions"], pair["a_lower"]) == (2, 2) and abs(pair["p"] - 0.5) < 1e-12
    for name, table in tables.items():
        assert table.count() >= 1, name


def test_baseline_summary(spark, rows):
    log = spark.createDataFrame(
        [(1, "a", "g", "wrong", None), (2, "a", "g", "knew", None), (3, "b", "g", None, None), (4, "c", "g", "wrong", None), (5, "d", "g", None, "timeout")],
        "seq bigint, query_id string, grader string, verdict string, error string",
    )
    t = summary.baseline_summary(log)
    assert rows(t["already_known"]) == [("a",)] and rows(t["confidently_wrong"]) == [("c",)]
    assert tuple(t["counters"].first()) == (2, 1, 1)


def test_arm_summary(spark):
    js = F.array(*[F.struct(F.lit(j).alias("judge"), F.lit(s).alias("retrieval_score"), F.lit("r").alias("retrieval_rationale"),
                            F.lit(s).alias("answer_score"), F.lit("r").alias("answer_rationale")) for j, s in (("x", 5.0), ("y", 7.0), ("z", 6.0))])
    log = spark.range(8).select(
        F.col("id").alias("seq"), F.concat(F.lit("q"), F.col("id") % 2).alias("query_id"), F.lit("t").alias("type"), F.lit("p").alias("provider"),
        (F.col("id") % 4).alias("seed"), js.alias("judgements"), F.lit(None).cast("string").alias("error"), F.lit(None).cast("string").alias("error_stage"),
        F.lit(9).alias("fetch_ms"),
    )
    t = summary.arm_summary(log, ["x", "y", "z"], sorted(r["provider"] for r in log.select("provider").distinct().collect()))
    assert t["agreement"].count() == 6 and t["variance"].first()["judge_gap_mean"] == 2.0
    assert t["by_provider"].first()["retrieval_mean"] == 6.0
