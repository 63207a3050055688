"""Provider responses under the layout table."""

import json
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from rankloom.sources import payloads

NOW = "2026-08-18 00:00:00"
SCHEMA = "provider string, query_id string, seq long, body string, num_sources int, extraction string"


@pytest.fixture
def read(spark):
    def get(rows, contents=None, more=()):
        df = spark.createDataFrame([(p, "q", i, b if isinstance(b, str) or b is None else json.dumps(b), n, x) for i, (p, b, n, x) in enumerate(rows)], SCHEMA)
        out = payloads.normalize(df, payloads.layouts(spark, *more), F.lit(NOW).cast("timestamp"), contents)
        return [r.asDict() for r in out.orderBy("seq", "pos").collect()]

    return get


def test_one_job_reads_every_layout(read):
    long = "x" * 50
    got = read([
        ("brave", {"web": {"results": [{"title": "A", "url": "https://a.example/p", "description": "said", "age": "2025-01-02", "extra_snippets": ["one", "", "two"]}]}}, 5, "clean"),
        ("exa", {"results": [{"url": "https://b.example/2024/03/x", "text": "[a](b)\nbody"}]}, 5, "clean"),
        ("parallel", {"results": [{"title": "P", "url": "u", "excerpts": ["e1", "e2"]}]}, 5, "raw"),
        ("perplexity", {"results": [{"title": "L", "url": "u", "snippet": long, "last_updated": "2025-05-06"}]}, 5, "clean"),
        ("perplexity", {"results": [{"title": "S", "url": "u", "snippet": "short"}]}, 5, "clean"),
        ("serper", {"organic": [{"title": "O", "link": "https://c.example/", "snippet": "s", "date": "March 1, 2024"}, {"title": "no link"}]}, 5, "clean"),
        ("tavily", {"results": [{"title": "T", "url": "u", "content": "snip", "raw_content": None}]}, 5, "clean"),
    ])
    assert [(r["provider"], r["title"], r["snippet"], r["content"], r["published"], r["dated_by"]) for r in got] == [
        ("brave", "A", "said", "said\n\none\n\ntwo", "2025-01-02", "age"), ("exa", "https://b.example/2024/03/x", "body", "body", "2024-03-01", "url"),
        ("parallel", "P", "e1\n\ne2", None, None, "none"), ("perplexity", "L", long, long, "2025-05-06", "last_updated"),
        ("perplexity", "S", "short", None, None, "none"), ("serper", "O", "s", None, "2024-03-01", "date"), ("tavily", "T", "snip", None, None, "none")]


def test_cutting_before_or_after_results_without_a_url(read):
    items = [{"title": str(i), "url": None if i == 1 else f"u{i}", "link": None if i == 1 else f"u{i}"} for i in range(4)]
    got = read([("firecrawl", {"data": {"web": items}}, 2, "clean"), ("serper", {"organic": items}, 2, "clean")])
    assert [(r["provider"], r["pos"], r["title"]) for r in got] == [("firecrawl", 0, "0"), ("serper", 0, "0"), ("serper", 1, "2")]


def test_the_last_text_of_a_page_is_taken_where_the_layout_says_so(spark, read):
    contents = spark.createDataFrame([("u1", 1, "zzz first and longest"), ("u1", 3, "last"), ("u1", 2, "mid"), ("u2", 1, None), ("other", 9, "x")], "url string, seq long, content string")
    page = {"organic": [{"title": "1", "link": "u1", "description": "d"}, {"title": "2", "link": "u2"}, {"title": "3", "link": "u3"}]}
    got = read([("bright_data", page, 5, "clean"), ("bright_data", page, 5, "raw"), ("serper", page, 5, "clean")], contents)
    assert [(r["provider"], r["seq"], r["title"], r["content"]) for r in got] == [
        ("bright_data", 0, "1", "last"), ("bright_data", 0, "2", None), ("bright_data", 0, "3", None),
        ("bright_data", 1, "1", None), ("bright_data", 1, "2", None), ("bright_data", 1, "3", None), ("serper", 2, "1", None), ("serper", 2, "2", None), ("serper", 2, "3", None)]


def test_a_new_provider_is_a_row(read):
    mine = ("newcomer", "a.b", "href", "blurb", ["when"], "markdown", "body", False, None, None, False)
    got = read([("newcomer", {"a": {"b": [{"href": "u", "blurb": "x", "body": "text", "when": "2025-02-03", "title": 7}]}}, 1, "clean"), ("unknown", {"results": [{"url": "u"}]}, 1, "clean")], more=(mine,))
    assert [(r["provider"], r["title"], r["snippet"], r["content"], r["published"]) for r in got] == [("newcomer", "7", "x", "text", "2025-02-03")]


def test_odd_bodies_hold_no_results(spark, read):
    bodies = [None, "", "oops", "[]", "{}", {"organic": {}}, {"organic": []}, {"organic": [{"title": "t"}, 3, None]}]
    assert read([("serper", b, 5, "clean") for b in bodies]) == []
    df = spark.createDataFrame([(p, "q", i, b if isinstance(b, str) or b is None else json.dumps(b), 5, "clean") for p in ("serper", "exa") for i, b in enumerate([*bodies, {"organic": [{"link": "u"}]}])], SCHEMA)
    got = payloads.empty_responses(df, payloads.layouts(spark)).collect()
    assert sorted((r.provider, r.seq) for r in got) == [("serper", i) for i in range(len(bodies))]


def test_of_texts_fetched_at_once_one_is_taken(spark, read):
    contents = spark.createDataFrame([("u", 1, "a"), ("u", 2, "b"), ("u", 2, "c"), ("u", 2, "c"), (None, 3, "d")], "url string, seq long, content string")
    assert [(r["title"], r["content"]) for r in read([("bright_data", {"organic": [{"title": "1", "link": "u"}]}, 5, "clean")], contents)] == [("1", "c")]


def test_a_snippet_that_was_not_sent_is_told_from_an_empty_one(read):
    items = [{"url": "u"}, {"url": "u", "description": ""}, {"url": "u", "snippet": "s"}]
    got = read([("brave", {"web": {"results": items}}, 5, "clean"), ("perplexity", {"results": items}, 5, "clean"), ("exa", {"results": items}, 5, "clean")])
    assert [(r["provider"], r["snippet"], r["sent"]) for r in got] == [
        ("brave", "", False), ("brave", "", True), ("brave", "", False), ("perplexity", "", False), ("perplexity", "", False), ("perplexity", "s", True),
        ("exa", "", True), ("exa", "", True), ("exa", "", True)]


@pytest.mark.parametrize("odd", [
    "select * from d where doc_id % 7 not in (2, 3)",
    "select * from d union all select doc_id + 100003, text, lang, source, n_chars from d",
    "select * from d union all select * from d where doc_id % 11 = 2",
    "select doc_id - 103 as doc_id, text, lang, source, n_chars from d",
    "select case when doc_id % 13 <> 4 then doc_id end as doc_id, text, lang, source, n_chars from d",
    "select doc_id, case when doc_id % 7 <> 3 then text end as text, lang, case when doc_id % 5 <> 1 then source end as source, n_chars from d",
    "select doc_id, case doc_id % 7 when 3 then '' when 4 then ' ' || chr(10) else text end as text, lang, case when doc_id % 5 <> 1 then source else '' end as source, n_chars from d",
], ids=["gaps", "shifted", "repeated", "negative", "no ids", "nulls", "empty"])
def test_odd_documents_give_the_rows_of_the_sql(spark, tmp_path, odd):
    con = duckdb.connect()
    con.sql("create view d as select * from '/root/testdata/sf0.001/documents.parquet'")
    con.sql(f"copy ({odd}) to '{tmp_path}/documents.parquet'")
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet'")
    df = entry.queries()["s13_payload_sources"](spark, str(tmp_path))
    want = con.sql(entry.oracle_sql()["s13_payload_sources"])
    at = [want.columns.index(c) for c in df.columns]
    assert Counter(map(tuple, df.collect())) == Counter(tuple(r[i] for i in at) for r in want.fetchall())


def test_texts_are_dealt_as_documents_and_as_fetched_pages_only(spark):
    """Without broadcasts by size, as on large tables: bodies, results and finished rows of the other layouts stay where they are made."""
    status = spark.sparkContext._jsc.sc()

    def shuffled():
        status.listenerBus().waitUntilEmpty(30_000)
        return status.statusStore().executorSummary("driver").totalShuffleWrite()

    whole = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.sum(F.octet_length("text"))).first()[0]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled()
        entry.queries()["s13_payload_sources"](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert shuffled() - before < 1.5 * whole
