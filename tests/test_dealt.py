"""Queries on tables where they differed from their SQL or moved more than they need."""

import pytest

import __spark_entry__ as entry
from pyspark.sql import functions as F
from rankloom.functions.urls import normalize_url
from rankloom.plans import views
from rankloom.plans.views import Views
from rankloom.sources import landing, question_sets

SMALL = "/root/testdata/sf0.001"


def test_f1_pairs_that_share_no_question_are_no_rows(spark, tmp_path):
    for name in ("lineitem", "events"):
        table = spark.read.parquet(f"{SMALL}/{name}.parquet")
        table.where("l_suppkey % 8 <> 3" if name == "lineitem" else "true").write.parquet(f"{tmp_path}/{name}.parquet")
    got = entry.queries()["a41_paired_sign_test"](spark, str(tmp_path)).collect()
    assert not [r for r in got if r.n_questions == 0 or "p3" in (r.a, r.b)]


def test_buckets_follow_the_bytes_of_the_tables(spark, monkeypatch):
    monkeypatch.setattr(landing, "PART_BYTES", 10_000)
    v = Views(spark, SMALL)
    n = v.parts("judgement_log")
    assert n > 4 and v.dealt("judgement_log").rdd.getNumPartitions() == n
    for name in ("judgement_log", "fetch_pages"):
        made = landing.land(v.dealt(name), name, landing.KEYS[name], buckets=n, dealt=True)
        assert sorted(map(repr, made.collect())) == sorted(map(repr, v.view(name).select(*made.columns).collect()))
        assert made.rdd.getNumPartitions() <= n


def test_pages_are_shuffled_once_and_told_apart_there(spark):
    plan = Views(spark, SMALL).dealt("fetch_pages")._jdf.queryExecution().executedPlan().toString()
    first = plan.split("Initial Plan")[-1]
    assert first.count("Exchange ") == 1 and "HashAggregate" not in first.split("Exchange ")[1]


@pytest.mark.parametrize("query", ["d08_resume_verdict_keys", "a38_overlap_histogram", "j05_join_match"])
def test_one_pass_queries_write_no_judgements_or_pages(spark, query):
    views._LANDED.clear()
    entry.queries()[query](spark, SMALL)
    assert not {k[1] for k in views._LANDED} & {"judgement_log", "fetch_pages"}


def test_urls_in_normal_form_pass_as_they_are(spark):
    urls = ["https://h.example/1", "http://a-b.c/x//y", "https://h.example/1/", "https://h.example/1?utm_source=x", "https://H.example/1", "https://h.example:443/a",
            "https://h.example/a\u0085", " https://h.example/a@b:c ", "https://u@h.example/a", "https://h.example", "https://h.example/%41", "no url", "", None]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    got = [r.n for r in df.select(normalize_url(F.col("u")).alias("n")).collect()]
    assert got == ["https://h.example/1", "http://a-b.c/x//y", "https://h.example/1", "https://h.example/1", "https://h.example/1", "https://h.example/a",
                   "https://h.example/a\u0085", "https://h.example/a@b:c", "https://u@h.example/a", "https://h.example", "https://h.example/%41", "no url", "", None]


def test_f2_arrays_read_in_splits_lose_no_element(spark, tmp_path):
    """The join with the kinds of files turns into a broadcast while it runs; the lines of a file stay together."""
    for n in (1, 2):
        (tmp_path / f"a{n}.json").write_text("\n [" + ",\n".join('{"i":%d,"x":"%s"}' % (i, "y" * 80) for i in range(1000)) + "]\n")
    conf = {"spark.sql.files.maxPartitionBytes": "20k", "spark.sql.files.openCostInBytes": "1k", "spark.sql.autoBroadcastJoinThreshold": "8k"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, x in conf.items():
            spark.conf.set(k, x)
        entries = question_sets.read_set(spark, str(tmp_path))
        plan, got = entries._jdf.queryExecution().executedPlan().toString(), entries.collect()
    finally:
        for k, x in old.items():
            spark.conf.set(k, x)
    assert sorted((r.file[-7:], r.pos, int(r.raw.split(":")[1].split(",")[0])) for r in got) == [(f"a{n}.json", i, i) for n in (1, 2) for i in range(1000)]
    assert "REPARTITION_BY_COL" in plan
