"""The registry as the driver sees it."""

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"
SAMPLE = ["a13_provider_stat", "a14_sliced_provider_stat", "a19_variance_shares", "d09_pool", "w07_network_dead", "j11_dominance"]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 130


def test_entry_returns_the_scoreboard(spark):
    df = entry.entry(spark)
    assert "mean_rung" in df.columns and df.count() == 8


@pytest.mark.parametrize("name", SAMPLE)
def test_results_do_not_depend_on_partition_count(spark, rows, name):
    seen = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.append(rows(entry.queries()[name](spark, SMALL)))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert seen[0] == seen[1]


@pytest.mark.parametrize("name", SAMPLE)
def test_results_match_the_sql(spark, name):
    import glob
    import os

    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    df = entry.queries()[name](spark, SMALL)
    cols = sorted(df.columns)
    want = con.sql(entry.oracle_sql()[name])
    at = [want.columns.index(c) for c in cols]
    expected = sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)
    assert sorted((tuple(r) for r in df.select(*cols).collect()), key=repr) == expected
