"""Registered queries: the log streams, run over the tables and compared with their batch forms."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from ..operators.dims import matrix
from ..operators.latest import FETCH_KEY
from ..session import shared_dir
from ..streaming import streams
from .registry import query
from .views import PROVIDERS, VIEWS, Views


def _area(v: Views, name: str) -> str:
    return f"{shared_dir(v.spark)}/streams/{name}-{uuid.uuid4().hex}"


def stream(v: Views, view: str, table: str) -> DataFrame:
    """A derived log read as a stream of the base table's files."""
    base = v.spark.readStream.schema(v.table(table).schema).parquet(f"{v.sf_dir}/{table}*.parquet")
    return v.spark.sql(VIEWS[view], **{table: base})


def fetch_stream(v: Views) -> DataFrame:
    return stream(v, "fetch_log", "events")


@query("t01_landing", "select seq, run_id, query_id, provider, error, fetch_ms from fetch_log")
def t01(v):
    area = _area(v, "t01")
    rows = fetch_stream(v).select("seq", "run_id", "query_id", "provider", "error", "fetch_ms")
    streams.land(rows, f"{area}/check", f"{area}/out").awaitTermination()
    return v.spark.read.parquet(f"{area}/out")


@query("t02_dead_provider_alerts", "select run_id, provider, min(seq) as dead_at from tally where ok = 0 and bad >= 2 group by 1, 2")
def t02(v):
    streams.use_rocksdb(v.spark)
    area = _area(v, "t02")
    alerts = streams.dead_provider_alerts(fetch_stream(v), limit=2)
    streams.start(alerts, f"{area}/check", f"{area}/out").awaitTermination()
    return v.spark.read.schema("run_id string, provider string, dead_at bigint").parquet(f"{area}/out")


@query("t03_network_alerts", """
select run_id, min(seq) as dead_at from (select run_id, seq, fault, row_number() over (partition by run_id, isle, fault = 'transport' order by seq) as k from isles)
where fault = 'transport' and k >= 2 group by 1""")
def t03(v):
    area = _area(v, "t03")
    streams.network_alerts(fetch_stream(v), f"{area}/check", f"{area}/state", limit=2).awaitTermination()
    return streams.network_state(v.spark, f"{area}/state").where("dead_at is not null").select("run_id", "dead_at")


@query("t02_dead_provider_default", "select run_id, provider, min(seq) as dead_at from outage_tally where ok = 0 and bad >= 8 group by 1, 2")
def t02_default(v):
    streams.use_rocksdb(v.spark)
    area = _area(v, "t02-default")
    alerts = streams.dead_provider_alerts(stream(v, "outage_log", "events"))
    streams.start(alerts, f"{area}/check", f"{area}/out").awaitTermination()
    return v.spark.read.schema("run_id string, provider string, dead_at bigint").parquet(f"{area}/out")


@query("t03_network_default", """
select run_id, min(seq) as dead_at from (select run_id, seq, hit, row_number() over (partition by run_id, isle, hit order by seq) as k from outage_isles)
where hit and k >= 12 group by 1""")
def t03_default(v):
    area = _area(v, "t03-default")
    streams.network_alerts(stream(v, "outage_log", "events"), f"{area}/check", f"{area}/state").awaitTermination()
    return streams.network_state(v.spark, f"{area}/state").where("dead_at is not null").select("run_id", "dead_at")


@query("t04_matrix_progress", "select run_id, count(*) as landed, 8 * count(distinct query_id) as total from fetch_log group by 1")
def t04_matrix(v):
    streams.use_rocksdb(v.spark)
    area = _area(v, "t04-matrix")
    asked = v.fetch_log.select("run_id", "query_id").distinct()
    totals = matrix(asked, provider=PROVIDERS).groupBy("run_id").agg(F.count(F.lit(1)).alias("total"))
    streams.write_progress(streams.progress(fetch_stream(v), totals), f"{area}/check", f"{area}/out").awaitTermination()
    return streams.latest_progress(v.spark, f"{area}/out")


@query("t04_progress", "select run_id, count(*) as landed, cast(100000 as bigint) as total from fetch_log group by 1")
def t04(v):
    streams.use_rocksdb(v.spark)
    area = _area(v, "t04")
    totals = v.fetch_log.select("run_id").distinct().withColumn("total", F.lit(100000).cast("bigint"))
    streams.write_progress(streams.progress(fetch_stream(v), totals), f"{area}/check", f"{area}/out").awaitTermination()
    return streams.latest_progress(v.spark, f"{area}/out")


@query("t05_expired_entries", """
select provider || '|' || query as key, max(epoch_us(fetched_at)) // 1000 as fetched_ms from reuse_entries group by 1
having max(fetched_at) <= (select max(date_trunc('millisecond', fetched_at)) from reuse_entries) - interval 24 hour""")
def t05(v):
    streams.use_rocksdb(v.spark)
    area = _area(v, "t05")
    rows = stream(v, "reuse_entries", "events").select(
        F.concat_ws("|", "provider", "query").alias("key"), F.col("fetched_at").cast("timestamp").alias("fetched_at")
    )
    streams.start(streams.expired_entries(rows), f"{area}/check", f"{area}/out").awaitTermination()
    return v.spark.read.schema("key string, fetched_ms bigint").parquet(f"{area}/out")


@query("t06_last_write_view", """
select seq, query_id, provider, error from (select *, row_number() over (partition by query_id, provider order by seq desc) as rn from fetch_log) where rn = 1""")
def t06(v):
    area = _area(v, "t06")
    rows = fetch_stream(v).select("seq", "query_id", "provider", "error")
    streams.upsert_stream(rows, FETCH_KEY, f"{area}/check", f"{area}/view").awaitTermination()
    return streams.current_view(v.spark, f"{area}/view", FETCH_KEY)


@query("t07_first_results", """
select query_id || '|' || provider as wire_id, seq, error, fetch_ms from
 (select *, row_number() over (partition by query_id, provider order by seq) as rn from fetch_log) where rn = 1""")
def t07(v):
    area = _area(v, "t07")
    rows = fetch_stream(v).select(F.concat_ws("|", "query_id", "provider").alias("wire_id"), "seq", "error", "fetch_ms")
    streams.deliver_first(rows, f"{area}/check", f"{area}/out", order="seq").awaitTermination()
    return v.spark.read.schema(rows.schema).parquet(f"{area}/out")
