"""The run logs, derived from the driver tables.

Each text runs unchanged on Spark and on DuckDB; ``{name}`` stands for a base
table. Keys of the logs come from ids of the tables, so their number follows
the tables: a hundred questions for every 10,000 events or 15,000 orders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources import landing

BASE_TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]
PROVIDERS = [f"p{i}" for i in range(8)]
ARM_PROVIDERS = [f"p{i}" for i in range(4)]
JUDGES = ["A", "N", "R"]
# Fixed instant that stands for the wall clock.
NOW = "2026-08-18 00:00:00"
EVENTS_NOW = "2024-01-03 00:00:00"

# Order of rows in the logs that come from lineitem.
JUDGED_ORDER = ("l_shipdate", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
LANDED_ORDER = {"fetch_log": ("seq",), "judgement_log": JUDGED_ORDER, "set_verdict_log": JUDGED_ORDER}

VIEWS = {
    "fetch_log": """
select event_id as seq, 'r' || cast(cast(ts as date) as string) as run_id,
 'q' || cast(user_id % 100 + 100 * cast(floor(event_id / 10000) as bigint) as string) as query_id, 'p' || cast(event_id % 8 as string) as provider,
 't' || cast(user_id % 100 % 6 as string) as type,
 case when user_id % 100 % 2 = 0 then 'sharp' when user_id % 100 % 10 = 5 then null else 'open' end as sharpness,
 case when user_id % 100 % 7 = 6 then null else 'g' || cast(user_id % 100 % 7 as string) end as genre,
 case when event_type = 'error' then case cast(floor(value * 100) as bigint) % 3 when 0 then 'fetch failed' when 1 then '402 payment required'
   else '500 from provider' end end as error,
 case when event_type = 'error' then case event_id % 5 when 0 then 'judge' when 1 then null else 'provider' end end as error_stage,
 case when event_type <> 'error' then cast(floor(value * 100) as bigint) end as fetch_ms,
 case when event_type <> 'error' then ts end as fetched_at,
 case when event_type <> 'error' then event_id % 9 else 0 end as num_sources,
 case when event_type <> 'error' then (event_id % 9) * (user_id % 3) / 2 else 0 end as num_extracted
from {events}""",
    "outage_log": """
select event_id as seq, 'r' || cast(run as string) as run_id, 'p' || cast(event_id % 8 as string) as provider,
 case when run % 2 = 0 and cast(floor(event_id / 20) as bigint) % 5 = 3 then 'fetch failed'
   when event_id % 8 = run % 8 then '500 from provider'
   when event_id % 8 = (run + 1) % 8 and event_id % 500 < 40 then '429 too many requests'
   when event_id % 8 = (run + 2) % 8 and event_id % 500 < 140 then '502 bad gateway'
   when event_type = 'error' then '500 from provider' end as error
from (select event_id, event_type, cast(floor(event_id / 500) as bigint) as run from {events}) as e""",
    "fetch_pages": """
select distinct 'q' || cast(l_orderkey % 100 + 100 * cast(floor(l_orderkey / 15000) as bigint) as string) as query_id, 'p' || cast(l_suppkey % 8 as string) as provider,
 'https://h.example/' || cast(l_partkey as string) as url from {lineitem}""",
    "judgement_log": """
select l_shipdate, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice,
 'q' || cast(l_orderkey % 100 + 100 * cast(floor(l_orderkey / 15000) as bigint) as string) as query_id, 'https://h.example/' || cast(l_partkey as string) as url,
 l_returnflag as judge, case when l_linenumber = 7 then null else cast(floor(l_quantity) as int) % 4 end as rung,
 case when l_tax >= 0.08 then 'Request timed out.' end as error from {lineitem}""",
    "set_verdict_log": """
select l_shipdate, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice,
 'q' || cast(l_orderkey % 100 + 100 * cast(floor(l_orderkey / 15000) as bigint) as string) as query_id, 'p' || cast(l_suppkey % 8 as string) as provider,
 l_returnflag as judge, case when l_linenumber = 7 then null else cast(floor(l_quantity) as int) % 4 end as score,
 case when l_tax >= 0.08 then 'Request timed out.' end as error from {lineitem}""",
    "arm_log": """
select o_orderkey as seq, 'q' || cast(o_custkey % 200 as string) as query_id, o_orderpriority as type,
 'p' || cast(o_orderkey % 4 as string) as provider, o_orderkey % 5 as seed,
 cast(floor(o_totalprice) as bigint) % 11 as ret_a, cast(floor(o_totalprice / 7) as bigint) % 11 as ret_b,
 cast(floor(o_totalprice / 13) as bigint) % 11 as ans_a, cast(floor(o_totalprice / 17) as bigint) % 11 as ans_b,
 case when o_orderkey % 97 = 0 then 'judge returned unparseable output' else 'fine' end as rationale_a,
 case when o_orderkey % 23 = 0 then 'HTTP 500' when o_orderkey % 41 = 0 then '402 insufficient credits'
   when o_orderkey % 59 = 0 then 'fetch failed' end as error,
 case when o_orderkey % 46 = 0 then 'judge' end as error_stage,
 case when o_orderkey % 23 <> 0 then cast(floor(o_totalprice) as bigint) % 5000 end as fetch_ms,
 cast(floor(o_totalprice) as bigint) % 9000 as latency_ms,
 'b' || cast(year(o_orderdate) as string) as batch_id
from {orders}""",
    "run_arms": """
select 'run' || cast(l_orderkey as string) as id, l_orderkey as seq, l_linenumber, l_partkey, l_suppkey,
 l_extendedprice, l_shipdate, 'p' || cast(l_suppkey % 4 as string) as provider,
 cast(floor(l_quantity) as bigint) % 11 as retrieval_score, cast(floor(l_extendedprice) as bigint) % 11 as score,
 cast(floor(l_extendedprice) as bigint) % 9000 as latency_ms,
 case when l_tax >= 0.07 then 'HTTP 500' end as error, l_returnflag as domain
from {lineitem}""",
    "panel_labels": """
select doc_id, 'quality' as judge, quality as rung from {labels}
union all select doc_id, 'toxic' as judge, toxic as rung from {labels}""",
    "source_log": """
select 'q' || cast(cast(floor(doc_id / 40) as bigint) as string) as query_id,
 'question ' || cast(cast(floor(doc_id / 40) as bigint) as string) as query,
 'p' || cast(doc_id % 8 as string) as provider,
 doc_id as seq, 0 as pos, source || ' ' || cast(doc_id as string) as title,
 case doc_id % 4
   when 0 then 'HTTPS://WWW.' || lang || '.Example.com:443/a/' || cast(n_chars % 5 as string) || '/'
   when 1 then 'https://www.' || lang || '.example.com/a/' || cast(n_chars % 5 as string) || '?utm_source=x#frag'
   when 2 then ' https://www.' || lang || '.example.com/a/' || cast(n_chars % 5 as string)
   else 'https://www.' || lang || '.example.com/a/' || cast(n_chars % 5 as string) || '?fbclid=1' end as url,
 lang || '.example.com' as domain,
 case when doc_id % 3 = 0 then '2026-0' || cast(1 + doc_id % 7 as string) || '-11' end as published,
 case when doc_id % 5 <> 0 then text end as content, source as snippet
from {documents}""",
    "questions": """
select o_orderkey as seq, 'q' || cast(o_orderkey as string) as id, o_orderpriority as type,
 'order ' || cast(o_orderkey as string) as query from {orders}""",
    "reuse_entries": """
select event_id as seq, 'p' || cast(event_id % 4 as string) as provider, 'ask ' || cast(user_id as string) as query,
 'all' as freshness, 8 as num_sources, 'clean' as extraction, 0 as seed, ts as fetched_at from {events}""",
    "doc_texts": """
select doc_id, 'p' || cast(doc_id % 8 as string) as provider, lang, source,
 case doc_id % 7 when 0 then '# Title' || chr(10) || text when 1 then text || '…'
  when 2 then text || chr(10) || '|---|:--|' when 3 then 'see [a](http://x.y) ![i ' || text
  when 4 then '* [Home](/home)' || chr(13) || chr(10) || '  [News](/n)  ' || chr(10) || chr(10) || chr(10) || chr(10) || text || chr(10) || chr(10) || chr(10) || '**end**  '
  when 5 then '' else '- item' || chr(10) || text end as content
from {documents}""",
    "provider_costs": """
select 'p' || cast(p_partkey % 8 as string) as provider, avg(p_retailprice) / 1000 as usd_per_query,
 sum(p_retailprice) / 1000 as usd_for_run, count(*) as calls from {part} group by 1""",
    "baseline_log": """
select o_orderkey as seq, 'q' || cast(o_custkey as string) as query_id, 'g' || cast(o_orderkey % 3 as string) as grader,
 case cast(floor(o_totalprice) as bigint) % 5 when 0 then 'knew' when 1 then 'partial' when 2 then 'wrong' when 3 then 'unknown' end as verdict,
 case when o_orderkey % 31 = 0 then 'timed out' end as error from {orders}""",
    "part_points": """
select p_partkey, 'v' || cast(p_partkey as string) as provider, p_retailprice as cost, avg(l_quantity) as rating
from {part} join {lineitem} on p_partkey = l_partkey group by p_partkey, p_retailprice""",
}


# Landed logs of this process, by application, log, buckets and state of the files that it comes from.
_LANDED: dict[tuple, DataFrame] = {}


class Views:
    """Base tables and derived logs of one data folder, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        used = {t: self.table(t) for t in BASE_TABLES if "{" + t + "}" in text}
        return self.spark.sql(text, **used)

    def view(self, name: str) -> DataFrame:
        return self.sql(VIEWS[name])

    def once(self, name: str, view: str, make: Callable[[], DataFrame]) -> DataFrame:
        """What ``make`` writes and reads back, made once for an application, its shuffle partitions and the files that the view comes from."""
        bases = tuple(landing.state_of(self.spark, f"{self.sf_dir}/{t}.parquet") for t in BASE_TABLES if "{" + t + "}" in VIEWS[view])
        key = (self.spark.sparkContext.applicationId, name, landing.buckets_of(self.spark), bases)
        if key not in _LANDED:
            _LANDED[key] = make()
        return _LANDED[key]

    def parts(self, name: str) -> int:
        """Buckets of a log, by the bytes of the files that it comes from."""
        bases = [t for t in BASE_TABLES if "{" + t + "}" in VIEWS[name]]
        return landing.parts_for(self.spark, sum(length for t in bases for _, length, _ in landing.state_of(self.spark, f"{self.sf_dir}/{t}.parquet")))

    def returned(self) -> DataFrame:
        """``fetch_pages`` before its rows are told apart."""
        return self.sql(VIEWS["fetch_pages"].replace("select distinct", "select", 1))

    def dealt(self, name: str) -> DataFrame:
        """A log in partitions of its key: one shuffle of the columns that are used, no table. Repeated pages go where they were dealt, so no map task holds all of its rows."""
        rows = self.returned() if name == "fetch_pages" else self.view(name)
        rows = rows.repartition(self.parts(name), *landing.KEYS[name])
        return rows.distinct() if name == "fetch_pages" else rows

    def landed(self, name: str) -> DataFrame:
        """A log from its bucketed table."""
        def make():
            dealt = name == "fetch_pages"
            return landing.land(self.dealt(name) if dealt else self.view(name), name, landing.KEYS[name], LANDED_ORDER.get(name, ()), self.parts(name), dealt)

        return self.once(name, name, make)

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            return self.view(name)
        if name in BASE_TABLES:
            return self.table(name)
        raise AttributeError(name)
