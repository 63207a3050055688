"""Reuse of earlier fetches: valid for 24 hours, never from the future.

Stored entries are partitioned by the day they were written. An entry is written
once it is fetched, so what is valid now was written yesterday or today: a lookup
reads those days only, and older ones are dropped whole. Of a key the last write
counts, valid or not; one that lies in an older day is not valid, so reading two
days gives what reading all would.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

TTL_SECONDS = 24 * 60 * 60
KEY_FIELDS = ["provider", "query", "freshness", "num_sources", "extraction", "seed"]


def reuse_key(*fields: Column) -> Column:
    """First 32 hex digits of the sha-256 of the NUL-joined fields."""
    return F.substring(F.sha2(F.concat_ws("\u0000", *[f.cast("string") for f in fields]), 256), 1, 32)


def with_key(df: DataFrame) -> DataFrame:
    return df.withColumn("key", reuse_key(*[F.col(c) for c in KEY_FIELDS]))


def _is_live(fetched_at: Column, now: Column) -> Column:
    at = fetched_at.try_cast("timestamp")
    age = F.unix_micros(now) - F.unix_micros(at)
    return F.coalesce(age.between(0, TTL_SECONDS * 1_000_000), F.lit(False))


def entries_by_key(entries: DataFrame) -> DataFrame:
    """The entry last written under each key."""
    w = Window.partitionBy("key").orderBy(F.col("seq").desc())
    return entries.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def lookup(requests: DataFrame, entries: DataFrame, now: Column) -> DataFrame:
    """Requests with the live entry of their key, if there is one. Entries with a ``day`` are read from yesterday's on."""
    if "day" in entries.columns:
        entries = entries.where(F.col("day") >= F.date_sub(F.to_date(now), 1)).drop("day", "written_at")
    live = entries_by_key(entries).where(_is_live(F.col("fetched_at"), now))
    payload = [c for c in live.columns if c not in (*KEY_FIELDS, "key", "seq")]
    hit = live.select("key", *payload)
    return requests.join(hit, "key", "left").withColumn("from_cache", F.col("fetched_at").isNotNull())


def write_entries(fetched: DataFrame, path: str, written_at: Column | None = None) -> None:
    """Add entries under the day they are written (now, unless the rows say)."""
    at = F.current_timestamp() if written_at is None else written_at.cast("timestamp")
    rows = with_key(fetched).withColumn("written_at", at).withColumn("day", F.to_date("written_at"))
    rows.hint("rebalance", "day").write.mode("append").partitionBy("day").parquet(path)


def stored_entries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def expire(spark: SparkSession, path: str, today: datetime.date) -> int:
    """Drop the days in which nothing is valid any more; how many went."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    files, gone = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), 0
    for found in files.listStatus(where):
        name = found.getPath().getName()
        if name.startswith("day=") and name[4:] < (today - datetime.timedelta(days=1)).isoformat():
            gone += bool(files.delete(found.getPath(), True))
    return gone


def entry_counts(entries: DataFrame, now: Column) -> DataFrame:
    live = _is_live(F.col("fetched_at"), now)
    return entries_by_key(entries).agg(F.count_if(live).alias("live"), F.count_if(~live).alias("expired"))
