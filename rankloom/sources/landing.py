"""Logs landed in the warehouse in buckets of their key, so dedupe and joins on the key read without a shuffle.

A log is shuffled once, when it lands. Rows of a bucket are in log order. Skewed
buckets are written by several tasks (the rebalance hint); a bucket is read by
one. Keys are chosen so that what shares one is small: the fetches and whole-set
ratings of one provider on one question, and the ratings and returns of one page
of one question.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import shared_dir

#: Bucket keys of each log.
KEYS = {
    "fetch_log": ("query_id", "provider"),
    "set_verdict_log": ("query_id", "provider"),
    "judgement_log": ("query_id", "url"),
    "fetch_pages": ("query_id", "url"),
}


def buckets_of(spark: SparkSession) -> int:
    """As many buckets as a shuffle has partitions, so that shuffled rows meet landed ones."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Input bytes for one bucket or partition of a log: a few hundred thousand rows, so sorts of it stay in memory.
PART_BYTES = 8 << 20


def parts_for(spark: SparkSession, size: int) -> int:
    """Buckets of a log from files of ``size`` bytes: as many as a shuffle has partitions, more where they would grow with the log."""
    return max(buckets_of(spark), -(-size // PART_BYTES))


def land(df: DataFrame, name: str, keys: tuple[str, ...], order: tuple[str, ...] = (), buckets: int | None = None, dealt: bool = False) -> DataFrame:
    """Write a log as a bucketed table in the shared folder and read it back; one that is ``dealt`` into its buckets is not shuffled again."""
    spark = df.sparkSession
    n, table = buckets or buckets_of(spark), f"landed_{name}_{uuid.uuid4().hex}"
    writer = (df if dealt else df.hint("rebalance", n, *keys)).write.format("parquet").option("path", f"{shared_dir(spark)}/landed/{table}").bucketBy(n, *keys)
    (writer.sortBy(*order) if order else writer).saveAsTable(table)
    return spark.table(table)


def state_of(spark: SparkSession, path: str) -> tuple:
    """Files under a path with their sizes and times: two equal states hold the same rows."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(where)
    return tuple(sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in found))
