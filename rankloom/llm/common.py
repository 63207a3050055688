"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..session import shared_dir

#: A word of the word-count and shingle contracts: no space and no tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: Rows and bytes of rows that a task hands to Python at a time.
BATCH_ROWS, BATCH_BYTES = 1000, 2 << 20


def small_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches are small: those of whole texts stand in memory several times, in the executor and in its workers."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        spark.conf.set(f"spark.sql.execution.arrow.{key}", str(most))


def whole(text: Column) -> Column:
    """Text with null read as empty."""
    return F.coalesce(text.cast("string"), F.lit(""))


def dropped(spark: SparkSession, path: str) -> None:
    """Remove a staged folder through Hadoop, so any shared store works."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Written intermediates of one call, in the shared folder, that their owner removes when nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{shared_dir(self.spark)}/staged/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        for path in self.paths:
            dropped(self.spark, path)
        self.paths = []


def placed(df: DataFrame, tree: str, order: list[str], scratch: Scratch) -> DataFrame:
    """Adds ``place``, each row's number from 0 in its tree by ``order``, and ``n``, the tree's rows; null is a tree.

    Rows are shuffled by range and counted per tree and range, so a tree of any
    size spreads over all tasks.
    """
    rows = df.repartitionByRange(tree, *order).sortWithinPartitions(tree, *order).withColumn("_at", F.monotonically_increasing_id())
    rows = scratch.keep(rows.withColumn("_range", F.shiftright("_at", 33)), "ranges")
    spans = rows.groupBy(F.col(tree).alias("_tree"), F.col("_range").alias("_r")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_c"))
    along = W.partitionBy("_tree").orderBy("_r").rowsBetween(W.unboundedPreceding, -1)
    spans = spans.withColumn("_before", F.coalesce(F.sum("_c").over(along), F.lit(0))).withColumn("n", F.sum("_c").over(W.partitionBy("_tree")))
    same = F.col(tree).eqNullSafe(F.col("_tree")) & (F.col("_range") == F.col("_r"))
    place = F.col("_before") + F.col("_at") - F.col("_first")
    return rows.join(spans, same).select(*df.columns, place.alias("place"), "n")
