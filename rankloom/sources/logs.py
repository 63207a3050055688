"""Readers and writers of the append-only logs."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.verdicts import is_json
from ..schemas import LOGS

CORRUPT = "_corrupt_record"
ON_CORRUPT = ("fail", "skip", "quarantine")


def _snake(name: str) -> str:
    return re.sub(r"(?<!^)(?=[A-Z])", "_", name).lower()


def _columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[c if c == CORRUPT else _snake(c) for c in df.columns])


def split_corrupt(df: DataFrame, on_corrupt: str) -> DataFrame | tuple[DataFrame, DataFrame]:
    """Apply the bad-line policy to rows that carry a corrupt-record column."""
    if on_corrupt not in ON_CORRUPT:
        raise ValueError(f"on_corrupt must be one of {ON_CORRUPT}")
    bad = F.col(CORRUPT).isNotNull()
    if on_corrupt == "fail":
        ok = F.assert_true(~bad, F.concat(F.lit("unreadable log line: "), F.col(CORRUPT)))
        return df.where(ok.isNull()).drop(CORRUPT)
    good = df.where(~bad).drop(CORRUPT)
    if on_corrupt == "skip":
        return good
    return good, df.where(bad).select(F.col(CORRUPT).alias("line"))


def _typed(lines: DataFrame, col: str, schema: str, *carry: str) -> DataFrame:
    """Fields of each JSON line, with the line itself where it does not parse.

    The parser stops after a line's first value, so two records that lost the
    line break between them are told by counting the values of the line.
    """
    parsed = F.from_json(F.col(col), f"{schema}, {CORRUPT} STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    broken = F.coalesce(F.col(f"_p.{CORRUPT}"), F.when(~is_json(F.col(col)), F.col(col)))
    rows = lines.where(F.trim(F.col(col)) != "").select(*carry, col, parsed.alias("_p"))
    return rows.select(*carry, "_p.*", broken.alias("_broken")).drop(CORRUPT).withColumnRenamed("_broken", CORRUPT)


def parse_lines(lines: DataFrame, col: str, schema: str, on_corrupt: str = "fail", *carry: str):
    """Log rows from a column of JSON lines under an explicit schema. Blank lines are no rows."""
    return split_corrupt(_columns(_typed(lines, col, schema, *carry)), on_corrupt)


def scan_lines(spark: SparkSession, path: str, schema: str, on_corrupt: str = "fail"):
    """Files of JSON lines under an explicit schema whose lines carry their own order; no shuffle."""
    return parse_lines(spark.read.text(path), "value", schema, on_corrupt)


def scan_log(spark: SparkSession, path: str, name: str, on_corrupt: str = "fail"):
    """A JSON-lines log by name. Lines without ``seq`` get one from their place in the files."""
    place = F.struct(
        F.unix_micros("_metadata.file_modification_time").alias("t"), F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"),
    )
    df = _typed(spark.read.text(path).select("value", place.alias("_place")), "value", LOGS[name], "_place")
    if "seq" not in df.columns:
        df = df.withColumn("seq", F.lit(None).cast("bigint"))
    return split_corrupt(_columns(with_seq(df, "_place").drop("_place")), on_corrupt)


def with_seq(df: DataFrame, place: str) -> DataFrame:
    """Fill a missing ``seq`` from file order without ordering the log in one task.

    The place of a line is (time, file, block, id); ids grow inside a block, so
    rows are numbered per block and blocks are offset by the sizes before them.
    Only the list of blocks (one row per file split) is ordered as a whole.
    """
    block = F.struct(*[F.col(f"{place}.{f}") for f in ("t", "file", "block")])
    rows = df.withColumns({"_block": block, "_id": F.col(f"{place}.id")})
    sizes = rows.groupBy("_block").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.withColumn("_from", F.sum("_n").over(Window.orderBy("_block")) - F.col("_n")).drop("_n")
    inside = F.row_number().over(Window.partitionBy("_block").orderBy("_id"))
    placed = rows.withColumn("_i", inside).join(offsets, "_block")
    return placed.withColumn("seq", F.coalesce("seq", F.col("_from") + F.col("_i") - 1)).drop("_block", "_id", "_i", "_from")


def run_records(log: DataFrame) -> DataFrame:
    """Single-run records of a mixed log."""
    return log.where("mode = 'run'").drop("batch_id", "row")


def batch_records(log: DataFrame) -> DataFrame:
    """Batch rows of a mixed log, flat, question ids in snake case."""
    row = log.where("mode = 'batch'").select("seq", "batch_id", "ts", "row.*")
    return _columns(row)


def append(df: DataFrame, path: str, fmt: str = "parquet", partition_by: tuple[str, ...] = ()) -> None:
    """Add rows to a log. Parquet partitioned by run lets later scans skip other runs."""
    df.write.mode("append").partitionBy(*partition_by).format(fmt).save(path)


def write_snapshot(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Replace a summary table."""
    df.write.mode("overwrite").format(fmt).save(path)
