"""Corpus pipeline: quality, toxicity, near-duplicates, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a frame; ``run`` writes every
stage's rows as Parquet in the shared folder and reads them as the next one's
docs. All but the last return the columns of documents. Stages handle null
columns, empty texts, repeated rows and empty tables as their operators say;
columns beyond those of documents are carried along by all stages but the last.
All stages run in the same executors, whose heap the first ones fill, so the
session hands texts to Python in small batches.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from rankloom.llm import minhash, mixing, pieces, quality, toxicity
from rankloom.llm.common import small_batches, table
from rankloom.session import shared_dir, staged


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quadratic-discriminant classifier: documents that it rejects go."""
    small_batches(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Weakly supervised toxicity: documents that it rejects go."""
    small_batches(spark)
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-duplicates on five-word shingles: one row of each group stays, of the smallest doc_id.

    Rows are told apart by doc_id and text, so null and repeated ids remove no
    other text. Of rows that share both, the first by their other columns stays;
    texts without words are in no group and all stay.
    """
    small_batches(spark)
    keyed = docs.withColumn("_row", F.xxhash64(F.col("text").cast("string")))
    rows = minhash.near_duplicates(keyed, row_key="_row").where("n_shingles > 0")
    odd = rows.groupBy("doc_id", "_row").agg(F.first("kept").alias("kept"), F.count(F.lit(1)).alias("n")).where("not kept or n > 1")
    odd = staged(odd.select(F.col("doc_id").alias("_id"), F.col("_row").alias("_key"), F.col("kept").alias("_stays")), "near-duplicates")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_row") == F.col("_key"))
    alone = keyed.join(odd, same, "left_anti").drop("_row")
    again = keyed.join(odd.where("_stays"), same, "left_semi")
    order = W.partitionBy("doc_id", "_row").orderBy(F.to_json(F.struct(*docs.columns)))
    once = again.withColumn("_nth", F.row_number().over(order)).where("_nth = 1")
    return alone.union(once.select(*docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a document comes once for each pass that reads it, cut where the target cuts it."""
    small_batches(spark)
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of SentencePiece pieces, their number, and the digest of the text decoded from them; texts that do not decode to themselves are not ``restored``."""
    small_batches(spark)
    return pieces.encode(docs.select("doc_id", "lang", "source", "text"), check=True).select(
        "doc_id", "lang", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", "decoded_sha256", "restored")


STAGES = [
    ("quality", keep_quality),
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("tokens", tokens),
]

#: Fitted models and hashes of the stages have no SQL form; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline/{uuid.uuid4().hex}"
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{name}")
    return docs
