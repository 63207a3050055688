"""Logs as streams: landing, alerts, progress, expiry, upserts, chunk delivery.

Checkpoints and state tables live under the shared folder, so a stream resumes
on other machines.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from ..functions.errors import failed, is_transport
from ..operators.breakers import DEAD_AFTER, NETWORK_DEAD_AFTER, network_streaks
from ..operators.latest import last_write

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state with timers needs this store; set before the query starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def read_log(spark: SparkSession, path: str, schema: str, fmt: str = "json", files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def start(df: DataFrame, checkpoint: str, out: str, fmt: str = "parquet") -> StreamingQuery:
    """Append whatever is available to a table, then stop; a rerun continues."""
    return (
        df.writeStream.format(fmt).option("path", out).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )


# --- landing -----------------------------------------------------------------

def land(rows: DataFrame, checkpoint: str, out: str) -> StreamingQuery:
    """Row-by-row landing: each row is durable as soon as its micro-batch is."""
    return start(rows, checkpoint, out)


# --- dead provider -------------------------------------------------------------

def _dead_provider(limit: int) -> StatefulProcessor:
    """Built here so that the class travels with the job; workers need not have the package."""

    class DeadProvider(StatefulProcessor):
        """Remembers the smallest failing positions until a success is seen.

        Rows of a micro-batch may come in any order, so the decision is taken on
        positions: the provider is dead at its n-th failure if no success precedes
        it. At most ``limit`` positions are held per key.
        """

        def __init__(self, limit: int):
            self.limit = limit

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.state = handle.getValueState("tally", "fails array<bigint>, settled boolean")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
            fails, settled = ([], False)
            if self.state.exists():
                saved = self.state.get()
                fails, settled = list(saved[0]), saved[1]
            first_ok = None
            for batch in rows:
                ok = batch.loc[~batch["bad"], "seq"]
                if len(ok):
                    first_ok = int(ok.min()) if first_ok is None else min(first_ok, int(ok.min()))
                fails = heapq.nsmallest(self.limit, fails + batch.loc[batch["bad"], "seq"].astype(int).tolist())
            if not settled:
                before = fails if first_ok is None else [s for s in fails if s < first_ok]
                if len(before) == self.limit:
                    settled = True
                    yield pd.DataFrame({"run_id": [key[0]], "provider": [key[1]], "dead_at": [before[-1]]})
                elif first_ok is not None:
                    settled = True
            self.state.update(([] if settled else [int(s) for s in fails], settled))

        def close(self) -> None:
            pass

    return DeadProvider(limit)


def dead_provider_alerts(log: DataFrame, limit: int = DEAD_AFTER) -> DataFrame:
    """One row when a provider's first ``limit`` counted attempts all failed."""
    lean = log.where(~is_transport(F.col("error"))).select("run_id", "provider", "seq", failed(F.col("error")).alias("bad"))
    return lean.groupBy("run_id", "provider").transformWithStateInPandas(
        _dead_provider(limit), outputStructType="run_id string, provider string, dead_at bigint",
        outputMode="append", timeMode="none",
    )


# --- dead network ----------------------------------------------------------------

def _state_before(spark: SparkSession, path: str, batch_id: int) -> DataFrame | None:
    """Streaks at the end of the batch before this one."""
    if batch_id == 0:
        return None
    return spark.read.schema("run_id string, streak bigint, dead_at bigint").parquet(f"{path}/batch={batch_id - 1}")


def network_alerts(log: DataFrame, checkpoint: str, state: str, limit: int = NETWORK_DEAD_AFTER) -> StreamingQuery:
    """Streak of transport failures per run across micro-batches.

    Each micro-batch is cut into spans like the batch form, so one huge run is
    still spread over tasks; what it leaves behind is one row per run. State is
    written per batch id, so a repeated batch writes the same folder again.
    """
    lean = log.select("run_id", "seq", "error")

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = _state_before(spark, state, batch_id)
        dead, streaks = network_streaks(batch, limit, before=before)
        now = streaks.join(dead, "run_id", "left")
        if before is not None:
            old = before.select("run_id", F.col("streak").alias("s0"), F.col("dead_at").alias("d0"))
            now = now.join(old, "run_id", "full").select(
                "run_id", F.coalesce("streak", "s0").alias("streak"), F.coalesce("d0", "dead_at").alias("dead_at")
            )
        now.select("run_id", F.col("streak").cast("bigint"), F.col("dead_at").cast("bigint")).write.mode("overwrite").parquet(
            f"{state}/batch={batch_id}"
        )

    return (
        lean.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def network_state(spark: SparkSession, state: str) -> DataFrame:
    """Latest streak and alert of every run."""
    rows = spark.read.parquet(state)
    last = rows.agg(F.max("batch")).scalar()
    return rows.where(F.col("batch") == last).drop("batch")


# --- progress --------------------------------------------------------------------

def progress(log: DataFrame, totals: DataFrame) -> DataFrame:
    """Landed rows per run beside the total expected; run in update or complete mode."""
    landed = log.groupBy("run_id").agg(F.count(F.lit(1)).alias("landed"))
    return landed.join(totals, "run_id", "left")


def write_progress(progress_rows: DataFrame, checkpoint: str, out: str) -> StreamingQuery:
    def step(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (
        progress_rows.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
        .outputMode("update").trigger(availableNow=True).start()
    )


def latest_progress(spark: SparkSession, out: str) -> DataFrame:
    return last_write(spark.read.parquet(out), ["run_id"], ("batch",)).drop("batch")


# --- expiry ----------------------------------------------------------------------

def _expiry(ttl_ms: int) -> StatefulProcessor:
    """Built here for the same reason as the tally above."""

    class Expiry(StatefulProcessor):
        """Holds the newest fetch of each key of a bucket and reports it once the watermark passes its end.

        A bucket has one timer, for the key that ends first. Its keys are read and
        written together: a call to the state store costs far more than a key.
        """

        def __init__(self, ttl_ms: int):
            self.ttl_ms = ttl_ms

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.newest = handle.getValueState("newest", "keys array<string>, fetched_ms array<bigint>")

        def load(self) -> dict:
            return dict(zip(*self.newest.get())) if self.newest.exists() else {}

        def save(self, held: dict, timed: int | None) -> None:
            first = min(held.values(), default=None)
            if first != timed:
                if timed is not None:
                    self.handle.deleteTimer(timed + self.ttl_ms)
                if first is not None:
                    self.handle.registerTimer(first + self.ttl_ms)
            if held:
                self.newest.update((list(held), list(held.values())))
            else:
                self.newest.clear()

        def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
            held = self.load()
            timed = min(held.values(), default=None)
            for batch in rows:
                for k, t in zip(batch["key"].tolist(), batch["fetched_ms"].tolist()):
                    if pd.notna(t) and (k not in held or t > held[k]):
                        held[k] = int(t)
            self.save(held, timed)
            return iter(())

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
            held, now = self.load(), timerValues.getCurrentWatermarkInMs()
            over = {k: t for k, t in held.items() if t + self.ttl_ms <= now}
            # The timer that fired is gone already.
            self.save({k: t for k, t in held.items() if k not in over}, None)
            yield pd.DataFrame({"key": pd.Series(list(over), dtype="object"), "fetched_ms": pd.Series(list(over.values()), dtype="int64")})

        def close(self) -> None:
            pass

    return Expiry(ttl_ms)


def expired_entries(fetches: DataFrame, ttl_seconds: int = 24 * 60 * 60, delay: str = "0 seconds", buckets: int = 4096) -> DataFrame:
    """Keys whose newest fetch is older than the time to live, as the watermark moves on.

    Keys share ``buckets`` places of the state store, a few hundred a place for
    millions of keys; a stream keeps the number that it began with.
    """
    timed = fetches.withWatermark("fetched_at", delay).select(
        F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket"), F.col("key").cast("string").alias("key"),
        "fetched_at", F.unix_millis("fetched_at").alias("fetched_ms"),
    )
    return timed.groupBy("bucket").transformWithStateInPandas(
        _expiry(ttl_seconds * 1000), outputStructType="key string, fetched_ms bigint",
        outputMode="append", timeMode="eventTime",
    )


# --- last write wins ----------------------------------------------------------------

def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def current_view(spark: SparkSession, path: str, keys, order=("seq",)) -> DataFrame:
    """The last write of every key over all batches that were appended."""
    return last_write(spark.read.parquet(path).drop("batch"), keys, order)


def upsert_stream(log: DataFrame, keys, checkpoint: str, view: str, order=("seq",)) -> StreamingQuery:
    """Keep a log's writes as a last-write-wins table.

    A micro-batch appends its own winners and rewrites nothing; the last write
    is resolved on reading, and ``compact`` folds batches together now and then.
    A repeated batch writes its own folder again.
    """
    def step(batch: DataFrame, batch_id: int) -> None:
        last_write(batch, keys, order).write.mode("overwrite").parquet(f"{view}/batch={batch_id}")

    return (
        log.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def compact(spark: SparkSession, view: str, to: str, keys, order=("seq",)) -> None:
    """Write the resolved view as one batch of a new table."""
    current_view(spark, view, keys, order).write.mode("overwrite").parquet(f"{to}/batch=0")


# --- chunked results ---------------------------------------------------------------

def _first_result() -> StatefulProcessor:
    """Built here for the same reason as the tally above."""

    class FirstResult(StatefulProcessor):
        """Remembers that a key was delivered; of the rows of its first micro-batch the earliest goes out."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.done = handle.getValueState("done", "done boolean")

        def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
            best = None
            known = self.done.exists()
            for batch in rows:
                if known:
                    continue
                at = batch["at"]
                row = batch.loc[at.idxmin()] if at.notna().any() else batch.iloc[0]
                if best is None or (pd.notna(row["at"]) and (pd.isna(best["at"]) or row["at"] < best["at"])):
                    best = row
            if best is not None:
                self.done.update((True,))
            yield pd.DataFrame({"payload": pd.Series([] if best is None else [best["payload"]], dtype="str")})

        def close(self) -> None:
            pass

    return FirstResult()


def deliver_first(results: DataFrame, checkpoint: str, out: str, key: str = "wire_id", order: str = "landed_at") -> StreamingQuery:
    """Each request's result once, ever, however many chunks repeat it and however late; the first one counts.

    Delivered keys are state, one flag each in the key's own place of the state
    store, so a batch looks up its own keys and reads nothing that was delivered.
    The file sink commits a batch's rows once.
    """
    use_rocksdb(results.sparkSession)
    form = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
    rows = results.select(key, F.col(order).alias("at"), F.to_json(F.struct(*results.columns), form).alias("payload"))
    first = rows.groupBy(key).transformWithStateInPandas(_first_result(), outputStructType="payload string", outputMode="append", timeMode="none")
    parsed = first.select(F.from_json("payload", results.schema, form).alias("r")).select("r.*")
    return start(parsed, checkpoint, out)
