"""Sign-in attempts: counts that start anew after a pause, in batch and as a stream; a stream merged into a snapshot."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.store import upsert

#: Minutes without an attempt after which the count starts anew, and attempts that lock.
PAUSE_MIN, LOCK = 15, 5


def attempt_islands(attempts: DataFrame) -> DataFrame:
    """user_id, island, n, first, last, locked from attempts (user_id, ts, event_id): gaps of 15 minutes and more part islands."""
    attempts = attempts.withColumn("ts", F.col("ts").cast("timestamp"))
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(by)) >= PAUSE_MIN * 60_000_000
    rows = attempts.withColumn("_new", F.coalesce(gap, F.lit(False)).cast("int"))
    rows = rows.withColumn("island", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    out = rows.groupBy("user_id", "island").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    return out.withColumn("locked", F.col("n") >= LOCK)


def attempt_sessions(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """user_id, first, last_end, n, locked of a stream of attempts (user_id, ts): one session until a quarter of an hour passes without any.

    State is one row for each open session; the watermark closes those that no attempt can reach any more. Windows that touch
    are one session, so they are a microsecond shorter than the pause: after exactly a quarter of an hour the count starts anew.
    """
    gap = f"{PAUSE_MIN * 60 - 1} seconds 999 milliseconds 999 microseconds"
    sessions = stream.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return sessions.select("user_id", F.col("w.start").alias("first"), F.col("w.end").alias("last_end"), "n", (F.col("n") >= LOCK).alias("locked"))


def snapshot_stream(landed: DataFrame, decided: DataFrame, folder: str, checkpoint: str):
    """Merge each batch of landed rows (key, hash, seen) into a snapshot, a version of it for each batch under `folder`.

    A batch that is run again writes its own version again from the one before, so nothing is merged twice. The query is
    started and ends when all that has landed is read.
    """

    def write(batch: DataFrame, number: int) -> None:
        old = batch.limit(0) if number == 0 else batch.sparkSession.read.schema(batch.schema).parquet(f"{folder}/version={number - 1}")
        upsert(old, batch, decided).write.mode("overwrite").parquet(f"{folder}/version={number}")

    return merge_stream(landed, write, checkpoint)


def merge_stream(landed: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str):
    """Run `write` (a merge into the snapshot, idempotent by batch number) on each batch of a stream of landed rows; the query is started and ends when all are read."""
    return landed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
