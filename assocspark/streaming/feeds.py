"""Micro-batch ingest and windowed co-activation as Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.engine import RAW, Engine


def ingest(memories: DataFrame, engine: Engine, checkpoint: str, now_ms: int) -> StreamingQuery:
    """Writes each micro-batch. Its new ids go to the log, then all of the log that has no unit is derived: a batch that is run again
    after a failure, wherever it was cut short, ends as if it had run once. Repeated ids in a batch are one memory."""

    def batch(df: DataFrame, _: int) -> None:
        known = engine.store.log("memory", RAW).select("id")
        new = df.select(*(c.split()[0] for c in RAW.split(", "))).dropDuplicates(["id"]).join(known, "id", "left_anti")
        if not new.isEmpty():
            engine.store.append("memory", new.select(*(c.split()[0] for c in RAW.split(", "))))
        engine.recover(now_ms)

    return memories.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def signal_counts(events: DataFrame, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """events (ts, memory_id, signal): counts per window and memory; rows later than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "memory_id", "signal").agg(F.count("*").alias("n"))


def feedback(signals: DataFrame, engine: Engine, checkpoint: str) -> StreamingQuery:
    """signals (retrieval_id, memory_id, ts_ms, signal): each micro-batch is one feedback. A batch that is run again after a failure counts
    again unless its number was noted, which is the last thing it does."""

    def batch(df: DataFrame, number: int) -> None:
        done = engine.store.log("feedback_batch", "number long")
        if df.isEmpty() or not done.where(F.col("number") == number).isEmpty():
            return
        engine.feedback(df)
        engine.store.append("feedback_batch", engine.spark.createDataFrame([(number,)], "number long"))

    return signals.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
