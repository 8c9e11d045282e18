"""Streams: idempotent consumption and counts by period."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators import usage


def consume_once(messages: DataFrame, key="message_id", ts="ts", keep="7 days") -> DataFrame:
    """Each message id once within ``keep``; rows without an id all pass."""
    marked = messages.withWatermark(ts, keep)
    known = F.coalesce(F.col(key).cast("string"), F.lit("")) != ""
    return marked.where(known).dropDuplicatesWithinWatermark([key]).unionByName(marked.where(~known))


def answer_messages(messages: DataFrame, handle: Callable[[DataFrame], DataFrame], out: str, key="message_id", ts="ts") -> DataStreamWriter:
    """A stream of messages in, their results out: each message id is handled once, and a batch that runs again after a failure
    replaces its own results. ``handle`` maps messages to results with ``message_id, type, success, data``; start the writer with a
    checkpoint location."""

    def run(batch: DataFrame, number: int) -> None:
        handle(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return consume_once(messages, key, ts).writeStream.foreachBatch(run)


def period_counts(reads: DataFrame, kind: str, late="1 day") -> DataFrame:
    """Reads by manual and business day, ISO week or month (UTC+8), by the keys of the popularity lists."""
    rows = reads.withWatermark("ts", late)
    return rows.groupBy(usage.period_keys(F.col("ts"))[kind].alias("period"), "manual").agg(F.count("*").alias("reads"))


def count_writer(counts: DataFrame, out: str) -> DataStreamWriter:
    """A writer of the counts that each batch has changed; a batch that runs again replaces its own."""

    def run(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return counts.writeStream.outputMode("update").foreachBatch(run)


def latest_counts(spark: SparkSession, out: str, counts: DataFrame) -> DataFrame:
    """The counts as they are now; a count only grows, so the largest is the newest."""
    keys = [c for c in counts.columns if c != "reads"]
    return spark.read.schema(counts.schema).parquet(f"{out}/batch=*").groupBy(*keys).agg(F.max("reads").alias("reads"))


def daily_counts(reads: DataFrame, late="1 day") -> DataFrame:
    """Reads by manual and business day (UTC+8)."""
    day = F.window("ts", "1 day", startTime="16 hours").alias("w")
    return reads.withWatermark("ts", late).groupBy(day, "manual").agg(F.count("*").alias("reads")).select("manual", F.col("w.start").alias("start"), "reads")
