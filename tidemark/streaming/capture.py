"""Structured Streaming capture: events become candidates, candidates go through the cascade into the log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.signals import capture_assistant, capture_tool, capture_user
from ..functions.text import content_hash, nfkc_lower

EVENT = T.StructType(
    [
        T.StructField("event_seq", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("source", T.StringType()), T.StructField("role", T.StringType()), T.StructField("tool_name", T.StringType()),
        T.StructField("is_error", T.BooleanType()), T.StructField("workspace", T.StringType()), T.StructField("text", T.StringType()),
    ]
)
#: Files a micro-batch takes, which bounds it; waiting replaces the dropping of events that come too fast.
FILES_PER_BATCH = 16


def candidates(events: DataFrame, mode: str = "balanced", auto_tags: bool = True, nfkc: bool = True) -> DataFrame:
    """event_seq, ts, workspace, kind, content, tags, hash of what the events (EVENT) leave to remember.

    Real users' messages, assistants' in aggressive mode, and outputs of tools that neither failed nor belong to the
    memory itself. Works alike on a batch and on a stream.
    """
    norm = nfkc_lower(F.col("text")) if nfkc else F.lower("text")
    rows = events.withColumn("norm", norm)
    text, n = F.col("text"), F.col("norm")
    tool_ok = ~F.coalesce("is_error", F.lit(False)) & ~F.coalesce(F.col("tool_name").startswith("memory_"), F.lit(False))
    found = (
        F.when((F.col("source") == "session") & (F.col("role") == "user"), capture_user(text, n, mode, auto_tags))
        .when((F.col("source") == "session") & (F.col("role") == "assistant"), capture_assistant(text, n, mode, auto_tags))
        .when((F.col("source") == "tool") & tool_ok, capture_tool(F.col("tool_name"), text, n, mode, auto_tags))
    )
    return rows.withColumn("c", found).where("c is not null").select("event_seq", "ts", "workspace", "c.*", content_hash(F.col("c.content")).alias("hash"))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", FILES_PER_BATCH).parquet(path)


def first_seen(found: DataFrame, window: str = "24 hours") -> DataFrame:
    """Of candidates with equal content within the window, the first that arrives; state is dropped with the
    watermark."""
    return found.withWatermark("ts", window).dropDuplicatesWithinWatermark(["hash"])


def capture_to(events: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "balanced", window: str = "24 hours"):
    """Starts the stream; `write` gets each micro-batch, ordered by event_seq, with its number, and may get one again
    after a failure, so it must be idempotent by that number."""
    ready = first_seen(candidates(events, mode), window)
    return ready.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, k: write(df.orderBy("event_seq"), k)).start()


def daily_counts(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Events per UTC day and source, in event time."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", "1 day"), "source").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("day"), "source", "n")
