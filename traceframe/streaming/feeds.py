"""Continuous forms of ingest, duplicate detection and stale-run detection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def file_stream(spark: SparkSession, folder: str, schema: str, fmt: str = "json", glob: str | None = None,
                files_per_trigger: int = 1000) -> DataFrame:
    """Stream of records from files that appear atomically in ``folder``."""
    reader = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(folder)


def stream_ingest(stream: DataFrame, target: str, checkpoint: str, partition: str | None = None) -> StreamingQuery:
    """Append the stream to a Parquet table, each record exactly once across restarts."""
    writer = stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
    if partition:
        writer = writer.partitionBy(partition)
    return writer.outputMode("append").trigger(availableNow=True).start()


def first_arrivals(stream: DataFrame, event_time: Column, keys: Sequence[str], delay: str) -> DataFrame:
    """First record of every key; a repeat within ``delay`` is a duplicate and is dropped.

    Keys are forgotten once the watermark has passed them by ``delay``, so the state follows the rate of the stream and
    not its length.  A repeat that arrives later than that is late itself and is dropped as such (``late_rows``).
    """
    timed = stream.withColumn("event_time", event_time.cast("timestamp"))
    return timed.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(list(keys))


def activity_sessions(stream: DataFrame, event_time: Column, run: str, gap: str = "600 seconds",
                      delay: str = "1 hour") -> DataFrame:
    """Sessions of activity per run: a run with no event for ``gap`` is stale until its next session.

    For append mode: a session is told once, when the watermark has passed its end, and then leaves the state; what is
    still open is not told.  Events behind the watermark are late and belong to no session.
    """
    timed = stream.withColumn("event_time", event_time.cast("timestamp")).withWatermark("event_time", delay)
    sessions = timed.groupBy(F.session_window("event_time", gap).alias("s"), run).agg(F.count(F.lit(1)).alias("n_events"))
    return sessions.select(run, F.col("s.start").alias("active_from"), F.col("s.end").alias("stale_from"), "n_events")


def late_rows(query: StreamingQuery) -> int:
    """Rows a finished query dropped behind the watermark, as far back as its progress reports go."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


def state_rows(query: StreamingQuery) -> list[int]:
    """Rows in the state after every batch of a query."""
    return [sum(op["numRowsTotal"] for op in p["stateOperators"]) for p in query.recentProgress]
