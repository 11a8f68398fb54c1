from pyspark.sql import functions as F

from ..session import scratch_path
from ..streaming import feeds as S
from .registry import query

SCHEMA = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def feed(t):
    return S.file_stream(t.spark, t.sf_dir, SCHEMA, "parquet", "events.parquet")


@query("stream_ingest", "SELECT event_id, user_id, event_type, round(value, 6) AS value FROM events")
def _(t):
    target, mark = scratch_path(t.spark, "ingested"), scratch_path(t.spark, "ingest-progress")
    S.stream_ingest(feed(t), target, mark).awaitTermination()
    # a restart over the same files adds nothing
    S.stream_ingest(feed(t), target, mark).awaitTermination()
    return t.spark.read.parquet(target).select("event_id", "user_id", "event_type", "value")


FILES = 5
# The feed in files of six days; some events come two files late, or are sent again with the file after the next.
PART = "least(4, (dayofmonth(ts) - 1) // 6)"
LATE = f"({PART} < 3 AND (dayofmonth(ts) - 1) % 6 < 5)"


def delivered(t, repeats):
    """A folder to which the files were added one after another, and the stream of it, a file a batch."""
    folder = scratch_path(t.spark, "feed")
    part = F.least(F.lit(4), F.floor((F.dayofmonth("ts") - 1) / 6))
    moved = (F.col("event_id") % (50 if repeats else 97) == 0) & (part < 3) & ((F.dayofmonth("ts") - 1) % 6 < 5)
    parts = F.when(moved, F.array(part, part + 2) if repeats else F.array(part + 2)).otherwise(F.array(part))
    events = t("events").withColumn("part", F.explode(parts))
    for k in range(FILES):
        events.where(F.col("part") == k).drop("part").coalesce(1).write.mode("append").parquet(folder)
    return S.file_stream(t.spark, folder, SCHEMA, "parquet", "*.parquet", files_per_trigger=1)


@query("stream_duplicates", f"""SELECT event_id, user_id, event_type, true AS state_evicted,
  (SELECT count(*) FROM events WHERE event_id % 50 = 0 AND {LATE}) AS late_rows FROM events""")
def _(t):
    target, mark = scratch_path(t.spark, "unique"), scratch_path(t.spark, "unique-progress")
    run = S.stream_ingest(S.first_arrivals(delivered(t, True), F.col("ts"), ["event_id"], "1 hour"), target, mark)
    run.awaitTermination()
    evicted, late = F.lit(max(S.state_rows(run)) > 2 * S.state_rows(run)[-1]), F.lit(S.late_rows(run)).cast("bigint")
    return t.spark.read.parquet(target).select("event_id", "user_id", "event_type", evicted.alias("state_evicted"), late.alias("late_rows"))


@query("stream_stale_runs", f"""WITH seen AS (SELECT * FROM events WHERE NOT (event_id % 97 = 0 AND {LATE})),
g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 600 SECOND THEN 0 ELSE 1 END AS fresh FROM seen
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM g)
SELECT user_id, epoch_us(min(ts)) AS active_from_us, epoch_us(max(ts)) + 600000000 AS stale_from_us, count(*) AS n_events,
  (SELECT count(*) FROM events WHERE event_id % 97 = 0 AND {LATE}) AS late_rows FROM s GROUP BY user_id, sid
HAVING max(ts) + INTERVAL 600 SECOND <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def _(t):
    target, mark = scratch_path(t.spark, "sessions"), scratch_path(t.spark, "session-progress")
    run = S.stream_ingest(S.activity_sessions(delivered(t, False), F.col("ts"), "user_id"), target, mark)
    run.awaitTermination()
    out = t.spark.read.parquet(target)
    return out.select("user_id", F.unix_micros("active_from").alias("active_from_us"), F.unix_micros("stale_from").alias("stale_from_us"), "n_events",
                      F.lit(S.late_rows(run)).cast("bigint").alias("late_rows"))
