"""Removal of boilerplate lines that spread over the conditions of an experiment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .records import GAP, whole_text


def line_table(traces: DataFrame) -> DataFrame:
    """``text_key, line_no, line_key, condition_key`` of every line that is not blank.

    Lines are compared in lower case with single blanks, by a 64-bit hash with the length beside it; null is a condition
    of its own.
    """
    text = whole_text()
    lines = traces.select(
        F.xxhash64(text).alias("text_key"), F.xxhash64("condition_id").alias("condition_key"), F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    normal = F.trim(F.lower(F.regexp_replace("line", GAP, " ")))
    return lines.select("text_key", "line_no", normal.alias("line"), "condition_key").where("line <> ''").select(
        "text_key", "line_no", F.struct(F.xxhash64("line").alias("h"), F.length("line").alias("n")).alias("line_key"), "condition_key")


def spread_lines(lines: DataFrame, min_conditions: int, log_buckets: int, band: float) -> DataFrame:
    """``line_key`` of the lines found in ``min_conditions`` conditions or more.

    Each task makes a HyperLogLog sketch of the conditions of its lines; sketches of a line merge by aggregation, so a line
    on a third of all rows costs each task one sketch.  Estimates within ``band`` of the threshold are not trusted: those
    lines get their conditions counted exactly.
    """
    sketched = lines.groupBy("line_key").agg(F.hll_sketch_agg("condition_key", F.lit(log_buckets)).alias("sketch"))
    estimated = settle(sketched.select("line_key", F.hll_sketch_estimate("sketch").alias("conditions")).where(
        F.col("conditions") >= min_conditions * (1 - band)), "spread")
    near = estimated.where(F.col("conditions") <= min_conditions * (1 + band)).select("line_key")
    exact = lines.join(near, "line_key", "left_semi").groupBy("line_key").agg(F.count_distinct("condition_key").alias("conditions"))
    sure = estimated.where(F.col("conditions") > min_conditions * (1 + band))
    return sure.select("line_key").unionByName(exact.where(F.col("conditions") >= min_conditions).select("line_key"))


def remove_spread_lines(traces: DataFrame, min_conditions: int = 12, log_buckets: int = 12, band: float = 0.15) -> DataFrame:
    """Removes the lines that ``min_conditions`` different conditions or more share: boilerplate across conditions.

    ``log_buckets`` is the binary logarithm of a sketch's size; its standard error at 12 is 1.6 %, far inside ``band``
    (``spread_lines``).  Lines of a text are hashed once; what is removed is gathered per distinct text, so copies of a text
    share one list, and texts meet their lists in one join.

    Returns one row per input row: ``trial_id, n_lines, n_removed, text`` (what is left, line ends between lines).  Blank
    lines are never removed.  Null text is one empty line and comes back empty.  Equal rows get equal results.  An empty
    table gives an empty result.
    """
    lines = settle(line_table(traces), "lines")
    spread = spread_lines(lines, min_conditions, log_buckets, band)
    found = lines.join(spread, "line_key", "left_semi").groupBy("text_key").agg(F.collect_set("line_no").alias("gone"))
    found = found.withColumnRenamed("text_key", "of")
    text = whole_text()
    rows = traces.select("trial_id", text.alias("text"), F.xxhash64(text).alias("text_key"))
    joined = rows.join(found, F.col("text_key") == F.col("of"), "left")
    split = F.split("text", "\n")
    kept = F.array_join(F.filter(split, lambda x, i: ~F.array_contains("gone", i)), "\n")
    return joined.select(
        "trial_id", F.size(split).cast("bigint").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_removed"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("text"))
