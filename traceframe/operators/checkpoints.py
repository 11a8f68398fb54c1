"""Checkpoint plans per draw."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def checkpoint_plan(df: DataFrame, keep: Sequence[str], length: Column, checkpoints: Sequence[int],
                    include_full: bool) -> DataFrame:
    """One row per planned probe of a draw.

    A checkpoint is eligible only when the reasoning is that long (zero always
    is); a shorter prefix is never put in its place.
    """
    asked = F.array(*[F.lit(int(c)).cast("bigint") for c in sorted(set(checkpoints))])
    n = length.cast("bigint")
    base = df.select(*keep, n.alias("__n"))
    eligible = F.filter(asked, lambda c: (c == 0) | (F.col("__n") >= c))
    lengths = F.array_union(eligible, F.array(F.col("__n"))) if include_full else eligible
    base = base.withColumn("__lengths", F.array_sort(lengths)).withColumn(
        "ineligible", F.transform(F.array_except(asked, eligible), lambda c: c.cast("string"))
    )
    rows = base.select(*keep, "__n", "ineligible", F.posexplode("__lengths").alias("__i", "checkpoint"))
    label = F.when(F.col("checkpoint").isin(*[int(c) for c in checkpoints]), F.col("checkpoint").cast("string"))
    return rows.select(
        *keep,
        "checkpoint",
        label.otherwise(F.lit("full_prefix")).alias("checkpoint_label"),
        F.col("__i").cast("bigint").alias("checkpoint_index"),
        (F.col("checkpoint") == F.col("__n")).alias("is_full_prefix"),
        "ineligible",
    )
