"""Ordered ranges of a group's values, with bounds taken from the data.

Running products, ranks and the like need the values of a group in order.  A large group is cut into ranges of about equal
numbers of rows, so no task sorts a whole group; the bounds only say which task a row is handled by, never a result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .frames import join_null_safe

#: Rows of a range, and ranges of a group.
PER_RANGE, MOST_RANGES = 500_000, 1000


def below(bounds: Column, value: Column, steps: int = 10) -> Column:
    """How many of fewer than 2^steps ascending ``bounds`` are below ``value``, by bisection."""
    halves = F.array(*[F.lit(1 << k) for k in range(steps - 1, -1, -1)])
    return F.aggregate(halves, F.lit(0), lambda at, step: F.when(F.get(bounds, at + step - 1) < value, at + step).otherwise(at))


def ranged(rows: DataFrame, groups: Sequence[str], value: str, label: str, per_range: int | None = None) -> DataFrame:
    """Settled ``rows`` with ``__range``, ascending with ``value`` in each group; groups of up to ``per_range`` rows are one range.

    ``rows`` hold a value once per group (a table of counts), so a range is as even as the quantile sketch of the bounds: its
    rank error is a ten-thousandth of the group.
    """
    groups, per_range = list(groups), per_range or PER_RANGE
    rows = settle(rows, label)
    large = rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("__rows")).where(F.col("__rows") > per_range)
    if large.isEmpty():
        return rows.withColumn("__range", F.lit(0))
    probabilities = [k / MOST_RANGES for k in range(1, MOST_RANGES)]
    bounds = join_null_safe(rows, large, groups).groupBy(*groups, "__rows").agg(
        F.percentile_approx(value, probabilities, 10_000).alias("__bounds"))
    step = F.greatest(F.lit(1), F.floor(F.lit(MOST_RANGES * per_range) / F.col("__rows"))).cast("int")
    bounds = bounds.select(*groups, F.array_distinct(F.filter("__bounds", lambda b, i: (i + 1) % step == 0)).alias("__bounds"))
    numbered = join_null_safe(rows, bounds, groups, "left")
    return settle(numbered.withColumn("__range", F.coalesce(below(F.col("__bounds"), F.col(value)), F.lit(0))).drop("__bounds"), label)
