"""Small DataFrame helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import settle

#: Rows of a group that one task may sort, and the buckets in which rows are counted to tell.
MOST_ROWS, BUCKETS = 1 << 20, 1 << 16


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner",
                   filled: Sequence[str] = ()) -> DataFrame:
    """Equi-join on ``keys`` where null equals null; keys come from the left side.

    Keys in ``filled`` are never null and join by plain equality.
    """
    renamed = right.select(
        *[F.col(k).alias(f"__r_{k}") for k in keys],
        *[F.col(c) for c in right.columns if c not in keys],
    )
    condition = F.lit(True)
    for k in keys:
        other = renamed[f"__r_{k}"]
        condition = condition & ((left[k] == other) if k in filled else left[k].eqNullSafe(other))
    joined = left.join(renamed, condition, how)
    return joined.drop(*[f"__r_{k}" for k in keys]) if how not in ("left_semi", "left_anti") else joined


def split_large(rows: DataFrame, keys: Sequence[str], label: str) -> tuple[DataFrame, DataFrame | None]:
    """(rows whose group is of at most ``MOST_ROWS``, the others or None if there are none).

    Groups are counted together in buckets of their hash: that is one small aggregate, combined where the rows are read.  A
    bucket of more rows is among the others with all its groups, so the first part holds no large group.
    """
    return split_counted(rows, keys, label)[:2]


def split_counted(rows: DataFrame, keys: Sequence[str], label: str) -> tuple[DataFrame, DataFrame | None, int]:
    """``split_large`` and the number of rows of its first part."""
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS))
    counts = settle(rows.groupBy(bucket.alias("__bucket")).agg(F.count(F.lit(1)).alias("__rows")), label)
    large = counts.where(F.col("__rows") > MOST_ROWS).select("__bucket")
    few, many = counts.agg(F.sum(F.when(F.col("__rows") <= MOST_ROWS, F.col("__rows"))), F.count_if(F.col("__rows") > MOST_ROWS)).first()
    if not many:
        return rows, None, few or 0
    marked = rows.withColumn("__bucket", bucket)
    return marked.join(large, "__bucket", "left_anti").drop("__bucket"), marked.join(large, "__bucket", "left_semi").drop("__bucket"), few or 0


def round_half_away(value: Column, digits: int) -> Column:
    """Binary rounding: scale, round half away from zero, scale back (what SQL engines do on doubles).

    ``F.round`` rounds the decimal text of a double instead and differs on ties.
    """
    scale = float(10**digits)
    near = F.signum(value) * F.floor(F.abs(value) * scale + 0.5).cast("double") / scale + F.lit(0.0)
    return F.when(F.isnan(value) | (F.abs(value) >= 1e11), value).otherwise(near)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every floating column; -0.0 becomes 0.0."""
    return df.select(
        *[
            round_half_away(F.col(f.name).cast("double"), digits).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType))
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def wide_integers(df: DataFrame) -> DataFrame:
    """All integer columns as bigint, so counts and array sizes report alike."""
    return df.select(*[
        F.col(f.name).cast("bigint").alias(f.name)
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)) else F.col(f.name)
        for f in df.schema.fields
    ])


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division as double; null when the denominator is zero or null."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def count_of(condition: Column) -> Column:
    """Number of rows where ``condition`` is true, zero when there is none."""
    return F.count_if(F.coalesce(condition, F.lit(False)))


def reason_list(*pairs: tuple[Column, str | Column]) -> Column:
    """Array of the messages whose condition holds, in the order given."""
    items = [
        F.when(cond, F.lit(msg) if isinstance(msg, str) else msg) for cond, msg in pairs
    ]
    return F.array_compact(F.array(*items))
