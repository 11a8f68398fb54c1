"""Exact order statistics of arbitrarily large groups.

``percentile`` keeps every distinct value of a group in one aggregation buffer.
Here values are first counted, then split into ordered ranges with bounds from
the data, so that a group holding most of it is spread over many tasks however
close its values are; only the ranges that contain a wanted rank are sorted.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import join_null_safe
from .ranges import ranged

def value_counts(df: DataFrame, groups: Sequence[str], value: str | Column) -> DataFrame:
    """Settled table (groups, __range, __v, __c) of the non-null values, the input of everything below."""
    v = F.col(value) if isinstance(value, str) else value
    counts = (
        df.select(*groups, v.cast("double").alias("__v"))
        .where(F.col("__v").isNotNull())
        .groupBy(*groups, "__v")
        .agg(F.count(F.lit(1)).alias("__c"))
    )
    return ranged(counts, groups, "__v", "value-counts")


def ranks_of_counts(counts: DataFrame, groups: Sequence[str], ranks: Mapping[str, Callable[[Column], Column]]) -> DataFrame:
    """Values at 0-based ranks of a ``value_counts`` table, plus the group size ``n_values``."""
    groups = list(groups)
    by_group = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    blocks = (
        counts.groupBy(*groups, "__range")
        .agg(F.sum("__c").alias("__bc"))
        .withColumn("__before", F.sum("__bc").over(by_group.orderBy("__range")) - F.col("__bc"))
        .withColumn("__n", F.sum("__bc").over(by_group))
    )
    wanted = F.lit(False)
    for rank in ranks.values():
        r = rank(F.col("__n"))
        wanted = wanted | ((r >= F.col("__before")) & (r < F.col("__before") + F.col("__bc")))
    hit = join_null_safe(counts, blocks.where(wanted), [*groups, "__range"], filled=["__range"])
    inside = Window.partitionBy(*groups, "__range").orderBy("__v")
    hit = hit.withColumn("__hi", F.col("__before") + F.sum("__c").over(inside)).withColumn(
        "__lo", F.col("__hi") - F.col("__c")
    )
    picks = []
    for name, rank in ranks.items():
        r = rank(F.col("__n"))
        picks.append(F.max(F.when((r >= F.col("__lo")) & (r < F.col("__hi")), F.col("__v"))).alias(name))
    return hit.groupBy(*groups).agg(F.max("__n").alias("n_values"), *picks)


def quantiles_of_counts(counts: DataFrame, groups: Sequence[str], probs: Mapping[str, float]) -> DataFrame:
    ranks: dict[str, Callable[[Column], Column]] = {}
    for name, p in probs.items():
        ranks[f"__{name}_lo"] = lambda n, p=p: F.floor((n - 1) * F.lit(p))
        ranks[f"__{name}_hi"] = lambda n, p=p: F.ceil((n - 1) * F.lit(p))
    stats = ranks_of_counts(counts, groups, ranks)
    out = []
    for name, p in probs.items():
        position = (F.col("n_values") - 1) * F.lit(p)
        low, high = F.col(f"__{name}_lo"), F.col(f"__{name}_hi")
        out.append((low + (high - low) * (position - F.floor(position))).alias(name))
    return stats.select(*groups, *out)


def order_statistics(df: DataFrame, groups: Sequence[str], value: str | Column,
                     ranks: Mapping[str, Callable[[Column], Column]]) -> DataFrame:
    """Values at given 0-based ranks per group: ``ranks`` maps a name to rank(n)."""
    return ranks_of_counts(value_counts(df, groups, value), groups, ranks)


def exact_quantiles(df: DataFrame, groups: Sequence[str], value: str | Column, probs: Mapping[str, float]) -> DataFrame:
    """Linearly interpolated quantiles per group, named by ``probs``."""
    return quantiles_of_counts(value_counts(df, groups, value), groups, probs)
