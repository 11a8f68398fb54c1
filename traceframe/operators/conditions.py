"""Decoding conditions declared by experiment specifications."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _counted(n: Column) -> Column:
    """0 .. n-1 as bigint, empty when n is not positive."""
    return F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), n.cast("bigint") - 1)).otherwise(
        F.array().cast("array<bigint>")
    )


def conditions_expand(specs: DataFrame, keep: Sequence[str], greedy_repeats: Column, seeds: Column,
                      repeats_per_seed: Column) -> DataFrame:
    """One row per declared execution: greedy repeats, then every seed with its repeats."""
    greedy = F.transform(_counted(greedy_repeats), lambda r: F.struct(
        F.lit("greedy").alias("mode"), F.lit(None).cast("bigint").alias("seed"), r.alias("repeat")))
    sampled = F.flatten(F.transform(seeds, lambda s: F.transform(_counted(repeats_per_seed), lambda r: F.struct(
        F.lit("sampled").alias("mode"), s.cast("bigint").alias("seed"), r.alias("repeat")))))
    return specs.select(*keep, F.inline(F.concat(greedy, sampled)))


def distinct_conditions(df: DataFrame, condition: str, order: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """The first row of every condition in ``order``."""
    first = df.groupBy(condition).agg(F.min(F.struct(*order, *[F.col(k).alias(f"__k_{k}") for k in keep])).alias("__f"))
    return first.select(condition, *[F.col(f"__f.__k_{k}").alias(k) for k in keep])
