"""Deterministic resampling: replicate weights are a pure function of (seed, replicate, cluster).

No random state is kept, so lost tasks recompute the same replicates.

Multinomial weights are split top down: the n draws of a replicate belong to the range of all n clusters; a range gives a
binomial number of its draws to its lower half and the rest to the upper one, until a range is one cluster.  Every split is
a pure function of (seed, replicate, range), so a task derives the weights of its own clusters from the number of draws of
their block, and only sums leave it: neither slots nor weights are shuffled.  Poisson weights hash the cluster together
with the replicate and need no order of the clusters at all.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import accumulate, takewhile
from math import exp, factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import settle
from .frames import join_null_safe

MODULUS = 2147483647  # prime, so x -> x^5 permutes the residues
#: Bits of a residue that decide draws of a half each.
DRAWS_PER_WORD = 30
#: Clusters of one task (a power of two); larger groups first get the draws of each block.
BLOCK = 1024
#: Turns times replicates whose residues are computed at once, and those that are kept from one range to the next.
TURNS, KEPT_WORDS = 1 << 16, 1 << 22
#: Replicates that are descended together where the draws of large groups are shared out, and tasks for that at most.
REPLICATES, MOST_TASKS = 50, 4000
#: Weights (clusters times replicates) that one task derives.
PER_TASK = 1 << 23
#: Weight matrices of whole groups that a task keeps: groups of equal size share them.
KEPT_WEIGHTS = 1 << 22
#: Groups of one size whose means are taken with the same weights; deriving weights costs what summing for ``SUMMED`` groups does.
POOL, SUMMED = 32, 8
# Cumulative Poisson(1) probabilities, as far as the 53 bits of a draw can tell them from 1.
POISSON_CDF = tuple(takewhile(lambda p: p < 1 - 2.0**-53, accumulate(exp(-1) / factorial(k) for k in range(30))))


def fifth_power(x):
    """x^5 of residues; integers and arrays alike."""
    square = x * x % MODULUS
    return square * square % MODULUS * x % MODULUS


class Splitter:
    """Splits the draws of a range of clusters, for a run of replicates at once; turns are taken many at a time."""

    def __init__(self, replicates: np.ndarray, seed: int):
        self.base = replicates.astype(np.int64) * 7919 + (seed * 104729 + 12345)
        self.per_slice = max(1, TURNS // len(replicates))
        self.words: list[np.ndarray] = []

    def word_slice(self, number: int) -> np.ndarray:
        """``[turns, replicates]`` of a slice of turns; the first slices are kept for the next ranges."""
        if number < len(self.words):
            return self.words[number]
        turns = np.arange(number * self.per_slice, (number + 1) * self.per_slice, dtype=np.int64)[:, None]
        words = fifth_power((self.base + turns * 15485863) % MODULUS)
        if number == len(self.words) and (number + 1) * words.size <= KEPT_WORDS:
            self.words.append(words)
        return words

    def slices(self, low: int, level: int, turns: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(turns as a column, uniform residues ``[turns, replicates]``) at the range that begins at ``low`` and needs ``level`` halvings."""
        number = low * 64 + level
        range_part = fifth_power((fifth_power(number % MODULUS + 1) + number // MODULUS) % MODULUS)
        for start in range(0, turns, self.per_slice):
            other = self.word_slice(start // self.per_slice)[:turns - start]
            yield np.arange(start, start + len(other))[:, None], fifth_power((range_part * other % MODULUS + range_part + other * 31) % MODULUS)

    def lower(self, low: int, size: int, draws: np.ndarray) -> np.ndarray:
        """Draws that fall into the lower part, the largest power of two below ``size``."""
        level = (size - 1).bit_length()
        half = 1 << (level - 1)
        most, out = int(draws.max(initial=0)), np.zeros(len(draws), np.int64)
        if size == 2 * half:  # each draw is one fair bit
            for turns, residues in self.slices(low, level, -(-most // DRAWS_PER_WORD)):
                bits = np.clip(draws - turns * DRAWS_PER_WORD, 0, DRAWS_PER_WORD)
                out += np.bitwise_count(residues & ((1 << bits) - 1)).sum(axis=0, dtype=np.int64)
        else:
            for turns, residues in self.slices(low, level, most):
                out += ((turns < draws) & (residues % size < half)).sum(axis=0)
        return out

    def leaves(self, low: int, size: int, draws: np.ndarray, smallest: int = 1) -> Iterator[tuple[int, np.ndarray]]:
        """(begin, draws) of all parts of at most ``smallest`` clusters, in order."""
        if size <= smallest:
            yield low, draws
            return
        half = 1 << ((size - 1).bit_length() - 1)
        first = self.lower(low, size, draws)
        yield from self.leaves(low, half, first, smallest)
        yield from self.leaves(low + half, size - half, draws - first, smallest)


_kept: dict[tuple, np.ndarray] = {}


def block_weights(n: int, block: int, block_size: int, draws: np.ndarray | None, n_resamples: int, seed: int) -> np.ndarray:
    """``[clusters, replicates]`` of one block; ``draws`` are those of the block, n where it is the whole group."""
    low = block * block_size
    size = min(block_size, n - low)
    key = (n, block, n_resamples, seed) if draws is None and size * n_resamples <= KEPT_WEIGHTS else None
    if key not in _kept:
        if draws is None:
            draws = np.full(n_resamples, n, np.int64)
        splitter = Splitter(np.arange(n_resamples), seed)
        weights = np.empty((size, n_resamples), np.int32)
        for at, part in splitter.leaves(low, size, draws):
            weights[at - low] = part
        if key is None:
            return weights
        _kept.clear()
        _kept[key] = weights
    return _kept[key]


def cluster_number(cluster: Column) -> Column:
    """60-bit number of a cluster id, independent of the data around it."""
    return F.conv(F.substring(F.md5(cluster.cast("string")), 1, 15), 16, 10).cast("bigint")


def dense_index(df: DataFrame, groups: Sequence[str], number: str, tie: str) -> DataFrame:
    """0-based ``idx`` by (number, tie) within each group plus the group size ``n``.

    Ordering runs inside 1024 ranges of the hash number; only the range counts
    are scanned per group.
    """
    keys = [*groups, "__rng"]
    df = df.withColumn("__rng", F.shiftright(F.col(number), 50))
    whole = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__c"))
    starts = counts.select(
        *keys,
        (F.sum("__c").over(whole.orderBy("__rng")) - F.col("__c")).alias("__start"),
        F.sum("__c").over(whole).alias("n"),
    )
    inside = Window.partitionBy(*keys).orderBy(number, tie)
    placed = df.withColumn("__pos", F.row_number().over(inside) - 1)
    return join_null_safe(placed, starts, keys, filled=["__rng"]).withColumn("idx", F.col("__start") + F.col("__pos")).drop(
        "__rng", "__start", "__pos"
    )


def block_draws(clusters: DataFrame, groups: Sequence[str], n_resamples: int, seed: int, block_size: int) -> DataFrame:
    """(groups, block, replicate, draws) of the groups that have more clusters than a block; ``draws`` are those of a run of
    replicates, the first being ``replicate``.

    The draws depend on the size of a group alone, so groups of one size share them.  A task descends from the whole group to
    its blocks for some replicates at a time, so the work on ranges that hold many draws is shared out and done once.
    """
    groups = list(groups)
    sizes = settle(clusters.groupBy(*groups).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block_size), "large-groups")
    return sizes.join(draws_of_sizes(sizes.select("n").distinct(), n_resamples, seed, block_size), "n").select(*groups, "block", "replicate", "draws")


def draws_of_sizes(some: DataFrame, n_resamples: int, seed: int, block_size: int) -> DataFrame:
    """(n, block, replicate, draws) of the distinct sizes ``n`` in ``some``, as in ``block_draws``."""
    runs = -(-n_resamples // REPLICATES)
    rows = some.withColumn("replicate", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_resamples - 1).cast("bigint"), F.lit(REPLICATES).cast("bigint"))))
    rows = rows.repartition(min(max(1, some.count() * runs), MOST_TASKS), "n", "replicate")
    names = ["n", "block", "replicate", "draws"]

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                replicates = np.arange(first, min(first + REPLICATES, n_resamples))
                parts = [draws for _, draws in Splitter(replicates, seed).leaves(0, n, np.full(len(replicates), n, np.int64), block_size)]
                ends = pa.array(np.arange(len(parts) + 1) * len(replicates), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([n] * len(parts), pa.int64()), pa.array(range(len(parts)), pa.int64()), pa.array([first] * len(parts), pa.int64()),
                     pa.ListArray.from_arrays(ends, pa.array(np.concatenate(parts)))], names=names)

    schema = T.StructType([*[T.StructField(c, T.LongType()) for c in names[:3]], T.StructField("draws", T.ArrayType(T.LongType()))])
    return rows.mapInArrow(descend, schema)


def with_weights(rows: DataFrame, clusters: DataFrame, groups: Sequence[str], n_resamples: int, seed: int, use, schema: T.StructType,
                 block_size: int | None = None) -> DataFrame:
    """Runs ``use(table, weights)`` on the rows of every block of clusters; its Arrow table (without the groups) is the result.

    ``rows`` carry ``groups, idx, n`` (``dense_index``) and what ``use`` needs, ``clusters`` the distinct clusters of the groups;
    ``weights`` is ``[clusters of the block, replicates]``, and a row's own are at ``idx % block_size``.
    """
    block_size = block_size or BLOCK
    drawn = block_draws(clusters, groups, n_resamples, seed, block_size)
    return _weigh(rows, drawn, groups, clusters.count() * n_resamples, n_resamples, seed, use, schema, block_size)


def _weigh(rows: DataFrame, drawn: DataFrame, groups: Sequence[str], work: int, n_resamples: int, seed: int, use, schema: T.StructType,
           block_size: int) -> DataFrame:
    groups = list(groups)
    keys = [*groups, "__block"]
    # rows are few and small beside the work they stand for, so their number of tasks is not left to their size
    tasks = max(1, work // PER_TASK)
    left = rows.withColumn("__block", F.shiftright("idx", block_size.bit_length() - 1)).repartition(tasks, *keys)
    right = drawn.withColumnRenamed("block", "__block").repartition(tasks, *keys)
    fields = [left.schema[g] for g in groups]

    def weigh(key: tuple, mine: pa.Table, drawn: pa.Table) -> pa.Table:
        if not mine.num_rows:
            return pa.table({f.name: pa.array([], t) for f, t in zip(out.fields, types)})
        draws = None
        if drawn.num_rows:
            draws = np.zeros(n_resamples, np.int64)
            for first, part in zip(drawn["replicate"].to_pylist(), drawn["draws"]):
                draws[first:first + len(part)] = part.values.to_numpy()
        weights = block_weights(mine["n"][0].as_py(), key[-1].as_py(), block_size, draws, n_resamples, seed)
        result = use(mine, weights)
        constant = {g: pa.array([key[k].as_py()] * result.num_rows, t) for k, (g, t) in enumerate(zip(groups, types))}
        return pa.table(constant | {c: result[c] for c in result.column_names})

    from pyspark.sql.pandas.types import to_arrow_type

    out = T.StructType([*fields, *schema.fields])
    types = [to_arrow_type(f.dataType) for f in out.fields]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(weigh, out)


def _explode_replicates(df: DataFrame, n_resamples: int) -> DataFrame:
    return df.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_resamples - 1).cast("bigint"))).alias("replicate"))


def _poisson_weight(u: str) -> Column:
    weight = F.lit(len(POISSON_CDF))
    for k in range(len(POISSON_CDF) - 1, -1, -1):
        weight = F.when(F.col(u) < POISSON_CDF[k], k).otherwise(weight)
    return weight


def _poisson(base: DataFrame, n_resamples: int, seed: int) -> DataFrame:
    mixed = F.shiftrightunsigned(F.xxhash64("__num", "replicate", F.lit(seed)), 11)
    return _explode_replicates(base, n_resamples).withColumn("__u", mixed.cast("double") * 2.0**-53).withColumn(
        "weight", _poisson_weight("__u")
    )


def numbered(df: DataFrame, cluster: str) -> DataFrame:
    return df.withColumn("__num", cluster_number(F.col(cluster)))


def check_scheme(scheme: str) -> None:
    if scheme not in ("multinomial", "poisson"):
        raise ValueError(f"unknown resampling scheme {scheme!r}")


def bootstrap_weights(clusters: DataFrame, groups: Sequence[str], cluster: str, n_resamples: int, seed: int,
                      scheme: str = "multinomial") -> DataFrame:
    """(groups, cluster, replicate, weight > 0) for distinct clusters per group.

    ``multinomial`` draws n clusters with replacement per replicate.  ``poisson``
    gives every cluster an independent Poisson(1) weight: no index and no
    shuffle, for very many clusters.
    """
    check_scheme(scheme)
    groups = list(groups)
    base = numbered(clusters.select(*groups, cluster), cluster)
    if scheme == "poisson":
        return _poisson(base, n_resamples, seed).select(*groups, cluster, "replicate", "weight").where("weight > 0")

    def listed(mine: pa.Table, weights: np.ndarray) -> pa.Table:
        at = mine["idx"].to_numpy() % BLOCK
        row, replicate = np.nonzero(weights[at])
        return pa.table({
            cluster: mine[cluster].take(pa.array(row)), "replicate": pa.array(replicate, pa.int64()),
            "weight": pa.array(weights[at[row], replicate].astype(np.int64)),
        })

    placed = dense_index(base, groups, "__num", cluster).drop("__num")
    schema = T.StructType([placed.schema[cluster], T.StructField("replicate", T.LongType()), T.StructField("weight", T.LongType())])
    return with_weights(placed, base, groups, n_resamples, seed, listed, schema)


def replicate_means(values: DataFrame, groups: Sequence[str], cluster: str, value: str, n_resamples: int, seed: int,
                    scheme: str = "multinomial") -> DataFrame:
    """(groups, replicate, estimate): mean of one value per cluster in every replicate.

    A block of clusters sends one sum per replicate, whatever its number of clusters is.
    """
    check_scheme(scheme)
    groups = list(groups)
    base = numbered(values.select(*groups, cluster, value), cluster)
    if scheme == "poisson":
        return (
            _poisson(base, n_resamples, seed).groupBy(*groups, "replicate")
            .agg(F.sum(F.col("weight") * F.col(value)).alias("__s"), F.sum("weight").alias("__sw"))
            .select(*groups, "replicate", F.try_divide("__s", "__sw").alias("estimate"))
        )

    # groups of one size have the same weights: up to about POOL of them meet where a block's weights are derived
    block_size, pool = BLOCK, ["n", "__share"]
    sizes = settle(base.groupBy(*groups).agg(F.count(F.lit(1)).alias("n")).withColumn("__group", F.monotonically_increasing_id()), "group-sizes")
    shares = sizes.groupBy("n").agg(F.count(F.lit(1)).alias("__groups")).withColumn("__shares", F.ceil(F.col("__groups") / POOL))
    work = shares.agg(F.sum(F.col("n") * F.col("__shares") * n_resamples), F.sum(F.col("n") * F.col("__groups") * n_resamples)).first()
    work = (work[0] or 0) + (work[1] or 0) // SUMMED

    def summed(mine: pa.Table, weights: np.ndarray) -> pa.Table:
        group, of = np.unique(mine["__group"].to_numpy(), return_inverse=True)
        at, v = mine["idx"].to_numpy() % block_size, mine["__value"].to_numpy()
        held = ~np.isnan(v)  # a value that is null or not a number takes no part, as in an average
        values, used = np.zeros((len(group), len(weights))), np.zeros((len(group), len(weights)))
        values[of[held], at[held]], used[of[held], at[held]] = v[held], 1.0
        weights = weights.astype(float)
        return pa.table({
            "__group": pa.array(np.repeat(group, weights.shape[1])), "replicate": pa.array(np.tile(np.arange(weights.shape[1], dtype=np.int64), len(group))),
            "__s": pa.array((values @ weights).reshape(-1)), "__sw": pa.array((used @ weights).reshape(-1).astype(np.int64)),
        })

    pooled = sizes.join(shares, "n").withColumn("__share", F.pmod(F.xxhash64("__group"), "__shares"))
    placed = dense_index(base, groups, "__num", cluster).select(*groups, "idx", F.col(value).cast("double").alias("__value"))
    placed = join_null_safe(placed, pooled.select(*groups, *pool, "__group"), groups).select(*pool, "__group", "idx", "__value")
    drawn = draws_of_sizes(shares.where(F.col("n") > block_size).select("n"), n_resamples, seed, block_size).join(
        pooled.select("n", F.col("__share").alias("__s")).distinct(), "n").withColumnRenamed("__s", "__share")
    schema = T.StructType([T.StructField("__group", T.LongType()), T.StructField("replicate", T.LongType()), T.StructField("__s", T.DoubleType()), T.StructField("__sw", T.LongType())])
    sums = _weigh(placed, drawn, pool, work, n_resamples, seed, summed, schema, block_size)
    means = sums.groupBy("__group", "replicate").agg(F.sum("__s").alias("__s"), F.sum("__sw").alias("__sw"))
    return means.join(sizes, "__group").select(*groups, "replicate", F.try_divide("__s", "__sw").alias("estimate"))


def interval(replicates: DataFrame, groups: Sequence[str], value: str, alpha: float = 0.05,
             mean_name: str | None = None, used_name: str | None = None) -> DataFrame:
    """Percentile interval over the replicates of each group (their number is a parameter)."""
    aggs = [F.percentile(value, F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2))).alias("__q")]
    if mean_name:
        aggs.append(F.avg(value).alias(mean_name))
    if used_name:
        aggs.append(F.count(value).alias(used_name))
    extra = [c for c in (mean_name, used_name) if c]
    low, high = F.get("__q", F.lit(0)), F.get("__q", F.lit(1))
    return replicates.groupBy(*groups).agg(*aggs).select(
        *groups, *extra, low.alias("lo"), high.alias("hi"), ((low > 0) | (high < 0)).alias("excludes_zero")
    )
