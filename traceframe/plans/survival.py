"""Product-limit (Kaplan-Meier) survival, median, restricted mean and their bootstrap.

Observations are first reduced to a life table (one row per stratum and distinct
time, a map-side combining aggregate).  The running products then work on
ranges of the time axis with bounds from the data, so a stratum that holds most
of it, or very many distinct times however close, is never scanned by one task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.frames import join_null_safe
from ..functions.ranges import ranged
from ..functions.resampling import BLOCK, bootstrap_weights, check_scheme, dense_index, interval, numbered, with_weights
from ..session import settle

#: Cells that are weighted at once, and replicates that share a row.
SLICE, CHUNK = 4096, 125


def life_table(df: DataFrame, strata: Sequence[str], time: str = "time", event: str = "event",
               weight: Column | None = None) -> DataFrame:
    """(strata, time, __n, __d): subjects leaving at ``time`` and events among them."""
    w = F.lit(1) if weight is None else weight
    return df.groupBy(*strata, F.col(time).cast("double").alias("time")).agg(
        F.sum(w).alias("__n"),
        F.sum(F.when(F.col(event), w).otherwise(F.lit(0))).alias("__d"),
    )


def product_limit(life: DataFrame, strata: Sequence[str], per_range: int | None = None) -> DataFrame:
    """Survival curve of a life table: at-risk counts include everyone with time >= t.

    The times of a large stratum are cut into ranges; totals and products of whole ranges carry over from one to the next.
    """
    keys = [*strata, "__range"]
    life = ranged(life, strata, "time", "life-table", per_range)
    per_block = life.groupBy(*keys).agg(F.sum("__n").alias("__bn"))
    along = (Window.partitionBy(*strata) if strata else Window.partitionBy(F.lit(0))).orderBy("__range")
    whole = Window.partitionBy(*strata) if strata else Window.partitionBy(F.lit(0))
    starts = per_block.select(
        *keys,
        (F.sum("__bn").over(whole) - F.sum("__bn").over(along) + F.col("__bn")).alias("__start"),
    )
    inside = Window.partitionBy(*keys).orderBy("time")
    rows = join_null_safe(life, starts, keys, filled=["__range"])
    rows = rows.withColumn("at_risk", F.col("__start") - F.sum("__n").over(inside) + F.col("__n"))
    rows = rows.withColumn(
        "__factor",
        F.when(F.col("at_risk") > 0, 1.0 - F.col("__d") / F.col("at_risk")).otherwise(F.lit(1.0)),
    ).withColumn("__inner", F.product("__factor").over(inside))
    block_products = rows.groupBy(*keys).agg(F.product("__factor").alias("__p"))
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    entering = block_products.select(
        *keys, F.coalesce(F.product("__p").over(before), F.lit(1.0)).alias("__enter")
    )
    rows = join_null_safe(rows, entering, keys, filled=["__range"])
    earlier = F.coalesce(F.product("__factor").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(1.0))
    survival = F.col("__enter") * F.col("__inner")
    return rows.withColumn("__earlier", F.col("__enter") * earlier).select(
        *strata,
        "time",
        "at_risk",
        F.col("__d").alias("events"),
        (F.col("__n") - F.col("__d")).alias("censored"),
        survival.alias("survival"),
        (F.col("__earlier") - survival).alias("drop"),
    )


def kaplan_meier(df: DataFrame, strata: Sequence[str] = (), time: str = "time", event: str = "event") -> DataFrame:
    return product_limit(life_table(df, strata, time, event), strata).drop("drop")


def curve_median(curve: DataFrame, strata: Sequence[str] = ()) -> DataFrame:
    """First time at which survival is at most one half; null when it never is."""
    return curve.groupBy(*strata).agg(F.min(F.when(F.col("survival") <= 0.5, F.col("time"))).alias("median"))


def area_of(tau: float) -> Column:
    """Aggregate over curve rows: area under the step function on [0, tau], null unless tau > 0.

    The area is the sum of drop * time over the steps up to tau plus tau times
    the survival left there, so no second ordered pass is needed.
    """
    inside = F.col("time") <= tau
    lost = F.sum(F.when(inside, F.col("drop") * F.col("time")).otherwise(F.lit(0.0)))
    left = F.coalesce(F.min(F.when(inside, F.col("survival"))), F.lit(1.0))
    return F.when(F.lit(tau > 0) & (F.count(F.lit(1)) > 0), lost + left * F.lit(float(tau)))


def curve_area(curve: DataFrame, strata: Sequence[str], tau: float) -> DataFrame:
    return curve.groupBy(*strata).agg(area_of(tau).alias("rmst"))


def rmst(df: DataFrame, strata: Sequence[str], tau: float, time: str = "time", event: str = "event") -> DataFrame:
    return curve_area(product_limit(life_table(df, strata, time, event), strata), strata, tau)


def survival_summary(df: DataFrame, strata: Sequence[str], tau: float, time: str = "time", event: str = "event",
                     weight: Column | None = None) -> DataFrame:
    """Counts, median and restricted mean per stratum; ``weight`` counts a row that many times."""
    curve = product_limit(life_table(df, strata, time, event, weight), strata)
    return curve.groupBy(*strata).agg(
        (F.sum("events") + F.sum("censored")).alias("n"),
        F.sum("events").alias("n_events"),
        F.sum("censored").alias("n_censored"),
        F.max("time").alias("max_time"),
        F.min(F.when(F.col("survival") <= 0.5, F.col("time"))).alias("median"),
        area_of(tau).alias("rmst"),
        F.lit(float(tau)).alias("tau"),
    )


def survival_by_family(df: DataFrame, family: str, tau: float, time: str = "time", event: str = "event",
                       min_n: int = 2) -> DataFrame:
    """One summary row per family; families with fewer than ``min_n`` rows get no estimate."""
    named = df.withColumn(family, F.coalesce(F.col(family).cast("string"), F.lit("?")))
    full = survival_summary(named, [family], tau, time, event)
    short = F.col("n") < F.lit(min_n)
    blank = ["n_events", "n_censored", "max_time", "median", "rmst"]
    return full.select(
        family,
        "n",
        "tau",
        short.alias("insufficient_data"),
        *[F.when(~short, F.col(c)).alias(c) for c in blank],
    )


def endpoint_observations(records: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Long form of the two endpoints: closure at the think-end token, termination at the last token."""
    closed = F.coalesce(F.col("think_end_reached"), F.lit(False))
    ended = F.coalesce(F.col("terminated_by_eos"), F.lit(False))
    closure = F.struct(
        F.lit("reasoning_closure").alias("endpoint"),
        F.when(closed, F.col("reasoning_tokens") + 1).otherwise(F.col("total_tokens")).cast("double").alias("time"),
        closed.alias("event"),
        (ended & ~closed).alias("competing"),
    )
    termination = F.struct(
        F.lit("generation_termination").alias("endpoint"),
        F.col("total_tokens").cast("double").alias("time"),
        ended.alias("event"),
        F.lit(False).alias("competing"),
    )
    return records.select(*keep, F.inline(F.array(closure, termination)))


def survival_endpoints(primary: DataFrame, tau: float, by: Sequence[str] = ("condition_id",)) -> DataFrame:
    """Per condition and endpoint over draw-level records: counts, median, restricted mean."""
    strata = [*by, "endpoint"]
    cells = settle(
        endpoint_observations(primary, by).groupBy(*strata, "time", "event", "competing").agg(F.count(F.lit(1)).alias("__w")),
        "endpoint-cells")
    competing = cells.groupBy(*strata).agg(
        F.coalesce(F.sum(F.when(F.col("competing"), F.col("__w"))), F.lit(0)).alias("n_competing"))
    summary = survival_summary(cells, strata, tau, weight=F.col("__w"))
    return join_null_safe(summary, competing, strata)


def replicate_steps(cells: DataFrame, shared: DataFrame, by: Sequence[str], arms: tuple[str, str], n_resamples: int, seed: int) -> DataFrame:
    """(by, __chunk, __side, time, n, d): leaving and events at a time, as arrays over the replicates of a chunk.

    Made where the clusters of a block are: their life tables times their weights, a bounded slice of cells at a time.  A
    time may have several rows, one for each block and slice.
    """
    by = list(by)
    placed = dense_index(numbered(shared, "__cl"), by, "__num", "__cl").drop("__num")
    rows = join_null_safe(cells, placed, [*by, "__cl"], filled=["__cl"]).select(
        *by, "idx", "n", F.when(F.col("__arm") == arms[0], 0).otherwise(1).alias("__side"), "time",
        F.col("__n").cast("bigint").alias("__n"), F.col("__d").cast("bigint").alias("__d"))

    def stepped(mine: pa.Table, weights: np.ndarray) -> pa.Table:
        at, side, time, n, d = (mine[c].to_numpy() for c in ("idx", "__side", "time", "__n", "__d"))
        order = np.lexsort((time, side))
        pieces = []
        for start in range(0, len(order), SLICE):
            o = order[start:start + SLICE]
            first = np.flatnonzero(np.concatenate(([True], (side[o][1:] != side[o][:-1]) | (time[o][1:] != time[o][:-1]))))
            for chunk in range(0, n_resamples, CHUNK):
                w = weights[at[o] % BLOCK, chunk:chunk + CHUNK].astype(np.int64)
                sums = [np.add.reduceat(w * x[o][:, None], first, axis=0) for x in (n, d)]
                ends = pa.array(np.arange(len(first) + 1) * w.shape[1], pa.int32())
                pieces.append(pa.table({
                    "__chunk": pa.array([chunk] * len(first), pa.int32()), "__side": pa.array(side[o][first], pa.int32()), "time": pa.array(time[o][first]),
                    **{c: pa.ListArray.from_arrays(ends, pa.array(x.reshape(-1))) for c, x in zip("nd", sums)},
                }))
        return pa.concat_tables(pieces)

    schema = T.StructType([T.StructField("__chunk", T.IntegerType()), T.StructField("__side", T.IntegerType()), T.StructField("time", T.DoubleType()),
                           T.StructField("n", T.ArrayType(T.LongType())), T.StructField("d", T.ArrayType(T.LongType()))])
    return with_weights(rows, shared, by, n_resamples, seed, stepped, schema)


def replicate_areas(steps: DataFrame, by: Sequence[str], tau: float) -> DataFrame:
    """(by, replicate, __side, rmst): restricted means of all replicates by one scan of the times, last first.

    Going back in time, the subjects at risk are a running sum, and the area beyond a time, as a share of those that reach
    it, follows from the area beyond the next one: nothing is held but one vector over the replicates of a chunk.
    """
    by = list(by)
    keys = [*by, "__chunk", "__side"]
    ordered = steps.repartition(*keys).sortWithinPartitions(*keys, F.desc("time")).select(*keys, "time", "n", "d")
    schema = T.StructType([*[ordered.schema[k] for k in by], T.StructField("__side", T.IntegerType()), T.StructField("replicate", T.LongType()), T.StructField("rmst", T.DoubleType())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = time = n = d = at_risk = beyond = later = kept = None

        def step() -> None:
            """Takes the finished time into the running values."""
            nonlocal at_risk, beyond, later
            at_risk = at_risk + n
            if time <= tau:
                left = np.where(at_risk > 0, 1.0 - d / np.maximum(at_risk, 1), 1.0)
                beyond = left * (later - time + beyond)
                later = time

        def told() -> pa.RecordBatch:
            step()
            size = len(at_risk)
            area = np.where(at_risk > 0, later + beyond, np.nan)
            here = pa.array([0] * size, pa.int32())
            return pa.RecordBatch.from_arrays(
                [*[c.take(here) for c in kept], pa.array([key[-1]] * size, pa.int32()), pa.array(key[-2] + np.arange(size), pa.int64()),
                 pa.array(area, pa.float64(), from_pandas=True)], names=[*by, "__side", "replicate", "rmst"])

        for batch in batches:
            found = list(zip(*[batch.column(k).to_pylist() for k in range(len(keys))]))
            times = batch.column(len(keys)).to_pylist()
            for row, (new_key, new_time) in enumerate(zip(found, times)):
                more, events = (batch.column(len(keys) + k)[row].values.to_numpy() for k in (1, 2))
                if new_key == key and new_time == time:
                    n, d = n + more, d + events
                    continue
                if new_key == key:
                    step()
                else:
                    if key is not None:
                        yield told()
                    key, kept = new_key, [batch.column(k).slice(row, 1) for k in range(len(by))]
                    at_risk, beyond, later = np.zeros(len(more), np.int64), np.zeros(len(more)), float(tau)
                time, n, d = new_time, more, events
        if key is not None:
            yield told()

    areas = ordered.mapInArrow(scan, schema)
    return areas if tau > 0 else areas.where("false")


def rmst_delta_bootstrap(df: DataFrame, tau: float, cluster: str = "task_id", arm: str = "arm",
                         arms: tuple[str, str] = ("A", "B"), time: str = "time", event: str = "event",
                         n_resamples: int = 2000, seed: int = 0, alpha: float = 0.05,
                         by: Sequence[str] = (), scheme: str = "multinomial") -> DataFrame:
    """Cluster bootstrap of RMST(first arm) - RMST(second arm) over shared clusters.

    A group without a shared cluster has ``n_clusters`` 0 and no estimates.

    The same replicate weights apply to both arms.  Weights multiply the life
    table of a cluster, not its raw observations, and are reduced over the
    clusters of a block before anything is sent.
    """
    by = list(by)
    obs = df.where(F.col(arm).isin(*arms)).select(
        *by, F.col(cluster).alias("__cl"), F.col(arm).alias("__arm"), time, event
    )
    cells = settle(life_table(obs, [*by, "__cl", "__arm"], time, event), "cluster-life-tables")
    shared = (
        cells.groupBy(*by, "__cl")
        .agg(F.count_if(F.col("__arm") == arms[0]).alias("__a"), F.count_if(F.col("__arm") == arms[1]).alias("__b"))
        .where("__a > 0 AND __b > 0")
        .drop("__a", "__b")
    )
    n_clusters = shared.groupBy(*by).agg(F.count(F.lit(1)).alias("n_clusters"))
    if by:
        n_clusters = join_null_safe(cells.select(*by).distinct(), n_clusters, by, "left").fillna(0, ["n_clusters"])
    cells = join_null_safe(cells, shared, [*by, "__cl"])

    def delta(life: DataFrame, keys: list[str]) -> DataFrame:
        area = curve_area(product_limit(life, [*keys, "__arm"]), [*keys, "__arm"], tau)
        return (
            area.groupBy(*keys)
            .agg(
                F.max(F.when(F.col("__arm") == arms[0], F.col("rmst"))).alias("__ra"),
                F.max(F.when(F.col("__arm") == arms[1], F.col("rmst"))).alias("__rb"),
            )
            .where("__ra IS NOT NULL AND __rb IS NOT NULL")
            .select(*keys, (F.col("__ra") - F.col("__rb")).alias("delta"))
        )

    pooled = cells.groupBy(*by, "__arm", "time").agg(F.sum("__n").alias("__n"), F.sum("__d").alias("__d"))
    point = delta(pooled, by).withColumnRenamed("delta", "point")
    check_scheme(scheme)
    if scheme == "poisson":
        weights = bootstrap_weights(shared, by, "__cl", n_resamples, seed, scheme)
        weighted = (
            join_null_safe(weights, cells, [*by, "__cl"], filled=["__cl"])
            .groupBy(*by, "replicate", "__arm", "time")
            .agg(F.sum(F.col("__n") * F.col("weight")).alias("__n"), F.sum(F.col("__d") * F.col("weight")).alias("__d"))
        )
        replicates = delta(weighted, [*by, "replicate"])
    else:
        areas = replicate_areas(replicate_steps(cells, shared, by, arms, n_resamples, seed), by, tau)
        replicates = areas.groupBy(*by, "replicate").agg(
            F.max(F.when(F.col("__side") == 0, F.col("rmst"))).alias("__ra"), F.max(F.when(F.col("__side") == 1, F.col("rmst"))).alias("__rb"),
        ).select(*by, "replicate", (F.col("__ra") - F.col("__rb")).alias("delta")).where("delta IS NOT NULL")
    ci = interval(replicates, by, "delta", alpha, mean_name="mean", used_name="n_resamples_used")
    if not by:
        return n_clusters.join(point, F.lit(True), "left").join(ci, F.lit(True), "left").withColumn("tau", F.lit(float(tau)))
    joined = join_null_safe(join_null_safe(n_clusters, point, by, "left"), ci, by, "left")
    return joined.withColumn("tau", F.lit(float(tau)))
