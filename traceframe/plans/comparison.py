"""Bootstrap intervals, effect labels and the paired metric panel.

Values are reduced to one row per cluster before replicates are drawn, so the
resampling cost depends on the number of clusters, not on the number of traces.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import join_null_safe
from ..functions.resampling import interval, replicate_means
from ..functions.status import record_status
from ..operators.aggregates import combine_noise, listed_noise, wide_noise
from ..operators.pairing import usable_pairs_by_task
from ..session import settle

Z_95 = 1.959964  # fixed value: 97.5 % point of the standard normal


def metric_columns() -> dict[str, Column]:
    """The named per-record metrics; add a metric by adding an expression."""
    one = lambda flag: F.coalesce(flag, F.lit(False)).cast("double")
    status = record_status()
    eos, seen = F.col("terminated_by_eos"), F.col("answer_normalized").isNotNull()
    return {
        "success_at_budget": one(F.col("correct")),
        "reasoning_closure_rate": one(F.col("think_end_reached")),
        "completion_rate": one(eos),
        "censored_rate": one(status == "censored"),
        "error_rate": one(status == "error"),
        "answer_observation_rate": one(seen),
        "conditional_accuracy_given_completed": F.when(eos & seen, one(F.col("correct"))),
        "reasoning_tokens": F.col("reasoning_tokens").cast("double"),
        "total_tokens": F.col("total_tokens").cast("double"),
        "wall_ms": F.col("wall_ms").cast("double"),
        "repeated_ngram_fraction_4": F.col("repeated_ngram_fraction_4").cast("double"),
        "unique_token_ratio": F.col("unique_token_ratio").cast("double"),
        "longest_run_length": F.col("longest_run_length").cast("double"),
        "terminated_by_eos": one(eos),
        "missing_answer": one(F.col("missing_answer")),
    }


def classify_effect(mean: Column, excludes_zero: Column, noise: Column) -> Column:
    """Label of a paired delta against the noise between repeats; the case order is the definition."""
    clear = F.coalesce(excludes_zero, F.lit(False))
    return (
        F.when(mean.isNull(), "insufficient_data")
        .when(noise.isNull(), F.when(clear, "ci_only").otherwise("insufficient_data"))
        .when(~clear, "below_noise")
        .when(noise <= 0, "comparable")
        .when(F.abs(mean) > noise * 2, "clearly_larger")
        .otherwise("comparable")
    )


def _with_ci(stats: DataFrame, replicates: DataFrame, groups: Sequence[str], alpha: float) -> DataFrame:
    ci = interval(replicates, groups, "estimate", alpha)
    if not groups:
        return stats.withColumn("__k", F.lit(1)).join(ci.withColumn("__k", F.lit(1)), "__k", "left").drop("__k")
    return join_null_safe(stats, ci, groups, "left")


def bootstrap_ci(df: DataFrame, groups: Sequence[str], unit: str, value: str, n_resamples: int = 2000,
                 alpha: float = 0.05, seed: int = 0, scheme: str = "multinomial") -> DataFrame:
    """Percentile interval of a mean; ``unit`` identifies one value."""
    rows = settle(df.select(*groups, F.col(unit).alias("__cl"), F.col(value).cast("double").alias("__v"))
                  .where(F.col("__v").isNotNull()), "bootstrap-values")
    stats = rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), F.avg("__v").alias("mean"))
    reps = replicate_means(rows, groups, "__cl", "__v", n_resamples, seed, scheme)
    return _with_ci(stats, reps, groups, alpha).drop("excludes_zero")


def paired_bootstrap_delta(df: DataFrame, groups: Sequence[str], unit: str, a: str, b: str, n_resamples: int = 2000,
                           alpha: float = 0.05, seed: int = 0, scheme: str = "multinomial") -> DataFrame:
    """Interval of mean(a - b) over matched rows."""
    rows = settle(df.select(*groups, F.col(unit).alias("__cl"), (F.col(a) - F.col(b)).cast("double").alias("__v")),
                  "paired-deltas")
    stats = rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), F.avg("__v").alias("mean"))
    return _with_ci(stats, replicate_means(rows, groups, "__cl", "__v", n_resamples, seed, scheme), groups, alpha)


def cluster_bootstrap_ci(df: DataFrame, groups: Sequence[str], cluster: str, value: str, n_resamples: int = 2000,
                         alpha: float = 0.05, seed: int = 0, scheme: str = "multinomial") -> DataFrame:
    """Interval of the mean over clusters of the per-cluster mean."""
    means = settle(
        df.where(F.col(value).isNotNull()).groupBy(*groups, F.col(cluster).alias("__cl")).agg(
            F.avg(F.col(value).cast("double")).alias("__v"), F.count(F.lit(1)).alias("__n")), "cluster-means")
    stats = means.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n_clusters"), F.sum("__n").alias("n_obs"), F.avg("__v").alias("mean"))
    reps = replicate_means(means, groups, "__cl", "__v", n_resamples, seed, scheme)
    return _with_ci(stats, reps, groups, alpha).drop("excludes_zero")


def cluster_deltas(df: DataFrame, groups: Sequence[str], cluster: str, value: str, arm: str,
                   arms: tuple[str, str]) -> DataFrame:
    """(groups, __cl, __a, __b, __na, __nb): both arms' cluster means and sizes in one aggregate."""
    pick = lambda a: F.when(F.col(arm) == a, F.col(value).cast("double"))
    return df.where(F.col(value).isNotNull() & F.col(arm).isin(*arms)).groupBy(
        *groups, F.col(cluster).alias("__cl")
    ).agg(
        F.avg(pick(arms[0])).alias("__a"), F.avg(pick(arms[1])).alias("__b"),
        F.count(pick(arms[0])).alias("__na"), F.count(pick(arms[1])).alias("__nb"),
    )


def paired_cluster_bootstrap(df: DataFrame, groups: Sequence[str], cluster: str, value: str, arm: str = "arm",
                             arms: tuple[str, str] = ("A", "B"), n_resamples: int = 2000, alpha: float = 0.05,
                             seed: int = 0, scheme: str = "multinomial", guard: bool = False) -> DataFrame:
    """Interval of the mean over shared clusters of mean(first arm) - mean(second arm).

    ``guard`` blanks the interval when fewer than two distinct deltas exist.
    """
    cells = settle(cluster_deltas(df, groups, cluster, value, arm, arms), "cluster-deltas")
    shared = cells.withColumn("__v", F.col("__a") - F.col("__b"))
    delta = F.col("__v")
    stats = shared.groupBy(*groups).agg(
        F.count(delta).alias("n_clusters"), (F.sum("__na") + F.sum("__nb")).alias("n_obs"), F.avg(delta).alias("mean"),
        F.min(F.round(delta, 9)).alias("__dlo"), F.max(F.round(delta, 9)).alias("__dhi"),
    )
    stats = stats.withColumn("n_obs", F.when(F.col("n_clusters") > 0, F.col("n_obs")).otherwise(F.lit(0)))
    reps = replicate_means(shared.where(delta.isNotNull()), groups, "__cl", "__v", n_resamples, seed, scheme)
    out = _with_ci(stats, reps, groups, alpha)
    if guard:
        out = degenerate_guard(out, F.coalesce(F.col("__dlo") == F.col("__dhi"), F.lit(True)) | (F.col("n_clusters") < 2))
    return out.drop("__dlo", "__dhi")


def degenerate_guard(stats: DataFrame, degenerate: Column) -> DataFrame:
    """No interval is made up from fewer than two distinct paired deltas."""
    out = stats.withColumn("degenerate", degenerate)
    for c in ("lo", "hi", "excludes_zero"):
        out = out.withColumn(c, F.when(~F.col("degenerate"), F.col(c)))
    return out


def panel_cells(pairs: DataFrame, metrics: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, metric, task_id, and mean m, count n, variance v of both arms) of usable pairs whose arm structs carry the metric columns.

    A pair is one row per metric that has a value in it, with both arms; a metric travels as its number.
    """
    names = list(metrics)
    rows = F.array(*[F.struct(F.lit(k).alias("__m"), *[F.col(f"{t}.m_{m}").alias(f"__{t}") for t in "ab"]) for k, m in enumerate(names)])
    cells = pairs.select(*by, "task_id", F.inline(rows)).where("__a IS NOT NULL OR __b IS NOT NULL").groupBy(*by, "task_id", "__m").agg(*[
        agg for t in "ab" for agg in (F.avg(f"__{t}").alias(f"m_{t}"), F.count(f"__{t}").alias(f"n_{t}"), F.coalesce(F.var_pop(f"__{t}"), F.lit(0.0)).alias(f"v_{t}"))])
    return cells.withColumn("metric", F.element_at(F.array(*[F.lit(m) for m in names]), F.col("__m") + 1)).drop("__m")


def metric_panel(records: DataFrame, n_resamples: int = 2000, seed: int = 0, arm: str = "arm",
                 arms: tuple[str, str] = ("A", "B"), scheme: str = "multinomial", by: Sequence[str] = ()) -> DataFrame:
    """Per metric: paired clustered delta with interval, noise of both arms, label and short summaries.

    Draws are collapsed and paired once; all metrics, and all groups of ``by`` (the pairs of ``pair_records``), run through
    one resampling.  A metric without values has its row, with counts of zero and no estimates.
    """
    by = list(by)
    keys = [*by, "metric"]
    metrics = metric_columns()
    wide = records.where(F.col(arm).isin(*arms)).select("*", *[c.alias(f"m_{m}") for m, c in metrics.items()])
    names = [f"m_{m}" for m in metrics]
    parts = [panel_cells(p, list(metrics), by) for p in usable_pairs_by_task(wide, names, arm, arms, by=by) if p is not None]
    cells = settle(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]), "panel-cells")
    stats = cells.groupBy(*keys).agg(
        F.count(F.col("m_a") - F.col("m_b")).alias("n_clusters"),
        (F.sum("n_a") + F.sum("n_b")).alias("n_obs"),
        F.avg(F.col("m_a") - F.col("m_b")).alias("mean"),
        *[agg for t in "ab" for agg in (
            F.sum(f"n_{t}").alias(f"n_{t}"),
            F.try_divide(F.sum(F.col(f"n_{t}") * F.col(f"m_{t}")), F.sum(f"n_{t}")).alias(f"mean_{t}"))],
    )
    # pooled sample variance from cluster means and variances, centred on the overall mean
    spread = join_null_safe(cells.select(*keys, *[f"{c}_{t}" for t in "ab" for c in "mnv"]),
                            stats.select(*keys, "mean_a", "mean_b"), keys, filled=["metric"])
    spread = spread.groupBy(*keys).agg(*[
        F.sum(F.col(f"n_{t}") * (F.col(f"v_{t}") + F.pow(F.col(f"m_{t}") - F.col(f"mean_{t}"), 2.0))).alias(f"ss_{t}")
        for t in "ab"])
    deltas = cells.select(*keys, F.col("task_id").alias("__cl"), (F.col("m_a") - F.col("m_b")).alias("__v")).where(
        "__v IS NOT NULL")
    out = _with_ci(stats, replicate_means(deltas, keys, "__cl", "__v", n_resamples, seed, scheme), keys, 0.05)
    out = join_null_safe(out, spread, keys, filled=["metric"])
    spreads = settle(wide_noise(wide, [*by, arm], names), "panel-noise")
    noise = listed_noise(spreads, [*by, arm], names).groupBy(*keys).agg(
        *[F.max(F.when(F.col(arm) == a, F.col("noise_scale"))).alias(f"noise_scale_{t}") for t, a in zip("ab", arms)]
    ).withColumn("metric", F.expr("substring(metric, 3)"))
    every = F.explode(F.array(*[F.lit(m) for m in metrics])).alias("metric")
    groups = spreads.select(*by).distinct() if by else wide.sparkSession.range(1)
    out = join_null_safe(groups.select(*by, every), out, keys, "left", filled=["metric"])
    out = join_null_safe(out, noise, keys, "left", filled=["metric"])
    for c in ("n_clusters", "n_obs", "n_a", "n_b"):
        out = out.withColumn(c, F.coalesce(c, F.lit(0).cast("bigint")))
    combined = combine_noise(F.col("noise_scale_a"), F.col("noise_scale_b"))

    def std(t: str) -> Column:
        n = F.col(f"n_{t}")
        return F.when(n > 1, F.sqrt(F.col(f"ss_{t}") / (n - 1))).when(n == 1, F.lit(0.0)).alias(f"std_{t}")

    return out.select(
        *keys, "n_clusters", "n_obs", "mean", "lo", "hi", "excludes_zero", "noise_scale_a", "noise_scale_b",
        combined.alias("noise_scale"),
        classify_effect(F.col("mean"), F.col("excludes_zero"), combined).alias("classification"),
        "n_a", "mean_a", std("a"), "n_b", "mean_b", std("b"),
        ((F.col("n_a") > 0) & (F.col("n_b") > 0)).alias("estimable"),
    )


def paired_precision(df: DataFrame, groups: Sequence[str], cluster: str, value: str, arm: str = "arm",
                     arms: tuple[str, str] = ("A", "B"), z: float = Z_95) -> DataFrame:
    """Normal half-width z * sd / sqrt(n) of a paired per-cluster difference."""
    cells = cluster_deltas(df, groups, cluster, value, arm, arms)
    d = F.col("__a") - F.col("__b")
    out = cells.groupBy(*groups).agg(F.count(d).alias("n_clusters"), F.stddev_samp(d).alias("sd_delta"))
    se = F.col("sd_delta") / F.sqrt("n_clusters")
    return out.withColumn("se", se).withColumn("ci_half_width", se * F.lit(z))


def cross_study(panel: DataFrame, label: str = "pair_id", metric: str = "reasoning_closure_rate") -> DataFrame:
    """Studies of one ``metric_panel`` by ``label`` side by side; pooling is withheld on purpose."""
    return panel.where(F.col("metric") == metric).select(
        F.col(label).alias("label"), "n_clusters", "n_obs", F.col("mean").alias("closure_rate_delta"),
        F.col("lo").alias("closure_rate_lo"), F.col("hi").alias("closure_rate_hi"), F.lit(None).cast("double").alias("pooled"),
    )
