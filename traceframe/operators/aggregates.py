"""Grouped summaries: distributions, cluster means, outcome counts and rates, histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import count_of, join_null_safe, ratio
from ..functions.quantiles import quantiles_of_counts, value_counts
from ..functions.status import FORCED_OUTCOMES, exhausted_after_close, record_status
from ..session import settle


def long_metrics(df: DataFrame, keep: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """(keep, metric, value): the metric columns as rows, values as double."""
    pairs = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]
    return df.select(*keep, F.inline(F.array(*pairs)))


def summarize(df: DataFrame, groups: Sequence[str], value: str | Column) -> DataFrame:
    """n, mean, median, std (n-1; 0 for one value), min, max, p10, p90 of the non-null values.

    Everything derives from one table of value counts, read once from the input.
    """
    groups = list(groups)
    counts = value_counts(df, groups, value)
    basic = counts.groupBy(*groups).agg(
        F.sum("__c").alias("n"),
        (F.sum(F.col("__c") * F.col("__v")) / F.sum("__c")).alias("mean"),
        F.min("__v").alias("min"),
        F.max("__v").alias("max"),
    )
    joined = _join(counts, basic, groups)
    spread = joined.groupBy(*groups).agg(
        F.sum(F.col("__c") * F.pow(F.col("__v") - F.col("mean"), 2.0)).alias("__ss")
    )
    quantiles = quantiles_of_counts(counts, groups, {"p10": 0.1, "median": 0.5, "p90": 0.9})
    out = _join(_join(basic, spread, groups), quantiles, groups)
    std = F.when(F.col("n") > 1, F.sqrt(F.col("__ss") / (F.col("n") - 1))).otherwise(F.lit(0.0))
    return out.select(*groups, "n", "mean", "median", std.alias("std"), "min", "max", "p10", "p90")


def summarize_metrics(df: DataFrame, groups: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    return summarize(long_metrics(df, groups, metrics), [*groups, "metric"], "value")


def _join(a: DataFrame, b: DataFrame, groups: Sequence[str]) -> DataFrame:
    return join_null_safe(a, b, groups)


def brief(df: DataFrame, groups: Sequence[str], value: str, suffix: str = "") -> DataFrame:
    """Short form: n, mean, std (n-1; 0 for one value)."""
    return df.where(F.col(value).isNotNull()).groupBy(*groups).agg(
        F.count(value).alias(f"n{suffix}"),
        F.avg(value).alias(f"mean{suffix}"),
        F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias(f"std{suffix}"),
    )


def cluster_means(df: DataFrame, groups: Sequence[str], cluster: str, value: str) -> DataFrame:
    """Mean of the non-null values of every cluster; clusters without one are left out."""
    return (
        df.where(F.col(value).isNotNull())
        .groupBy(*groups, cluster)
        .agg(F.avg(F.col(value).cast("double")).alias("cluster_mean"), F.count(value).alias("cluster_n"))
    )


def macro_mean(df: DataFrame, groups: Sequence[str], cluster: str, value: str) -> DataFrame:
    means = cluster_means(df, groups, cluster, value)
    return means.groupBy(*groups).agg(F.avg("cluster_mean").alias("macro_mean"), F.count(F.lit(1)).alias("n_clusters"))


def within_cluster_std(df: DataFrame, groups: Sequence[str], cluster: Sequence[str], value: str) -> DataFrame:
    """Mean sample standard deviation of the clusters with more than one value; null when there is none."""
    per = (
        df.where(F.col(value).isNotNull())
        .groupBy(*groups, *cluster)
        .agg(F.count(value).alias("__n"), F.stddev_samp(value).alias("__s"))
    )
    return per.groupBy(*groups).agg(F.avg(F.when(F.col("__n") > 1, F.col("__s"))).alias("within_cluster_std"))


def noise_scale(records: DataFrame, groups: Sequence[str], metrics: Sequence[str], task: str = "task_id",
                seed: str = "seed") -> DataFrame:
    """Within-(task, seed) spread of raw executions, all metrics in one pass."""
    return listed_noise(wide_noise(records, groups, metrics, task, seed), groups, metrics)


def wide_noise(records: DataFrame, groups: Sequence[str], metrics: Sequence[str], task: str = "task_id", seed: str = "seed") -> DataFrame:
    """One row per group with ``__s_`` (mean spread) and ``__n_`` (number of values) of every metric: an execution stays one row."""
    value = {m: F.col(m).cast("double") for m in metrics}
    per = records.groupBy(*groups, task, seed).agg(*[
        agg for m in metrics for agg in (F.count(value[m]).alias(f"__n_{m}"), F.stddev_samp(value[m]).alias(f"__s_{m}"))])
    return per.groupBy(*groups).agg(*[agg for m in metrics for agg in (
        F.sum(f"__n_{m}").alias(f"__n_{m}"), F.avg(F.when(F.col(f"__n_{m}") > 1, F.col(f"__s_{m}"))).alias(f"__s_{m}"))])


def listed_noise(wide: DataFrame, groups: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """(groups, metric, noise_scale) of ``wide_noise``, without metrics that have no values in a group."""
    listed = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"__s_{m}").alias("noise_scale"), F.col(f"__n_{m}").alias("__n")) for m in metrics])
    return wide.select(*groups, F.inline(listed)).where(F.col("__n") > 0).drop("__n")


def combine_noise(*scales: Column) -> Column:
    """Larger of the available scales; null when none is."""
    return F.greatest(*scales) if len(scales) > 1 else scales[0]


def _category_aggregates() -> list[Column]:
    status = F.col("__status")
    return [
        F.count(F.lit(1)).alias("n"),
        count_of(F.col("think_end_reached")).alias("native_reasoning_closures"),
        count_of(F.col("terminated_by_eos")).alias("eos_terminations"),
        count_of(exhausted_after_close(F.col("think_end_reached"), F.col("capped"))).alias(
            "budget_exhausted_after_closure"
        ),
        count_of(status == "censored").alias("censored"),
        count_of(status == "terminated_no_closure").alias("terminated_no_closure"),
        count_of(status == "unparseable").alias("unparseable"),
        count_of(status == "error").alias("errors"),
        count_of(~F.coalesce(F.col("missing_answer"), F.lit(True))).alias("raw_answer_present"),
        count_of(F.col("answer_normalized").isNotNull()).alias("observed_answers"),
        count_of(F.col("correct")).alias("correct_answers"),
        count_of(F.col("answer_normalized").isNotNull() & ~F.coalesce(F.col("correct"), F.lit(False))).alias(
            "scorable_incorrect"
        ),
    ]


def category_counts(records: DataFrame, by: Sequence[str]) -> DataFrame:
    return records.withColumn("__status", record_status()).groupBy(*by).agg(*_category_aggregates())


def family_reconciliation(records: DataFrame, condition: str = "condition_id", family: str = "family") -> DataFrame:
    """Category counts per condition and family, plus one ALL row per condition that they add up to."""
    rolled = records.withColumn("__status", record_status()).rollup(condition, family).agg(
        F.grouping_id().alias("__level"), *_category_aggregates()
    )
    return rolled.where(F.col("__level") < 2).select(
        condition,
        F.when(F.col("__level") == 1, F.lit("ALL")).otherwise(F.col(family)).alias(family),
        *[c for c in rolled.columns if c not in (condition, family, "__level")],
    )


def termination_counts(records: DataFrame, by: Sequence[str]) -> DataFrame:
    """Long form (by, label, n): natural statuses and termination causes that occur."""
    eos, capped = F.coalesce("terminated_by_eos", F.lit(False)), F.coalesce("capped", F.lit(False))
    labels = F.array_compact(F.array(
        F.concat(F.lit("status:"), record_status()),
        F.when(eos, "natural_eos").when(capped, "capped_length").otherwise("error_or_other"),
        F.when(F.col("eos_observed"), "eos_observed"),
        F.when(F.col("think_end_reached"), "think_end_reached"),
        F.when(F.col("missing_answer"), "missing_answer"),
    ))
    return records.select(*by, F.explode(labels).alias("label")).groupBy(*by, "label").agg(
        F.count(F.lit(1)).alias("n")
    )


def budget_metrics(records: DataFrame, by: Sequence[str]) -> DataFrame:
    """End-to-end success at budget next to accuracy among observed answers."""
    status, n = F.col("__status"), F.count(F.lit(1))
    done = F.coalesce(F.col("terminated_by_eos"), F.lit(False))
    seen = F.col("answer_normalized").isNotNull()
    right = F.coalesce(F.col("correct"), F.lit(False))
    counts = {
        "n_attempted": n,
        "n_completed": count_of(done),
        "n_answer_observed": count_of(seen),
        "n_censored": count_of(status == "censored"),
        "n_error": count_of(status == "error"),
        "n_unparseable": count_of(status == "unparseable"),
        "n_terminated_no_closure": count_of(status == "terminated_no_closure"),
        "__right": count_of(right),
        "__done_seen": count_of(done & seen),
        "__done_right": count_of(done & seen & right),
        "__seen_right": count_of(seen & right),
    }
    out = records.withColumn("__status", record_status()).groupBy(*by).agg(*[c.alias(k) for k, c in counts.items()])
    total = F.col("n_attempted")
    return out.select(
        *by,
        *[k for k in counts if not k.startswith("__")],
        ratio(F.col("__right"), total).alias("success_at_budget"),
        ratio(F.col("n_completed"), total).alias("completion_rate"),
        ratio(F.col("__done_right"), F.col("__done_seen")).alias("conditional_accuracy_given_completed"),
        ratio(F.col("__seen_right"), F.col("n_answer_observed")).alias("answer_observed_accuracy"),
        ratio(F.col("n_censored"), total).alias("censored_rate"),
        ratio(F.col("n_error"), total).alias("error_rate"),
        ratio(F.col("n_unparseable"), total).alias("unparseable_rate"),
        ratio(F.col("n_answer_observed"), total).alias("answer_observation_rate"),
    )


def outcome_by_checkpoint(probes: DataFrame, by: Sequence[str] = ("arm", "checkpoint_label")) -> DataFrame:
    """Outcome distribution and recoverable / scorable rates per checkpoint."""
    counts = probes.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_eligible"), *[count_of(F.col("outcome") == o).alias(f"n_{o}") for o in FORCED_OUTCOMES]
    )
    n = F.col("n_eligible")
    return counts.withColumn("recoverable_correct_rate", ratio(F.col("n_correct"), n)).withColumn(
        "scorable_answer_rate", ratio(F.col("n_correct") + F.col("n_scorable_incorrect"), n)
    )


def prefix_state_counts(trajectories: DataFrame, by: Sequence[str]) -> DataFrame:
    """Histogram of trajectory states with the two stable-answer counts."""
    return trajectories.groupBy(*by, "prefix_state").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("stable_sufficient_with_natural_final_tokens").alias("n_stable_sufficient"),
        F.count("observed_probe_stable_from_tokens").alias("n_observed_stable"),
    )


def histogram(df: DataFrame, groups: Sequence[str], value: str, bins: int = 20) -> DataFrame:
    """Equal-width bins over [min, max], the last one closed, empty bins included.

    A value belongs to the bin whose computed edges enclose it; the division
    that finds the bin can be off by one at an edge and is corrected there.  A constant column gets the range [value - 0.5, value + 0.5].
    """
    v = df.select(*groups, F.col(value).cast("double").alias("__v")).where(F.col("__v").isNotNull())
    bounds = v.groupBy(*groups).agg(F.min("__v").alias("__min"), F.max("__v").alias("__max"))
    flat = F.col("__min") == F.col("__max")
    bounds = bounds.select(
        *groups,
        F.when(flat, F.col("__min") - 0.5).otherwise(F.col("__min")).alias("__lo"),
        F.when(flat, F.col("__max") + 0.5).otherwise(F.col("__max")).alias("__hi"),
    )
    placed = _join(v, bounds, groups) if groups else v.join(bounds, F.lit(True))
    width = (F.col("__hi") - F.col("__lo")) / bins
    index = F.least(F.floor((F.col("__v") - F.col("__lo")) / width), F.lit(bins - 1)).cast("int")
    placed = placed.withColumn("bin", index)
    below = F.col("__v") < F.col("__lo") + width * F.col("bin")
    above = (F.col("__v") >= F.col("__lo") + width * (F.col("bin") + 1)) & (F.col("bin") < bins - 1)
    counts = placed.withColumn("bin", F.col("bin") - below.cast("int") + above.cast("int")).groupBy(*groups, "bin").agg(F.count(F.lit(1)).alias("__n"))
    edges = bounds.select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    out = join_null_safe(edges, counts, [*groups, "bin"], "left", filled=["bin"])
    return out.select(
        *groups,
        "bin",
        (F.col("__lo") + width * F.col("bin")).alias("bin_low"),
        F.when(F.col("bin") == bins - 1, F.col("__hi"))
        .otherwise(F.col("__lo") + width * (F.col("bin") + 1))
        .alias("bin_high"),
        F.coalesce("__n", F.lit(0)).alias("n"),
    )


def condition_summary(draws: DataFrame, executions: DataFrame, condition: str = "condition_id") -> DataFrame:
    """Per condition: draw-level behaviour next to execution-level timing.

    ``draws`` holds one collapsed row per draw (``ambiguous`` and, when it is
    not, the representative's columns); timing uses every execution.
    """
    draws = settle(draws, "draws")
    usable = draws.where(~F.col("ambiguous"))
    counts = draws.groupBy(condition).agg(
        F.sum("n_executions").alias("n_executions"),
        F.count(F.lit(1)).alias("n_unique_draws"),
        count_of(~F.col("ambiguous")).alias("n_primary_draws"),
        count_of(F.col("ambiguous")).alias("n_ambiguous_draws"),
    )
    tasks = usable.groupBy(condition, "task_id").agg(F.avg(F.col("correct").cast("double")).alias("__m"))
    tasks = tasks.groupBy(condition).agg(F.count(F.lit(1)).alias("n_tasks"), F.avg("__m").alias("success_macro_mean"))
    out = join_null_safe(counts, tasks, [condition], "left")
    out = join_null_safe(out, budget_metrics(usable, [condition]), [condition], "left")
    long = long_metrics(
        usable, [condition], ["reasoning_tokens", "answer_tokens", "total_tokens", "unique_token_ratio",
                              "repeated_ngram_fraction_4", "text_repeat_ratio"]
    ).unionByName(long_metrics(executions, [condition], ["wall_ms", "tokens_per_sec", "ttft_ms"]))
    stats = summarize(long, [condition, "metric"], "value")
    wide = stats.groupBy(condition).pivot(
        "metric", ["reasoning_tokens", "answer_tokens", "total_tokens", "unique_token_ratio",
                   "repeated_ngram_fraction_4", "text_repeat_ratio", "wall_ms", "tokens_per_sec", "ttft_ms"]
    ).agg(F.first("mean").alias("mean"), F.first("median").alias("median"), F.first("std").alias("std"),
          F.first("p90").alias("p90"))
    return join_null_safe(out, wide, [condition], "left")


def lane_overhead(samples: DataFrame, lane: str, baseline: str, metrics: dict[str, str]) -> DataFrame:
    """Per lane: medians, spread and overhead against the baseline lane.

    ``metrics`` maps ``wall_ms``, ``ttft_ms``, ``output_tps`` and ``decode_tps`` to columns.
    """
    from ..functions.quantiles import exact_quantiles

    renamed = samples.select(F.col(lane).alias("lane"), *[F.col(c).cast("double").alias(k) for k, c in metrics.items()])
    names = list(metrics)
    long = long_metrics(renamed, ["lane"], names)
    q = exact_quantiles(long, ["lane", "metric"], "value", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    wide = q.groupBy("lane").pivot("metric", names).agg(
        F.first("median").alias("median"), F.first(F.col("q3") - F.col("q1")).alias("iqr")
    )
    spread = renamed.groupBy("lane").agg(
        F.count(F.lit(1)).alias("n"), F.stddev_pop("output_tps").alias("output_tps_std"),
        F.count("decode_tps").alias("__nd"),
    )
    out = join_null_safe(wide, spread, ["lane"])
    base = out.where(F.col("lane") == baseline).select(
        F.lit(1).alias("__k"), F.col("decode_tps_median").alias("__bd"), F.col("wall_ms_median").alias("__bw")
    )
    out = out.withColumn("__k", F.lit(1)).join(base, "__k", "left")
    return out.select(
        "lane", "n", "wall_ms_median", "ttft_ms_median", "output_tps_median", "output_tps_std", "decode_tps_median",
        F.when(F.col("__nd") >= 2, F.col("decode_tps_iqr")).alias("decode_tps_iqr"),
        ratio(F.col("__bd") - F.col("decode_tps_median"), F.col("__bd")).alias("decode_overhead_fraction"),
        ratio(F.col("wall_ms_median") - F.col("__bw"), F.col("__bw")).alias("wall_overhead_fraction"),
    )


def budget_diagnostic(probes: DataFrame, by: Sequence[str], budget: str = "probe_max_tokens") -> DataFrame:
    """Outcome, scorable, observed and end-of-sequence counts per probe budget."""
    return probes.groupBy(*by, budget).agg(
        F.count(F.lit(1)).alias("n"),
        *[count_of(F.col("outcome") == o).alias(f"n_{o}") for o in FORCED_OUTCOMES],
        count_of(F.col("answer_scorable")).alias("n_scorable"),
        count_of(F.col("answer_observed")).alias("n_observed"),
        count_of(F.col("eos_observed")).alias("n_eos"),
    )


