"""Repetition and loop metrics of token sequences, one output row per trace.

Metrics that need only counts or neighbours stay row-local: they are array
expressions evaluated where the trace is read, so no token crosses the network.
The sliding-window metrics are computed on whole sequences (``functions.windows``)
after one exchange of the compact arrays by trace id.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import arrays as A
from ..functions.frames import count_of, join_null_safe, split_large
from ..functions.text import non_blank_lines
from ..functions.windows import windowed
from .aggregates import summarize_metrics


def _indices(size: Column) -> Column:
    """0 .. size-1, empty for size 0."""
    return F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))


def _run_starts(items: Column) -> Column:
    """0-based positions at which a run of equal neighbours begins."""
    return F.filter(
        _indices(F.size(items)),
        lambda i: (i == 0) | ~F.get(items, i).eqNullSafe(F.get(items, i - 1)),
    )


def with_runs(df: DataFrame, items: str, out: str) -> DataFrame:
    """Add ``out``: array of struct(len, start, item) for each run of equal neighbours."""
    df = df.withColumn("__starts", _run_starts(F.col(items)))
    runs = F.transform(
        F.col("__starts"),
        lambda start, j: F.struct(
            (F.coalesce(F.get(F.col("__starts"), j + 1), F.size(items)) - start).alias("len"),
            start.alias("start"),
            F.get(F.col(items), start).alias("item"),
        ),
    )
    return df.withColumn(out, runs).drop("__starts")


def with_counts(df: DataFrame, items: Column, out: str) -> DataFrame:
    """Add ``out``: array of struct(len, start, item), one entry per distinct item with its count as ``len``."""
    # sort_array compares in generated code, array_sort by an interpreted function; only that equal items are neighbours counts
    return with_runs(df.withColumn("__sorted", F.sort_array(items)), "__sorted", out).drop("__sorted")


def repetition_basic(df: DataFrame, trace: str, tokens: str = "tokens") -> DataFrame:
    counted = with_counts(df.select(trace, tokens), F.col(tokens), "__counts")
    n, unique = F.size(tokens), F.size("__counts")
    return counted.select(
        trace,
        n.alias("n_tokens"),
        unique.alias("unique_tokens"),
        F.when(n > 0, unique / n).otherwise(F.lit(1.0)).alias("unique_token_ratio"),
        F.coalesce(F.array_max(F.transform("__counts", lambda c: c["len"])), F.lit(0)).alias("most_common_token_count"),
    )


def distinct_n(df: DataFrame, trace: str, tokens: str = "tokens", sizes: Sequence[int] = (1, 2, 4)) -> DataFrame:
    """Distinct n-grams over n-grams; 1.0 for a sequence shorter than n."""
    out = df.select(trace, tokens, *[A.grams(F.col(tokens), n).alias(f"__g{n}") for n in sizes])
    return out.select(
        trace,
        *[
            F.when(F.size(f"__g{n}") > 0, F.size(F.array_distinct(f"__g{n}")) / F.size(f"__g{n}"))
            .otherwise(F.lit(1.0))
            .alias(f"distinct_{n}")
            for n in sizes
        ],
    )


def repeated_ngram_fraction(df: DataFrame, trace: str, tokens: str = "tokens", sizes: Sequence[int] = (4, 8)) -> DataFrame:
    """Share of n-gram occurrences whose gram occurs more than once; 0.0 when there is none."""
    out = df.select(trace, tokens)
    for n in sizes:
        out = with_counts(out, A.grams(F.col(tokens), n), f"__c{n}")
    cols = []
    for n in sizes:
        total = F.size(tokens) - (n - 1)
        repeated = F.aggregate(
            f"__c{n}", F.lit(0), lambda acc, c: acc + F.when(c["len"] > 1, c["len"]).otherwise(F.lit(0))
        )
        cols.append(F.when(total > 0, repeated / total).otherwise(F.lit(0.0)).alias(f"repeated_ngram_fraction_{n}"))
    return out.select(trace, *cols)


def longest_run_span(df: DataFrame, trace: str, tokens: str = "tokens") -> DataFrame:
    """Longest run of equal tokens; the earliest one wins ties. Start and end are 0-based, inclusive."""
    runs = with_runs(df.select(trace, tokens), tokens, "__runs")
    keyed = F.transform("__runs", lambda r: F.struct(r["len"], (-r["start"]).alias("back"), r["item"]))
    runs = runs.withColumn("__best", F.array_max(keyed))
    best = F.col("__best")
    return runs.select(
        trace,
        F.coalesce(best["len"], F.lit(0)).alias("run_length"),
        best["item"].alias("run_token"),
        (-best["back"]).alias("run_start"),
        (-best["back"] + best["len"] - 1).alias("run_end"),
    )


def max_run(df: DataFrame, trace: str, tokens: str = "tokens") -> DataFrame:
    return longest_run_span(df, trace, tokens).select(trace, F.col("run_length").alias("max_token_run"))


def top_motif(df: DataFrame, trace: str, tokens: str = "tokens", n: int = 4) -> DataFrame:
    """Most frequent n-gram with its count and span; the largest gram wins ties.

    Grams compare element by element, as the token arrays themselves do.  They
    are sorted, so equal ones are neighbours: one walk counts each and keeps the
    last of the most frequent, which is the largest.
    """
    ids = F.col(tokens)
    starts = F.sequence(F.lit(1), F.size(ids) - (n - 1))
    ordered = F.array_sort(F.transform(starts, lambda i: F.slice(ids, i, F.lit(n))))
    none = F.slice(ids, 1, 0)

    def state(gram: Column, run: Column, motif: Column, top: Column) -> Column:
        return F.struct(gram.alias("gram"), run.alias("run"), motif.alias("motif"), top.alias("top"))

    def walk(seen: Column, gram: Column) -> Column:
        run = F.when(gram == seen["gram"], seen["run"] + 1).otherwise(1)
        return state(gram, run, F.when(run >= seen["top"], gram).otherwise(seen["motif"]), F.greatest(run, seen["top"]))

    found = df.select(trace, F.when(F.size(ids) >= n, F.aggregate(ordered, state(none, F.lit(0), none, F.lit(0)), walk)).alias("__found"))
    top = F.coalesce("__found.top", F.lit(0))
    return found.select(
        trace,
        F.coalesce(F.array_join(F.col("__found.motif").cast("array<string>"), " "), F.lit("")).alias("motif"),
        top.alias("motif_count"), (top * n).alias("motif_span_tokens"),
    )


def line_repeat_ratio(df: DataFrame, trace: str, text: str = "text") -> DataFrame:
    lines = df.select(trace, non_blank_lines(F.col(text)).alias("__lines"))
    n = F.size("__lines")
    return lines.select(
        trace,
        F.when(n > 0, 1.0 - F.size(F.array_distinct("__lines")) / n).otherwise(F.lit(0.0)).alias("text_repeat_ratio"),
    )


def special_run_flag(df: DataFrame, trace: str, special: DataFrame, token: str, tokens: str = "tokens") -> DataFrame:
    """Is the token of the longest run listed in ``special``? (sizes decide how the join is done)"""
    runs = longest_run_span(df, trace, tokens)
    marked = special.select(F.col(token).alias("run_token")).distinct().withColumn("__special", F.lit(True))
    return runs.join(marked, "run_token", "left").select(
        trace, "run_length", F.coalesce(F.col("__special"), F.lit(False)).alias("longest_run_is_special")
    )


def rolling_unique_min(df: DataFrame, trace: str, tokens: str = "tokens", window: int = 64) -> DataFrame:
    """Minimum over window positions of distinct tokens / window; linear but for a sort of each sequence, with no row per token.

    A token at p is the first of its kind in the window starting at s exactly
    for s in [max(previous + 1, p - window + 1), p].
    """
    base = df.select(trace, tokens).repartition(trace)
    n = F.size(tokens)
    short = base.where(n < window).select(
        trace, F.when(n > 0, F.size(F.array_distinct(tokens)) / n).alias("rolling_unique_ratio_min")
    )

    def first_of_kind(p: np.ndarray, before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.maximum(before + 1, p - (window - 1)), p

    def least(level: np.ndarray, begin: np.ndarray, starts: np.ndarray) -> pa.Array:
        return pa.array(np.minimum.reduceat(level, begin) / window)

    long = windowed(base, trace, tokens, T.StructField("rolling_unique_ratio_min", T.DoubleType()), window, 1, first_of_kind, least)
    return short.unionByName(long)


def degeneration_onset(df: DataFrame, trace: str, tokens: str = "tokens", window: int = 64,
                       threshold: float = 0.5) -> DataFrame:
    """Earliest window start from which the repeated-4-gram share stays at or above ``threshold``.

    A gram at g is a singleton of the window starting at s exactly for s in
    [max(previous + 1, g - m), min(g, next - m - 1)] with m = window - 4.
    Null when the sequence is shorter than the window or the last window is below.
    """
    base = df.select(trace, tokens).repartition(trace)
    m = window - 4
    short = base.where(F.size(tokens) < window).select(trace, F.lit(None).cast("int").alias("degeneration_onset_index"))

    def singleton(g: np.ndarray, before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.maximum(before + 1, g - m), np.where(after < 0, g, np.minimum(g, after - (m + 1)))

    def onset(level: np.ndarray, begin: np.ndarray, starts: np.ndarray) -> pa.Array:
        at = np.arange(len(level)) - np.repeat(begin, starts)
        found = np.maximum.reduceat(np.where(1.0 - level / (window - 3) < threshold, at, -1), begin) + 1
        return pa.array(found, pa.int32(), mask=found >= starts)

    long = windowed(base, trace, tokens, T.StructField("degeneration_onset_index", T.IntegerType()), window, 4, singleton, onset)
    return short.unionByName(long)


def prefix_invariance(df: DataFrame, by: Sequence[str], cap: str, tokens: str = "tokens") -> DataFrame:
    """Is each shorter sequence an exact prefix of the next longer cap's? One sequence per group and cap."""
    along = Window.partitionBy(*by).orderBy(cap)
    pairs = df.select(*by, cap, tokens).withColumn("__short", F.lag(tokens).over(along))
    checked = pairs.select(
        *by, F.when(F.col("__short").isNotNull(), A.is_prefix(F.col("__short"), F.col(tokens))).alias("__ok")
    )
    out = checked.groupBy(*by).agg(F.count("__ok").alias("n_comparisons"), F.bool_and("__ok").alias("exact_prefix"))
    status = F.when(F.col("exact_prefix"), "ok").when(~F.col("exact_prefix"), "divergent")
    return out.withColumn("status", status.otherwise("insufficient_data"))


def execution_divergence(df: DataFrame, draw: Sequence[str], order: Sequence[str], tokens: str = "tokens",
                         keep: Sequence[str] = ()) -> DataFrame:
    """First divergence of every execution from the first execution of its draw.

    Executions are exchanged and sorted once, by draw; only draws too large for one task have their first execution joined.
    """
    split = A.first_divergence(F.col("__base"), F.col(tokens)).alias("first_divergence")
    df, large = split_large(df, draw, "large-draws")
    along = Window.partitionBy(*draw).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = df.withColumn("__base", F.first(tokens).over(along)).select(*draw, *keep, split)
    if large is None:
        return out
    first = large.groupBy(*draw).agg(F.min_by(tokens, F.struct(*order)).alias("__base"))
    return out.unionByName(join_null_safe(large.select(*draw, *keep, tokens), first, draw).select(*draw, *keep, split))


def loop_summary(records: DataFrame, by: Sequence[str], run_length: str = "longest_run_length",
                 onset: str = "degeneration_onset_index", motif_count: str = "top_motif_count",
                 special: str = "longest_run_is_special") -> DataFrame:
    """Per group and loop metric a distribution summary, with the counts of special runs and onsets."""
    stats = summarize_metrics(records, by, [run_length, onset, motif_count])
    counts = records.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_records"),
        F.count(onset).alias("n_with_degeneration_onset"),
        count_of(F.col(special)).alias("special_longest_run_count"),
    )
    return join_null_safe(stats, counts, by)
