"""Column expressions for termination status, probe outcomes, endpoint times and throughput."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import ratio
from .text import canonical_gold, extract_answer, normalize_answer

# Label sets.
NATURAL_STATUSES = ("correct", "incorrect", "censored", "terminated_no_closure", "unparseable", "error")
FORCED_OUTCOMES = ("correct", "scorable_incorrect", "unparseable", "censored", "error")
SCORABLE_OUTCOMES = ("correct", "scorable_incorrect")


def _true(flag: Column) -> Column:
    return F.coalesce(flag, F.lit(False))


def natural_status(correct: Column, scorable: Column, think_end_reached: Column, capped: Column,
                   finish_reason: Column, error_type: Column, raw_present: Column) -> Column:
    """Natural final status; the order of the cases is part of the definition."""
    failed = (F.coalesce(error_type, F.lit("")) != "") | _true(finish_reason == "error")
    budget_spent = _true(capped) | _true(finish_reason == "length")
    return (
        F.when(failed, "error")
        .when(_true(scorable) & _true(correct), "correct")
        .when(_true(scorable), "incorrect")
        .when(_true(raw_present), "unparseable")
        .when(budget_spent & _true(think_end_reached), "unparseable")
        .when(budget_spent, "censored")
        .when(_true(finish_reason == "stop") & ~_true(think_end_reached), "terminated_no_closure")
        .otherwise("unparseable")
    )


def record_status() -> Column:
    """``natural_status`` from the flat record columns."""
    return natural_status(
        F.col("correct"), F.col("answer_normalized").isNotNull(), F.col("think_end_reached"), F.col("capped"),
        F.col("finish_reason"), F.col("error_type"), ~F.coalesce(F.col("missing_answer"), F.lit(True)),
    )


def tri_state_correct(status: Column) -> Column:
    """True / false / null: only an observed answer can be wrong."""
    return F.when(status == "correct", True).when(status == "incorrect", False)


def exhausted_after_close(think_end_reached: Column, capped: Column) -> Column:
    return _true(think_end_reached) & _true(capped)


def answer_state(normalized: Column, raw: Column, correct: Column) -> Column:
    return (
        F.when(normalized.isNotNull() & _true(correct), "scorable_correct")
        .when(normalized.isNotNull(), "scorable_incorrect")
        .when(raw.isNotNull(), "unparseable")
        .otherwise("none")
    )


def forced_outcome(df: DataFrame, family: Column, gold: Column, text: Column, finish_reason: Column, capped: Column,
                   error: Column, eos_observed: Column) -> DataFrame:
    """Add a probe's outcome, what it would have been without its budget, and observation flags.

    Added in stages, so that answer extraction and normalisation run once per row.
    """
    failed = F.coalesce(error, F.lit("")) != ""
    spent = (_true(capped) | _true(finish_reason == "length")) & ~_true(eos_observed)
    df = df.withColumn("answer_raw", F.when(~failed & (F.coalesce(text, F.lit("")) != ""), extract_answer(text)))
    raw = F.col("answer_raw")
    df = df.withColumn("answer_normalized", F.when(raw.isNotNull(), normalize_answer(family, raw)))
    normalized = F.col("answer_normalized")
    df = df.withColumn("correct", F.when(normalized.isNotNull(), normalized == canonical_gold(family, gold)))
    scored = F.when(F.col("correct"), "correct").when(~F.col("correct"), "scorable_incorrect")
    without_budget = F.coalesce(scored, F.when(raw.isNotNull(), "unparseable").otherwise("censored"))
    return (
        df.withColumn("outcome", F.when(failed, "error").when(spent, "censored").otherwise(
            F.coalesce(scored, F.lit("unparseable"))))
        .withColumn("pre_censor_outcome", F.when(~failed & spent, without_budget))
        .withColumn("censored_with_extractable_answer", ~failed & spent & raw.isNotNull())
        .withColumn("answer_observed", raw.isNotNull())
        .withColumn("answer_scorable", normalized.isNotNull())
        .withColumn("correct", F.coalesce("correct", F.lit(False)))
    )


def closure_time(reasoning_tokens: Column, total_tokens: Column, think_end_reached: Column) -> Column:
    """Tokens through the think-end token, or the observation horizon when it never came."""
    return F.when(_true(think_end_reached), reasoning_tokens + 1).otherwise(total_tokens).cast("double")


def tokens_per_second(tokens: Column, wall_ms: Column) -> Column:
    return F.when(wall_ms > 0, ratio(tokens * 1000, wall_ms)).otherwise(F.lit(0.0))


def decode_tokens_per_second(tokens: Column, wall_ms: Column, ttft_ms: Column) -> Column:
    return F.when((wall_ms > ttft_ms) & (tokens > 1), ratio((tokens - 1) * 1000, wall_ms - ttft_ms))
