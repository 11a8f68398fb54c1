"""Trajectories over ordered checkpoints and paired transitions between two arms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import count_of, join_null_safe
from ..functions.quantiles import order_statistics
from ..functions.status import FORCED_OUTCOMES, SCORABLE_OUTCOMES, record_status, tri_state_correct
from ..session import settle


def state_of(n: Column, flips: Column, hits: Column, last: Column) -> Column:
    """Prefix state from the number of observations, flips, correct ones and the last one's correctness."""
    return (
        F.when(n == 0, "never_correct")
        .when(flips >= 2, "multiple_flips")
        .when(hits == n, "stable_correct")
        .when(hits == 0, "never_correct")
        .when(last, "wrong_to_correct")
        .otherwise("correct_to_wrong")
    )


def observed_runs(df: DataFrame, draw: Sequence[str], order: Sequence[str], correct: Column,
                  label: Column) -> DataFrame:
    """One row per draw with flips, state and the first / stable positions of observed correctness.

    Rows are the observed checkpoints only.  ``label`` is what a position is
    reported as (a prefix length or a checkpoint name).
    """
    along = Window.partitionBy(*draw).orderBy(*order)
    rows = df.select(*draw, *order, correct.alias("__c"), label.alias("__label"))
    rows = rows.withColumn("__i", F.row_number().over(along) - 1)
    rows = rows.withColumn("__flip", F.coalesce(F.col("__c") != F.lag("__c").over(along), F.lit(False)))
    rows = rows.withColumn("__after", F.lead("__label").over(along))
    i, c = F.col("__i"), F.col("__c")
    grouped = rows.groupBy(*draw).agg(
        F.count(F.lit(1)).alias("__n"),
        count_of(F.col("__flip")).alias("__flips"),
        count_of(c).alias("__hits"),
        F.max_by(c, i).alias("__last"),
        F.min(F.when(c, i)).alias("first_correct_index"),
        F.min_by(F.when(c, F.col("__label")), F.when(c, i)).alias("first_correct_label"),
        F.max(F.when(~c, i)).alias("__last_wrong"),
        F.max_by(F.when(~c, F.col("__after")), F.when(~c, i)).alias("__after_wrong"),
        F.min_by("__label", i).alias("__first_label"),
    )
    stable = F.when(F.col("__last_wrong").isNull(), F.col("__first_label")).otherwise(F.col("__after_wrong"))
    return grouped.select(
        *draw,
        F.col("__n").alias("n_observed"),
        F.col("__flips").alias("flips"),
        F.col("__hits").alias("n_correct"),
        state_of(F.col("__n"), F.col("__flips"), F.col("__hits"), F.col("__last")).alias("state"),
        "first_correct_index",
        "first_correct_label",
        stable.alias("stable_from_label"),
    )


def prefix_flips(probes: DataFrame, draw: Sequence[str], order: Sequence[str], correct: str = "correct") -> DataFrame:
    out = observed_runs(probes, draw, order, F.col(correct), F.lit(0))
    return out.select(*draw, F.col("flips").alias("prefix_flips"))


def prefix_state(probes: DataFrame, draw: Sequence[str], order: Sequence[str], correct: str = "correct") -> DataFrame:
    out = observed_runs(probes, draw, order, F.col(correct), F.lit(0))
    return out.select(*draw, F.col("state").alias("prefix_state"))


def trajectory(probes: DataFrame, draw: Sequence[str], order: Sequence[str], length: str,
               natural: DataFrame, correct: str = "correct") -> DataFrame:
    """Observed probes of a draw next to its natural final status (``natural``: draw key, natural_final_status).

    A draw without a natural record counts as censored; an unknown final answer
    supports neither sufficiency nor harm.
    """
    runs = observed_runs(probes, draw, order, F.col(correct), F.col(length))
    out = join_null_safe(runs, natural.select(*draw, "natural_final_status"), draw, "left")
    out = out.withColumn("natural_final_status", F.coalesce("natural_final_status", F.lit("censored")))
    final = tri_state_correct(F.col("natural_final_status"))
    return out.select(
        *draw,
        F.col("state").alias("prefix_state"),
        F.col("flips").alias("prefix_flips"),
        "natural_final_status",
        final.alias("natural_final_correct"),
        F.col("first_correct_index").alias("first_correct_probe_index"),
        F.col("first_correct_label").alias("first_correct_prefix_tokens"),
        F.col("stable_from_label").alias("observed_probe_stable_from_tokens"),
        F.when(final, F.col("stable_from_label")).alias("stable_sufficient_with_natural_final_tokens"),
        (F.coalesce(~final, F.lit(False)) & (F.col("n_correct") > 0)).alias("harmful_overthinking_observed"),
    )


def last_probes(probes: DataFrame, draw: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """One probe per draw and checkpoint label: of several the last by ``position``, any of them without such a column."""
    last = F.col("position") if "position" in probes.columns else F.lit(0)
    return probes.groupBy(*draw, "checkpoint_label").agg(*[F.max_by(c, last).alias(c) for c in keep])


def forced_trajectory(selected: DataFrame, draw: Sequence[str], declared: Sequence[str]) -> DataFrame:
    """State from explicit probe outcomes at the declared checkpoint labels.

    Only scorable outcomes carry a verdict; the other outcomes are counted as
    indeterminate and absent checkpoints as missing.  Labels that are not
    declared do not count; of several probes at one checkpoint the last by
    ``position`` counts (any one of them without such a column).
    """
    selected = selected.where(F.col("checkpoint_label").isin(list(declared)))
    selected = last_probes(selected, draw, ("outcome", "checkpoint_index"))
    scorable = selected.where(F.col("outcome").isin(*SCORABLE_OUTCOMES))
    order = ["checkpoint_index"]
    runs = observed_runs(scorable, draw, order, F.col("outcome") == "correct", F.col("checkpoint_label"))
    counts = selected.groupBy(*draw).agg(
        F.count(F.lit(1)).alias("__seen"), *[count_of(F.col("outcome") == o).alias(f"n_{o}") for o in FORCED_OUTCOMES]
    )
    out = join_null_safe(counts, runs.drop("n_correct"), draw, "left")
    total = F.lit(len(set(declared)))
    observed = F.coalesce("n_observed", F.lit(0))
    return out.select(
        *draw,
        *[f"n_{o}" for o in FORCED_OUTCOMES],
        observed.alias("n_observed_scorable"),
        (F.col("__seen") - observed).alias("n_indeterminate"),
        (total - F.col("__seen")).alias("n_missing"),
        F.coalesce("state", F.lit("never_correct")).alias("state"),
        F.coalesce("flips", F.lit(0)).alias("flips"),
        F.col("first_correct_label").alias("first_correct_checkpoint"),
        F.when(F.col("first_correct_label").isNotNull() & (F.col("flips") == F.when(
            F.col("first_correct_index") > 0, 1).otherwise(0)), F.col("first_correct_label")).alias("stable_from_checkpoint"),
        F.when(F.col("first_correct_label").isNotNull(), F.col("flips") == F.when(
            F.col("first_correct_index") > 0, 1).otherwise(0)).alias("stable_through_end"),
    )


def _arm_outcomes(selected: DataFrame, draw: Sequence[str]) -> DataFrame:
    """Per draw (arm included in the key): first correct, last wrong and how much was observed."""
    i = F.col("checkpoint_index")
    right, wrong = F.col("outcome") == "correct", F.col("outcome") == "scorable_incorrect"
    selected = last_probes(selected, draw, ("checkpoint_index", "outcome", "native_closed", "family"))
    return selected.groupBy(*draw).agg(
        F.min_by(F.when(right, F.col("checkpoint_label")), F.when(right, i)).alias("first_correct"),
        F.min(F.when(right, i)).alias("first_at"),
        F.max(F.when(wrong, i)).alias("wrong_at"),
        count_of(F.col("outcome").isin(*SCORABLE_OUTCOMES)).alias("n_scorable"),
        F.count(F.lit(1)).alias("n_probes"),
        F.bool_or("native_closed").alias("closed"),
        F.min("family").alias("family"),
    )


def _reverted() -> Column:
    """A wrong answer observed after the first correct one; indeterminate outcomes do not count."""
    return F.coalesce(F.col("wrong_at") > F.col("first_at"), F.lit(False))


def first_recoverable(selected: DataFrame, draw: Sequence[str] = ("task_id", "seed"), arm: str = "arm") -> DataFrame:
    """Per arm: how many draws first answered correctly at each checkpoint."""
    per = _arm_outcomes(selected, [arm, *draw]).where(F.col("first_correct").isNotNull())
    return per.groupBy(arm, F.col("first_correct").alias("checkpoint_label")).agg(F.count(F.lit(1)).alias("n_draws"))


def probe_stability(selected: DataFrame, draw: Sequence[str] = ("task_id", "seed"), arm: str = "arm") -> DataFrame:
    """Per arm: draws never correct, reverted after the first correct answer, or stable from it."""
    per = _arm_outcomes(selected, [arm, *draw])
    kind = F.when(F.col("first_at").isNull(), "no_correct").when(_reverted(), "reverted").otherwise(
        "stable_from_first_correct")
    return per.groupBy(arm, kind.alias("stability")).agg(F.count(F.lit(1)).alias("n_draws"))


def draw_pattern(selected: DataFrame, draw: Sequence[str] = ("task_id", "seed"), arm: str = "arm",
                 arms: tuple[str, str] = ("A", "B")) -> DataFrame:
    """Draws probed in both arms: who recovers, whether answers fluctuate, whether too little was observed."""
    per = _arm_outcomes(selected.where(F.col(arm).isin(*arms)), [arm, *draw]).withColumn("fluctuates", _reverted())
    picks = []
    for tag, value in zip("ab", arms):
        here = F.col(arm) == value
        picks += [F.max(F.when(here, F.col(c))).alias(f"{c}_{tag}") for c in ("first_correct", "fluctuates", "closed")]
        picks.append(F.max(here).alias(f"__has_{tag}"))
    both = per.groupBy(*draw).agg(
        *picks, F.sum("n_scorable").alias("__obs"), F.sum("n_probes").alias("__all"), F.min("family").alias("family")
    ).where("__has_a AND __has_b")
    a, b = F.col("first_correct_a").isNotNull(), F.col("first_correct_b").isNotNull()
    pattern = (
        F.when(a & b, "both_recover").when(a, "only_a_recovers").when(b, "only_b_recovers").otherwise("neither_recovers")
    )
    ca, cb = F.coalesce("closed_a", F.lit(False)), F.coalesce("closed_b", F.lit(False))
    group = (
        F.when(ca & cb, "both_naturally_closed").when(~ca & ~cb, "both_naturally_censored")
        .when(ca, "only_a_closed").otherwise("only_b_closed")
    )
    return both.select(
        *draw, "family", group.alias("closure_group"), pattern.alias("pattern"),
        (F.col("fluctuates_a") | F.col("fluctuates_b")).alias("fluctuates"),
        ((F.col("__all") > 0) & (F.col("__obs") / F.col("__all") < 0.5)).alias("indeterminate_dominant"),
        "first_correct_a", "first_correct_b",
    )


def censored_strata(patterns: DataFrame) -> DataFrame:
    """Recovery patterns by which arms closed naturally."""
    return patterns.groupBy("closure_group", "pattern").agg(
        F.count(F.lit(1)).alias("n_pairs"),
        count_of(F.col("fluctuates")).alias("n_fluctuating"),
        count_of(F.col("indeterminate_dominant")).alias("n_indeterminate_dominant"),
    )


def recoverability_by_family(joint: DataFrame) -> DataFrame:
    return joint.groupBy("family", "checkpoint_label").agg(
        F.count(F.lit(1)).alias("n_jointly_eligible"),
        count_of(F.col("outcome_a") == "correct").alias("a_recoverable_correct"),
        count_of(F.col("outcome_b") == "correct").alias("b_recoverable_correct"),
    )


def representative_examples(patterns: DataFrame, draw: Sequence[str] = ("task_id", "seed"), limit: int = 6) -> DataFrame:
    """First draw in key order of each example class; ``limit`` is the number of classes shown."""
    kinds = F.array_compact(F.array(
        F.when(F.col("pattern") == "both_recover", "positive_both_recover")
        .when(F.col("pattern") == "neither_recovers", "negative_neither_recovers").otherwise("one_sided"),
        F.when(F.col("fluctuates"), "unstable"),
    ))
    keep = [c for c in patterns.columns if c not in draw]
    rows = patterns.select(*draw, *keep, F.explode(kinds).alias("example_class"))
    first = rows.groupBy("example_class").agg(F.min(F.struct(*draw, *keep)).alias("__e"))
    return first.select("example_class", *[F.col(f"__e.{c}").alias(c) for c in (*draw, *keep)]).orderBy(*draw).limit(limit)


def outcome_transition(a: Column, b: Column, value: str) -> Column:
    """both / only_a / only_b / neither; a missing side is not jointly eligible."""
    return (
        F.when(a.isNull() | b.isNull(), "not_jointly_eligible")
        .when((a == value) & (b == value), "both").when(a == value, "only_a").when(b == value, "only_b")
        .otherwise("neither")
    )


def indeterminate_transition(a: Column, b: Column) -> Column:
    ia, ib = ~a.isin(*SCORABLE_OUTCOMES), ~b.isin(*SCORABLE_OUTCOMES)
    return (
        F.when(a.isNull() | b.isNull(), "not_jointly_eligible")
        .when(ia & ib, "both_indeterminate").when(ia, "only_a_indeterminate").when(ib, "only_b_indeterminate")
        .otherwise("both_observed")
    )


def flag_transition(a: Column, b: Column) -> Column:
    """both / only_a / only_b / neither of two flags; an unknown side makes the pair ambiguous."""
    return (
        F.when(a.isNull() | b.isNull(), "ambiguous")
        .when(a & b, "both").when(a, "only_a").when(b, "only_b").otherwise("neither")
    )


def arm_flag(side: Column, name: str) -> Column:
    """A flag of an arm's draw: unset counts as false, and only an absent or ambiguous draw is unknown."""
    return F.when(side.isNotNull(), F.coalesce(side[name], F.lit(False)))


# Columns a paired arm struct must carry for the functions below.
PAIR_COLUMNS = ("family", "difficulty", "think_end_reached", "correct", "scorable", "status", "reasoning_tokens",
                "repeated_ngram_fraction_4")


def with_pair_columns(records: DataFrame) -> DataFrame:
    return records.withColumn("status", record_status()).withColumn("scorable", F.col("answer_normalized").isNotNull())


def paired_outcomes(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Long contingency table (``by``, dimension, level, kind, label, n) over every matched draw.

    A draw that is ambiguous in an arm is labelled, not dropped.  ``neither`` in
    success_at_budget does not mean both answered incorrectly.
    """
    a, b = F.col("a"), F.col("b")
    label = {
        "closure": flag_transition(arm_flag(a, "think_end_reached"), arm_flag(b, "think_end_reached")),
        "success_at_budget": flag_transition(arm_flag(a, "correct"), arm_flag(b, "correct")),
        "scorable": flag_transition(arm_flag(a, "scorable"), arm_flag(b, "scorable")),
        "natural_status": F.concat(F.coalesce(a["status"], F.lit("unavailable")), F.lit(" -> "),
                                   F.coalesce(b["status"], F.lit("unavailable"))),
    }
    family = F.coalesce(F.when(a.isNotNull(), a["family"]).otherwise(b["family"]), F.lit("?"))
    level = F.coalesce(F.when(a.isNotNull(), a["difficulty"]).otherwise(b["difficulty"]), F.lit("?"))
    rows = [("all", F.lit("ALL"), k) for k in label]
    rows += [("family", family, "closure"), ("family", family, "success_at_budget"), ("difficulty", level, "closure")]
    structs = [F.struct(F.lit(d).alias("dimension"), lv.alias("level"), F.lit(k).alias("kind"), label[k].alias("label"))
               for d, lv, k in rows]
    long = pairs.select(*by, F.inline(F.array(*structs)))
    return long.groupBy(*by, "dimension", "level", "kind", "label").agg(F.count(F.lit(1)).alias("n"))


def repetition_strata(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean paired difference (second arm - first) of the repeated-4-gram share, overall and in strata.

    Length buckets use the index picks n//4 and 3n//4 of the sorted pair lengths.
    """
    a, b = F.col("a"), F.col("b")
    keys = [*by] or ["__k"]
    usable = settle(pairs.where(a.isNotNull() & b.isNotNull()).withColumn("__k", F.lit(1)).select(
        *keys,
        (b["repeated_ngram_fraction_4"] - a["repeated_ngram_fraction_4"]).alias("delta"),
        F.coalesce(a["family"], F.lit("?")).alias("family"),
        F.when(a["think_end_reached"] & b["think_end_reached"], "both_closed").otherwise("other").alias("closure"),
        ((a["reasoning_tokens"] + b["reasoning_tokens"]) / 2).alias("length"),
    ), "usable-pairs")
    bounds = order_statistics(usable, keys, "length", {
        "q1": lambda n: F.floor(n / 4), "q3": lambda n: F.floor(n * 3 / 4)}).select(*keys, "q1", "q3")
    rows = join_null_safe(usable, bounds, keys)
    bucket = F.when(F.col("length") <= F.col("q1"), "short").when(F.col("length") >= F.col("q3"), "long").otherwise("mid")
    strata = [("overall", F.lit("ALL")), ("family", F.col("family")), ("closure_state", F.col("closure")),
              ("length_bucket", bucket)]
    long = rows.select(*keys, "delta", "q1", "q3", F.inline(F.array(*[
        F.struct(F.lit(k).alias("stratum_kind"), v.alias("stratum")) for k, v in strata])))
    return long.groupBy(*keys, "stratum_kind", "stratum").agg(
        F.count(F.lit(1)).alias("n_paired_draws"), F.avg("delta").alias("mean_delta"),
        F.max("q1").alias("q1"), F.max("q3").alias("q3"),
    ).drop("__k")
