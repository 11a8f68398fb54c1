"""Paired recoverability per checkpoint: joint eligibility, transitions and guarded clustered deltas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import count_of, join_null_safe, ratio
from ..functions.status import FORCED_OUTCOMES, SCORABLE_OUTCOMES
from ..operators.pairing import jointly_eligible
from ..operators.transitions import indeterminate_transition, outcome_transition
from ..session import settle
from .comparison import paired_cluster_bootstrap

LABEL = ["checkpoint_label"]
KINDS = ("correct", "scorable_incorrect")


def agreed_checkpoints(declared: DataFrame, arm: str = "arm", arms: tuple[str, str] = ("A", "B")) -> DataFrame:
    """The declared checkpoint labels (``arm, checkpoint_label``); refused when the arms declare different ones."""
    sides = declared.where(F.col(arm).isin(*arms)).groupBy(*LABEL).agg(F.collect_set(arm).alias("__by"))
    odd = sides.where(F.size("__by") < 2).select("checkpoint_label", F.get("__by", 0).alias("arm")).orderBy("checkpoint_label").head(5)
    if odd:
        raise ValueError("checkpoints declared by one arm only: " + ", ".join(f"{r[0]} ({r[1]})" for r in odd))
    return sides.select(*LABEL)


def paired_recoverability(selected: DataFrame, n_resamples: int = 2000, seed: int = 0, declared: DataFrame | None = None) -> DataFrame:
    """One row per checkpoint; deltas are second arm - first.

    With ``declared`` (the checkpoints of each arm) every declared checkpoint has its row, also one that no draw of both
    arms reached: counts of zero, no rates, no interval.  ``a_eligible`` and ``b_eligible`` count draws of an arm alone, all
    other counts are over draws of both.
    """
    probes = settle(jointly_eligible(selected, only_joint=False), "probe-pairs")
    a, b = F.col("outcome_a"), F.col("outcome_b")
    both = a.isNotNull() & b.isNotNull()
    labels = probes.withColumn("__i", indeterminate_transition(a, b))
    for kind in KINDS:
        labels = labels.withColumn(f"__{kind}", outcome_transition(a, b, kind))
    n = F.count(F.when(both, 1))

    def joint(condition: Column) -> Column:
        return count_of(both & condition)

    table = labels.groupBy(*LABEL).agg(
        n.alias("n_jointly_eligible"), F.count_distinct(F.when(both, F.col("task_id"))).alias("n_tasks"),
        F.count(a).alias("a_eligible"), F.count(b).alias("b_eligible"),
        *[joint(side == o).alias(f"{t}_{o}") for t, side in (("a", a), ("b", b)) for o in FORCED_OUTCOMES],
        *[ratio(joint(side == "correct"), n).alias(f"{t}_recoverable_rate") for t, side in (("a", a), ("b", b))],
        *[ratio(joint(side.isin(*SCORABLE_OUTCOMES)), n).alias(f"{t}_scorable_rate") for t, side in (("a", a), ("b", b))],
        *[count_of(F.col(f"__{kind}") == k).alias(f"{kind}_{k}") for kind in KINDS for k in ("both", "only_a", "only_b", "neither")],
        *[count_of(F.col("__i") == k).alias(k) for k in ("both_indeterminate", "only_a_indeterminate", "only_b_indeterminate", "both_observed")],
    )
    counts = [c for c in table.columns if c not in LABEL and not c.endswith("_rate")]
    values = [F.struct(F.lit(kind).alias("kind"), F.lit(t).alias("arm"), (side == kind).cast("double").alias("value"))
              for t, side in (("a", a), ("b", b)) for kind in KINDS]
    long = probes.where(both).select("checkpoint_label", "task_id", F.inline(F.array(*values)))
    deltas = paired_cluster_bootstrap(long, ["checkpoint_label", "kind"], "task_id", "value", "arm", ("b", "a"),
                                      n_resamples=n_resamples, seed=seed, guard=True)
    wide = deltas.groupBy(*LABEL).pivot("kind", list(KINDS)).agg(
        *[F.first(c).alias(f"delta_{c}") for c in ("mean", "lo", "hi", "degenerate")])
    if declared is not None:
        table = join_null_safe(agreed_checkpoints(declared), table, LABEL, "left", filled=LABEL)
    out = join_null_safe(table, wide, LABEL, "left", filled=LABEL).fillna(0, counts)
    return out.fillna({f"{kind}_delta_degenerate": True for kind in KINDS})
