"""Comparison of runs pair by pair: verdict, metric panel, endpoint differences and trajectories of all pairs in one job."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import join_null_safe
from ..operators.pairing import pair_records, paired_draws, usable_pairs
from ..operators.population import PROJECTION, arm_set_counts, population_audit
from ..operators.provenance import comparability_gate, field_states, fields_in_state, publication_gate
from ..session import settle
from .comparison import metric_panel
from .survival import endpoint_observations, rmst_delta_bootstrap

PAIR = ["pair_id"]
ENDPOINT_COLUMNS = ("think_end_reached", "terminated_by_eos", "reasoning_tokens", "total_tokens")
#: Audit figures a verdict carries.
FIGURES = tuple(f"{k}_trials_{s}" for k in ("expected", "missing", "unexpected") for s in "ab") + ("matched_pairs",)


@dataclass(frozen=True)
class Comparison:
    """Lazy tables of a comparison, each by ``pair_id``: ``verdicts`` of all pairs, the rest of those not refused."""

    verdicts: DataFrame
    metrics: DataFrame
    endpoints: DataFrame
    trajectories: DataFrame | None


def in_pairs(rows: DataFrame, pairs: DataFrame, run: str = "run_id") -> DataFrame:
    """Rows that a run declares, of every pair it is in: with ``pair_id`` and ``arm``, of the pair's mode where they have one."""
    if "mode" in rows.columns:
        return pair_records(rows, pairs, run)
    return pair_records(rows.withColumn("mode", F.lit(None).cast("string")), pairs.withColumn("mode", F.lit(None).cast("string")), run).drop("mode")


def pair_verdicts(records: DataFrame, pairs: DataFrame, runs: DataFrame, fields: Mapping[str, str], expected: DataFrame, declared: DataFrame,
                  gate: Mapping[str, bool] | None = None, **publication: bool) -> DataFrame:
    """Whether each pair may be compared: contrast and reasons of the gate, completeness of both populations, intact evidence.

    ``records`` are those of ``pair_records``.  ``runs`` has one row per run: ``run_id``, ``verified`` and the columns that ``fields``
    maps ``section.field`` names to.  ``expected`` and ``declared`` are the trials and presentations of each run.  ``gate`` holds
    the intent flags of ``comparability_gate``, ``publication`` those of ``publication_gate``.
    """
    state = F.struct("verified", *fields.values())
    sides = pairs
    for t in "ab":
        sides = sides.join(runs.select(F.col("run_id").alias(f"run_{t}"), state.alias(t)), f"run_{t}", "left")
    states = field_states({k: (F.col(f"a.{v}"), F.col(f"b.{v}")) for k, v in fields.items()})
    known = sides.withColumn("states", states).select(
        "pair_id", fields_in_state(F.col("states"), "changed").alias("changed"), fields_in_state(F.col("states"), "missing").alias("missing"),
        (F.coalesce("a.verified", F.lit(False)) & F.coalesce("b.verified", F.lit(False))).alias("verified"))
    tasks = arm_set_counts(records, PAIR, "task_id").select("pair_id", "only_a", "only_b")
    # the audit looks at the presentations of both arms as well, so their difference needs no pass of its own
    audit = population_audit(records, in_pairs(expected, pairs), in_pairs(declared, pairs), by=PAIR, apart="apart")
    audit = audit.select("pair_id", (F.col("apart") > 0).alias("presentation_mismatch"), "complete", "incomplete_reasons", *FIGURES)
    joined = known
    for part in (tasks, audit):
        joined = join_null_safe(joined, part, PAIR, "left")
    joined = joined.fillna({"only_a": 0, "only_b": 0, "presentation_mismatch": False, "complete": False, **{c: 0 for c in FIGURES}})
    gated = comparability_gate(joined, "changed", "missing", "only_a", "only_b", "presentation_mismatch", **(gate or {}))
    return publication_gate(gated, **publication)


def endpoint_deltas(records: DataFrame, tau: float, by: Sequence[str] = PAIR, n_resamples: int = 2000, seed: int = 0) -> DataFrame:
    """Restricted mean of the first arm less that of the second, for both endpoints, over draws that are usable in both arms.

    One row per pair and endpoint, as ``rmst_delta_bootstrap`` gives it: tasks are resampled, with the same draws in both arms.
    """
    by = list(by)
    draws = usable_pairs(paired_draws(records, ENDPOINT_COLUMNS, by=by))
    arms = F.inline(F.array(*[F.struct(F.lit(a).alias("arm"), *[F.col(f"{t}.{c}").alias(c) for c in ENDPOINT_COLUMNS]) for t, a in (("a", "A"), ("b", "B"))]))
    observed = endpoint_observations(draws.select(*by, "task_id", arms), [*by, "task_id", "arm"])
    return rmst_delta_bootstrap(observed, tau, by=[*by, "endpoint"], n_resamples=n_resamples, seed=seed)


def state_counts(states: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair_id, arm, state, n) of the trajectory states (``run_id, state``) of both arms."""
    return in_pairs(states, pairs).groupBy("pair_id", "arm", "state").agg(F.count(F.lit(1)).alias("n"))


def compare(records: DataFrame, pairs: DataFrame, runs: DataFrame, fields: Mapping[str, str], expected: DataFrame, declared: DataFrame, tau: float,
            states: DataFrame | None = None, n_resamples: int = 2000, seed: int = 0, gate: Mapping[str, bool] | None = None,
            **publication: bool) -> Comparison:
    """Compares all ``pairs`` (``pair_id, run_a, run_b, mode``) of the runs in ``records``; estimates only for pairs not refused."""
    met = pair_records(records, pairs)
    verdicts = settle(pair_verdicts(met, pairs, runs, fields, expected, declared, gate, **publication), "verdicts")
    allowed = verdicts.where(~F.col("refused")).select("pair_id")
    some = met.join(allowed, "pair_id", "left_semi")
    return Comparison(
        verdicts, metric_panel(some, n_resamples, seed, by=PAIR), endpoint_deltas(some, tau, PAIR, n_resamples, seed),
        None if states is None else state_counts(states, pairs.join(allowed, "pair_id", "left_semi")))
