"""Comparison of several pairs of runs, both modes, in one job."""

import numpy as np
import pytest
from conftest import one, rows
from pyspark.sql import functions as F

from traceframe.functions import frames
from traceframe.operators import pairing as M
from traceframe.operators import transitions as T
from traceframe.operators.pairing import pair_records, paired_draws, paired_population
from traceframe.operators.population import PROJECTION, population_audit
from traceframe.plans import compare as P
from traceframe.plans.comparison import cross_study, metric_panel, panel_cells

SCHEMA = """run_id string, trial_id string, presentation_id string, task_id string, condition_id string, mode string, seed bigint, repeat bigint,
 tokens array<int>, family string, difficulty string, correct boolean, answer_normalized string, think_end_reached boolean, capped boolean, finish_reason string,
 error_type string, missing_answer boolean, terminated_by_eos boolean, reasoning_tokens bigint, total_tokens bigint, wall_ms double,
 repeated_ngram_fraction_4 double, unique_token_ratio double, longest_run_length bigint"""


def execution(run, task, mode, seed, repeat=0, tokens=(1, 2), closed=True, n=50, correct=True, ratio=None):
    return (run, f"{run}/{task}/{mode}/{seed}/{repeat}", f"p-{task}", f"t-{task}", mode[0], mode, seed, repeat, list(tokens), "arith", "easy", correct, "1",
            closed, not closed, "stop" if closed else "length", None, False, closed, n, n + 5, float(n), 0.1, ratio, 3)


def all_runs():
    """r1 and r2 hold the same trials, r3 lacks a task, r4 has other sampled seeds; r2 is slower, r3 never closes."""
    out = []
    for run, slow in (("r1", 0), ("r2", 20), ("r3", 0), ("r4", 5)):
        for task in range(5 if run == "r3" else 6):
            out.append(execution(run, task, "greedy", None, n=30 + task + slow, closed=run != "r3"))
            for seed in (0, 1) if run != "r4" else (1, 2):
                out.append(execution(run, task, "sampled", seed, n=40 + task + seed + slow, closed=run != "r3", correct=seed == 0))
    out.append(execution("r2", 0, "sampled", 0, repeat=1, tokens=(9,)))
    return out


PAIRS = [("both", "r1", "r2", None), ("greedy", "r1", "r2", "greedy"), ("short", "r1", "r3", "sampled"), ("seeds", "r1", "r4", "sampled"),
         ("same", "r1", "r1", "sampled"), ("nobody", "r1", "r9", None)]


@pytest.fixture(scope="module")
def records(spark):
    return spark.createDataFrame(all_runs(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame(PAIRS, "pair_id string, run_a string, run_b string, mode string")


def alone(records, name):
    """The records of one pair, picked by hand."""
    _, a, b, mode = next(p for p in PAIRS if p[0] == name)
    mine = records if mode is None else records.where(F.col("mode") == mode)
    return mine.where(F.col("run_id") == a).withColumn("arm", F.lit("A")).unionByName(mine.where(F.col("run_id") == b).withColumn("arm", F.lit("B")))


def test_all_pairs_at_once_equal_each_pair_alone(records, pairs):
    met = pair_records(records, pairs)
    population = {r["pair_id"]: r for r in rows(paired_population(paired_draws(met, ["trial_id"], by=["pair_id"]), ["pair_id"]))}
    outcomes = rows(T.paired_outcomes(paired_draws(T.with_pair_columns(met), T.PAIR_COLUMNS, by=["pair_id"]), ["pair_id"]))
    panel = rows(metric_panel(met, n_resamples=50, by=["pair_id"]))
    for name in ("both", "greedy", "short", "seeds", "same"):
        mine = alone(records, name)
        assert {k: v for k, v in population[name].items() if k != "pair_id"} == one(paired_population(paired_draws(mine, ["trial_id"])))
        want = rows(T.paired_outcomes(paired_draws(T.with_pair_columns(mine), T.PAIR_COLUMNS)), "dimension", "level", "kind", "label")
        got = sorted(({k: v for k, v in r.items() if k != "pair_id"} for r in outcomes if r["pair_id"] == name), key=lambda r: tuple(r[c] for c in ("dimension", "level", "kind", "label")))
        assert got == want
        for r in rows(metric_panel(mine, n_resamples=50)):
            both = next(x for x in panel if x["pair_id"] == name and x["metric"] == r["metric"])
            assert all(both[k] == pytest.approx(v) if isinstance(v, float) else both[k] == v for k, v in r.items()), (name, r["metric"])


def test_metrics_without_values_keep_their_row(records, pairs):
    panel = metric_panel(pair_records(records, pairs), n_resamples=20, by=["pair_id"])
    names = {r["metric"] for r in rows(panel)}
    got = {(r["pair_id"], r["metric"]): r for r in rows(panel)}
    assert len(names) == 15 and set(got) == {(p[0], m) for p in PAIRS for m in names}
    empty = got["both", "unique_token_ratio"]
    assert empty["n_clusters"] == empty["n_obs"] == 0 and empty["mean"] is None and empty["classification"] == "insufficient_data" and not empty["estimable"]
    assert got["nobody", "wall_ms"]["n_clusters"] == 0 and got["same", "wall_ms"]["mean"] == 0
    study = {r["label"]: r for r in rows(cross_study(panel))}
    assert set(study) == {p[0] for p in PAIRS} and study["short"]["closure_rate_delta"] == 1 and study["nobody"]["n_clusters"] == 0


def test_audit_of_each_pair(records, pairs):
    wanted = records.where("run_id = 'r1'").select(*PROJECTION).distinct()
    expected = records.sparkSession.createDataFrame([(r,) for r in ("r1", "r2", "r3", "r4", "r9")], "run_id string").crossJoin(wanted)
    audit = population_audit(pair_records(records, pairs), P.in_pairs(expected, pairs), P.in_pairs(expected.select("run_id", "presentation_id").distinct(), pairs), by=["pair_id"])
    out = {r["pair_id"]: r for r in rows(audit)}
    assert out["same"]["complete"] and out["greedy"]["complete"]
    assert (out["both"]["unexpected_trials_b"], out["both"]["ambiguous_draws_b"], out["both"]["incomplete_reasons"]) == (1, 1, ["arm_b"])
    assert (out["short"]["missing_trials_b"], out["short"]["incomplete_reasons"]) == (2, ["arm_b", "pairs_short"])
    assert (out["seeds"]["missing_trials_b"], out["seeds"]["unexpected_trials_b"]) == (6, 6) and out["nobody"]["missing_trials_b"] == 18


def test_compare_estimates_only_what_is_not_refused(records, pairs, spark):
    runs = spark.createDataFrame([("r1", True, "bf16", "x"), ("r2", True, "q4", "x"), ("r3", True, "q4", "y"), ("r4", False, "bf16", "x")],
                                 "run_id string, verified boolean, precision string, hardware string")
    wanted = records.select("run_id", *PROJECTION).distinct()
    states = spark.createDataFrame([("r1", "stable_correct")] * 3 + [("r2", "never_correct")], "run_id string, state string")
    out = P.compare(records, pairs, runs, {"model.precision": "precision", "runtime.hardware": "hardware"}, wanted,
                    wanted.select("run_id", "presentation_id").distinct(), tau=60.0, states=states, n_resamples=40)
    verdicts = {r["pair_id"]: r for r in rows(out.verdicts)}
    assert {k for k, r in verdicts.items() if r["refused"]} == {"short", "seeds", "nobody"}
    assert verdicts["short"]["refusal_reasons"] == ["tasks_unequal", "model_and_runtime", "presentations_unequal"]
    assert verdicts["seeds"]["refusal_reasons"] == ["seal_unverified"] and "fields_unknown" in verdicts["nobody"]["refusal_reasons"]
    assert verdicts["greedy"]["contrast"] == "weight_representation" and verdicts["greedy"]["publication_grade"] and not verdicts["both"]["complete"]
    assert {r["pair_id"] for r in rows(out.metrics)} == {"both", "greedy", "same"}
    ends = {(r["pair_id"], r["endpoint"]): r for r in rows(out.endpoints)}
    assert len(ends) == 6 and ends["same", "reasoning_closure"]["point"] == 0 and not ends["same", "reasoning_closure"]["excludes_zero"]
    # greedy: every task is closed at 31 + task, in the other run 20 later, both before tau
    assert ends["greedy", "reasoning_closure"]["point"] == pytest.approx(-20) and ends["greedy", "reasoning_closure"]["excludes_zero"]
    closed = np.array([35.0 + k for k in range(6)])
    assert ends["greedy", "generation_termination"]["point"] == pytest.approx(closed.mean() - np.minimum(closed + 20, 60).mean())
    assert {(r["pair_id"], r["arm"], r["state"]): r["n"] for r in rows(out.trajectories)}["both", "A", "stable_correct"] == 3


def test_few_runs_are_not_dealt_out_by_run(spark):
    from traceframe.operators.pairing import pair_records

    records = spark.range(20).selectExpr("cast(id % 2 as string) AS run_id", "'sampled' AS mode", "id")
    pairs = spark.createDataFrame([("x", "0", "1", None), ("y", "1", "0", "greedy")], "pair_id string, run_a string, run_b string, mode string")
    met = pair_records(records, pairs)
    assert "Exchange hashpartitioning" not in met._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["pair_id"], r["arm"], r["id"] % 2) for r in met.collect()) == [("x", a, k) for a, k in (("A", 0), ("B", 1)) for _ in range(10)]


def test_executions_of_a_panel_are_exchanged_once(records, pairs, monkeypatch):
    """Pairs and cells by task need one exchange between them, and are those of ``paired_draws``; null tasks and copies included."""
    monkeypatch.setattr(M, "PER_SORT", 40)
    met = pair_records(records, pairs)
    met = met.unionByName(met.where("seed = 1")).withColumn("task_id", F.when(F.col("task_id") != "t-3", F.col("task_id")))
    keep = ["m_total_tokens", "m_unique_token_ratio"]
    met = met.withColumn("m_total_tokens", F.col("total_tokens").cast("double")).withColumn("m_unique_token_ratio", F.col("unique_token_ratio"))
    here, rest = M.usable_pairs_by_task(met, keep, by=["pair_id"])
    assert rest is None
    cells = panel_cells(here, ["total_tokens", "unique_token_ratio"], ["pair_id"])
    assert cells._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    want = M.usable_pairs(paired_draws(met, keep, by=["pair_id"])).select("pair_id", "task_id", "a", "b")
    assert sorted(map(repr, here.collect())) == sorted(map(repr, want.collect())) and want.count() > 20
    assert {r["metric"] for r in rows(cells)} == {"total_tokens"}


def test_large_tasks_of_a_panel_take_the_other_way(records, pairs, monkeypatch):
    met = pair_records(records.unionByName(records.where("task_id = 't-2'")), pairs)
    whole = rows(metric_panel(met, n_resamples=30, by=["pair_id"]), "pair_id", "metric")
    monkeypatch.setattr(frames, "MOST_ROWS", 10)
    here, rest = M.usable_pairs_by_task(met, ["total_tokens"], by=["pair_id"])
    assert rest is not None and rest.count() > 0 and here.count() > 0
    for r, w in zip(rows(metric_panel(met, n_resamples=30, by=["pair_id"]), "pair_id", "metric"), whole, strict=True):
        assert all(r[k] == pytest.approx(v, abs=1e-9) if isinstance(v, float) else r[k] == v for k, v in w.items()), (w["pair_id"], w["metric"])
