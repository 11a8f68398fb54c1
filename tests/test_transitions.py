import pytest
from conftest import one, rows
from pyspark.sql import functions as F

from traceframe.operators import pairing as M
from traceframe.operators import transitions as T


def selected(spark, outcomes):
    return spark.createDataFrame([("d", str(c), c, o) for c, o in outcomes], "draw string, checkpoint_label string, checkpoint_index int, outcome string")


LABELS = ("0", "256", "512")


@pytest.mark.parametrize("outcomes, want", [
    ([(0, "correct"), (256, "censored"), (512, "correct")], dict(n_indeterminate=1, flips=0, state="stable_correct", stable_through_end=True, n_missing=0)),
    ([(0, "scorable_incorrect")], dict(n_missing=2, state="never_correct", first_correct_checkpoint=None, stable_through_end=None)),
    ([(0, "scorable_incorrect"), (512, "correct")], dict(state="wrong_to_correct", flips=1, first_correct_checkpoint="512", stable_from_checkpoint="512")),
    ([(0, "correct"), (256, "scorable_incorrect"), (512, "correct")], dict(state="multiple_flips", stable_through_end=False, stable_from_checkpoint=None)),
    ([(0, "error")], dict(state="never_correct", n_observed_scorable=0, n_indeterminate=1)),
])
def test_forced_trajectories(spark, outcomes, want):
    out = one(T.forced_trajectory(selected(spark, outcomes), ["draw"], LABELS))
    assert {k: out[k] for k in want} == want


@pytest.mark.parametrize("correct, final, want", [
    ([1, 1, 1], "correct", ("stable_correct", 0, 0, 0, False)), ([0, 1, 1], "correct", ("wrong_to_correct", 1, 100, 100, False)),
    ([1, 0, 0], "incorrect", ("correct_to_wrong", 1, None, None, True)), ([0, 1, 0], "censored", ("multiple_flips", 2, None, None, False)),
    ([0, 0], "incorrect", ("never_correct", 0, None, None, False)), ([0, 1], None, ("wrong_to_correct", 1, 100, None, False))])
def test_trajectory(spark, correct, final, want):
    probes = spark.createDataFrame([("d", i * 100, bool(c)) for i, c in enumerate(correct)], "draw string, n int, correct boolean")
    natural = spark.createDataFrame([("d", final)] if final else [], "draw string, natural_final_status string")
    r = one(T.trajectory(probes, ["draw"], ["n"], "n", natural))
    assert (r["prefix_state"], r["prefix_flips"], r["observed_probe_stable_from_tokens"],
            r["stable_sufficient_with_natural_final_tokens"], r["harmful_overthinking_observed"]) == want


PROBE = "arm string, task_id string, seed bigint, family string, native_closed boolean, checkpoint_label string, checkpoint bigint, is_full_prefix boolean, outcome string"


def test_full_prefix_that_is_a_numeric_checkpoint_counts_for_both(spark):
    df = spark.createDataFrame([("A", "t", None, "f", True, "64", 64, True, "correct"), ("B", "t", None, "f", False, "full_prefix", 90, True, "correct")], PROBE)
    sel = M.select_checkpoints(df)
    assert sorted((r["arm"], r["checkpoint_label"]) for r in rows(sel)) == [("A", "64"), ("A", "full_prefix"), ("B", "full_prefix")]
    joint = one(M.jointly_eligible(sel))
    assert (joint["checkpoint_label"], joint["seed"], joint["outcome_a"], joint["outcome_b"]) == ("full_prefix", None, "correct", "correct")


def test_reversion_needs_an_observed_wrong_answer(spark):
    def arm(a, seq):
        return [(a, "t", 1, "f", True, str(i), i, False, o) for i, o in enumerate(seq)]
    df = M.select_checkpoints(spark.createDataFrame(arm("A", ["correct", "censored"]) + arm("B", ["correct", "scorable_incorrect"]), PROBE))
    assert {r["arm"]: r["stability"] for r in rows(T.probe_stability(df))} == {"A": "stable_from_first_correct", "B": "reverted"}
    p = one(T.draw_pattern(df))
    assert (p["pattern"], p["fluctuates"], p["closure_group"], p["indeterminate_dominant"]) == ("both_recover", True, "both_naturally_closed", False)
    assert {r["example_class"] for r in rows(T.representative_examples(T.draw_pattern(df)))} == {"positive_both_recover", "unstable"}


def test_forced_trajectory_counts_each_declared_label_once(spark):
    df = spark.createDataFrame([("d", "0", 0, "correct", 1), ("d", "0", 0, "error", 2), ("d", "256", 256, "correct", 1), ("d", "999", 999, "correct", 3)],
                               "draw string, checkpoint_label string, checkpoint_index int, outcome string, position int")
    out = one(T.forced_trajectory(df, ["draw"], LABELS))
    assert (out["n_missing"], out["n_error"], out["n_correct"], out["n_observed_scorable"]) == (1, 1, 1, 1)


def test_last_probe_of_an_arm_counts(spark):
    df = spark.createDataFrame([("A", "t", 1, "f", True, "64", 64, False, "unparseable", 1), ("A", "t", 1, "f", True, "64", 64, False, "correct", 2),
                                ("B", "t", 1, "f", True, "64", 64, False, "error", 3)], PROBE + ", position bigint")
    sel = df.withColumn("checkpoint_index", F.col("checkpoint"))
    joint = one(M.jointly_eligible(sel))
    assert (joint["outcome_a"], joint["outcome_b"]) == ("correct", "error")


def test_probes_take_the_status_of_their_own_run(spark):
    probes = spark.createDataFrame([("A", "t", 1), ("B", "t", 1), ("C", "t", 1)], "run_id string, task_id string, n int")
    records = spark.createDataFrame([("A", "t", "greedy", 0, "x", "correct"), ("B", "t", "greedy", 0, "y", "error"), ("B", "t", "greedy", 1, "a", "correct")],
                                    "run_id string, task_id string, mode string, repeat int, trial_id string, st string")
    out = {r["run_id"]: r["natural_final_status"] for r in rows(M.join_natural(probes, records, F.col("st")))}
    assert out == {"A": "correct", "B": "error", "C": "censored"}


def test_unset_flags_count_as_false(spark):
    df = spark.createDataFrame([((None,), (True,)), (None, (True,))], "a struct<f: boolean>, b struct<f: boolean>")
    label = T.flag_transition(T.arm_flag(F.col("a"), "f"), T.arm_flag(F.col("b"), "f"))
    assert [r["l"] for r in rows(df.select(label.alias("l")))] == ["only_b", "ambiguous"]


def test_only_the_last_of_several_probes_counts_in_patterns(spark):
    probes = [("A", "t", 1, "f", True, "0", 0, False, "correct", 1), ("A", "t", 1, "f", True, "0", 0, False, "scorable_incorrect", 2),
              ("A", "t", 1, "f", True, "64", 64, False, "correct", 3), ("B", "t", 1, "f", True, "0", 0, False, "error", 4)]
    sel = spark.createDataFrame(probes, PROBE + ", position bigint").withColumn("checkpoint_index", F.col("checkpoint"))
    assert [(r["arm"], r["checkpoint_label"]) for r in rows(T.first_recoverable(sel))] == [("A", "64")]
    pattern = one(T.draw_pattern(sel))
    assert (pattern["pattern"], pattern["fluctuates"], pattern["indeterminate_dominant"]) == ("only_a_recovers", False, False)


def test_pair_labels(spark):
    df = spark.createDataFrame([(True, True), (True, False), (False, True), (False, False), (None, True)], "a boolean, b boolean")
    assert [r["l"] for r in rows(df.select(T.flag_transition(F.col("a"), F.col("b")).alias("l")))] == ["both", "only_a", "only_b", "neither", "ambiguous"]
