import hashlib
from collections import Counter, defaultdict

import pytest
from conftest import one, rows
from pyspark.sql import functions as F

from traceframe.functions import frames
from traceframe.operators import draws as D
from traceframe.operators import pairing as M
from traceframe.operators import population as P
from traceframe.operators import provenance as V

COLUMNS = ("arm string, presentation_id string, task_id string, condition_id string, mode string, seed bigint, repeat bigint, "
           "trial_id string, tokens array<int>, answer_normalized string, correct boolean, reasoning_tokens bigint, wall_ms double")


def trial(arm, i, seed, repeat=0, tokens=(1, 2, 3), cid="cond-x"):
    return (arm, f"pres{i}", f"task{i}", cid, "sampled", seed, repeat, f"{arm}{i}-{seed}-{repeat}", list(tokens), "5", True, 10, 1.0)


def records(spark, *rows_):
    return spark.createDataFrame(list(rows_), COLUMNS)


def both(seeds, n=10, **kw):
    return [trial(arm, i, s, **kw) for arm in "AB" for i in range(n) for s in seeds]


def audit(spark, rows_, seeds=(0, 1, 2), n=10, repeats=1, seeds_b=None):
    spec = spark.createDataFrame([("A", list(seeds), repeats, 1), ("B", list(seeds_b or seeds), repeats, 1)],
                                 "arm string, sampled_seeds array<int>, sampled_repeats_per_seed int, greedy_repeats int")
    pres = spark.createDataFrame([(arm, f"pres{i}") for arm in "AB" for i in range(n)], "arm string, presentation_id string")
    cond = spark.createDataFrame([(arm, "cond-x", "sampled") for arm in "AB"], "arm string, condition_id string, mode string")
    expected = P.expected_trials(spec, pres, cond, "arm", "sampled")
    return one(P.population_audit(records(spark, *rows_), expected, pres))


def test_complete_population(spark):
    out = audit(spark, both([0, 1, 2]))
    assert out["complete"] and out["matched_pairs"] == 30 and out["incomplete_reasons"] == []


def test_missing_seed(spark):
    out = audit(spark, both([0, 1]))
    assert (out["expected_trials_a"], out["observed_executions_a"], out["missing_trials_a"], out["complete"]) == (30, 20, 10, False)
    assert "arm_a" in out["incomplete_reasons"] or "arm_b" in out["incomplete_reasons"]


def test_swapped_seed_is_found_though_counts_match(spark):
    out = audit(spark, both([0, 1, 9]))
    assert (out["unexpected_trials_a"], out["missing_trials_a"], out["complete"]) == (10, 10, False)


def test_duplicate_and_ambiguous(spark):
    out = audit(spark, [*both([0, 1, 2]), trial("A", 0, 0)])
    assert out["duplicate_keys_a"] == 1 and not out["complete"]
    rows_ = [trial(arm, i, s, r, (9, 9, 9) if (r and not s) else (1, 2, 3)) for arm in "AB" for i in range(10) for s in (0, 1) for r in (0, 1)]
    out = audit(spark, rows_, seeds=(0, 1), repeats=2)
    assert out["ambiguous_draws_a"] == 10 and not out["complete"]


def test_arms_must_declare_the_same(spark):
    out = audit(spark, both([0, 1]), seeds=(0, 1), seeds_b=(0, 1, 2))
    assert "declarations_unequal" in out["incomplete_reasons"]


def test_incomplete_declaration_gives_a_reason(spark):
    spec = spark.createDataFrame([("r1", None, 1, 1), ("r2", [1], 1, 1)], "run string, sampled_seeds array<int>, sampled_repeats_per_seed int, greedy_repeats int")
    pres = spark.createDataFrame([("r1", "p")], "run string, presentation_id string")
    cond = spark.createDataFrame([("r1", "c", "sampled"), ("r2", "c", "sampled")], "run string, condition_id string, mode string")
    out = {r["run"]: r["reason"] for r in rows(P.declaration_status(spec, pres, cond, "run", "sampled"))}
    assert out == {"r1": "no_counts", "r2": "no_presentations"}


def test_wide_states_are_exchanged_once_and_without_their_digest(spark):
    df = spark.createDataFrame(
        [("p", "c", None, 1, "t1", ["1", "2"], 5), ("p", "c", None, 0, "t0", ["1", "2"], 4), ("p", "c", 3, 0, "t2", ["1"], 1), ("p", "c", 3, 1, "t3", ["2"], 2)],
        "presentation_id string, condition_id string, seed bigint, repeat bigint, trial_id string, tokens array<string>, v bigint")
    draws = D.collapse_draws(df, keep=["v"], divergence=False)
    assert [(r["seed"], r["n_executions"], r["ambiguous"], r["v"]) for r in rows(draws, "seed")] == [(None, 2, False, 4), (3, 2, True, None)]
    plan = draws._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange hashpartitioning") == 1
    assert dict(D.with_digest(df).dtypes)["__dig"] == "binary"


def test_collapse_keeps_null_seeds_together_and_finds_the_divergence(spark):
    df = records(spark, trial("A", 0, None, 0), trial("A", 0, None, 1), trial("A", 1, 3, 1, (1, 2, 9)), trial("A", 1, 3, 0), trial("A", 1, 3, 2, (1,)))
    out = rows(D.collapse_draws(df, keep=["trial_id"]), "presentation_id")
    assert (out[0]["n_executions"], out[0]["ambiguous"], out[0]["trial_id"], out[0]["first_token_divergence"]) == (2, False, "A0-None-0", None)
    assert (out[1]["n_executions"], out[1]["ambiguous"], out[1]["trial_id"], out[1]["first_token_divergence"]) == (3, True, None, 2)


def test_divergent_draws_take_one_exchange_and_large_ones_any_number_of_tasks(spark, monkeypatch):
    null = trial("A", 3, 1, 1)
    df = records(spark, trial("A", 0, None, 0), trial("A", 0, None, 1), trial("A", 1, 3, 2, (1, 9)), trial("A", 1, 3, 1, (1, 2, 9)), trial("A", 1, 3, 0),
                 trial("A", 1, 3, 3), trial("A", 2, 1), trial("A", 3, 1, 0, ()), null[:8] + (None,) + null[9:], trial("A", 3, 1, 2, (7,)), trial("A", 4, 1, 0, (1,)),
                 trial("A", 4, 1, 1, (1, 2)), trial("A", 4, 1, 2, (3,)), trial("A", 5, 1, None), trial("A", 5, 1, None, (1,)), trial("A", 5, 1, 2, (4,)))

    def collapsed():
        draws = D.collapse_draws(df, keep=["trial_id", "correct"], extra={"seen": F.count("answer_normalized")})
        return draws, rows(draws, "presentation_id")

    draws, whole = collapsed()
    assert [(r["n_executions"], r["ambiguous"], r["trial_id"], r["first_token_divergence"], r["seen"]) for r in whole] == [
        (2, False, "A0-None-0", None, 2), (4, True, None, 2, 4), (1, False, "A2-1-0", None, 1), (3, True, None, None, 3), (3, True, None, 1, 3), (3, True, None, None, 3)]
    plan = draws._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    monkeypatch.setattr(frames, "MOST_ROWS", 2)
    parts, split = collapsed()
    assert "Join" in parts._jdf.queryExecution().executedPlan().toString() and split == whole


def test_conditions_do_not_collide_and_repeats_add_no_draws(spark):
    df = records(spark, trial("A", 0, 0), trial("A", 0, 0, cid="cond-y"))
    assert D.collapse_draws(df, divergence=False).count() == 2
    more = df.unionByName(records(spark, trial("A", 0, 0, 1)))
    assert one(D.draw_summary(D.collapse_draws(more.withColumn("g", F.lit(1)), ["g", *D.DRAW_KEY], divergence=False), ["g"]))["n_unique_draws"] == 2


def test_a_draw_ambiguous_in_one_arm_leaves_both(spark):
    df = records(spark, trial("A", 0, 0, 0), trial("A", 0, 0, 1, (7,)), trial("B", 0, 0, 0), trial("B", 0, 0, 1), trial("A", 1, None), trial("B", 1, None))
    pairs = M.paired_draws(df, ["trial_id"])
    out = one(M.paired_population(pairs))
    assert (out["n_draws_a"], out["n_paired_draws"], out["n_ambiguous_a"], out["n_unpaired_b"]) == (2, 1, 1, 1)
    assert rows(M.usable_pairs(pairs))[0]["a"] == {"trial_id": "A1-None-0"}


def test_compact_refuses_raw_columns(spark):
    with pytest.raises(ValueError, match="tokens"):
        D.compact_draws(records(spark, trial("A", 0, 0)), ["presentation_id"], ["tokens"])


def plain_tree(items, leaf, digits=None):
    """The digest tree by its definition."""
    counts = Counter(items)
    if digits is None:
        digits = next(d for d in (0, 2, 4, 6, 8) if len(counts) <= leaf * 16**d)
    level = defaultdict(list)
    for i, n in counts.items():
        level[hashlib.md5(i.encode()).hexdigest()[:digits]].append(i if n == 1 else f"{i}\t{n}")
    folded = {p: hashlib.sha256("\n".join(sorted(x)).encode()).hexdigest() for p, x in level.items()}
    while digits:
        digits -= 2
        level = defaultdict(list)
        for p, d in folded.items():
            level[p[:digits]].append(f"{p}:{d}")
        folded = {p: hashlib.sha256("\n".join(sorted(x)).encode()).hexdigest() for p, x in level.items()}
    return folded[""]


@pytest.mark.parametrize("leaf", [256, 20, 1])
def test_set_digest_is_a_tree_of_bounded_digests(spark, leaf):
    """Small sets have the plain digest; order and partitions do not matter; repeats do; a group may be much larger than others."""
    groups = {"g": ["b", "a", "c"], "h": [f"x{i}" for i in range(900)], None: ["only"], "twice": ["a", "a", "b"], "hot": ["same"] * 3000 + ["other"]}
    df = spark.createDataFrame([(g, x) for g, xs in groups.items() for x in xs] + [("g", None), ("void", None)], "g string, x string")
    got = {r["g"]: r["digest"] for r in rows(P.set_digest(df, ["g"], F.col("x"), leaf=leaf))}
    assert got == {g: plain_tree(xs, leaf) for g, xs in groups.items()}
    assert got == {r["g"]: r["digest"] for r in rows(P.set_digest(df.orderBy("x").repartition(3), ["g"], F.col("x"), leaf=leaf))}
    if leaf == 256:
        assert got["g"] == hashlib.sha256(b"a\nb\nc").hexdigest()


def test_every_lock_field_is_compared(spark):
    """One population for each way a lock can differ, one that fits, one without a lock, one that only expects other executions."""
    fields = [*P.LOCK_FIELDS, *P.SPEC_FIELDS, "population_key"]
    names = [f"p{i}" for i in range(len(fields))] + ["same", "fresh", "design"]
    tasks = spark.createDataFrame([(p, f"{p}-t{i}", f"{p}-q{i}", f"s{i}", "fam", "easy") for p in names for i in range(3)],
                                  "population string, task_id string, presentation_id string, signature string, family string, level string")
    specs = spark.createDataFrame([(p, "pop-1", "pack", "gen", "main", 1, "plain", 3, 9) for p in names],
                                  "population string, population_key string, task_pack string, generator_version string, split string, task_seed int, prompt_policy string, n_per_family int, expected_executions int")
    fresh = P.population_lock(tasks, specs)
    stored = fresh.where("population <> 'fresh'")
    for p, f in zip(names, fields):
        kind = stored.schema[f].dataType
        stored = stored.withColumn(f, F.when(F.col("population") == p, F.lit("0").cast(kind)).otherwise(F.col(f)))
    stored = stored.withColumn("expected_executions", F.when(F.col("population") == "design", 1).otherwise(F.col("expected_executions")))
    out = {r["population"]: r for r in rows(P.lock_verify(fresh, stored))}
    assert {p: out[p]["mismatches"] for p in names} == {**{p: [f] for p, f in zip(names, fields)}, "same": [], "fresh": [], "design": []}
    assert len(fields) == 13 and not out["fresh"]["locked"] and out["design"]["ok"]


def test_gold_must_exist(spark):
    probes = spark.createDataFrame([("t1",), ("t2",)], "task_id string")
    tasks = spark.createDataFrame([("t1", "5")], "task_id string, answer string")
    with pytest.raises(Exception, match="no gold answer for task t2"):
        M.join_gold(probes, tasks, "task_id", "answer").collect()


@pytest.mark.parametrize("changed, label", [
    (["model.precision", "model.conversion"], "weight_representation"), (["model.revision"], "different_source_model"),
    (["model.precision", "runtime.os"], "confounded_model_runtime"), (["runtime.os"], "runtime_hardware"),
    (["decoding.conditions"], "decoding"), (["spec.split"], "same_deployment"), (["model.family"], "model_other")])
def test_contrast_labels(spark, changed, label):
    df = spark.createDataFrame([(changed,)], "c array<string>")
    assert one(df.select(V.contrast(F.col("c"))["label"].alias("l")))["l"] == label


def test_intent_lifts_a_refusal_and_overrides_bar_publication(spark):
    df = spark.createDataFrame([(["spec.max_tokens"], [], 0, 0, False, True, True)],
                               "changed array<string>, missing array<string>, only_a int, only_b int, pm boolean, complete boolean, verified boolean")
    args = ("changed", "missing", "only_a", "only_b", "pm")
    assert not one(V.comparability_gate(df, *args))["clean"]
    clean = V.comparability_gate(df, *args, horizon_intentional=True)
    assert one(V.publication_gate(clean))["publication_grade"]
    forced = one(V.publication_gate(V.comparability_gate(df, *args), allow_confounded=True))
    assert forced["overrides_applied"] == ["confounded"] and not forced["publication_grade"] and not forced["refused"]


def test_reasons_name_the_fields_and_counts_behind_them(spark):
    df = spark.createDataFrame([(["runtime.os", "runtime.hardware", "task_pack.generator_version", "spec.max_tokens"], ["model.revision", "model.precision"], 2, 1, False)],
                               "changed array<string>, missing array<string>, only_a int, only_b int, pm boolean")
    out = one(V.comparability_gate(df, "changed", "missing", "only_a", "only_b", "pm", horizon_intentional=True))
    assert out["reasons"] == ["fields_unknown", "tasks_unequal", "runtime_many", "pack_version"]
    assert out["explained"] == ["fields_unknown: model.precision,model.revision", "tasks_unequal: only_a=2, only_b=1",
                                "runtime_many: runtime.hardware,runtime.os", "pack_version: generator_version"]


def test_overlaps_of_every_pair_of_populations(spark):
    df = spark.createDataFrame([("a", "1"), ("b", "1"), ("b", "2"), ("c", "2"), ("c", "2"), ("d", "3"), (None, "3"), ("a", None)], "p string, x string")
    out = {(r["first"], r["second"]): r["overlap"] for r in rows(P.disjointness(df, "p", ["a", "b", "c", "d"], ["x"]))}
    assert out == {("a", "b"): 1, ("a", "c"): 0, ("a", "d"): 0, ("b", "c"): 1, ("b", "d"): 0, ("c", "d"): 0}


def test_ambiguous_draws_are_counted_without_a_sort(spark):
    from traceframe.operators.draws import ambiguous_count

    df = spark.createDataFrame(
        [("A", "p", "c", 0, [1, 2]), ("A", "p", "c", 0, [1, 2]), ("A", "q", "c", None, [1]), ("A", "q", "c", None, [2]), ("A", "r", "c", 0, None),
         ("A", "r", "c", 0, [3]), ("B", "p", "c", 0, None)],
        "arm string, presentation_id string, condition_id string, seed bigint, tokens array<int>")
    counted = ambiguous_count(df, ["arm"])
    assert "SortAggregate" not in counted._jdf.queryExecution().executedPlan().toString()
    assert {r["arm"]: r["n_ambiguous_draws"] for r in counted.collect()} == {"A": 1, "B": 0}
