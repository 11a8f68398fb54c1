import numpy as np
import pytest
from conftest import one, rows
from pyspark.sql import functions as F

from traceframe.functions import ranges
from traceframe.functions import resampling as R
from traceframe.functions.quantiles import exact_quantiles, order_statistics, quantiles_of_counts, value_counts
from traceframe.operators import aggregates as G
from traceframe.plans import comparison as C


def frame(spark, values, **consts):
    df = spark.createDataFrame([(i, None if v is None else float(v)) for i, v in enumerate(values)], "id long, v double")
    for k, v in consts.items():
        df = df.withColumn(k, F.lit(v))
    return df


def test_summary_of_four(spark):
    out = one(G.summarize(frame(spark, [1, 2, 3, None, 4]), [], "v"))
    assert out["n"] == 4 and out["mean"] == 2.5 and out["median"] == 2.5 and out["min"] == 1 and out["max"] == 4
    assert out["std"] == pytest.approx(np.std([1, 2, 3, 4], ddof=1)) and out["p10"] == pytest.approx(1.3)


def test_summary_of_one_has_zero_std(spark):
    assert one(G.summarize(frame(spark, [7]), [], "v"))["std"] == 0.0


def test_quantiles_with_one_hot_group_and_both_signs(spark):
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.normal(0, 1e5, 4000), np.full(3000, 12.5), rng.exponential(1e-4, 500)])
    df = spark.createDataFrame([("hot" if i % 10 else None, float(v)) for i, v in enumerate(values)], "g string, v double")
    out = {r["g"]: r for r in rows(exact_quantiles(df, ["g"], "v", {"a": 0.0, "b": 0.371, "c": 0.5, "d": 1.0}))}
    for g, part in (("hot", [v for i, v in enumerate(values) if i % 10]), (None, [v for i, v in enumerate(values) if i % 10 == 0])):
        for name, p in (("a", 0.0), ("b", 0.371), ("c", 0.5), ("d", 1.0)):
            assert out[g][name] == pytest.approx(np.quantile(part, p), rel=1e-12)


def test_order_statistics_pick_ranks(spark):
    out = one(order_statistics(frame(spark, [5, 1, 1, 9, 7]), [], "v", {"q1": lambda n: F.floor(n / 4), "top": lambda n: n - 1}))
    assert (out["q1"], out["top"], out["n_values"]) == (1.0, 9.0, 5)


def test_multinomial_weights_sum_to_the_number_of_clusters(spark):
    clusters = spark.range(37).select(F.col("id").cast("string").alias("c"), F.when(F.col("id") < 30, "g").alias("g"))
    w = R.bootstrap_weights(clusters, ["g"], "c", 50, 1)
    sums = rows(w.groupBy("g", "replicate").agg(F.sum("weight").alias("s")))
    assert {(r["g"], r["s"]) for r in sums} == {("g", 30), (None, 7)} and len(sums) == 100


def test_blocks_and_partitions_do_not_change_the_weights(spark, monkeypatch):
    """Weights are a function of seed, replicate and rank alone; groups of one cluster and null groups included."""
    clusters = spark.range(300).select(F.col("id").cast("string").alias("c"), F.when(F.col("id") < 200, "g").when(F.col("id") < 201, "h").alias("g"))

    def weights(df):
        return {(r["g"], r["c"], r["replicate"]): r["weight"] for r in rows(R.bootstrap_weights(df, ["g"], "c", 20, 3))}

    whole = weights(clusters)
    monkeypatch.setattr(R, "BLOCK", 16)
    R._kept.clear()
    assert weights(clusters.repartition(7)) == whole
    assert all(whole["h", "200", k] == 1 for k in range(20))


def test_draws_of_large_groups_are_shared_out_many_at_a_time(spark, monkeypatch):
    """Groups of one size share their draws, a row holds a run of replicates, and slices of turns give what single turns give."""
    clusters = spark.range(10_000).select(F.col("id").cast("string").alias("c"), (F.col("id") % 2).alias("g"))
    drawn = rows(R.block_draws(clusters, ["g"], 120, 5, 1024))
    assert len(drawn) == 2 * 5 * 3 and {r["block"] for r in drawn} == set(range(5))
    for first, size in ((0, 50), (50, 50), (100, 20)):
        for g in (0, 1):
            mine = np.array([r["draws"] for r in sorted(drawn, key=lambda r: r["block"]) if r["g"] == g and r["replicate"] == first])
            want = [d for _, d in R.Splitter(np.arange(first, first + size), 5).leaves(0, 5000, np.full(size, 5000), 1024)]
            assert (mine == want).all() and (mine.sum(axis=0) == 5000).all()
    whole = R.Splitter(np.arange(3), 2).lower(0, 5000, np.array([5000, 7, 0]))
    monkeypatch.setattr(R, "TURNS", 8)
    monkeypatch.setattr(R, "KEPT_WORDS", 64)
    assert (R.Splitter(np.arange(3), 2).lower(0, 5000, np.array([5000, 7, 0])) == whole).all() and whole[2] == 0


def test_weights_are_multinomial(spark):
    """Means, variances and covariances of the weights, also of ranges of uneven halves and of ranks beyond 2^40."""
    w = R.block_weights(11, 0, 1024, None, 20_000, 7).astype(float)
    assert (w.sum(axis=0) == 11).all()
    assert np.abs(w.mean(axis=1) - 1).max() < 0.03 and np.abs(np.cov(w) - (np.eye(11) - 1 / 11)).max() < 0.04
    far = R.Splitter(np.arange(4000), 1)
    low = [far.lower(base, 48, np.full(4000, 48)) for base in (1 << 41, (1 << 41) + 64, (1 << 41) + (1 << 36))]
    assert all(abs(x.mean() - 32) < 0.3 and abs(x.var() - 48 * 2 / 9) < 0.9 for x in low)
    assert abs(np.corrcoef(low)[np.triu_indices(3, 1)]).max() < 0.06


def test_no_slot_is_shuffled(spark):
    """The plan exchanges clusters and sums; sums are at most one per block, group and replicate."""
    values = spark.range(3000).select(F.col("id").cast("string").alias("c"), (F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("v"))
    means = R.replicate_means(values, ["g"], "c", "v", 50, 0)
    plan = means._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") <= 1 and "Join" in plan and plan.count("FlatMapCoGroupsInArrow") == 1
    assert means.count() == 150
    for r in rows(means.groupBy("g").agg(F.avg("estimate").alias("m"), F.stddev("estimate").alias("s"))):
        assert r["m"] == pytest.approx(1500, abs=60) and r["s"] == pytest.approx(866 / 1000**0.5, rel=0.3)


def test_groups_of_one_size_share_their_weights(spark, monkeypatch):
    """Means equal values times weights, of many groups, blocks and shares; null groups and values that are missing or not a number included."""
    rng = np.random.default_rng(5)
    data = [(None if g == 0 else f"g{g}", f"c{c}", None if g == 3 and c == 1 else float("nan") if g == 4 and c == 2 else float(rng.normal()))
            for g in range(12) for c in range(40 if g < 9 else 7)]
    values = spark.createDataFrame(data, "g string, c string, v double").repartition(3)
    monkeypatch.setattr(R, "POOL", 4)
    monkeypatch.setattr(R, "BLOCK", 16)
    means = R.replicate_means(values, ["g"], "c", "v", 25, 2)
    plan = means._jdf.queryExecution().optimizedPlan().toString()
    keys = next(line for line in plan.splitlines() if "FlatMapCoGroupsInArrow" in line).split("]")[0]
    assert "n#" in keys and "__share#" in keys and "g#" not in keys
    weights = {(r["g"], r["c"], r["replicate"]): r["weight"] for r in rows(R.bootstrap_weights(values, ["g"], "c", 25, 2))}
    got = {(r["g"], r["replicate"]): r["estimate"] for r in rows(means)}
    assert len(got) == 12 * 25
    for (g, k), estimate in got.items():
        pairs = [(weights.get((g, c, k), 0), v) for h, c, v in data if h == g and v is not None and not np.isnan(v)]
        assert estimate == pytest.approx(sum(w * v for w, v in pairs) / sum(w for w, _ in pairs))


def test_close_values_are_not_sorted_in_one_group(spark, monkeypatch):
    """A million different values between 0 and 0.01: exact, from ranges of bounded size."""
    monkeypatch.setattr(ranges, "PER_RANGE", 50_000)
    n = 1_000_000
    df = spark.range(n).select((F.col("id") * 7919 % n / n * 0.01).alias("v"), F.lit("x").alias("g"))
    counts = value_counts(df, ["g"], "v")
    sizes = [r["n"] for r in rows(counts.groupBy("__range").agg(F.count("*").alias("n")))]
    assert len(sizes) >= 15 and max(sizes) < 3 * n / len(sizes)
    want = np.arange(n) / n * 0.01
    out = one(quantiles_of_counts(counts, ["g"], {"a": 0.1, "b": 0.5, "c": 0.999}))
    assert [out[k] for k in "abc"] == pytest.approx(np.quantile(want, [0.1, 0.5, 0.999]).tolist(), rel=1e-12)


def test_poisson_weights_have_mean_and_variance_one(spark):
    clusters = spark.range(2000).select(F.col("id").cast("string").alias("c"))
    out = one(R.bootstrap_weights(clusters, [], "c", 50, 0, "poisson").agg(
        F.sum("weight").alias("s"), F.sum(F.pow("weight", F.lit(2))).alias("q")))
    assert out["s"] / 1e5 == pytest.approx(1, abs=0.02) and out["q"] / 1e5 == pytest.approx(2, abs=0.06)


@pytest.mark.parametrize("scheme", ["multinomial", "poisson"])
def test_interval_is_close_to_a_numpy_bootstrap(spark, scheme):
    values = np.random.default_rng(5).gamma(2.0, 3.0, 300)
    out = one(C.bootstrap_ci(frame(spark, values), [], "id", "v", n_resamples=1000, scheme=scheme))
    means = values[np.random.default_rng(0).integers(0, 300, (4000, 300))].mean(axis=1)
    assert out["mean"] == pytest.approx(values.mean())
    assert out["lo"] == pytest.approx(np.percentile(means, 2.5), abs=0.12)
    assert out["hi"] == pytest.approx(np.percentile(means, 97.5), abs=0.12)


def test_paired_delta(spark):
    df = spark.createDataFrame([(i, float(i + 9), float(i)) for i in range(1, 5)], "id long, a double, b double")
    out = one(C.paired_bootstrap_delta(df, [], "id", "a", "b", n_resamples=100))
    assert out["mean"] == 9 and out["excludes_zero"] and out["lo"] == 9
    same = one(C.paired_bootstrap_delta(df, [], "id", "a", "a", n_resamples=100))
    assert same["mean"] == 0 and not same["excludes_zero"]


def test_duplicated_repeats_do_not_change_the_cluster_estimate(spark):
    df = spark.createDataFrame([(str(i % 6), "AB"[i % 2], float(i % 5)) for i in range(60)], "c string, arm string, v double")
    once = one(C.paired_cluster_bootstrap(df, [], "c", "v", n_resamples=80))
    twice = one(C.paired_cluster_bootstrap(df.unionByName(df).repartition(7), [], "c", "v", n_resamples=80))
    for key in ("n_clusters", "mean", "lo", "hi"):
        assert once[key] == twice[key] or once[key] == pytest.approx(twice[key])


def test_guard_blanks_a_constant_delta(spark):
    df = spark.createDataFrame([("1", "A", 1.0), ("1", "B", 0.0), ("2", "A", 1.0), ("2", "B", 0.0)], "c string, arm string, v double")
    out = one(C.paired_cluster_bootstrap(df, [], "c", "v", n_resamples=20, guard=True))
    assert out["degenerate"] and out["lo"] is None and out["mean"] == 1.0


def test_noise_keeps_an_execution_in_one_row(spark):
    """Metrics become rows after the executions are grouped; a metric without values has no row, one without repeats no scale."""
    data = [("A", "t", 0, 1.0, None, 5.0), ("A", "t", 0, 2.0, None, 5.0), ("A", "t", 1, 4.0, None, None), ("A", None, None, 1.0, None, 1.0),
            ("A", None, None, 5.0, None, None), (None, "t", 0, 3.0, 1.0, None)]
    df = spark.createDataFrame(data, "arm string, task_id string, seed int, x double, y double, z double")
    noise = G.noise_scale(df, ["arm"], ["x", "y", "z"])
    plan = noise._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Aggregate") and plan.count("Generate") == 1
    got = {(r["arm"], r["metric"]): r["noise_scale"] for r in rows(noise)}
    assert got == {("A", "x"): pytest.approx((0.5**0.5 + 8**0.5) / 2), ("A", "z"): 0.0, (None, "x"): None, (None, "y"): None}


def test_within_cluster_std(spark):
    df = spark.createDataFrame([("t1", 1.0), ("t1", 1.0)], "c string, v double")
    assert one(G.within_cluster_std(df, [], ["c"], "v"))["within_cluster_std"] == 0
    assert one(G.within_cluster_std(df.limit(1), [], ["c"], "v"))["within_cluster_std"] is None


@pytest.mark.parametrize("mean, excludes, noise, label", [
    (None, None, 1.0, "insufficient_data"), (1.0, True, None, "ci_only"), (1.0, False, None, "insufficient_data"),
    (5.0, False, 1.0, "below_noise"), (1.0, True, 0.0, "comparable"), (3.0, True, 1.0, "clearly_larger"), (-2.0, True, 1.0, "comparable"),
])
def test_effect_labels(spark, mean, excludes, noise, label):
    df = spark.createDataFrame([(mean, excludes, noise)], "m double, x boolean, n double")
    assert one(df.select(C.classify_effect(F.col("m"), F.col("x"), F.col("n")).alias("l")))["l"] == label


def test_histogram_counts_everything(spark):
    out = rows(G.histogram(frame(spark, range(101)), [], "v"), "bin")
    assert len(out) == 20 and sum(r["n"] for r in out) == 101 and out[-1]["n"] == 6 and out[-1]["bin_high"] == 100
    values = [i * 0.05 for i in range(7)] + [i * 0.015 for i in range(21)]
    want, _ = np.histogram(values, bins=20)
    assert [r["n"] for r in rows(G.histogram(frame(spark, values), [], "v"), "bin")] == want.tolist()
    flat = rows(G.histogram(frame(spark, [3, 3, 3]), [], "v"), "bin")
    assert sum(r["n"] for r in flat) == 3 and flat[0]["bin_low"] == 2.5
