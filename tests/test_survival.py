import numpy as np
import pytest
from conftest import one, rows
from pyspark.sql import functions as F

from traceframe.functions import resampling as R
from traceframe.functions import ranges
from traceframe.functions.ranges import ranged
from traceframe.plans import survival as S


def obs(spark, pairs, **extra):
    df = spark.createDataFrame([(float(t), bool(e)) for t, e in pairs], "time double, event boolean")
    for name, value in extra.items():
        df = df.withColumn(name, F.lit(value))
    return df


@pytest.mark.parametrize("pairs, survival, median, tau, area", [
    ([(1, 1), (2, 1), (3, 1), (4, 1)], [0.75, 0.5, 0.25, 0.0], 2, 4, 2.5),
    ([(5, 0), (5, 0)], [1.0], None, 5, 5.0),
    ([(2, 1), (4, 0)], [0.5, 0.5], 2, 4, 3.0),
    ([(3, 1), (3, 0)], [0.5], 3, 3, 3.0),
    ([(1, 1), (10, 1)], [0.5, 0.0], 1, 2, 1.5),
    ([(50, 1)], [0.0], 50, 50, 50.0),
    ([(50, 1)], [0.0], 50, 100, 50.0),
])
def test_known_curves(spark, pairs, survival, median, tau, area):
    df = obs(spark, pairs, g="x")
    curve = rows(S.kaplan_meier(df, ["g"]), "time")
    assert [r["survival"] for r in curve] == pytest.approx(survival)
    summary = one(S.survival_summary(df, ["g"], float(tau)))
    assert summary["median"] == median
    assert summary["rmst"] == pytest.approx(area)
    assert summary["n"] == len(pairs)


def test_no_area_for_non_positive_tau(spark):
    assert one(S.rmst(obs(spark, [(1, 1)], g="x"), ["g"], 0.0))["rmst"] is None


def test_blocks_do_not_change_the_curve(spark):
    df = spark.range(4000).select(
        ((F.col("id") * 7919) % 1013).cast("double").alias("time"), ((F.col("id") * 31) % 3 > 0).alias("event"),
        F.when(F.col("id") % 3 == 0, "small").alias("g"))  # the null stratum holds most rows
    life = S.life_table(df, ["g"])
    wide = rows(S.product_limit(life, ["g"]), "g", "time")
    narrow = rows(S.product_limit(life, ["g"], per_range=16), "g", "time")
    assert [(r["g"], r["time"], r["at_risk"]) for r in wide] == [(r["g"], r["time"], r["at_risk"]) for r in narrow]
    assert [r["survival"] for r in wide] == pytest.approx([r["survival"] for r in narrow], abs=1e-12)


def test_close_times_of_one_stratum_are_spread(spark, monkeypatch):
    """A million different times between 0 and 1 in one stratum: ranges are even, and the curve is that of the formula."""
    monkeypatch.setattr(ranges, "PER_RANGE", 50_000)
    n = 1_000_000
    life = spark.range(n).select((F.col("id") / n).alias("time"), F.lit(1).cast("bigint").alias("__n"), (F.col("id") % 2).alias("__d"), F.lit("x").alias("g"))
    sizes = [r["n"] for r in rows(ranged(life, ["g"], "time", "times").groupBy("g", "__range").agg(F.count("*").alias("n")))]
    assert len(sizes) >= 15 and max(sizes) < 3 * n / len(sizes)
    whole = S.product_limit(life, ["g"])
    at = {r["time"]: r for r in rows(whole.where("time IN (0.25, 0.75)"))}
    ids = np.arange(n)
    survival = np.cumprod(np.where(ids % 2, 1 - 1 / (n - ids), 1.0))
    for time in (0.25, 0.75):
        assert at[time]["at_risk"] == n - int(time * n) and at[time]["survival"] == pytest.approx(survival[int(time * n)], rel=1e-9)


def naive_rmst(observations, tau):
    """Area under the product-limit curve of (time, event, weight)."""
    area, survival, last = 0.0, 1.0, 0.0
    for t in sorted({t for t, _, w in observations if w}):
        if t > tau:
            break
        area, last = area + survival * (t - last), t
        at_risk = sum(w for s, _, w in observations if s >= t)
        survival *= 1 - sum(w for s, e, w in observations if s == t and e) / at_risk
    return area + survival * (tau - last)


@pytest.mark.parametrize("block", [4, 1024])
def test_replicates_against_a_naive_area(spark, monkeypatch, block):
    """Every replicate, weighted by the drawn clusters; small blocks and slices give the same; one cluster holds a third of the rows."""
    monkeypatch.setattr(R, "BLOCK", block)
    monkeypatch.setattr(S, "BLOCK", block)
    monkeypatch.setattr(S, "SLICE", 7)
    monkeypatch.setattr(S, "CHUNK", 3)
    rng = np.random.default_rng(2)
    data = [(f"t{0 if rng.random() < 0.3 else rng.integers(0, 11)}", "AB"[rng.integers(0, 2)], float(rng.integers(1, 20)), bool(rng.random() < 0.7), g)
            for g in ("x", None) for _ in range(160)]
    df = spark.createDataFrame(data, "task_id string, arm string, time double, event boolean, g string")
    cells = S.life_table(df.withColumnRenamed("task_id", "__cl").withColumnRenamed("arm", "__arm"), ["g", "__cl", "__arm"])
    shared = cells.groupBy("g", "__cl").agg(F.count_distinct("__arm").alias("k")).where("k = 2").drop("k")
    areas = rows(S.replicate_areas(S.replicate_steps(cells, shared, ["g"], ("A", "B"), 8, 0), ["g"], 12.0))
    drawn = {(r["g"], r["__cl"], r["replicate"]): r["weight"] for r in rows(R.bootstrap_weights(shared, ["g"], "__cl", 8, 0))}
    assert len(areas) == 2 * 2 * 8
    for r in areas:
        arm = "AB"[r["__side"]]
        mine = [(t, e, drawn.get((g, c, r["replicate"]), 0)) for c, a, t, e, g in data if a == arm and g == r["g"]]
        assert r["rmst"] == pytest.approx(naive_rmst(mine, 12.0))
    out = one(S.rmst_delta_bootstrap(df.where("g = 'x'"), 12.0, n_resamples=8))
    deltas = {k: {r["__side"]: r["rmst"] for r in areas if r["g"] == "x" and r["replicate"] == k} for k in range(8)}
    assert out["mean"] == pytest.approx(np.mean([d[0] - d[1] for d in deltas.values()])) and out["n_resamples_used"] == 8


def test_small_families_get_no_estimate(spark):
    df = obs(spark, [(1, 1), (2, 1)], family="big").unionByName(obs(spark, [(3, 1)], family="tiny"))
    out = {r["family"]: r for r in rows(S.survival_by_family(df, "family", 4.0))}
    assert out["tiny"]["insufficient_data"] and out["tiny"]["rmst"] is None
    assert not out["big"]["insufficient_data"] and out["big"]["rmst"] == pytest.approx(1.5)


@pytest.mark.parametrize("scheme", ["multinomial", "poisson"])
def test_identical_arms_have_no_delta(spark, scheme):
    base = spark.range(60).select((F.col("id") % 12).cast("string").alias("task_id"),
                                  (F.col("id") % 7 + 1).cast("double").alias("time"), (F.col("id") % 4 > 0).alias("event"))
    both = base.withColumn("arm", F.lit("A")).unionByName(base.withColumn("arm", F.lit("B")))
    out = one(S.rmst_delta_bootstrap(both, 6.0, n_resamples=40, scheme=scheme))
    assert out["n_clusters"] == 12 and out["point"] == pytest.approx(0) and out["lo"] == pytest.approx(0)
    assert not out["excludes_zero"]


def test_no_shared_cluster_gives_a_row_without_estimates(spark):
    df = spark.createDataFrame([("g", "A", "t1", 1.0, True), ("g", "B", "t2", 2.0, True)], "g string, arm string, task_id string, time double, event boolean")
    for by in ([], ["g"]):
        out = one(S.rmst_delta_bootstrap(df, 3.0, n_resamples=5, by=by))
        assert out["n_clusters"] == 0 and out["point"] is None and out["lo"] is None


def test_endpoint_times(spark):
    df = spark.createDataFrame([("c", 100, 140, True, True), ("c", 2048, 2048, False, False), ("c", 10, 12, False, True)],
                               "condition_id string, reasoning_tokens bigint, total_tokens bigint, think_end_reached boolean, terminated_by_eos boolean")
    times = rows(S.endpoint_observations(df, ["condition_id"]), "endpoint", "time")
    assert [(r["endpoint"], r["time"], r["event"]) for r in times] == [
        ("generation_termination", 12.0, True), ("generation_termination", 140.0, True), ("generation_termination", 2048.0, False),
        ("reasoning_closure", 12.0, False), ("reasoning_closure", 101.0, True), ("reasoning_closure", 2048.0, False)]
    out = {r["endpoint"]: r for r in rows(S.survival_endpoints(df, 2048.0))}
    assert out["reasoning_closure"]["n_competing"] == 1 and out["reasoning_closure"]["n_events"] == 1
