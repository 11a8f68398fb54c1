from pyspark.sql import functions as F

from ..operators.pairing import pair_records, paired_draws, paired_population
from ..operators.population import PROJECTION, population_audit
from ..plans import comparison as C
from .population import KEYS, PAIRS
from .registry import query
from .scalars import STATUS_SQL
from .shared_sql import resample_means

R = PANEL_R = 2000


def ci_sql(groups):
    g = f"{groups}, " if groups else ""
    return f"""ci AS (SELECT {g}quantile_cont(estimate, 0.025) AS lo, quantile_cont(estimate, 0.975) AS hi FROM reps GROUP BY {groups or 'ALL'})"""


@query("bootstrap_ci", f"""WITH vals AS (SELECT 'all' AS g, task_id AS cl, avg(time) AS v FROM obs GROUP BY task_id), {resample_means('g', R)}, {ci_sql('g')},
s AS (SELECT g, count(*) AS n, avg(v) AS mean FROM vals GROUP BY 1) SELECT n, round(mean, 6) AS mean, round(lo, 6) AS lo, round(hi, 6) AS hi FROM s JOIN ci USING (g)""")
def _(t):
    values = t("obs").groupBy("task_id").agg(F.avg("time").alias("v"))
    return C.bootstrap_ci(values, [], "task_id", "v", n_resamples=R)


@query("paired_bootstrap_delta", f"""WITH vals AS (SELECT family, task_id AS cl, avg(time) FILTER (arm = 'A') - avg(time) FILTER (arm = 'B') AS v FROM obs GROUP BY ALL),
{resample_means('family', R)}, {ci_sql('family')}, s AS (SELECT family, count(*) AS n, avg(v) AS mean FROM vals GROUP BY 1)
SELECT family, n, round(mean, 6) AS mean, round(lo, 6) AS lo, round(hi, 6) AS hi, (lo > 0 OR hi < 0) AS excludes_zero FROM s JOIN ci USING (family)""")
def _(t):
    wide = t("obs").groupBy("family", "task_id").agg(
        F.avg(F.when(F.col("arm") == "A", F.col("time"))).alias("a"), F.avg(F.when(F.col("arm") == "B", F.col("time"))).alias("b"))
    return C.paired_bootstrap_delta(wide, ["family"], "task_id", "a", "b", n_resamples=R)


@query("cluster_bootstrap_ci", f"""WITH vals AS (SELECT condition_id, task_id AS cl, avg(ttft_ms) AS v, count(ttft_ms) AS c FROM records WHERE ttft_ms IS NOT NULL GROUP BY ALL),
{resample_means('condition_id', R)}, {ci_sql('condition_id')},
s AS (SELECT condition_id, count(*) AS n_clusters, CAST(sum(c) AS BIGINT) AS n_obs, avg(v) AS mean FROM vals GROUP BY 1)
SELECT condition_id, n_clusters, n_obs, round(mean, 6) AS mean, round(lo, 6) AS lo, round(hi, 6) AS hi FROM s JOIN ci USING (condition_id)""")
def _(t):
    return C.cluster_bootstrap_ci(t("records"), ["condition_id"], "task_id", "ttft_ms", n_resamples=R)


def paired_sql(groups, source, value, cluster="task_id"):
    return f"""cells AS (SELECT {groups}, {cluster} AS cl, avg({value}) FILTER (arm = 'A') AS a, avg({value}) FILTER (arm = 'B') AS b,
    count({value}) FILTER (arm IN ('A', 'B')) AS c FROM {source} WHERE {value} IS NOT NULL GROUP BY ALL),
  vals AS (SELECT {groups}, cl, a - b AS v FROM cells WHERE a IS NOT NULL AND b IS NOT NULL),
  {resample_means(groups, R)}, {ci_sql(groups)},
  s AS (SELECT {groups}, count(a - b) AS n_clusters, CAST(sum(c) AS BIGINT) AS n_obs, avg(a - b) AS mean,
    count(DISTINCT round(a - b, 9)) AS nd FROM cells GROUP BY {groups})"""


@query("paired_cluster_bootstrap", f"""WITH {paired_sql('condition_id', 'records', 'wall_ms')}
SELECT condition_id, n_clusters, n_obs, round(mean, 6) AS mean, round(lo, 6) AS lo, round(hi, 6) AS hi, (lo > 0 OR hi < 0) AS excludes_zero FROM s JOIN ci USING (condition_id)""")
def _(t):
    return C.paired_cluster_bootstrap(t("records"), ["condition_id"], "task_id", "wall_ms", n_resamples=R)


@query("degenerate_guard", f"""WITH z AS (SELECT arm, task_id, family, CASE WHEN family = 'logic' THEN 1.0 ELSE time END AS v FROM (
    SELECT arm, task_id, CASE WHEN task_id IN ('task-1', 'task-2') THEN 'logic' ELSE family END AS family, time FROM obs) o),
  {paired_sql('family', 'z', 'v')}
SELECT family, n_clusters, n_obs, round(mean, 6) AS mean, nd < 2 AS degenerate, CASE WHEN nd >= 2 THEN round(lo, 6) END AS lo,
  CASE WHEN nd >= 2 THEN round(hi, 6) END AS hi, CASE WHEN nd >= 2 THEN (lo > 0 OR hi < 0) END AS excludes_zero FROM s JOIN ci USING (family)""")
def _(t):
    obs = t("obs").withColumn("family", F.when(F.col("task_id").isin("task-1", "task-2"), "logic").otherwise(F.col("family")))
    obs = obs.withColumn("v", F.when(F.col("family") == "logic", 1.0).otherwise(F.col("time")))
    return C.paired_cluster_bootstrap(obs, ["family"], "task_id", "v", n_resamples=R, guard=True)


@query("classify_effect", """WITH e AS (SELECT trial_id, CASE WHEN wall_ms > 3000 THEN unique_token_ratio - 0.95 END AS m, repeated_ngram_fraction_4 > 0.02 AS x,
  CASE WHEN reasoning_tokens > 60 THEN text_repeat_ratio END AS noise FROM records)
SELECT trial_id, CASE WHEN m IS NULL THEN 'insufficient_data' WHEN noise IS NULL THEN CASE WHEN x THEN 'ci_only' ELSE 'insufficient_data' END
  WHEN NOT x THEN 'below_noise' WHEN noise <= 0 THEN 'comparable' WHEN abs(m) > 2 * noise THEN 'clearly_larger' ELSE 'comparable' END AS classification FROM e""")
def _(t):
    mean = F.when(F.col("wall_ms") > 3000, F.col("unique_token_ratio") - 0.95)
    noise = F.when(F.col("reasoning_tokens") > 60, F.col("text_repeat_ratio"))
    return t("records").select(
        "trial_id", C.classify_effect(mean, F.col("repeated_ngram_fraction_4") > 0.02, noise).alias("classification"))


METRIC_SQL = {
    "success_at_budget": "CASE WHEN correct THEN 1.0 ELSE 0.0 END",
    "reasoning_closure_rate": "CASE WHEN think_end_reached THEN 1.0 ELSE 0.0 END",
    "completion_rate": "CASE WHEN terminated_by_eos THEN 1.0 ELSE 0.0 END",
    "censored_rate": "CASE WHEN st = 'censored' THEN 1.0 ELSE 0.0 END",
    "error_rate": "CASE WHEN st = 'error' THEN 1.0 ELSE 0.0 END",
    "answer_observation_rate": "CASE WHEN answer_normalized IS NOT NULL THEN 1.0 ELSE 0.0 END",
    "conditional_accuracy_given_completed": "CASE WHEN terminated_by_eos AND answer_normalized IS NOT NULL THEN CASE WHEN correct THEN 1.0 ELSE 0.0 END END",
    "reasoning_tokens": "reasoning_tokens", "total_tokens": "total_tokens", "wall_ms": "wall_ms",
    "repeated_ngram_fraction_4": "repeated_ngram_fraction_4", "unique_token_ratio": "unique_token_ratio",
    "longest_run_length": "longest_run_length", "terminated_by_eos": "CASE WHEN terminated_by_eos THEN 1.0 ELSE 0.0 END",
    "missing_answer": "CASE WHEN missing_answer THEN 1.0 ELSE 0.0 END",
}


def long_sql(source):
    return " UNION ALL ".join(
        f"SELECT arm, task_id, seed, '{m}' AS metric, CAST({x} AS DOUBLE) AS value FROM {source}" for m, x in METRIC_SQL.items())


PANEL = f"""{PAIRS}, st AS (SELECT *, {STATUS_SQL} AS st FROM records),
used AS (SELECT rep_a AS trial_id FROM pairs WHERE NOT ambiguous_a AND NOT ambiguous_b UNION ALL SELECT rep_b FROM pairs WHERE NOT ambiguous_a AND NOT ambiguous_b),
sel AS (SELECT st.* FROM st JOIN used USING (trial_id)),
lng AS ({long_sql('sel')}), raw AS ({long_sql('st')}),
pc AS (SELECT metric, task_id AS cl, avg(value) FILTER (arm = 'A') AS a, avg(value) FILTER (arm = 'B') AS b FROM lng WHERE value IS NOT NULL GROUP BY ALL),
vals AS (SELECT metric, cl, a - b AS v FROM pc WHERE a - b IS NOT NULL), {resample_means('metric', PANEL_R)}, {ci_sql('metric')},
s AS (SELECT metric, count(a - b) AS n_clusters, avg(a - b) AS mean FROM pc GROUP BY 1),
nz AS (SELECT metric, max(ns) FILTER (arm = 'A') AS noise_scale_a, max(ns) FILTER (arm = 'B') AS noise_scale_b FROM (
  SELECT metric, arm, avg(sd) AS ns FROM (SELECT metric, arm, task_id, seed, stddev_samp(value) AS sd FROM raw WHERE value IS NOT NULL
    GROUP BY ALL HAVING count(*) > 1) q GROUP BY 1, 2) w GROUP BY 1),
br AS (SELECT metric, count(value) AS n_obs, count(*) FILTER (arm = 'A') AS n_a, avg(value) FILTER (arm = 'A') AS mean_a,
  coalesce(stddev_samp(value) FILTER (arm = 'A'), 0.0) AS std_a, count(*) FILTER (arm = 'B') AS n_b, avg(value) FILTER (arm = 'B') AS mean_b,
  coalesce(stddev_samp(value) FILTER (arm = 'B'), 0.0) AS std_b FROM lng WHERE value IS NOT NULL GROUP BY 1)
SELECT metric, n_clusters, n_obs, round(mean, 6) AS mean, round(lo, 6) AS lo, round(hi, 6) AS hi, (lo > 0 OR hi < 0) AS excludes_zero,
  round(noise_scale_a, 6) AS noise_scale_a, round(noise_scale_b, 6) AS noise_scale_b, round(greatest(noise_scale_a, noise_scale_b), 6) AS noise_scale,
  CASE WHEN greatest(noise_scale_a, noise_scale_b) IS NULL THEN CASE WHEN lo > 0 OR hi < 0 THEN 'ci_only' ELSE 'insufficient_data' END
    WHEN NOT (lo > 0 OR hi < 0) THEN 'below_noise' WHEN greatest(noise_scale_a, noise_scale_b) <= 0 THEN 'comparable'
    WHEN abs(mean) > 2 * greatest(noise_scale_a, noise_scale_b) THEN 'clearly_larger' ELSE 'comparable' END AS classification,
  n_a, round(mean_a, 6) AS mean_a, round(std_a, 6) AS std_a, n_b, round(mean_b, 6) AS mean_b, round(std_b, 6) AS std_b, (n_a > 0 AND n_b > 0) AS estimable
FROM s JOIN ci USING (metric) LEFT JOIN nz USING (metric) JOIN br USING (metric)"""


@query("metric_panel", f"WITH {PANEL}")
def _(t):
    return C.metric_panel(t("records"), n_resamples=PANEL_R)


@query("paired_precision", """WITH c AS (SELECT condition_id, task_id, avg(wall_ms) FILTER (arm = 'A') - avg(wall_ms) FILTER (arm = 'B') AS d FROM records GROUP BY ALL)
SELECT condition_id, count(d) AS n_clusters, round(stddev_samp(d), 6) AS sd_delta, round(stddev_samp(d) / sqrt(count(d)), 6) AS se,
  round(1.959964 * stddev_samp(d) / sqrt(count(d)), 6) AS ci_half_width FROM c GROUP BY 1""")
def _(t):
    return C.paired_precision(t("records"), ["condition_id"], "task_id", "wall_ms")


# ---- several pairs in one job ---------------------------------------------------------------------------------
# (label, run of arm A, run of arm B, mode); a run is an arm at a difficulty
STUDIES = [("calibration", "A-easy", "B-easy", None), ("extension", "A-medium", "B-medium", None), ("replication", "A-hard", "B-hard", None)]
COMPARED = [("sampled", "A-easy", "B-easy", "sampled"), ("greedy", "A-easy", "B-easy", "greedy"), ("swapped", "B-hard", "A-hard", "sampled"),
            ("all", "A-medium", "B-medium", None), ("alone", "A-easy", "B-none", None)]


def pair_sql(body, pairs=COMPARED, label="pair_id", more=""):
    """The query `body` over `records`, once for every pair, with the pair's records in its place."""
    parts = []
    for name, run_a, run_b, mode in pairs:
        rows = " UNION ALL ".join(
            f"SELECT * REPLACE ('{arm}' AS arm) FROM records WHERE arm || '-' || difficulty = '{run}'" + (f" AND mode = '{mode}'" if mode else "")
            for arm, run in (("A", run_a), ("B", run_b)))
        parts.append(f"SELECT '{name}' AS {label}, * FROM (WITH records AS (SELECT * FROM ({rows}) r) {body}) p {more}")
    return " UNION ALL ".join(parts)


def of_pairs(t, pairs=COMPARED):
    records = t("records").withColumn("run_id", F.concat_ws("-", "arm", "difficulty"))
    return pair_records(records, t.spark.createDataFrame(pairs, "pair_id string, run_a string, run_b string, mode string"))


STUDY = pair_sql(f", {PANEL}", STUDIES, "label", "WHERE metric = 'reasoning_closure_rate'")


@query("cross_study", f"""SELECT label, n_clusters, n_obs, mean AS closure_rate_delta, lo AS closure_rate_lo, hi AS closure_rate_hi, CAST(NULL AS DOUBLE) AS pooled
FROM ({STUDY}) s""")
def _(t):
    return C.cross_study(C.metric_panel(of_pairs(t, STUDIES), n_resamples=PANEL_R, by=["pair_id"]))


@query("pair_panels", pair_sql(f", {PANEL}", [c for c in COMPARED if c[0] != "alone"]) + f""" UNION ALL SELECT 'alone', metric, 0, 0, NULL, NULL, NULL, NULL,
  round(ns, 6), NULL, round(ns, 6), 'insufficient_data', 0, NULL, NULL, 0, NULL, NULL, false FROM (SELECT m.metric, n.ns FROM (SELECT DISTINCT metric FROM (
    {long_sql('(SELECT *, ' + STATUS_SQL + ' AS st FROM records)')}) x) m LEFT JOIN (
  SELECT metric, avg(sd) AS ns FROM (SELECT metric, task_id, seed, stddev_samp(value) AS sd FROM ({long_sql("(SELECT *, " + STATUS_SQL + " AS st FROM records WHERE arm = 'A' AND difficulty = 'easy')")}) y
    WHERE value IS NOT NULL GROUP BY ALL HAVING count(*) > 1) z GROUP BY 1) n USING (metric)) q""")
def _(t):
    return C.metric_panel(of_pairs(t), n_resamples=PANEL_R, by=["pair_id"])


@query("pair_populations", pair_sql(f""", {PAIRS} SELECT count(*) AS n_draws_a, count(*) AS n_draws_b,
  count(*) FILTER (NOT ambiguous_a) AS n_usable_draws_a, count(*) FILTER (NOT ambiguous_b) AS n_usable_draws_b,
  count(*) FILTER (NOT ambiguous_a AND NOT ambiguous_b) AS n_paired_draws, count(*) FILTER (ambiguous_a) AS n_ambiguous_a,
  count(*) FILTER (ambiguous_b) AS n_ambiguous_b, count(*) FILTER (NOT ambiguous_a AND ambiguous_b) AS n_unpaired_a,
  count(*) FILTER (NOT ambiguous_b AND ambiguous_a) AS n_unpaired_b FROM pairs HAVING count(*) > 0"""))
def _(t):
    return paired_population(paired_draws(of_pairs(t), ["trial_id"], by=["pair_id"]), ["pair_id"])


@query("pair_audits", pair_sql(f""", sides AS (SELECT presentation_id, condition_id, mode, seed, repeat, bool_or(arm = 'A') AS a, bool_or(arm = 'B') AS b,
    count(*) FILTER (arm = 'A') AS na, count(*) FILTER (arm = 'B') AS nb FROM records GROUP BY ALL),
  wanted AS (SELECT DISTINCT presentation_id, condition_id, mode, seed, repeat FROM records),
  trials AS (SELECT {KEYS}, bool_or(arm = 'A') AS a, bool_or(arm = 'B') AS b FROM records GROUP BY ALL)
SELECT (SELECT count(*) FROM records WHERE arm = 'A') AS observed_executions_a, (SELECT count(*) FROM records WHERE arm = 'B') AS observed_executions_b,
  (SELECT count(*) FROM trials WHERE a AND b) AS matched_pairs, (SELECT count(*) FROM wanted) AS expected_trials_a, (SELECT count(*) FROM wanted) AS expected_trials_b,
  count(*) FILTER (NOT a) AS missing_trials_a, count(*) FILTER (NOT b) AS missing_trials_b, CAST(0 AS BIGINT) AS unexpected_trials_a, CAST(0 AS BIGINT) AS unexpected_trials_b
FROM sides"""))
def _(t):
    # both arms declare what either of them holds
    records = of_pairs(t)
    wanted = records.select("pair_id", *PROJECTION).distinct().withColumn("arm", F.explode(F.array(F.lit("A"), F.lit("B"))))
    audit = population_audit(records, wanted, wanted.select("pair_id", "arm", "presentation_id").distinct(), by=["pair_id"])
    return audit.select("pair_id", "observed_executions_a", "observed_executions_b", "matched_pairs", *[
        f"{k}_trials_{s}" for k in ("expected", "missing", "unexpected") for s in "ab"])
