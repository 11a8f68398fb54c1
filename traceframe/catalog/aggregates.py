from pyspark.sql import functions as F

from ..functions.quantiles import exact_quantiles
from ..functions.status import SCORABLE_OUTCOMES
from ..operators import aggregates as G
from ..operators import draws as D
from ..operators.pairing import select_checkpoints
from .registry import query
from .scalars import GOLD, STATUS_SQL, classified
from .sequences import summary_sql

FORCED = ["correct", "scorable_incorrect", "unparseable", "censored", "error"]


@query("summarize", f"""WITH long AS (SELECT condition_id, arm, 'total_tokens' AS metric, CAST(total_tokens AS DOUBLE) AS value FROM records
  UNION ALL SELECT condition_id, arm, 'wall_ms', wall_ms FROM records UNION ALL SELECT condition_id, arm, 'ttft_ms', ttft_ms FROM records)
SELECT * REPLACE (round(min, 6) AS min, round(max, 6) AS max) FROM ({summary_sql('long', 'condition_id, arm')}) s""")
def _(t):
    return G.summarize_metrics(t("records"), ["condition_id", "arm"], ["total_tokens", "wall_ms", "ttft_ms"])


@query("cluster_means", """SELECT arm, task_id, round(avg(degeneration_onset_index), 6) AS cluster_mean, count(degeneration_onset_index) AS cluster_n
FROM records WHERE degeneration_onset_index IS NOT NULL GROUP BY 1, 2""")
def _(t):
    return G.cluster_means(t("records"), ["arm"], "task_id", "degeneration_onset_index")


@query("macro_mean", """SELECT arm, family, round(avg(m), 6) AS macro_mean, count(*) AS n_clusters FROM (
  SELECT arm, family, task_id, avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END) AS m FROM records GROUP BY ALL) x GROUP BY 1, 2""")
def _(t):
    rows = t("records").withColumn("hit", F.col("correct").cast("double"))
    return G.macro_mean(rows, ["arm", "family"], "task_id", "hit")


@query("termination_counts", f"""SELECT arm, label, count(*) AS n FROM (SELECT arm, unnest([
  'status:' || {STATUS_SQL}, CASE WHEN terminated_by_eos THEN 'natural_eos' WHEN capped THEN 'capped_length' ELSE 'error_or_other' END,
  CASE WHEN eos_observed THEN 'eos_observed' END, CASE WHEN think_end_reached THEN 'think_end_reached' END,
  CASE WHEN missing_answer THEN 'missing_answer' END]) AS label FROM records) x WHERE label IS NOT NULL GROUP BY 1, 2""")
def _(t):
    return G.termination_counts(t("records"), ["arm"])


ST = f"(SELECT *, {STATUS_SQL} AS st FROM records)"
BUDGET = """count(*) AS n_attempted, count(*) FILTER (terminated_by_eos) AS n_completed,
  count(answer_normalized) AS n_answer_observed, count(*) FILTER (st = 'censored') AS n_censored, count(*) FILTER (st = 'error') AS n_error,
  count(*) FILTER (st = 'unparseable') AS n_unparseable, count(*) FILTER (st = 'terminated_no_closure') AS n_terminated_no_closure,
  round(count(*) FILTER (correct) / count(*), 6) AS success_at_budget, round(count(*) FILTER (terminated_by_eos) / count(*), 6) AS completion_rate,
  round(count(*) FILTER (terminated_by_eos AND answer_normalized IS NOT NULL AND correct) /
     nullif(count(*) FILTER (terminated_by_eos AND answer_normalized IS NOT NULL), 0), 6) AS conditional_accuracy_given_completed,
  round(count(*) FILTER (answer_normalized IS NOT NULL AND correct) / nullif(count(answer_normalized), 0), 6) AS answer_observed_accuracy,
  round(count(*) FILTER (st = 'censored') / count(*), 6) AS censored_rate, round(count(*) FILTER (st = 'error') / count(*), 6) AS error_rate,
  round(count(*) FILTER (st = 'unparseable') / count(*), 6) AS unparseable_rate,
  round(count(answer_normalized) / count(*), 6) AS answer_observation_rate"""


@query("budget_metrics", f"SELECT arm, condition_id, family, {BUDGET} FROM {ST} r GROUP BY 1, 2, 3")
def _(t):
    return G.budget_metrics(t("records"), ["arm", "condition_id", "family"])


CATEGORIES = """count(*) AS n, count(*) FILTER (think_end_reached) AS native_reasoning_closures, count(*) FILTER (terminated_by_eos) AS eos_terminations,
  count(*) FILTER (think_end_reached AND capped) AS budget_exhausted_after_closure, count(*) FILTER (st = 'censored') AS censored,
  count(*) FILTER (st = 'terminated_no_closure') AS terminated_no_closure, count(*) FILTER (st = 'unparseable') AS unparseable,
  count(*) FILTER (st = 'error') AS errors, count(*) FILTER (NOT missing_answer) AS raw_answer_present, count(answer_normalized) AS observed_answers,
  count(*) FILTER (correct) AS correct_answers, count(*) FILTER (answer_normalized IS NOT NULL AND NOT correct) AS scorable_incorrect"""


@query("category_counts", f"SELECT arm, difficulty, {CATEGORIES} FROM {ST} r GROUP BY 1, 2")
def _(t):
    return G.category_counts(t("records"), ["arm", "difficulty"])


@query("family_reconciliation", f"""SELECT condition_id, family, {CATEGORIES} FROM {ST} r GROUP BY 1, 2
UNION ALL SELECT condition_id, 'ALL', {CATEGORIES} FROM {ST} r GROUP BY 1""")
def _(t):
    return G.family_reconciliation(t("records"))


WIDE = ["reasoning_tokens", "answer_tokens", "total_tokens", "unique_token_ratio", "repeated_ngram_fraction_4", "text_repeat_ratio"]
TIMES = ["wall_ms", "tokens_per_sec", "ttft_ms"]


def wide_sql(metrics):
    return ", ".join(
        f"round(avg({m}), 6) AS {m}_mean, round(quantile_cont({m}, 0.5), 6) AS {m}_median, round(stddev_samp({m}), 6) AS {m}_std, "
        f"round(quantile_cont({m}, 0.9), 6) AS {m}_p90" for m in metrics)


@query("condition_summary", f"""WITH tagged AS (SELECT *, total_tokens * 1000 / wall_ms AS tokens_per_sec,
  row_number() OVER (PARTITION BY arm, presentation_id, condition_id, seed ORDER BY repeat, trial_id) AS rn,
  min(array_to_string(tokens, ' ')) OVER (PARTITION BY arm, presentation_id, condition_id, seed) <>
  max(array_to_string(tokens, ' ')) OVER (PARTITION BY arm, presentation_id, condition_id, seed) AS amb, {STATUS_SQL} AS st FROM records),
c AS (SELECT condition_id, count(*) AS n_executions, count(*) FILTER (rn = 1) AS n_unique_draws, count(*) FILTER (rn = 1 AND NOT amb) AS n_primary_draws,
  count(*) FILTER (rn = 1 AND amb) AS n_ambiguous_draws, {wide_sql(TIMES)} FROM tagged GROUP BY 1),
p AS (SELECT condition_id, {BUDGET}, {wide_sql(WIDE)} FROM tagged WHERE rn = 1 AND NOT amb GROUP BY 1),
k AS (SELECT condition_id, count(*) AS n_tasks, round(avg(m), 6) AS success_macro_mean FROM (SELECT condition_id, task_id,
  avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END) AS m FROM tagged WHERE rn = 1 AND NOT amb GROUP BY ALL) x GROUP BY 1)
SELECT * FROM c JOIN p USING (condition_id) JOIN k USING (condition_id)""")
def _(t):
    records = t("records").withColumn("tokens_per_sec", F.col("total_tokens") * 1000 / F.col("wall_ms"))
    keep = ["task_id", "finish_reason", "capped", "terminated_by_eos", "think_end_reached", "missing_answer", "error_type",
            "answer_normalized", "correct", *WIDE]
    draws = D.collapse_draws(records, ["arm", *D.DRAW_KEY], keep=keep, divergence=False)
    return G.condition_summary(draws, records)


@query("within_cluster_std", """SELECT arm, round(avg(s), 6) AS within_cluster_std FROM (SELECT arm, task_id, stddev_samp(wall_ms) AS s
  FROM records GROUP BY ALL HAVING count(wall_ms) > 1) x GROUP BY 1""")
def _(t):
    return G.within_cluster_std(t("records"), ["arm"], ["task_id"], "wall_ms")


@query("noise_scale", """SELECT arm, metric, round(avg(s), 6) AS noise_scale FROM (
  SELECT arm, metric, task_id, seed, stddev_samp(value) AS s FROM (
    SELECT arm, task_id, seed, 'wall_ms' AS metric, wall_ms AS value FROM records
    UNION ALL SELECT arm, task_id, seed, 'ttft_ms', ttft_ms FROM records
    UNION ALL SELECT arm, task_id, seed, 'total_tokens', total_tokens FROM records) l
  WHERE value IS NOT NULL GROUP BY ALL HAVING count(*) > 1) x GROUP BY 1, 2""")
def _(t):
    return G.noise_scale(t("records"), ["arm"], ["wall_ms", "ttft_ms", "total_tokens"])


@query("combine_noise", """WITH s AS (SELECT family, arm, avg(s) AS s FROM (SELECT family, arm, task_id, stddev_samp(wall_ms) AS s FROM records
  GROUP BY ALL) x GROUP BY 1, 2)
SELECT family, round(greatest(max(s) FILTER (arm = 'A'), max(s) FILTER (arm = 'B')), 6) AS noise_scale FROM s GROUP BY 1""")
def _(t):
    per_arm = G.within_cluster_std(t("records"), ["family", "arm"], ["task_id"], "wall_ms")
    wide = per_arm.groupBy("family").pivot("arm", ["A", "B"]).agg(F.first("within_cluster_std"))
    return wide.select("family", G.combine_noise(F.col("A"), F.col("B")).alias("noise_scale"))


@query("outcome_by_checkpoint", f"""SELECT arm, checkpoint_label, count(*) AS n_eligible, {', '.join(f"count(*) FILTER (outcome = '{o}') AS n_{o}" for o in FORCED)},
  round(count(*) FILTER (outcome = 'correct') / count(*), 6) AS recoverable_correct_rate,
  round(count(*) FILTER (outcome IN {tuple(SCORABLE_OUTCOMES)}) / count(*), 6) AS scorable_answer_rate FROM selected GROUP BY 1, 2""")
def _(t):
    return G.outcome_by_checkpoint(select_checkpoints(t("probes")))


@query("histogram", """WITH b AS (SELECT condition_id, min(total_tokens) AS lo, max(total_tokens) AS hi FROM records GROUP BY 1),
e AS (SELECT condition_id, lo, hi, CAST(bin AS INT) AS bin FROM b, range(0, 20) r(bin)),
p AS (SELECT condition_id, total_tokens AS v, lo, (hi - lo) / 20.0 AS w, CAST(least(floor((total_tokens - lo) / ((hi - lo) / 20.0)), 19) AS INT) AS k FROM records JOIN b USING (condition_id)),
c AS (SELECT condition_id, CASE WHEN v < lo + w * k THEN k - 1 WHEN k < 19 AND v >= lo + w * (k + 1) THEN k + 1 ELSE k END AS bin, count(*) AS n FROM p GROUP BY ALL)
SELECT condition_id, CAST(bin AS BIGINT) AS bin, round(lo + (hi - lo) / 20.0 * bin, 6) AS bin_low, round(lo + (hi - lo) / 20.0 * (bin + 1), 6) AS bin_high, coalesce(n, 0) AS n
FROM e LEFT JOIN c USING (condition_id, bin)""")
def _(t):
    return G.histogram(t("records"), ["condition_id"], "total_tokens")


@query("lane_overhead", """WITH s AS (SELECT l_returnflag AS lane, count(*) AS n, median(l_extendedprice) AS w, median(l_tax) AS f, median(l_quantity) AS o,
  stddev_pop(l_quantity) AS os, median(d) AS dm, quantile_cont(d, 0.75) - quantile_cont(d, 0.25) AS iqr FROM
  (SELECT *, CASE WHEN l_linenumber > 1 THEN l_extendedprice / l_quantity END AS d FROM lineitem) l GROUP BY 1),
b AS (SELECT dm AS bd, w AS bw FROM s WHERE lane = 'A')
SELECT lane, n, round(w, 6) AS wall_ms_median, round(f, 6) AS ttft_ms_median, round(o, 6) AS output_tps_median, round(os, 6) AS output_tps_std,
  round(dm, 6) AS decode_tps_median, round(iqr, 6) AS decode_tps_iqr, round((bd - dm) / bd, 6) AS decode_overhead_fraction,
  round((w - bw) / bw, 6) AS wall_overhead_fraction FROM s, b""")
def _(t):
    items = t("lineitem").withColumn("d", F.when(F.col("l_linenumber") > 1, F.col("l_extendedprice") / F.col("l_quantity")))
    return G.lane_overhead(items, "l_returnflag", "A", {
        "wall_ms": "l_extendedprice", "ttft_ms": "l_tax", "output_tps": "l_quantity", "decode_tps": "d"})


@query("budget_diagnostic", f"""WITH p AS (SELECT *, CASE WHEN probe_error IS NOT NULL THEN 'error' WHEN finish_reason = 'length' AND NOT eos_observed THEN 'censored'
   WHEN norm IS NULL THEN 'unparseable' WHEN norm = canon THEN 'correct' ELSE 'scorable_incorrect' END AS outcome,
   CAST(CASE WHEN k < 50 THEN 256 ELSE 512 END AS BIGINT) AS probe_max_tokens FROM ({GOLD}) g)
SELECT family, probe_max_tokens, count(*) AS n, {', '.join(f"count(*) FILTER (outcome = '{o}') AS n_{o}" for o in FORCED)},
  count(*) FILTER (probe_error IS NULL AND norm IS NOT NULL) AS n_scorable, count(*) FILTER (probe_error IS NULL AND raw IS NOT NULL) AS n_observed,
  count(*) FILTER (eos_observed) AS n_eos FROM p GROUP BY 1, 2""")
def _(t):
    probes = classified(t).withColumn("probe_max_tokens", F.when(F.col("k") < 50, 256).otherwise(512))
    return G.budget_diagnostic(probes, ["family"])


@query("exact_quantiles", """SELECT condition_id, round(quantile_cont(wall_ms, 0.25), 6) AS q1, round(quantile_cont(wall_ms, 0.999), 6) AS q999
FROM records GROUP BY 1""")
def _(t):
    return exact_quantiles(t("records"), ["condition_id"], "wall_ms", {"q1": 0.25, "q999": 0.999})


