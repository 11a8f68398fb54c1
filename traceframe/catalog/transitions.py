from pyspark.sql import functions as F

from ..operators import aggregates as G
from ..operators import pairing as M
from ..operators import transitions as T
from ..functions.status import FORCED_OUTCOMES
from ..plans.recoverability import paired_recoverability
from .population import JOINT, PAIRS
from .registry import query
from .scalars import STATUS_SQL
from .shared_sql import resample_means

DRAW = ["arm", "task_id", "seed"]
D = ", ".join(DRAW)


def runs_sql(source, correct, order, label):
    return f"""ob AS (SELECT {D}, {correct} AS c, {label} AS lab, row_number() OVER w - 1 AS i,
    {correct} <> lag({correct}) OVER w AS flip FROM {source} WINDOW w AS (PARTITION BY {D} ORDER BY {order})),
  ag AS (SELECT {D}, count(*) AS n, count(*) FILTER (flip) AS flips, count(*) FILTER (c) AS hits, max(i) AS last_i,
    min(i) FILTER (c) AS fc, coalesce(max(i) FILTER (NOT c), -1) AS lw FROM ob GROUP BY {D}),
  rn AS (SELECT ag.*, (SELECT c FROM ob WHERE ob.arm = ag.arm AND ob.task_id = ag.task_id AND ob.seed = ag.seed AND ob.i = ag.last_i) AS last,
    (SELECT lab FROM ob WHERE ob.arm = ag.arm AND ob.task_id = ag.task_id AND ob.seed = ag.seed AND ob.i = ag.fc) AS first_lab,
    (SELECT lab FROM ob WHERE ob.arm = ag.arm AND ob.task_id = ag.task_id AND ob.seed = ag.seed AND ob.i = ag.lw + 1) AS stable_lab FROM ag),
  st AS (SELECT *, CASE WHEN flips >= 2 THEN 'multiple_flips' WHEN hits = n THEN 'stable_correct' WHEN hits = 0 THEN 'never_correct'
    WHEN last THEN 'wrong_to_correct' ELSE 'correct_to_wrong' END AS state FROM rn)"""


BASE = runs_sql("probes", "correct", "checkpoint", "checkpoint")


@query("prefix_flips", f"WITH {BASE} SELECT {D}, flips AS prefix_flips FROM st")
def _(t):
    return T.prefix_flips(t("probes"), DRAW, ["checkpoint"])


@query("prefix_state", f"WITH {BASE} SELECT {D}, state AS prefix_state FROM st")
def _(t):
    return T.prefix_state(t("probes"), DRAW, ["checkpoint"])


NATURAL = f"""nat AS (SELECT arm, task_id, seed, CASE arg_max(outcome, checkpoint) WHEN 'correct' THEN 'correct' WHEN 'scorable_incorrect' THEN 'incorrect'
  ELSE arg_max(outcome, checkpoint) END AS ns FROM probes GROUP BY {D})"""
TRAJ = f"""WITH {BASE}, {NATURAL}, tr AS (SELECT {', '.join('st.' + d for d in DRAW)}, state AS prefix_state, flips AS prefix_flips, coalesce(ns, 'censored') AS natural_final_status,
  CASE coalesce(ns, 'censored') WHEN 'correct' THEN true WHEN 'incorrect' THEN false END AS natural_final_correct, fc AS first_correct_probe_index,
  first_lab AS first_correct_prefix_tokens, stable_lab AS observed_probe_stable_from_tokens,
  CASE WHEN ns = 'correct' THEN stable_lab END AS stable_sufficient_with_natural_final_tokens,
  coalesce(ns = 'incorrect', false) AND hits > 0 AS harmful_overthinking_observed FROM st LEFT JOIN nat USING ({D}))"""


def trajectories(t):
    probes = t("probes")
    last = F.max_by("outcome", "checkpoint")
    natural = probes.groupBy(*DRAW).agg(
        F.when(last == "scorable_incorrect", "incorrect").otherwise(last).alias("natural_final_status"))
    return T.trajectory(probes, DRAW, ["checkpoint"], "checkpoint", natural)


@query("trajectory", f"{TRAJ} SELECT * FROM tr")
def _(t):
    return trajectories(t)


@query("prefix_state_counts", f"""{TRAJ} SELECT arm, prefix_state, count(*) AS n, count(stable_sufficient_with_natural_final_tokens) AS n_stable_sufficient,
  count(observed_probe_stable_from_tokens) AS n_observed_stable FROM tr GROUP BY 1, 2""")
def _(t):
    return G.prefix_state_counts(trajectories(t), ["arm"])


FORCED = runs_sql("(SELECT * FROM selected WHERE outcome IN ('correct', 'scorable_incorrect'))", "(outcome = 'correct')",
                  "checkpoint_index", "checkpoint_label")
DECLARED = [*[str(day * 64) for day in range(30)], "full_prefix"]  # the labels the probe adapter makes of a month
OUTS = ["correct", "scorable_incorrect", "unparseable", "censored", "error"]


@query("forced_trajectory", f"""WITH {FORCED}, c AS (SELECT {D}, count(*) AS seen, {', '.join(f"count(*) FILTER (outcome = '{o}') AS n_{o}" for o in OUTS)} FROM selected GROUP BY {D})
SELECT {', '.join('c.' + d for d in DRAW)}, {', '.join('n_' + o for o in OUTS)}, coalesce(n, 0) AS n_observed_scorable, seen - coalesce(n, 0) AS n_indeterminate,
  {len(DECLARED)} - seen AS n_missing, coalesce(state, 'never_correct') AS state, coalesce(flips, 0) AS flips, first_lab AS first_correct_checkpoint,
  CASE WHEN hits > 0 AND lw < fc THEN first_lab END AS stable_from_checkpoint, CASE WHEN hits > 0 THEN lw < fc END AS stable_through_end
FROM c LEFT JOIN st USING ({D})""")
def _(t):
    return T.forced_trajectory(M.select_checkpoints(t("probes")), DRAW, DECLARED)


ARM = f"""ar AS (SELECT {D}, arg_min(checkpoint_label, checkpoint_index) FILTER (outcome = 'correct') AS first_correct,
  min(checkpoint_index) FILTER (outcome = 'correct') AS fa, max(checkpoint_index) FILTER (outcome = 'scorable_incorrect') AS wa,
  count(*) FILTER (outcome IN ('correct', 'scorable_incorrect')) AS ns, count(*) AS np, bool_or(native_closed) AS closed, min(family) AS family
  FROM selected GROUP BY {D})"""


@query("first_recoverable", f"WITH {ARM} SELECT arm, first_correct AS checkpoint_label, count(*) AS n_draws FROM ar WHERE first_correct IS NOT NULL GROUP BY 1, 2")
def _(t):
    return T.first_recoverable(M.select_checkpoints(t("probes")))


@query("probe_stability", f"""WITH {ARM} SELECT arm, CASE WHEN fa IS NULL THEN 'no_correct' WHEN wa > fa THEN 'reverted' ELSE 'stable_from_first_correct' END AS stability,
  count(*) AS n_draws FROM ar GROUP BY 1, 2""")
def _(t):
    return T.probe_stability(M.select_checkpoints(t("probes")))


PATTERN = f"""{ARM}, pt AS (SELECT a.task_id, a.seed, least(a.family, b.family) AS family,
  CASE WHEN a.closed AND b.closed THEN 'both_naturally_closed' WHEN NOT a.closed AND NOT b.closed THEN 'both_naturally_censored'
    WHEN a.closed THEN 'only_a_closed' ELSE 'only_b_closed' END AS closure_group,
  CASE WHEN a.fa IS NOT NULL AND b.fa IS NOT NULL THEN 'both_recover' WHEN a.fa IS NOT NULL THEN 'only_a_recovers'
    WHEN b.fa IS NOT NULL THEN 'only_b_recovers' ELSE 'neither_recovers' END AS pattern,
  coalesce(a.wa > a.fa, false) OR coalesce(b.wa > b.fa, false) AS fluctuates, (a.ns + b.ns) / (a.np + b.np) < 0.5 AS indeterminate_dominant,
  a.first_correct AS first_correct_a, b.first_correct AS first_correct_b
  FROM (SELECT * FROM ar WHERE arm = 'A') a JOIN (SELECT * FROM ar WHERE arm = 'B') b USING (task_id, seed))"""


@query("draw_pattern", f"WITH {PATTERN} SELECT * FROM pt")
def _(t):
    return T.draw_pattern(M.select_checkpoints(t("probes")))


@query("censored_strata", f"""WITH {PATTERN} SELECT closure_group, pattern, count(*) AS n_pairs, count(*) FILTER (fluctuates) AS n_fluctuating,
  count(*) FILTER (indeterminate_dominant) AS n_indeterminate_dominant FROM pt GROUP BY 1, 2""")
def _(t):
    return T.censored_strata(T.draw_pattern(M.select_checkpoints(t("probes"))))


@query("recoverability_by_family", f"""WITH {JOINT} SELECT family, checkpoint_label, count(*) AS n_jointly_eligible,
  count(*) FILTER (outcome_a = 'correct') AS a_recoverable_correct, count(*) FILTER (outcome_b = 'correct') AS b_recoverable_correct FROM joint GROUP BY 1, 2""")
def _(t):
    return T.recoverability_by_family(M.jointly_eligible(M.select_checkpoints(t("probes"))))


@query("representative_examples", f"""WITH {PATTERN}, cl AS (SELECT *, unnest([CASE pattern WHEN 'both_recover' THEN 'positive_both_recover'
  WHEN 'neither_recovers' THEN 'negative_neither_recovers' ELSE 'one_sided' END, CASE WHEN fluctuates THEN 'unstable' END]) AS example_class FROM pt)
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY example_class ORDER BY task_id, seed) AS rn FROM cl WHERE example_class IS NOT NULL) x WHERE rn = 1""")
def _(t):
    return T.representative_examples(T.draw_pattern(M.select_checkpoints(t("probes"))))


@query("outcome_transition", """WITH o AS (SELECT checkpoint_label, checkpoint_index, task_id, seed, max(outcome) FILTER (arm = 'A') AS a, max(outcome) FILTER (arm = 'B') AS b
  FROM selected GROUP BY ALL)
SELECT checkpoint_label, task_id, seed, CASE WHEN a IS NULL OR b IS NULL THEN 'not_jointly_eligible' WHEN a = 'correct' AND b = 'correct' THEN 'both'
  WHEN a = 'correct' THEN 'only_a' WHEN b = 'correct' THEN 'only_b' ELSE 'neither' END AS correctness,
  CASE WHEN a IS NULL OR b IS NULL THEN 'not_jointly_eligible' WHEN a NOT IN ('correct', 'scorable_incorrect') AND b NOT IN ('correct', 'scorable_incorrect') THEN 'both_indeterminate'
  WHEN a NOT IN ('correct', 'scorable_incorrect') THEN 'only_a_indeterminate' WHEN b NOT IN ('correct', 'scorable_incorrect') THEN 'only_b_indeterminate' ELSE 'both_observed' END AS indeterminate FROM o""")
def _(t):
    joint = M.jointly_eligible(M.select_checkpoints(t("probes")), only_joint=False)
    a, b = F.col("outcome_a"), F.col("outcome_b")
    return joint.select("checkpoint_label", "task_id", "seed", T.outcome_transition(a, b, "correct").alias("correctness"),
                        T.indeterminate_transition(a, b).alias("indeterminate"))


def delta_ctes(kind):
    return f"""c_{kind} AS (SELECT checkpoint_label, task_id AS cl, avg(CASE WHEN outcome_b = '{kind}' THEN 1.0 ELSE 0.0 END) - avg(CASE WHEN outcome_a = '{kind}' THEN 1.0 ELSE 0.0 END) AS v FROM joint GROUP BY ALL)"""


REC_R = 2000


def ci_part(kind):
    # group key carries the kind so one resampling covers both
    return f"SELECT checkpoint_label, '{kind}' AS kind, cl, v FROM c_{kind}"


N_JOINT = "count(*) FILTER (a IS NOT NULL AND b IS NOT NULL)"


@query("paired_recoverability", f"""WITH {JOINT}, {delta_ctes('correct')}, {delta_ctes('scorable_incorrect')},
vals AS ({ci_part('correct')} UNION ALL {ci_part('scorable_incorrect')}), {resample_means('checkpoint_label, kind', REC_R)},
ci AS (SELECT checkpoint_label, kind, quantile_cont(estimate, 0.025) AS lo, quantile_cont(estimate, 0.975) AS hi FROM reps GROUP BY 1, 2),
s AS (SELECT checkpoint_label, kind, avg(v) AS mean, count(DISTINCT round(v, 9)) < 2 AS degenerate FROM vals GROUP BY 1, 2),
d AS (SELECT checkpoint_label, kind, round(mean, 6) + 0.0 AS mean, degenerate, CASE WHEN NOT degenerate THEN round(lo, 6) + 0.0 END AS lo, CASE WHEN NOT degenerate THEN round(hi, 6) + 0.0 END AS hi
  FROM s JOIN ci USING (checkpoint_label, kind)),
declared AS (SELECT DISTINCT checkpoint_label FROM selected UNION SELECT 'never_reached'),
sides AS (SELECT checkpoint_label, task_id, seed, arg_max(outcome, checkpoint) FILTER (arm = 'A') AS a, arg_max(outcome, checkpoint) FILTER (arm = 'B') AS b FROM selected GROUP BY ALL),
tb AS (SELECT checkpoint_label, {N_JOINT} AS n_jointly_eligible, count(DISTINCT task_id) FILTER (a IS NOT NULL AND b IS NOT NULL) AS n_tasks, count(a) AS a_eligible, count(b) AS b_eligible,
  {', '.join(f"count(*) FILTER ({t} = '{o}' AND {u} IS NOT NULL) AS {t}_{o}" for t, u in ('ab', 'ba') for o in FORCED_OUTCOMES)},
  {', '.join(f"round(count(*) FILTER ({t} = 'correct' AND {u} IS NOT NULL) / nullif({N_JOINT}, 0), 6) AS {t}_recoverable_rate" for t, u in ('ab', 'ba'))},
  {', '.join(f"round(count(*) FILTER ({t} IN ('correct', 'scorable_incorrect') AND {u} IS NOT NULL) / nullif({N_JOINT}, 0), 6) AS {t}_scorable_rate" for t, u in ('ab', 'ba'))},
  {', '.join(f"count(*) FILTER (a = '{k}' AND b = '{k}') AS {k}_both, count(*) FILTER (a = '{k}' AND b <> '{k}') AS {k}_only_a, count(*) FILTER (a <> '{k}' AND b = '{k}') AS {k}_only_b, count(*) FILTER (a <> '{k}' AND b <> '{k}') AS {k}_neither" for k in ('correct', 'scorable_incorrect'))},
  count(*) FILTER (NOT sa AND NOT sb) AS both_indeterminate, count(*) FILTER (NOT sa AND sb) AS only_a_indeterminate,
  count(*) FILTER (sa AND NOT sb) AS only_b_indeterminate, count(*) FILTER (sa AND sb) AS both_observed
  FROM (SELECT checkpoint_label, s.* EXCLUDE (checkpoint_label), a IN ('correct', 'scorable_incorrect') AS sa, b IN ('correct', 'scorable_incorrect') AS sb
    FROM declared LEFT JOIN sides s USING (checkpoint_label)) j GROUP BY 1)
SELECT tb.*, {', '.join(f"{k}.{c} AS {k}_delta_{c}" for k in ('correct', 'scorable_incorrect') for c in ('mean', 'lo', 'hi'))},
  {', '.join(f"coalesce({k}.degenerate, true) AS {k}_delta_degenerate" for k in ('correct', 'scorable_incorrect'))}
FROM tb LEFT JOIN (SELECT * FROM d WHERE kind = 'correct') correct USING (checkpoint_label)
 LEFT JOIN (SELECT * FROM d WHERE kind = 'scorable_incorrect') scorable_incorrect USING (checkpoint_label)""")
def _(t):
    selected = M.select_checkpoints(t("probes"))
    labels = selected.select("checkpoint_label").unionByName(t.spark.createDataFrame([("never_reached",)], "checkpoint_label string")).distinct()
    declared = labels.withColumn("arm", F.explode(F.array(F.lit("A"), F.lit("B"))))
    return paired_recoverability(selected, n_resamples=REC_R, declared=declared)


OUTCOME = f"""{PAIRS}, os AS (SELECT trial_id, family, difficulty, think_end_reached AS cl, correct AS co, answer_normalized IS NOT NULL AS sc, {STATUS_SQL} AS st,
  reasoning_tokens AS rt, repeated_ngram_fraction_4 AS rep FROM records),
po AS (SELECT CASE WHEN ambiguous_a THEN NULL ELSE a END AS a, CASE WHEN ambiguous_b THEN NULL ELSE b END AS b
  FROM pairs JOIN os a ON a.trial_id = rep_a JOIN os b ON b.trial_id = rep_b)"""


def flag(f):
    return (f"CASE WHEN a IS NULL OR b IS NULL THEN 'ambiguous' WHEN coalesce(a.{f}, false) AND coalesce(b.{f}, false) THEN 'both' "
            f"WHEN coalesce(a.{f}, false) THEN 'only_a' WHEN coalesce(b.{f}, false) THEN 'only_b' ELSE 'neither' END")


LONG = " UNION ALL ".join(f"SELECT '{d}' AS dimension, {lv} AS level, '{k}' AS kind, {e} AS label FROM po" for d, lv, k, e in [
    ("all", "'ALL'", "closure", flag("cl")), ("all", "'ALL'", "success_at_budget", flag("co")), ("all", "'ALL'", "scorable", flag("sc")),
    ("all", "'ALL'", "natural_status", "coalesce(a.st, 'unavailable') || ' -> ' || coalesce(b.st, 'unavailable')"),
    ("family", "coalesce(a.family, b.family, '?')", "closure", flag("cl")),
    ("family", "coalesce(a.family, b.family, '?')", "success_at_budget", flag("co")),
    ("difficulty", "coalesce(a.difficulty, b.difficulty, '?')", "closure", flag("cl"))])


@query("paired_outcomes", f"WITH {OUTCOME} SELECT dimension, level, kind, label, count(*) AS n FROM ({LONG}) l GROUP BY ALL")
def _(t):
    return T.paired_outcomes(M.paired_draws(T.with_pair_columns(t("records")), T.PAIR_COLUMNS))


@query("repetition_strata", f"""WITH {OUTCOME}, us AS (SELECT b.rep - a.rep AS delta, a.family AS family, CASE WHEN a.cl AND b.cl THEN 'both_closed' ELSE 'other' END AS closure,
  (a.rt + b.rt) / 2 AS len FROM po WHERE a IS NOT NULL AND b IS NOT NULL),
rk AS (SELECT *, row_number() OVER (ORDER BY len) - 1 AS r, count(*) OVER () AS n FROM us),
bd AS (SELECT max(len) FILTER (r = n // 4) AS q1, max(len) FILTER (r = 3 * n // 4) AS q3 FROM rk),
lg AS (SELECT delta, q1, q3, unnest([{{'k': 'overall', 'v': 'ALL'}}, {{'k': 'family', 'v': family}}, {{'k': 'closure_state', 'v': closure}},
  {{'k': 'length_bucket', 'v': CASE WHEN len <= q1 THEN 'short' WHEN len >= q3 THEN 'long' ELSE 'mid' END}}]) AS s FROM us, bd)
SELECT s.k AS stratum_kind, s.v AS stratum, count(*) AS n_paired_draws, round(avg(delta), 6) AS mean_delta, max(q1) AS q1, max(q3) AS q3 FROM lg GROUP BY 1, 2""")
def _(t):
    return T.repetition_strata(M.paired_draws(T.with_pair_columns(t("records")), T.PAIR_COLUMNS))


