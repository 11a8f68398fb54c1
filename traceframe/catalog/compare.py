from pyspark.sql import functions as F

from ..operators.pairing import pair_records
from ..operators.population import PROJECTION
from ..plans import compare as P
from .comparison import COMPARED, of_pairs, pair_sql
from .population import KEYS, PAIRS
from .registry import query
from .scalars import STATUS_SQL
from .shared_sql import AREA, KM, drawn_weights

R, TAU = 2000, 400.0
FIELDS = {"model.precision": "precision", "runtime.runtime_version": "runtime_version"}


def pair_list(t):
    return t.spark.createDataFrame(COMPARED, "pair_id string, run_a string, run_b string, mode string")


def configured(t):
    """A run is an arm at a difficulty; arm B is quantised, one run had another runtime, one seal does not verify."""
    runs = t("records").select("arm", F.concat_ws("-", "arm", "difficulty").alias("run_id")).distinct()
    return runs.select(
        "run_id", F.when(F.col("arm") == "A", "bf16").otherwise("q4").alias("precision"),
        F.when(F.col("run_id") == "B-hard", "r2").otherwise("r1").alias("runtime_version"), (F.col("run_id") != "B-medium").alias("verified"))


def sql_text(value):
    return "CAST(NULL AS VARCHAR)" if value is None else f"'{value}'"


LISTED = ", ".join(f"({', '.join(map(sql_text, p))})" for p in COMPARED)
SIDES = " UNION ALL ".join(
    f"SELECT pair_id, '{side}' AS side, r.* FROM pr JOIN records r ON r.arm || '-' || r.difficulty = run_{side.lower()} AND (pr.mode IS NULL OR pr.mode = r.mode)" for side in "AB")


def both_sides(item):
    return f"SELECT pair_id, {item}, bool_or(side = 'A') AS a, bool_or(side = 'B') AS b FROM rec GROUP BY ALL"


PROJ = ", ".join(PROJECTION)


@query("compare_verdicts", f"""WITH pr(pair_id, run_a, run_b, mode) AS (VALUES {LISTED}),
cfg AS (SELECT DISTINCT arm || '-' || difficulty AS run_id, CASE arm WHEN 'A' THEN 'bf16' ELSE 'q4' END AS prec,
  CASE WHEN arm = 'B' AND difficulty = 'hard' THEN 'r2' ELSE 'r1' END AS rt, NOT (arm = 'B' AND difficulty = 'medium') AS verified FROM records),
m AS (SELECT pair_id, coalesce(x.prec <> y.prec, false) AS mc, coalesce(x.rt <> y.rt, false) AS rc, x.run_id IS NULL OR y.run_id IS NULL AS gone,
  coalesce(x.verified AND y.verified, false) AS verified FROM pr LEFT JOIN cfg x ON x.run_id = run_a LEFT JOIN cfg y ON y.run_id = run_b),
rec AS ({SIDES}),
ts AS (SELECT pair_id, count(*) FILTER (a <> b) AS apart FROM ({both_sides('task_id')}) x GROUP BY 1),
ps AS (SELECT pair_id, count(*) FILTER (a <> b) AS apart FROM ({both_sides('presentation_id')}) x GROUP BY 1),
ex AS (SELECT pair_id, count(*) FILTER (a) AS ea, count(*) FILTER (b) AS eb, count(*) FILTER (a <> b) AS apart FROM ({both_sides(PROJ)}) x GROUP BY 1),
tk AS (SELECT pair_id, count(*) FILTER (a AND b) AS matched FROM ({both_sides(KEYS)}) x GROUP BY 1),
dup AS (SELECT DISTINCT pair_id FROM (SELECT pair_id FROM rec GROUP BY pair_id, side, {KEYS} HAVING count(*) > 1) x),
amb AS (SELECT DISTINCT pair_id FROM (SELECT pair_id FROM rec GROUP BY pair_id, side, presentation_id, condition_id, seed HAVING count(DISTINCT tokens) > 1) x),
v AS (SELECT pair_id, mc, verified, ea, eb, matched, list_filter([CASE WHEN gone THEN 'fields_unknown' END, CASE WHEN ts.apart > 0 THEN 'tasks_unequal' END,
    CASE WHEN mc AND rc THEN 'model_and_runtime' END, CASE WHEN ps.apart > 0 THEN 'presentations_unequal' END, CASE WHEN NOT verified THEN 'seal_unverified' END],
    lambda r: r IS NOT NULL) AS rs,
  CASE WHEN mc AND rc THEN 'confounded_model_runtime' WHEN mc THEN 'weight_representation' WHEN rc THEN 'runtime_hardware' ELSE 'same_deployment' END AS contrast,
  ea > 0 AND eb > 0 AND ex.apart = 0 AND matched = ea AND pair_id NOT IN (SELECT pair_id FROM dup) AND pair_id NOT IN (SELECT pair_id FROM amb) AS complete
  FROM m JOIN ts USING (pair_id) JOIN ps USING (pair_id) JOIN ex USING (pair_id) JOIN tk USING (pair_id))
SELECT pair_id, contrast, array_to_string(rs, '; ') AS refusal_reasons, complete, len(rs) > 0 AS refused, verified AND complete AND len(rs) = 0 AS publication_grade,
  ea AS expected_trials_a, eb AS expected_trials_b, CAST(0 AS BIGINT) AS missing_trials_a, CAST(0 AS BIGINT) AS unexpected_trials_b, matched AS matched_pairs FROM v""")
def _(t):
    records = t("records").withColumn("run_id", F.concat_ws("-", "arm", "difficulty"))
    pairs = pair_list(t)
    wanted = records.select("run_id", *PROJECTION).distinct()
    out = P.pair_verdicts(pair_records(records, pairs), pairs, configured(t), FIELDS, wanted, wanted.select("run_id", "presentation_id").distinct())
    return out.select("pair_id", "contrast", F.array_join("refusal_reasons", "; ").alias("refusal_reasons"), "complete", "refused", "publication_grade",
                      "expected_trials_a", "expected_trials_b", "missing_trials_a", "unexpected_trials_b", "matched_pairs")


ENDPOINTS = f""", {PAIRS}, used AS (SELECT unnest([rep_a, rep_b]) AS trial_id, unnest(['A', 'B']) AS arm FROM pairs WHERE NOT ambiguous_a AND NOT ambiguous_b),
seen AS (SELECT r.task_id AS cl, u.arm, think_end_reached AS te, terminated_by_eos AS eos, reasoning_tokens AS rt, total_tokens AS tt
  FROM records r JOIN used u ON u.trial_id = r.trial_id AND u.arm = r.arm),
long AS (SELECT 'reasoning_closure' AS endpoint, cl, arm, CAST(CASE WHEN te THEN rt + 1 ELSE tt END AS DOUBLE) AS time, te AS event FROM seen
  UNION ALL SELECT 'generation_termination', cl, arm, CAST(tt AS DOUBLE), eos FROM seen),
tcells AS (SELECT endpoint, cl, arm, time, count(*) AS tn, sum(CASE WHEN event THEN 1 ELSE 0 END) AS td FROM long GROUP BY ALL),
shared AS (SELECT endpoint, cl FROM tcells GROUP BY ALL HAVING count(DISTINCT arm) = 2),
placed AS (SELECT endpoint, cl, row_number() OVER (PARTITION BY endpoint ORDER BY CAST('0x' || substr(md5(cl), 1, 15) AS BIGINT), cl) - 1 AS idx,
  count(*) OVER (PARTITION BY endpoint) AS n FROM shared),
picks AS (SELECT * FROM {drawn_weights('placed', R)} z),
cells AS (SELECT endpoint, replicate, arm, time, sum(tn * w) AS n, sum(td * w) AS d FROM picks JOIN placed USING (n, idx) JOIN tcells USING (endpoint, cl) GROUP BY ALL
  UNION ALL SELECT endpoint, -1, arm, time, sum(tn), sum(td) FROM tcells JOIN shared USING (endpoint, cl) GROUP BY ALL),
{KM.format(g='endpoint, replicate, arm')}, {AREA.format(g='endpoint, replicate, arm', tau=TAU)},
deltas AS (SELECT endpoint, replicate, max(CASE WHEN arm = 'A' THEN rmst END) - max(CASE WHEN arm = 'B' THEN rmst END) AS delta FROM area GROUP BY 1, 2)
SELECT endpoint, (SELECT count(*) FROM shared s WHERE s.endpoint = e.endpoint) AS n_clusters, round(max(delta) FILTER (replicate = -1), 6) AS point,
  round(avg(delta) FILTER (replicate >= 0), 6) AS mean, count(delta) FILTER (replicate >= 0) AS n_resamples_used,
  round(quantile_cont(delta, 0.025) FILTER (replicate >= 0), 6) AS lo, round(quantile_cont(delta, 0.975) FILTER (replicate >= 0), 6) AS hi,
  (quantile_cont(delta, 0.025) FILTER (replicate >= 0) > 0 OR quantile_cont(delta, 0.975) FILTER (replicate >= 0) < 0) AS excludes_zero, CAST({TAU} AS DOUBLE) AS tau
FROM deltas e GROUP BY endpoint"""


@query("compare_endpoints", pair_sql(ENDPOINTS))
def _(t):
    return P.endpoint_deltas(of_pairs(t), TAU, n_resamples=R)


@query("compare_states", f"""WITH pr(pair_id, run_a, run_b, mode) AS (VALUES {LISTED}), st AS (SELECT arm || '-' || difficulty AS run_id, {STATUS_SQL} AS state FROM records)
SELECT pair_id, arm, state, count(*) AS n FROM (SELECT pair_id, 'A' AS arm, state FROM pr JOIN st ON run_id = run_a UNION ALL SELECT pair_id, 'B', state FROM pr JOIN st ON run_id = run_b) x
GROUP BY ALL""")
def _(t):
    from ..functions.status import record_status

    states = t("records").select(F.concat_ws("-", "arm", "difficulty").alias("run_id"), record_status().alias("state"))
    return P.state_counts(states, pair_list(t))
