from pyspark.sql import functions as F

from ..operators.draws import PAIR_KEY, collapse_draws
from ..plans import survival as S
from .registry import query
from .shared_sql import AREA, KM, drawn_weights

TAU = 40.0
CELLS = "cells AS (SELECT family, time, count(*) AS n, sum(CASE WHEN event THEN 1 ELSE 0 END) AS d FROM obs GROUP BY ALL)"
BASE = f"WITH {CELLS}, {KM.format(g='family')}, {AREA.format(g='family', tau=TAU)}"


@query("kaplan_meier", f"""{BASE}
SELECT family, time, CAST(at_risk AS BIGINT) at_risk, CAST(d AS BIGINT) AS events, CAST(n - d AS BIGINT) AS censored,
       round(survival, 6) AS survival FROM km""")
def _(t):
    return S.kaplan_meier(t("obs"), ["family"])


@query("km_median", f"{BASE} SELECT family, min(CASE WHEN survival <= 0.5 THEN time END) AS median FROM km GROUP BY 1")
def _(t):
    return S.curve_median(S.kaplan_meier(t("obs"), ["family"]), ["family"])


@query("rmst", f"{BASE} SELECT family, round(rmst, 6) AS rmst FROM area")
def _(t):
    return S.rmst(t("obs"), ["family"], TAU)


SUMMARY = f"""SELECT family, CAST(sum(n) AS BIGINT) AS n, CAST(sum(d) AS BIGINT) AS n_events,
 CAST(sum(n - d) AS BIGINT) AS n_censored, max(time) AS max_time,
 min(CASE WHEN survival <= 0.5 THEN time END) AS median, round(any_value(rmst), 6) AS rmst,
 CAST({TAU} AS DOUBLE) AS tau"""


@query("survival_summary", f"{BASE} {SUMMARY} FROM km JOIN area USING (family) GROUP BY family")
def _(t):
    return S.survival_summary(t("obs"), ["family"], TAU)


FAM = "o2 AS (SELECT CASE WHEN time = 50 AND task_id = 'task-7' THEN 'rare' ELSE family END AS family, time, event FROM obs)"


@query("survival_by_family", f"""WITH {FAM},
{CELLS.replace('FROM obs', 'FROM o2')}, {KM.format(g='family')}, {AREA.format(g='family', tau=TAU)},
s AS ({SUMMARY} FROM km JOIN area USING (family) GROUP BY family)
SELECT family, n, tau, n < 4000 AS insufficient_data,
  CASE WHEN n >= 4000 THEN n_events END AS n_events, CASE WHEN n >= 4000 THEN n_censored END AS n_censored,
  CASE WHEN n >= 4000 THEN max_time END AS max_time, CASE WHEN n >= 4000 THEN median END AS median,
  CASE WHEN n >= 4000 THEN rmst END AS rmst FROM s""")
def _(t):
    rare = (F.col("time") == 50) & (F.col("task_id") == "task-7")
    obs = t("obs").withColumn("family", F.when(rare, F.lit("rare")).otherwise(F.col("family")))
    return S.survival_by_family(obs, "family", TAU, min_n=4000)


@query("survival_endpoints", f"""WITH long AS (
  SELECT condition_id, 'reasoning_closure' AS endpoint,
    CAST(CASE WHEN think_end_reached THEN reasoning_tokens + 1 ELSE total_tokens END AS DOUBLE) AS time,
    think_end_reached AS event, (terminated_by_eos AND NOT think_end_reached) AS competing FROM primary_draws
  UNION ALL
  SELECT condition_id, 'generation_termination', CAST(total_tokens AS DOUBLE), terminated_by_eos, false FROM primary_draws),
cells AS (SELECT condition_id, endpoint, time, count(*) AS n, sum(CASE WHEN event THEN 1 ELSE 0 END) AS d FROM long GROUP BY ALL),
{KM.format(g='condition_id, endpoint')}, {AREA.format(g='condition_id, endpoint', tau=400.0)},
comp AS (SELECT condition_id, endpoint, count(*) FILTER (competing) AS n_competing FROM long GROUP BY ALL)
SELECT condition_id, endpoint, CAST(sum(n) AS BIGINT) AS n, CAST(sum(d) AS BIGINT) AS n_events,
 CAST(sum(n - d) AS BIGINT) AS n_censored, max(time) AS max_time,
 min(CASE WHEN survival <= 0.5 THEN time END) AS median, round(any_value(rmst), 6) AS rmst,
 CAST(400.0 AS DOUBLE) AS tau, any_value(n_competing) AS n_competing
FROM km JOIN area USING (condition_id, endpoint) JOIN comp USING (condition_id, endpoint) GROUP BY condition_id, endpoint""")
def _(t):
    keep = ["think_end_reached", "terminated_by_eos", "reasoning_tokens", "total_tokens"]
    draws = collapse_draws(t("records"), ["arm", *PAIR_KEY], keep=keep, divergence=False)
    return S.survival_endpoints(draws.where(~F.col("ambiguous")), 400.0)


R = 2000


@query("rmst_delta_bootstrap", f"""WITH
tcells AS (SELECT task_id, arm, time, count(*) AS n, sum(CASE WHEN event THEN 1 ELSE 0 END) AS d FROM obs GROUP BY ALL),
shared AS (SELECT task_id AS cl FROM tcells GROUP BY 1 HAVING count(DISTINCT arm) = 2),
placed AS (SELECT cl, row_number() OVER (ORDER BY CAST('0x' || substr(md5(cl), 1, 15) AS BIGINT), cl) - 1 AS idx,
  count(*) OVER () AS n FROM shared),
picks AS (SELECT * FROM {drawn_weights('placed', R)} z),
cells AS (
  SELECT replicate, arm, time, sum(tcells.n * w) AS n, sum(d * w) AS d
  FROM picks JOIN placed USING (idx) JOIN tcells ON tcells.task_id = placed.cl GROUP BY ALL
  UNION ALL SELECT -1, arm, time, sum(tcells.n), sum(d) FROM tcells JOIN shared ON task_id = cl GROUP BY ALL),
{KM.format(g='replicate, arm')}, {AREA.format(g='replicate, arm', tau=TAU)},
deltas AS (SELECT replicate, max(CASE WHEN arm = 'A' THEN rmst END) - max(CASE WHEN arm = 'B' THEN rmst END) AS delta
  FROM area GROUP BY 1)
SELECT (SELECT count(*) FROM shared) AS n_clusters,
  round((SELECT delta FROM deltas WHERE replicate = -1), 6) AS point,
  round(avg(delta), 6) AS mean, count(delta) AS n_resamples_used,
  round(quantile_cont(delta, 0.025), 6) AS lo, round(quantile_cont(delta, 0.975), 6) AS hi,
  (quantile_cont(delta, 0.025) > 0 OR quantile_cont(delta, 0.975) < 0) AS excludes_zero, CAST({TAU} AS DOUBLE) AS tau
FROM deltas WHERE replicate >= 0""")
def _(t):
    return S.rmst_delta_bootstrap(t("obs"), TAU, n_resamples=R)
