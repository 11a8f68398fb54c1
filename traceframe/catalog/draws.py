from pyspark.sql import functions as F

from ..operators import draws as D
from .registry import query

KEY = ["arm", "presentation_id", "condition_id", "seed"]
K = ", ".join(KEY)
ON = " AND ".join(f"a.{k} IS NOT DISTINCT FROM b.{k}" for k in KEY)


def ranked(key, where="true"):
    return f"""(SELECT *, first_value(tokens) OVER w AS base, row_number() OVER w AS rn,
      count(*) OVER (PARTITION BY {key}) AS n_exec FROM records WHERE {where}
      WINDOW w AS (PARTITION BY {key} ORDER BY repeat, trial_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""


DIV = "(SELECT min(i) FROM (SELECT unnest(range(0, greatest(len(base), len(tokens)))) AS i) WHERE base[i + 1] IS DISTINCT FROM tokens[i + 1])"


def collapsed(key):
    return f"""(SELECT {key}, count(*) AS n_executions, bool_and(tokens = base) AS token_identical,
      NOT bool_and(tokens = base) AS ambiguous,
      arg_min({DIV}, rn) FILTER (tokens <> base) AS first_token_divergence
    FROM {ranked(key)} r GROUP BY {key})"""


@query("collapse_draws", f"""SELECT c.*, CASE WHEN token_identical THEN r.trial_id END AS trial_id,
  CASE WHEN token_identical THEN r.correct END AS correct
FROM {collapsed(K)} c JOIN {ranked(K)} r ON r.rn = 1 AND {ON.replace('a.', 'c.').replace('b.', 'r.')}""")
def _(t):
    return D.collapse_draws(t("records"), KEY, keep=["trial_id", "correct"])


@query("draw_summary", f"""SELECT arm, condition_id, CAST(sum(n_executions) AS BIGINT) AS n_executions, count(*) AS n_unique_draws,
  count(*) FILTER (NOT ambiguous) AS n_primary_draws, count(*) FILTER (ambiguous) AS n_ambiguous_draws
FROM {collapsed(K)} c GROUP BY 1, 2""")
def _(t):
    draws = D.collapse_draws(t("records"), KEY, divergence=False)
    return D.draw_summary(draws, ["arm", "condition_id"])


@query("ambiguous_count", f"SELECT arm, count(*) FILTER (ambiguous) AS n_ambiguous_draws FROM {collapsed(K)} c GROUP BY 1")
def _(t):
    return D.ambiguous_count(t("records"), ["arm"])


COMPACT = ["correct", "answer_normalized", "think_end_reached", "terminated_by_eos", "reasoning_tokens", "answer_tokens",
           "total_tokens", "wall_ms", "ttft_ms", "unique_token_ratio", "repeated_ngram_fraction_4", "longest_run_length"]


def _compact_col(c):
    rounded = c in ("wall_ms", "ttft_ms", "unique_token_ratio", "repeated_ngram_fraction_4")
    return f"CASE WHEN token_identical THEN {'round(' if rounded else ''}r.{c}{', 6)' if rounded else ''} END AS {c}"


@query("compact_draws", f"""SELECT {', '.join('c.' + k for k in KEY)}, n_executions, token_identical, ambiguous, first_token_divergence,
  {', '.join(_compact_col(c) for c in COMPACT)}
FROM {collapsed(K)} c JOIN {ranked(K)} r ON r.rn = 1 AND {ON.replace('a.', 'c.').replace('b.', 'r.')}""")
def _(t):
    draws = D.collapse_draws(t("records"), KEY, keep=COMPACT)
    return D.compact_draws(draws, [*KEY, "n_executions", "token_identical", "ambiguous", "first_token_divergence"], COMPACT)


def replay_sql(key, where):
    return f"""(SELECT {key}, count(*) AS n_repeats, bool_and(tokens = base) AS identical_tokens,
      arg_min({DIV}, rn) FILTER (tokens <> base) AS first_token_divergence,
      CASE WHEN count(answer_normalized) = 0 THEN NULL WHEN count(answer_normalized) < count(*) THEN false
        ELSE count(DISTINCT answer_normalized) = 1 END AS answer_agreement,
      count(answer_normalized) > 0 AS answer_observed, stddev_pop(reasoning_tokens) AS reasoning_token_std,
      stddev_pop(wall_ms) AS wall_ms_std
    FROM {ranked(key, where)} r GROUP BY {key} HAVING count(*) > 1)"""


REPLAY_COLS = """n_repeats, identical_tokens, first_token_divergence, answer_agreement, answer_observed,
  round(reasoning_token_std, 6) AS reasoning_token_std, round(wall_ms_std, 6) AS wall_ms_std"""
GREEDY = "arm, presentation_id, condition_id, task_id"


@query("greedy_replay", f"""SELECT arm, presentation_id, condition_id, task_id, {REPLAY_COLS},
  first_token_divergence AS first_digest_divergence FROM (SELECT x.* REPLACE (
     (SELECT min(i) FROM (SELECT unnest(range(0, greatest(len(s0), len(s1)))) AS i) WHERE s0[i + 1] IS DISTINCT FROM s1[i + 1]) AS first_token_divergence)
   FROM (SELECT q.*, s.s0, s.s1 FROM {replay_sql(GREEDY, "mode = 'greedy'")} q JOIN
     (SELECT {GREEDY}, any_value(tokens) FILTER (rn = 1) AS s0, any_value(tokens) FILTER (rn = 2) AS s1
      FROM {ranked(GREEDY, "mode = 'greedy'")} z GROUP BY ALL) s USING ({GREEDY})) x)""".replace(
        "first_token_divergence, answer_agreement, answer_observed,\n  round", "t0 AS first_token_divergence, answer_agreement, answer_observed,\n  round", 1
    ).replace("SELECT q.*, s.s0", "SELECT q.*, q.first_token_divergence AS t0, s.s0"))
def _(t):
    return D.greedy_replay(t("records").withColumn("step_digests", F.col("tokens")), ["arm", "presentation_id"],
                           digest_of_steps="step_digests")


SAME = "arm, presentation_id, condition_id, task_id, seed"


@query("same_seed_replay", f"""SELECT arm, count(*) AS n_keys, count(*) FILTER (identical_tokens) AS token_identical_count,
  round(count(*) FILTER (identical_tokens) / count(*), 6) AS token_identical_rate,
  count(*) FILTER (NOT identical_tokens) AS ambiguous_count,
  round(count(*) FILTER (answer_observed AND answer_agreement) / count(*) FILTER (answer_observed), 6) AS answer_agreement_rate,
  round(avg(reasoning_token_std), 6) AS mean_reasoning_token_std, round(avg(wall_ms_std), 6) AS mean_wall_ms_std
FROM {replay_sql(SAME, "mode = 'sampled'")} x GROUP BY 1""")
def _(t):
    return D.replay_rates(D.same_seed_replay(t("records"), ["arm", "presentation_id"]), ["arm"])


@query("cross_seed_tokens", f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY arm, condition_id, task_id, presentation_id, seed ORDER BY repeat, trial_id) AS rn,
   avg(reasoning_tokens) OVER (PARTITION BY arm, condition_id, task_id, presentation_id, seed) AS len FROM records WHERE mode = 'sampled'),
f AS (SELECT *, first_value(tokens) OVER (PARTITION BY arm, condition_id, task_id, presentation_id ORDER BY seed) AS base FROM r WHERE rn = 1)
SELECT arm, presentation_id, condition_id, task_id, count(*) AS n_seeds, round(stddev_pop(len), 6) AS reasoning_tokens_std_across_seeds,
  min({DIV}) AS first_token_divergence FROM f GROUP BY ALL HAVING count(*) > 1""")
def _(t):
    return D.cross_seed_tokens(t("records"), ["arm", "presentation_id"])


@query("across_seed_answers", f"""WITH s AS (SELECT arm, presentation_id, condition_id, task_id, seed, bool_and(tokens = base) AS same,
   any_value(answer_normalized) FILTER (rn = 1) AS ans, avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END) AS acc
   FROM {ranked(SAME, "mode = 'sampled'")} x GROUP BY ALL),
u AS (SELECT * REPLACE (CASE WHEN same THEN ans END AS ans) FROM s)
SELECT arm, presentation_id, condition_id, task_id, count(*) AS n_seeds, count(ans) AS n_seeds_with_observed_answer,
  count(*) FILTER (NOT same) AS n_ambiguous_seeds, CASE WHEN count(ans) > 0 THEN count(DISTINCT ans) END AS distinct_answers,
  round(count(ans) / count(*), 6) AS answer_observation_rate,
  round(CASE WHEN count(ans) > 1 THEN stddev_pop(acc) FILTER (ans IS NOT NULL) END, 6) AS accuracy_std_across_seeds
FROM u GROUP BY ALL HAVING count(*) > 1""")
def _(t):
    return D.across_seed_answers(t("records"), ["arm", "presentation_id"])
