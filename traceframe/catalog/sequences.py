from pyspark.sql import functions as F

from ..operators import sequences as Q
from .registry import query

TOKENS = "SELECT trace_id, unnest(tokens) AS tok, unnest(range(0, len(tokens))) AS pos, len(tokens) AS n FROM traces"


def gram_sql(n):
    leads = ", ".join(f"lead(tok, {i}) OVER w" if i else "tok" for i in range(n))
    return f"""(SELECT trace_id, concat_ws(' ', {leads}) AS gram, pos AS g, n FROM tk
      WINDOW w AS (PARTITION BY trace_id ORDER BY pos) QUALIFY lead(tok, {n - 1}) OVER w IS NOT NULL)"""


@query("repetition_basic", f"""WITH tk AS ({TOKENS}), c AS (SELECT trace_id, tok, count(*) AS c FROM tk GROUP BY ALL)
SELECT trace_id, CAST(sum(c) AS BIGINT) AS n_tokens, count(*) AS unique_tokens, round(count(*) / sum(c), 6) AS unique_token_ratio,
  max(c) AS most_common_token_count FROM c GROUP BY 1""")
def _(t):
    return Q.repetition_basic(t("traces"), "trace_id")


@query("distinct_n", f"""WITH tk AS ({TOKENS}),
d1 AS (SELECT trace_id, count(DISTINCT tok) / count(*) AS r FROM tk GROUP BY 1),
d2 AS (SELECT trace_id, count(DISTINCT gram) / count(*) AS r FROM {gram_sql(2)} x GROUP BY 1),
d4 AS (SELECT trace_id, count(DISTINCT gram) / count(*) AS r FROM {gram_sql(4)} x GROUP BY 1)
SELECT trace_id, round(coalesce(d1.r, 1.0), 6) AS distinct_1, round(coalesce(d2.r, 1.0), 6) AS distinct_2,
  round(coalesce(d4.r, 1.0), 6) AS distinct_4
FROM traces LEFT JOIN d1 USING (trace_id) LEFT JOIN d2 USING (trace_id) LEFT JOIN d4 USING (trace_id)""")
def _(t):
    return Q.distinct_n(t("traces"), "trace_id")


def _frac(n):
    return f"""(SELECT trace_id, sum(CASE WHEN c > 1 THEN c ELSE 0 END) / sum(c) AS r FROM
      (SELECT trace_id, gram, count(*) AS c FROM {gram_sql(n)} x GROUP BY ALL) y GROUP BY 1)"""


@query("repeated_ngram_fraction", f"""WITH tk AS ({TOKENS})
SELECT trace_id, round(coalesce(a.r, 0.0), 6) AS repeated_ngram_fraction_4, round(coalesce(b.r, 0.0), 6) AS repeated_ngram_fraction_8
FROM traces LEFT JOIN {_frac(4)} a USING (trace_id) LEFT JOIN {_frac(8)} b USING (trace_id)""")
def _(t):
    return Q.repeated_ngram_fraction(t("traces"), "trace_id")


RUNS = f"""tk AS ({TOKENS}),
isl AS (SELECT trace_id, tok, pos, row_number() OVER (PARTITION BY trace_id ORDER BY pos)
   - row_number() OVER (PARTITION BY trace_id, tok ORDER BY pos) AS grp FROM tk),
runs_of AS (SELECT trace_id, tok, grp, count(*) AS len, min(pos) AS s, max(pos) AS e FROM isl GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY len DESC, s) AS rn FROM runs_of)"""


@query("max_run", f"WITH {RUNS} SELECT trace_id, max(len) AS max_token_run FROM runs_of GROUP BY 1")
def _(t):
    return Q.max_run(t("traces"), "trace_id")


@query("longest_run_span", f"""WITH {RUNS} SELECT trace_id, len AS run_length, tok AS run_token, s AS run_start, e AS run_end
FROM best WHERE rn = 1""")
def _(t):
    return Q.longest_run_span(t("traces"), "trace_id")


@query("top_motif", f"""WITH tk AS ({TOKENS}), c AS (SELECT trace_id, gram, count(*) AS c FROM {gram_sql(4)} x GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY c DESC, string_split(gram, ' ') DESC) AS rn FROM c)
SELECT trace_id, coalesce(gram, '') AS motif, coalesce(c, 0) AS motif_count, coalesce(c, 0) * 4 AS motif_span_tokens
FROM traces LEFT JOIN (SELECT * FROM r WHERE rn = 1) x USING (trace_id)""")
def _(t):
    return Q.top_motif(t("traces"), "trace_id")


@query("line_repeat_ratio", """WITH l AS (SELECT trace_id, trim(unnest(string_split(text, chr(10))), ' ' || chr(9) || chr(13)) AS line FROM traces),
r AS (SELECT trace_id, 1 - count(DISTINCT line) / count(*) AS r FROM l WHERE line <> '' GROUP BY 1)
SELECT trace_id, round(coalesce(r, 0.0), 6) AS text_repeat_ratio FROM traces LEFT JOIN r USING (trace_id)""")
def _(t):
    return Q.line_repeat_ratio(t("traces"), "trace_id")


W = 64


@query("rolling_unique_min", f"""WITH tk AS ({TOKENS}),
prevs AS (SELECT *, coalesce(lag(pos) OVER (PARTITION BY trace_id, tok ORDER BY pos), -1) AS q FROM tk WHERE n >= {W}),
ends AS (SELECT trace_id, greatest(q + 1, pos - {W - 1}, 0) AS s, 1 AS d FROM prevs
   WHERE greatest(q + 1, pos - {W - 1}, 0) <= least(pos, n - {W})
  UNION ALL SELECT trace_id, least(pos, n - {W}) + 1, -1 FROM prevs
   WHERE greatest(q + 1, pos - {W - 1}, 0) <= least(pos, n - {W}) AND pos < n - {W}),
lv AS (SELECT trace_id, sum(sum(d)) OVER (PARTITION BY trace_id ORDER BY s) AS u FROM ends GROUP BY trace_id, s),
mins AS (SELECT trace_id, min(u) / {float(W)} AS r FROM lv GROUP BY 1
  UNION ALL SELECT trace_id, len(list_distinct(tokens)) / len(tokens) FROM traces WHERE len(tokens) < {W})
SELECT trace_id, round(r, 6) AS rolling_unique_ratio_min FROM mins""")
def _(t):
    return Q.rolling_unique_min(t("traces"), "trace_id", window=W)


@query("degeneration_onset", f"""WITH tk AS (SELECT * FROM ({TOKENS}) x WHERE n >= {W}),
gr AS (SELECT *, lag(g) OVER (PARTITION BY trace_id, gram ORDER BY g) AS pv, lead(g) OVER (PARTITION BY trace_id, gram ORDER BY g) AS nx
  FROM {gram_sql(4)} x),
iv AS (SELECT trace_id, n - {W} AS last, greatest(coalesce(pv + 1, 0), g - {W - 4}, 0) AS lo,
  least(g, coalesce(nx - {W - 3}, g), n - {W}) AS hi FROM gr),
ends AS (SELECT trace_id, last, lo AS s, 1 AS d FROM iv WHERE lo <= hi
  UNION ALL SELECT trace_id, last, hi + 1, -1 FROM iv WHERE lo <= hi AND hi < last
  UNION ALL SELECT DISTINCT trace_id, last, 0, 0 FROM iv),
lv AS (SELECT trace_id, last, s, sum(sum(d)) OVER (PARTITION BY trace_id ORDER BY s) AS u,
  lead(s, 1, last + 1) OVER (PARTITION BY trace_id ORDER BY s) - 1 AS e FROM ends GROUP BY trace_id, last, s),
o AS (SELECT trace_id, last, coalesce(max(CASE WHEN 1 - u / {float(W - 3)} < 0.5 THEN e END) + 1, 0) AS onset FROM lv GROUP BY 1, 2)
SELECT trace_id, CASE WHEN onset <= last THEN onset END AS degeneration_onset_index FROM traces LEFT JOIN o USING (trace_id)""")
def _(t):
    return Q.degeneration_onset(t("traces"), "trace_id", window=W, threshold=0.5)


@query("special_run_flag", f"""WITH {RUNS}, sp AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS tok FROM benchmark)
SELECT trace_id, len AS run_length, tok IN (SELECT tok FROM sp) AS longest_run_is_special FROM best WHERE rn = 1""")
def _(t):
    special = t("benchmark").select(F.explode(F.split("text", " ")).alias("tok"))
    return Q.special_run_flag(t("traces"), "trace_id", special, "tok")


DRAW = "arm, presentation_id, task_id, condition_id, seed"


@query("first_divergence", f"""WITH b AS (SELECT *, first_value(tokens) OVER (PARTITION BY {DRAW} ORDER BY repeat, trial_id) AS base FROM records)
SELECT {DRAW}, trial_id, (SELECT min(i) FROM (SELECT unnest(range(0, greatest(len(base), len(tokens)))) AS i)
   WHERE base[i + 1] IS DISTINCT FROM tokens[i + 1]) AS first_divergence FROM b""")
def _(t):
    return Q.execution_divergence(t("records"), DRAW.split(", "), ["repeat", "trial_id"], keep=["trial_id"])


@query("prefix_invariance", """WITH capped AS (
  SELECT trace_id, cap, CASE WHEN family = 'fr' AND cap = 16 THEN tokens[2:cap + 1] ELSE tokens[1:cap] END AS tokens
  FROM traces, (SELECT unnest([8, 16, 32]) AS cap) c WHERE len(tokens) > 5 OR cap = 8),
p AS (SELECT trace_id, tokens, lag(tokens) OVER (PARTITION BY trace_id ORDER BY cap) AS short FROM capped),
k AS (SELECT trace_id, CASE WHEN short IS NOT NULL THEN len(short) <= len(tokens) AND tokens[1:len(short)] = short END AS ok FROM p)
SELECT trace_id, count(ok) AS n_comparisons, bool_and(ok) AS exact_prefix,
  CASE WHEN count(ok) = 0 THEN 'insufficient_data' WHEN bool_and(ok) THEN 'ok' ELSE 'divergent' END AS status FROM k GROUP BY 1""")
def _(t):
    shifted = (F.col("family") == "fr") & (F.col("cap") == 16)
    cut = F.when(shifted, F.slice("tokens", F.lit(2), F.col("cap"))).otherwise(F.slice("tokens", F.lit(1), F.col("cap")))
    caps = F.explode(F.when(F.size("tokens") > 5, F.array(F.lit(8), F.lit(16), F.lit(32))).otherwise(F.array(F.lit(8))))
    runs = t("traces").select("trace_id", "family", "tokens", caps.alias("cap"))
    return Q.prefix_invariance(runs.select("trace_id", "cap", cut.alias("tokens")), ["trace_id"], "cap")


def summary_sql(source, groups):
    return f"""SELECT {groups}, metric, count(value) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median,
      round(coalesce(stddev_samp(value), 0.0), 6) AS std, min(value) AS min, max(value) AS max,
      round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.9), 6) AS p90
    FROM {source} WHERE value IS NOT NULL GROUP BY {groups}, metric"""


@query("loop_summary", f"""WITH long AS (
  SELECT condition_id, 'longest_run_length' AS metric, CAST(longest_run_length AS DOUBLE) AS value FROM records
  UNION ALL SELECT condition_id, 'degeneration_onset_index', CAST(degeneration_onset_index AS DOUBLE) FROM records
  UNION ALL SELECT condition_id, 'top_motif_count', CAST(top_motif_count AS DOUBLE) FROM records),
c AS (SELECT condition_id, count(*) AS n_records, count(degeneration_onset_index) AS n_with_degeneration_onset,
  count(*) FILTER (longest_run_is_special) AS special_longest_run_count FROM records GROUP BY 1)
SELECT * FROM ({summary_sql('long', 'condition_id')}) s JOIN c USING (condition_id)""")
def _(t):
    return Q.loop_summary(t("records"), ["condition_id"])
