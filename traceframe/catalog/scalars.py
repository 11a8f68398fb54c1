from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import identity as I
from ..functions import status as S
from ..functions import text as X
from ..operators import checkpoints as C
from .registry import query

NL = "chr(10)"
SPECIAL = r"'<\|[^|]*\|>|<think>|</think>'"


@query("split_tokens", """SELECT trial_id,
  array_to_string(CASE WHEN p > 0 THEN tokens[1:p-1] ELSE tokens END, ' ') AS reasoning,
  array_to_string(CASE WHEN p > 0 THEN tokens[p+1:] ELSE [] END, ' ') AS final, coalesce(p > 0, false) AS closed
FROM (SELECT *, list_position(tokens, '99') AS p FROM records) r""")
def _(t):
    mark = F.lit("99")
    return t("records").select(
        "trial_id",
        F.array_join(A.reasoning_tokens(F.col("tokens"), mark), " ").alias("reasoning"),
        F.array_join(A.final_tokens(F.col("tokens"), mark), " ").alias("final"),
        F.array_contains("tokens", mark).alias("closed"),
    )


@query("strip_trailing_eos", """SELECT trial_id, array_to_string(CASE WHEN list_contains(tokens, '99')
  THEN tokens[1:list_position(tokens, '99') - 1]
  ELSE string_split(regexp_replace(array_to_string(tokens, ' '), '( (17|16))+$', ''), ' ') END, ' ') AS kept FROM records""")
def _(t):
    eos = F.array(F.lit("17"), F.lit("16"))
    return t("records").select(
        "trial_id", F.array_join(A.reasoning_only(F.col("tokens"), F.lit("99"), eos), " ").alias("kept")
    )


@query("split_text", """SELECT event_id,
  CASE WHEN p > 0 THEN substr(text, 1, p - 1) ELSE text END AS reasoning,
  CASE WHEN p > 0 THEN substr(text, p + 8) ELSE '' END AS final, p > 0 AS closed,
  array_to_string(string_split(text || text, '</think>')[:-2], '</think>') AS reasoning_last,
  CASE WHEN p > 0 THEN string_split(text || text, '</think>')[-1] ELSE '' END AS final_last
FROM (SELECT *, strpos(text, '</think>') AS p FROM answers) a WHERE p > 0
UNION ALL SELECT event_id, text, '', false, text || text, '' FROM answers WHERE strpos(text, '</think>') = 0""")
def _(t):
    first = X.split_first(F.col("text"))
    last = X.split_last(F.concat("text", "text"), F.lit(False))
    return t("answers").select(
        "event_id", first["reasoning"].alias("reasoning"), first["final"].alias("final"),
        first["closed"].alias("closed"), last["reasoning"].alias("reasoning_last"), last["final"].alias("final_last"),
    )


@query("strip_special", f"SELECT event_id, regexp_replace(text, {SPECIAL}, '', 'g') AS clean FROM answers")
def _(t):
    return t("answers").select("event_id", X.strip_special(F.col("text")).alias("clean"))


RAW = f"""SELECT *, CASE WHEN regexp_matches(clean, '(?i)answer\\s*[:=]')
    THEN trim(string_split_regex(clean, '(?i)answer\\s*[:=]')[-1], ' ' || {NL})
    ELSE list_filter(list_transform(string_split(clean, {NL}), lambda x: trim(x)), lambda x: x <> '')[-1] END AS raw
  FROM (SELECT *, regexp_replace(text, {SPECIAL}, '', 'g') AS clean FROM answers) a"""
INT = r"regexp_replace(regexp_replace(nullif(regexp_extract(raw, '-?[0-9]+'), ''), '^(-?)0+([0-9])', '\1\2'), '^-0$', '0')"
SM = r"'s' || regexp_replace(nullif(regexp_extract({x}, '(?i)\b(?:state\s*)?s\s*(\d+)\b', 1), ''), '^0+([0-9])', '\1')"
NORM = f"""SELECT *, CASE WHEN family IN ('arith', 'path') THEN {INT}
    WHEN family = 'order' THEN nullif(lower(array_to_string(regexp_extract_all(raw, '[A-Za-z]+'), ',')), '')
    WHEN family = 'logic' THEN nullif(lower(array_to_string(regexp_extract_all(raw, '(?i)\\b(true|false)\\b'), ', ')), '')
    ELSE {SM.format(x='raw')} END AS norm FROM ({RAW}) r"""
GOLD = f"""SELECT *, CASE WHEN family = 'order' THEN lower(array_to_string(
        list_filter(string_split_regex(trim(gold), '[,\\s]+'), lambda x: x <> ''), ','))
    WHEN family = 'logic' THEN array_to_string(list_transform(string_split(gold, ','), lambda x: lower(trim(x))), ', ')
    WHEN family = 'sm' THEN coalesce({SM.format(x='gold')}, lower(trim(gold))) ELSE trim(gold) END AS canon FROM ({NORM}) n"""


@query("extract_answer", f"SELECT event_id, raw AS answer_raw FROM ({RAW}) r")
def _(t):
    return t("answers").select("event_id", X.extract_answer(F.col("text")).alias("answer_raw"))


def normalized(t):
    df = t("answers").withColumn("raw", X.extract_answer(F.col("text")))
    df = df.withColumn("norm", X.normalize_answer(F.col("family"), F.col("raw")))
    return df.withColumn("canon", X.canonical_gold(F.col("family"), F.col("gold")))


@query("normalize_answer", f"SELECT event_id, family, norm AS answer_normalized FROM ({NORM}) n")
def _(t):
    return normalized(t).select("event_id", "family", F.col("norm").alias("answer_normalized"))


@query("canonical_gold", f"SELECT event_id, family, canon AS gold FROM ({GOLD}) n")
def _(t):
    return normalized(t).select("event_id", "family", F.col("canon").alias("gold"))


@query("score_exact", f"SELECT event_id, coalesce(norm = canon, false) AS correct FROM ({GOLD}) n")
def _(t):
    return normalized(t).select("event_id", X.score_exact(F.col("norm"), F.col("canon")).alias("correct"))


@query("answer_state", f"""SELECT event_id, CASE WHEN norm IS NOT NULL THEN
   CASE WHEN norm = canon THEN 'scorable_correct' ELSE 'scorable_incorrect' END
   WHEN raw IS NOT NULL THEN 'unparseable' ELSE 'none' END AS answer_state FROM ({GOLD}) n""")
def _(t):
    right = X.score_exact(F.col("norm"), F.col("canon"))
    return normalized(t).select("event_id", S.answer_state(F.col("norm"), F.col("raw"), right).alias("answer_state"))


STATUS_SQL = """CASE WHEN error_type IS NOT NULL OR finish_reason = 'error' THEN 'error'
  WHEN answer_normalized IS NOT NULL THEN CASE WHEN correct THEN 'correct' ELSE 'incorrect' END
  WHEN NOT missing_answer THEN 'unparseable'
  WHEN capped OR finish_reason = 'length' THEN CASE WHEN think_end_reached THEN 'unparseable' ELSE 'censored' END
  WHEN finish_reason = 'stop' AND NOT think_end_reached THEN 'terminated_no_closure' ELSE 'unparseable' END"""


@query("natural_status", f"SELECT trial_id, {STATUS_SQL} AS status FROM records")
def _(t):
    return t("records").select("trial_id", S.record_status().alias("status"))


@query("tri_state_correct", f"""SELECT trial_id, CASE {STATUS_SQL} WHEN 'correct' THEN true WHEN 'incorrect' THEN false END
  AS final_correct FROM records""")
def _(t):
    return t("records").select("trial_id", S.tri_state_correct(S.record_status()).alias("final_correct"))


@query("exhausted_after_close", "SELECT trial_id, (think_end_reached AND capped) AS exhausted FROM records")
def _(t):
    return t("records").select(
        "trial_id", S.exhausted_after_close(F.col("think_end_reached"), F.col("capped")).alias("exhausted")
    )


def classified(t):
    return S.forced_outcome(t("answers"), F.col("family"), F.col("gold"), F.col("text"), F.col("finish_reason"),
                            F.col("finish_reason") == "length", F.col("probe_error"), F.col("eos_observed"))


@query("forced_outcome", f"""WITH p AS (SELECT *, finish_reason = 'length' AND NOT eos_observed AS spent,
    probe_error IS NOT NULL AS failed,
    CASE WHEN norm IS NOT NULL THEN CASE WHEN norm = canon THEN 'correct' ELSE 'scorable_incorrect' END END AS scored
  FROM ({GOLD}) n)
SELECT event_id, CASE WHEN failed THEN 'error' WHEN spent THEN 'censored' ELSE coalesce(scored, 'unparseable') END AS outcome,
  CASE WHEN spent AND NOT failed THEN coalesce(scored, CASE WHEN raw IS NOT NULL THEN 'unparseable' ELSE 'censored' END) END
    AS pre_censor_outcome,
  (spent AND NOT failed AND raw IS NOT NULL) AS censored_with_extractable_answer,
  (NOT failed AND raw IS NOT NULL) AS answer_observed, (NOT failed AND norm IS NOT NULL) AS answer_scorable,
  (NOT failed AND coalesce(norm = canon, false)) AS correct FROM p""")
def _(t):
    names = ["outcome", "pre_censor_outcome", "censored_with_extractable_answer", "answer_observed", "answer_scorable", "correct"]
    return classified(t).select("event_id", *names)


@query("endpoint_times", """SELECT trial_id,
  CAST(CASE WHEN think_end_reached THEN reasoning_tokens + 1 ELSE total_tokens END AS DOUBLE) AS closure_time,
  think_end_reached AS closure_event, CAST(total_tokens AS DOUBLE) AS termination_time,
  terminated_by_eos AS termination_event, (terminated_by_eos AND NOT think_end_reached) AS competing_event FROM records""")
def _(t):
    return t("records").select(
        "trial_id",
        S.closure_time(F.col("reasoning_tokens"), F.col("total_tokens"), F.col("think_end_reached")).alias("closure_time"),
        F.col("think_end_reached").alias("closure_event"),
        F.col("total_tokens").cast("double").alias("termination_time"),
        F.col("terminated_by_eos").alias("termination_event"),
        (F.col("terminated_by_eos") & ~F.col("think_end_reached")).alias("competing_event"),
    )


@query("throughput", """SELECT trial_id, round(total_tokens * 1000 / wall_ms, 6) AS tokens_per_sec,
  round(CASE WHEN wall_ms > ttft_ms AND total_tokens > 1 THEN (total_tokens - 1) * 1000 / (wall_ms - ttft_ms) END, 6)
    AS decode_tokens_per_sec FROM records""")
def _(t):
    n, wall, first = F.col("total_tokens"), F.col("wall_ms"), F.col("ttft_ms")
    return t("records").select(
        "trial_id", S.tokens_per_second(n, wall).alias("tokens_per_sec"),
        S.decode_tokens_per_second(n, wall, first).alias("decode_tokens_per_sec"),
    )


def sql_id(prefix, body):
    return f"'{prefix}-' || substr(sha256('{I.IDENTITY_SCHEMA}' || chr(10) || {body}), 1, 12)"


@query("content_id", f"""SELECT run_id, {sql_id('dep', '''('{' || array_to_string(list_filter([
  '"hardware":"' || hardware || '"', '"repo_id":"' || repo_id || '"', '"revision":"' || revision || '"',
  '"runtime":{"precision":"' || prec || '","version":"' || runtime_version || '"}'], lambda x: x IS NOT NULL), ',') || '}')''')}
  AS content_id FROM (SELECT *, "precision" AS prec FROM runs) r""")
def _(t):
    tree = {"repo_id": F.col("repo_id"), "revision": F.col("revision"), "hardware": F.col("hardware"),
            "empty": I.not_empty(F.array().cast("array<string>")), "gone": {"empty": F.lit(None).cast("string")},
            "runtime": {"version": F.col("runtime_version"), "precision": F.col("precision")}}
    return t("runs").select("run_id", I.content_id(tree, "dep").alias("content_id"))


def policy():
    """A decoding policy per line item: quantity gives the horizon, discount and tax the penalties."""
    return {
        "mode": F.col("mode"), "max_tokens": F.col("max_tokens"), "temperature": I.canonical_float(F.col("l_tax")),
        "presence_penalty": F.col("l_discount"), "presence_context_size": F.col("l_linenumber"),
        "presence_scope": F.col("scope"), "repetition_penalty": F.col("rep"),
        "repetition_context_size": F.col("l_linenumber"), "stop_on_eos": F.lit(True), "seed": F.col("seed"),
    }


def policies(t):
    return t.wide("lineitem").select(
        "*",
        F.when(F.col("l_returnflag") == "N", "greedy").otherwise("sampled").alias("mode"),
        (F.col("l_quantity").cast("bigint") * 64).alias("max_tokens"),
        F.when(F.col("l_linestatus") == "F", "mlx_window").otherwise("generated").alias("scope"),
        F.when(F.col("l_quantity") > 25, 1.0).otherwise(1.5).alias("rep"),
        F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "R", 1).alias("seed"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("row_id"),
    )


POLICY = """SELECT *, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS row_id,
  CASE WHEN l_returnflag = 'N' THEN 'greedy' ELSE 'sampled' END AS mode, CAST(l_quantity AS BIGINT) * 64 AS max_tokens,
  CASE WHEN l_linestatus = 'F' THEN 'mlx_window' ELSE 'generated' END AS scope,
  CASE WHEN l_quantity > 25 THEN 1.0 ELSE 1.5 END AS rep,
  CASE l_returnflag WHEN 'A' THEN 0 WHEN 'R' THEN 1 END AS seed FROM lineitem"""
NUM = "printf('%.2f', {x})"


def _num(col):
    return f"regexp_replace(printf('%.2f', {col}), '0$', '')"


CONDITION = f"""'{{"max_tokens":' || max_tokens || ',"mode":"' || mode || '"'
  || CASE WHEN l_discount = 0 THEN '' ELSE CASE WHEN scope = 'mlx_window' THEN ',"presence_context_size":' || l_linenumber ELSE '' END
     || ',"presence_penalty":' || {_num('l_discount')} || CASE WHEN scope = 'generated' THEN ',"presence_scope":"generated"' ELSE '' END END
  || CASE WHEN rep = 1.0 THEN '' ELSE ',"repetition_context_size":' || l_linenumber || ',"repetition_penalty":1.5' END
  || ',"stop_on_eos":true,"temperature":' || {_num('l_tax')} || '}}'"""
FULL = f"""'{{"max_tokens":' || max_tokens || ',"mode":"' || mode || '","presence_context_size":' || l_linenumber
  || ',"presence_penalty":' || {_num('l_discount')} || ',"presence_scope":"' || scope || '","repetition_context_size":' || l_linenumber
  || ',"repetition_penalty":' || CASE WHEN rep = 1.0 THEN '1.0' ELSE '1.5' END
  || CASE WHEN seed IS NULL THEN '' ELSE ',"seed":' || seed END || ',"stop_on_eos":true,"temperature":' || {_num('l_tax')} || '}}'"""


@query("condition_id", f"SELECT row_id, {sql_id('cond', CONDITION)} AS condition_id FROM ({POLICY}) p")
def _(t):
    return policies(t).select("row_id", I.condition_id(policy()).alias("condition_id"))


@query("presentation_id", f"""SELECT doc_id, {sql_id('pres', '''('{"prompt_policy":"' || lang || '","prompt_sha256":"' || sha256(text)
  || '","structural_task_id":"' || source || '"}')''')} AS presentation_id FROM documents""")
def _(t):
    return t.wide("documents").select(
        "doc_id", I.presentation_id(F.col("source"), F.col("lang"), F.col("text")).alias("presentation_id")
    )


@query("trial_draw_ids", f"""SELECT row_id,
  {sql_id('trial', f'''('{{"condition":' || {FULL} || ',"presentation_id":"' || l_partkey || '","repeat":' || l_linenumber
    || CASE WHEN seed IS NULL THEN '' ELSE ',"seed":' || seed END || ',"task_id":"' || l_suppkey || '"}}')''')} AS trial_id,
  {sql_id('draw', f'''('{{"condition":' || {CONDITION} || ',"presentation_id":"' || l_partkey || '"'
    || CASE WHEN seed IS NULL THEN '' ELSE ',"seed":' || seed END || ',"task_id":"' || l_suppkey || '"}}')''')} AS draw_id
FROM ({POLICY}) p""")
def _(t):
    task, pres = F.col("l_suppkey").cast("string"), F.col("l_partkey").cast("string")
    return policies(t).select(
        "row_id",
        I.trial_id(task, pres, policy(), F.col("seed"), F.col("l_linenumber")).alias("trial_id"),
        I.draw_id(task, pres, policy(), F.col("seed")).alias("draw_id"),
    )


@query("task_hash_id", """SELECT p_partkey, substr(sha256(p_name || '|' || p_brand || '|' || p_partkey || '|' ||
  CASE WHEN p_size > 10 THEN p_type ELSE '' END), 1, 16) AS task_id FROM part""")
def _(t):
    variant = F.when(F.col("p_size") > 10, F.col("p_type"))
    return t("part").select(
        "p_partkey", I.task_hash_id(F.col("p_name"), F.col("p_brand"), F.col("p_partkey"), variant).alias("task_id")
    )


@query("prefix_digest", """SELECT trial_id, sha256('[' || array_to_string(tokens[1:longest_run_length], ',') || ']') AS prefix_sha256,
  sha256('[' || array_to_string(tokens, ',') || ']') AS tokens_sha256 FROM records""")
def _(t):
    return t("records").select(
        "trial_id",
        I.prefix_digest(F.col("tokens"), F.col("longest_run_length").cast("int")).alias("prefix_sha256"),
        I.prefix_digest(F.col("tokens")).alias("tokens_sha256"),
    )


@query("answer_leak_filter", r"""SELECT event_id, regexp_matches(text,
  '(?i)(answer\s*[:=]\s*|=\s*)' || regexp_escape(trim(gold)) || '([^A-Za-z0-9]|$)') AS leaked FROM answers""")
def _(t):
    return t("answers").select("event_id", X.answer_leaked(F.col("text"), F.col("gold")).alias("leaked"))


@query("checkpoint_grid", """SELECT trial_id,
  array_to_string(list_sort(list_distinct([0, reasoning_tokens] || list_filter([64, 128, 256, 400],
    lambda c: c <= reasoning_tokens))), ',') AS explicit_grid,
  array_to_string(CASE WHEN reasoning_tokens > 16 THEN list_sort(list_distinct([0, reasoning_tokens] ||
    list_transform(range(0, 4), lambda i: CAST(round_even(16 + (reasoning_tokens - 16) / 4 * i, 0) AS BIGINT)))) ELSE [0] END, ',')
    AS uniform_grid FROM records""")
def _(t):
    n = F.col("reasoning_tokens")
    given = F.array(*[F.lit(c) for c in (64, 128, 256, 400)])
    return t("records").select(
        "trial_id",
        F.array_join(A.explicit_checkpoints(n, given), ",").alias("explicit_grid"),
        F.array_join(A.uniform_checkpoints(n, 5), ",").alias("uniform_grid"),
    )


@query("checkpoint_plan", """WITH c AS (SELECT trial_id, reasoning_tokens AS n, unnest([0, 64, 128, 250, 400]) AS cp FROM records),
lens AS (SELECT trial_id, n, cp AS checkpoint FROM c WHERE cp = 0 OR n >= cp UNION SELECT trial_id, reasoning_tokens, reasoning_tokens FROM records),
bad AS (SELECT trial_id, string_agg(CAST(cp AS VARCHAR), ',' ORDER BY cp) FILTER (cp > 0 AND n < cp) AS ineligible FROM c GROUP BY 1)
SELECT trial_id, checkpoint, CASE WHEN checkpoint IN (0, 64, 128, 250, 400) THEN CAST(checkpoint AS VARCHAR) ELSE 'full_prefix' END
  AS checkpoint_label, row_number() OVER (PARTITION BY trial_id ORDER BY checkpoint) - 1 AS checkpoint_index,
  checkpoint = n AS is_full_prefix, coalesce(ineligible, '') AS ineligible FROM lens JOIN bad USING (trial_id)""")
def _(t):
    plan = C.checkpoint_plan(t("records"), ["trial_id"], F.col("reasoning_tokens"), [0, 64, 128, 250, 400], include_full=True)
    return plan.withColumn("ineligible", F.array_join("ineligible", ","))


@query("top_k", """SELECT vec_id, rank, id, value FROM (
  SELECT vec_id, i - 1 AS id, CAST(embedding[i] AS DOUBLE) AS v, round(CAST(embedding[i] AS DOUBLE), 6) AS value,
    row_number() OVER (PARTITION BY vec_id ORDER BY embedding[i] DESC, i) AS rank
  FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) e) x WHERE rank <= 5""")
def _(t):
    top = A.top_k(F.transform("embedding", lambda x: x.cast("double")), 5)
    return t.wide("embeddings").select("vec_id", F.posexplode(top).alias("rank", "s")).select(
        "vec_id", (F.col("rank") + 1).alias("rank"), F.col("s.id").alias("id"), F.col("s.value").alias("value")
    )


@query("entropy", """WITH e AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
z AS (SELECT vec_id, ln(sum(exp(x))) AS lse FROM e GROUP BY 1)
SELECT vec_id, round(-sum(exp(x - lse) * (x - lse)), 6) AS entropy FROM e JOIN z USING (vec_id) GROUP BY 1""")
def _(t):
    return t.wide("embeddings").select("vec_id", A.entropy(A.log_softmax(F.col("embedding"))).alias("entropy"))
