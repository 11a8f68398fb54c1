from pyspark.sql import functions as F

from ..functions import identity as I
from ..functions.status import record_status
from ..operators import pairing as M
from ..operators import population as P
from ..operators import provenance as V
from .registry import query
from .scalars import STATUS_SQL, sql_id

KEYS = "presentation_id, task_id, condition_id, mode, seed, repeat"


@query("matched_trials", f"SELECT {KEYS} FROM records WHERE arm = 'A' INTERSECT SELECT {KEYS} FROM records WHERE arm = 'B'")
def _(t):
    return M.matched_trials(t("records"))


@query("dedupe_last", f"""SELECT arm, {KEYS}, trial_id, correct FROM (SELECT *, row_number() OVER (
  PARTITION BY arm, {KEYS} ORDER BY trial_id DESC) AS rn FROM records) r WHERE rn = 1""")
def _(t):
    return M.dedupe_last(t("records"), ["arm", *M.TRIAL_KEY], ["trial_id"], ["trial_id", "correct"])


DECLARED = """declared AS (SELECT arm, 'pres-' || s_suppkey || '-' || y || '-' || m AS presentation_id
  FROM supplier, range(1995, 2001) a(y), range(1, 13) b(m), (SELECT unnest(['A', 'B']) AS arm) c
  WHERE NOT (arm = 'B' AND s_nationkey = 3))"""
EXPECTED = """expected AS (
  SELECT arm, presentation_id, 'cond-sampled' AS condition_id, 'sampled' AS mode, CAST(seed AS BIGINT) AS seed, CAST(rep AS BIGINT) AS repeat
  FROM declared, range(0, 2) s(seed), range(0, 2) r(rep)
  UNION ALL SELECT arm, presentation_id, 'cond-greedy', 'greedy', NULL, rep FROM declared, range(0, 2) r(rep))"""


def declared(t):
    rows = t("supplier").select("s_suppkey", "s_nationkey", F.explode(F.sequence(F.lit(1995), F.lit(2000))).alias("y"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("m"))
    rows = rows.select("*", F.explode(F.array(F.lit("A"), F.lit("B"))).alias("arm"))
    return rows.where(~((F.col("arm") == "B") & (F.col("s_nationkey") == 3))).select(
        "arm", F.concat_ws("-", F.lit("pres"), "s_suppkey", "y", "m").alias("presentation_id")
    )


def expected(t, modes=("sampled", "greedy")):
    records = t("records")
    conditions = records.select("arm", "condition_id", "mode").distinct()
    spec = records.select("arm").distinct().select(
        "arm", F.array(F.lit(0), F.lit(1)).alias("sampled_seeds"), F.lit(2).alias("sampled_repeats_per_seed"),
        F.lit(2).alias("greedy_repeats"),
    )
    out = None
    for mode in modes:
        part = P.expected_trials(spec, declared(t), conditions, "arm", mode)
        out = part if out is None else out.unionByName(part)
    return out


@query("expected_trials", f"WITH {DECLARED}, {EXPECTED} SELECT * FROM expected")
def _(t):
    return expected(t)


@query("expected_counts", """SELECT p_partkey, f * p_size AS n_tasks, CASE WHEN g > 0 THEN f * p_size ELSE CAST(0 AS BIGINT) END AS greedy_draws,
  f * p_size * g AS greedy_executions, f * p_size * s AS sampled_draws, f * p_size * s * 3 AS sampled_executions,
  CASE WHEN g > 0 THEN f * p_size ELSE CAST(0 AS BIGINT) END + f * p_size * s AS total_draws, f * p_size * g + f * p_size * s * 3 AS total_executions
FROM (SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size, CAST(CASE WHEN p_type = 'ECONOMY' THEN 2 ELSE 5 END AS BIGINT) AS f,
  CAST(p_size % 3 AS BIGINT) AS g, CAST(p_size % 4 AS BIGINT) AS s FROM part) p""")
def _(t):
    families = F.when(F.col("p_type") == "ECONOMY", 2).otherwise(5)
    size = F.col("p_size")
    return t("part").select("p_partkey", *P.expected_counts(families, size, size % 4, F.lit(3), size % 3))


def _side(x):
    arm = x.upper()
    return f"""(SELECT count(*) FROM records WHERE arm = '{arm}') AS observed_executions_{x},
  (SELECT count(*) FROM (SELECT DISTINCT {KEYS} FROM records WHERE arm = '{arm}')) AS unique_trial_keys_{x},
  (SELECT count(*) FROM (SELECT * EXCLUDE (arm) FROM expected WHERE arm = '{arm}')) AS expected_trials_{x},
  (SELECT count(*) FROM (SELECT {PROJ} FROM expected WHERE arm = '{arm}' EXCEPT SELECT {PROJ} FROM records WHERE arm = '{arm}')) AS missing_trials_{x},
  (SELECT count(*) FROM (SELECT {PROJ} FROM records WHERE arm = '{arm}' EXCEPT SELECT {PROJ} FROM expected WHERE arm = '{arm}')) AS unexpected_trials_{x},
  (SELECT count(*) FROM (SELECT 1 FROM records WHERE arm = '{arm}' GROUP BY presentation_id, condition_id, seed
     HAVING count(DISTINCT tokens) > 1)) AS ambiguous_draws_{x},
  (SELECT count(*) FROM (SELECT presentation_id FROM records WHERE arm = '{arm}' EXCEPT SELECT presentation_id FROM declared WHERE arm = '{arm}')) = 0
   AND (SELECT count(*) FROM (SELECT presentation_id FROM declared WHERE arm = '{arm}' EXCEPT SELECT presentation_id FROM records WHERE arm = '{arm}')) = 0
     AS presentation_population_match_{x}"""


PROJ = "presentation_id, condition_id, mode, seed, repeat"


@query("population_audit", f"""WITH {DECLARED}, {EXPECTED}, z AS (SELECT {_side('a')}, {_side('b')},
  (SELECT count(*) FROM (SELECT {KEYS} FROM records WHERE arm = 'A' INTERSECT SELECT {KEYS} FROM records WHERE arm = 'B')) AS matched_pairs)
SELECT *, observed_executions_a - unique_trial_keys_a AS duplicate_keys_a, observed_executions_b - unique_trial_keys_b AS duplicate_keys_b,
  unique_trial_keys_a - matched_pairs AS unmatched_a, unique_trial_keys_b - matched_pairs AS unmatched_b, false AS complete,
  'arm_a; arm_b; declarations_unequal; pairs_short' AS incomplete_reasons FROM z""")
def _(t):
    audit = P.population_audit(t("records"), expected(t), declared(t))
    return audit.withColumn("incomplete_reasons", F.array_join("incomplete_reasons", "; "))


PAIRS = f"""mk AS (SELECT {KEYS} FROM records WHERE arm = 'A' INTERSECT SELECT {KEYS} FROM records WHERE arm = 'B'),
mr AS (SELECT r.* FROM records r WHERE EXISTS (SELECT 1 FROM mk WHERE mk.presentation_id = r.presentation_id AND mk.task_id = r.task_id
  AND mk.condition_id = r.condition_id AND mk.mode = r.mode AND mk.seed IS NOT DISTINCT FROM r.seed AND mk.repeat = r.repeat)),
cd AS (SELECT arm, presentation_id, task_id, condition_id, seed, count(*) AS n_executions, count(DISTINCT tokens) > 1 AS ambiguous,
  arg_min(trial_id, repeat || '/' || trial_id) AS rep FROM mr GROUP BY ALL),
pairs AS (SELECT a.presentation_id, a.task_id, a.condition_id, a.seed, a.n_executions AS n_executions_a, b.n_executions AS n_executions_b,
  a.ambiguous AS ambiguous_a, b.ambiguous AS ambiguous_b, a.rep AS rep_a, b.rep AS rep_b
  FROM (SELECT * FROM cd WHERE arm = 'A') a JOIN (SELECT * FROM cd WHERE arm = 'B') b ON a.presentation_id = b.presentation_id
   AND a.task_id = b.task_id AND a.condition_id = b.condition_id AND a.seed IS NOT DISTINCT FROM b.seed)"""


@query("paired_population", f"""WITH {PAIRS} SELECT count(*) AS n_draws_a, count(*) AS n_draws_b,
  count(*) FILTER (NOT ambiguous_a) AS n_usable_draws_a, count(*) FILTER (NOT ambiguous_b) AS n_usable_draws_b,
  count(*) FILTER (NOT ambiguous_a AND NOT ambiguous_b) AS n_paired_draws, count(*) FILTER (ambiguous_a) AS n_ambiguous_a,
  count(*) FILTER (ambiguous_b) AS n_ambiguous_b, count(*) FILTER (NOT ambiguous_a AND ambiguous_b) AS n_unpaired_a,
  count(*) FILTER (NOT ambiguous_b AND ambiguous_a) AS n_unpaired_b FROM pairs""")
def _(t):
    return M.paired_population(M.paired_draws(t("records"), ["trial_id"]))


@query("unpaired_examples", f"""WITH {PAIRS}, u AS (SELECT CASE WHEN ambiguous_b THEN 'A' ELSE 'B' END AS arm, presentation_id, task_id,
  condition_id, seed FROM pairs WHERE ambiguous_a <> ambiguous_b)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY arm ORDER BY presentation_id, task_id, condition_id, seed NULLS FIRST) AS example FROM u) x
WHERE example <= 3""")
def _(t):
    return M.unpaired_examples(M.paired_draws(t("records"), ["trial_id"]))


@query("join_gold", """SELECT trial_id, task_id, answer_normalized, CAST(s_nationkey AS VARCHAR) AS gold_answer
FROM records JOIN supplier ON task_id = 'task-' || s_suppkey""")
def _(t):
    tasks = t("supplier").select(F.concat_ws("-", F.lit("task"), "s_suppkey").alias("task_id"),
                                 F.col("s_nationkey").cast("string").alias("answer"))
    return M.join_gold(t("records").select("trial_id", "task_id", "answer_normalized"), tasks, "task_id", "answer")


@query("join_natural", f"""WITH g AS (SELECT arm, task_id, arg_min({STATUS_SQL}, repeat || '/' || trial_id) AS st FROM records WHERE mode = 'greedy' GROUP BY 1, 2)
SELECT arm, task_id, seed, checkpoint, outcome, coalesce(st, 'censored') AS natural_final_status FROM probes LEFT JOIN g USING (arm, task_id)""")
def _(t):
    probes = t("probes").select("arm", "task_id", "seed", "checkpoint", "outcome")
    return M.join_natural(probes, t("records"), record_status(), run=["arm"])


JOINT = """joint AS (SELECT a.checkpoint_label, a.checkpoint_index, a.task_id, a.seed, least(a.family, b.family) AS family,
  a.outcome AS outcome_a, b.outcome AS outcome_b, a.native_closed AS closed_a, b.native_closed AS closed_b
  FROM (SELECT * FROM selected WHERE arm = 'A') a JOIN (SELECT * FROM selected WHERE arm = 'B') b USING (checkpoint_label, task_id, seed))"""


@query("jointly_eligible", f"WITH {JOINT} SELECT * FROM joint")
def _(t):
    return M.jointly_eligible(M.select_checkpoints(t("probes")))


# ---- provenance -----------------------------------------------------------------------------------------------
FIELDS = {
    "model.repo_id": "repo_id", "model.revision": "revision", "model.precision": "precision",
    "runtime.runtime_version": "runtime_version", "runtime.hardware": "hardware", "spec.prompt_policy": "prompt_policy",
    "spec.max_tokens": "max_tokens", "spec.capture_level": "capture_level",
    "task_pack.generator_version": "generator_version", "decoding.conditions": "decoding",
}


def run_pairs(t):
    runs = t("runs")
    a = runs.select("run_no", "run_id", F.struct(*FIELDS.values()).alias("a"))
    b = runs.select((F.col("run_no") - 1).alias("run_no"), F.struct(*FIELDS.values()).alias("b"))
    return a.join(b, "run_no")


def pair_fields():
    return {k: (F.col(f"a.{v}"), F.col(f"b.{v}")) for k, v in FIELDS.items()}


PAIR_SQL = "rp AS (SELECT a.run_no, a.run_id, a AS a, b AS b FROM runs a JOIN runs b ON b.run_no = a.run_no + 1)"
LONG_SQL = "df AS (" + " UNION ALL ".join(
    f"""SELECT run_id, run_no, '{k}' AS field, CAST(a."{v}" AS VARCHAR) AS a, CAST(b."{v}" AS VARCHAR) AS b,
  CASE WHEN a."{v}" IS NULL OR b."{v}" IS NULL THEN 'missing' WHEN a."{v}" = b."{v}" THEN 'identical' ELSE 'changed' END AS state FROM rp"""
    for k, v in FIELDS.items()) + ")"


@query("config_diff", f"WITH {PAIR_SQL}, {LONG_SQL} SELECT run_id, field, state, a, b FROM df")
def _(t):
    return V.config_diff(run_pairs(t), "run_id", pair_fields())


SETS_SQL = """arrs AS (SELECT run_id, any_value(run_no) AS run_no,
  list_sort(coalesce(list(split_part(field, '.', 2)) FILTER (state = 'changed' AND field LIKE 'model.%'), [])) AS model,
  list_sort(coalesce(list(split_part(field, '.', 2)) FILTER (state = 'changed' AND field LIKE 'runtime.%'), [])) AS runtime,
  list_sort(coalesce(list(split_part(field, '.', 2)) FILTER (state = 'changed' AND field LIKE 'decoding.%'), [])) AS decoding,
  list_sort(coalesce(list(split_part(field, '.', 2)) FILTER (state = 'changed' AND field LIKE 'spec.%'), [])) AS spec,
  list_sort(coalesce(list(split_part(field, '.', 2)) FILTER (state = 'changed' AND field LIKE 'task_pack.%'), [])) AS pack,
  list_sort(coalesce(list(field) FILTER (state = 'missing'), [])) AS missing FROM df GROUP BY 1),
kinds AS (SELECT *, list_filter(model, lambda m: m IN ('repo_id', 'revision')) AS source,
  list_filter(model, lambda m: m NOT IN ('precision')) AS beyond FROM arrs),
lab AS (SELECT *, CASE WHEN len(source) > 0 THEN 'different_source_model'
  WHEN len(model) > 0 AND len(runtime) = 0 AND len(beyond) = 0 THEN 'weight_representation'
  WHEN len(model) > 0 AND len(runtime) > 0 THEN 'confounded_model_runtime' WHEN len(model) > 0 THEN 'model_other'
  WHEN len(runtime) > 0 THEN 'runtime_hardware' WHEN len(decoding) > 0 THEN 'decoding' ELSE 'same_deployment' END AS label,
  CASE WHEN len(source) > 0 THEN source WHEN len(model) > 0 THEN model WHEN len(runtime) > 0 THEN runtime ELSE decoding END AS cf FROM kinds)"""
HEAD = f"WITH {PAIR_SQL}, {LONG_SQL}, {SETS_SQL}"


@query("classify_contrast", f"{HEAD} SELECT run_id, label AS contrast, array_to_string(cf, ',') AS changed_fields FROM lab")
def _(t):
    states = run_pairs(t).select("run_id", V.field_states(pair_fields()).alias("states"))
    kind = V.contrast(V.fields_in_state(F.col("states"), "changed"))
    return states.select("run_id", kind.alias("k")).select(
        "run_id", F.col("k.label").alias("contrast"), F.array_join("k.fields", ",").alias("changed_fields")
    )


def gated_pairs(t):
    states = run_pairs(t).withColumn("states", V.field_states(pair_fields()))
    states = states.select(
        "run_no", "run_id", V.fields_in_state(F.col("states"), "changed").alias("changed"),
        V.fields_in_state(F.col("states"), "missing").alias("missing"),
        ((F.col("a.max_tokens") == 2048) & (F.col("b.max_tokens") == 2048)).alias("verified"),
    )
    parts = t("lineitem").select(F.explode(F.array(
        F.struct(F.col("l_partkey").alias("run_no"), F.lit("A").alias("arm")),
        F.struct((F.col("l_partkey") - 1).alias("run_no"), F.lit("B").alias("arm")),
    )).alias("p"), "l_linenumber", "l_returnflag").select("p.run_no", "p.arm", "l_linenumber", "l_returnflag")
    tasks = P.arm_set_counts(parts, ["run_no"], "l_linenumber").select("run_no", "only_a", "only_b")
    pres = P.arm_set_counts(parts, ["run_no"], "l_returnflag").select(
        "run_no", (F.col("only_a") + F.col("only_b") > 0).alias("presentation_mismatch")
    )
    joined = states.join(tasks, "run_no", "left").join(pres, "run_no", "left").fillna(
        {"only_a": 0, "only_b": 0, "presentation_mismatch": False}
    )
    gated = V.comparability_gate(joined, "changed", "missing", "only_a", "only_b", "presentation_mismatch")
    return gated.withColumn("complete", F.col("only_a") == 0)


SETCOUNT = """pm AS (SELECT l_partkey AS run_no, 'A' AS arm, l_linenumber, l_returnflag FROM lineitem
  UNION ALL SELECT l_partkey - 1, 'B', l_linenumber, l_returnflag FROM lineitem),
tc AS (SELECT run_no, count(*) FILTER (a AND NOT b) AS only_a, count(*) FILTER (b AND NOT a) AS only_b FROM
  (SELECT run_no, l_linenumber, bool_or(arm = 'A') AS a, bool_or(arm = 'B') AS b FROM pm GROUP BY ALL) x GROUP BY 1),
pc AS (SELECT run_no, bool_or(a <> b) AS mm FROM
  (SELECT run_no, l_returnflag, bool_or(arm = 'A') AS a, bool_or(arm = 'B') AS b FROM pm GROUP BY ALL) x GROUP BY 1),
gate AS (SELECT l.*, coalesce(only_a, 0) AS oa, coalesce(only_b, 0) AS ob, a.max_tokens = 2048 AND b.max_tokens = 2048 AS verified,
  list_filter([
  CASE WHEN len(missing) > 0 THEN 'fields_unknown' END, CASE WHEN coalesce(only_a, 0) + coalesce(only_b, 0) > 0 THEN 'tasks_unequal' END,
  CASE WHEN len(model) > 0 AND len(runtime) > 0 THEN 'model_and_runtime' END, CASE WHEN len(runtime) > 1 THEN 'runtime_many' END,
  CASE WHEN len(pack) > 0 THEN 'pack_version' END, CASE WHEN len(decoding) > 0 THEN 'decoding' END,
  CASE WHEN list_contains(spec, 'prompt_policy') THEN 'prompt' END, CASE WHEN coalesce(mm, false) THEN 'presentations_unequal' END,
  CASE WHEN list_contains(spec, 'max_tokens') THEN 'horizon' END, CASE WHEN list_contains(spec, 'capture_level') THEN 'capture' END
  ], lambda x: x IS NOT NULL) AS reasons
  FROM lab l JOIN rp USING (run_id) LEFT JOIN tc ON tc.run_no = l.run_no LEFT JOIN pc ON pc.run_no = l.run_no)"""
EXPLAINED = """list_transform(reasons, lambda r: CASE r WHEN 'fields_unknown' THEN r || ': ' || array_to_string(missing, ',')
  WHEN 'tasks_unequal' THEN r || ': only_a=' || oa || ', only_b=' || ob
  WHEN 'runtime_many' THEN r || ': ' || array_to_string(list_transform(runtime, lambda x: 'runtime.' || x), ',')
  WHEN 'pack_version' THEN r || ': ' || array_to_string(pack, ',') ELSE r END)"""


@query("comparability_gate", f"""{HEAD}, {SETCOUNT} SELECT run_id, label AS contrast, array_to_string({EXPLAINED}, '; ') AS reasons,
  len(reasons) = 0 AS clean, CAST(len(model) + len(runtime) + len(decoding) AS BIGINT) AS n_dimensions_changed FROM gate""")
def _(t):
    return gated_pairs(t).select("run_id", "contrast", F.array_join("explained", "; ").alias("reasons"), "clean",
                                 "n_dimensions_changed")


@query("publication_gate", f"""{HEAD}, {SETCOUNT}, rf AS (SELECT *, oa = 0 AS complete, len(reasons) + CAST(NOT verified AS INT) + CAST(oa > 0 AS INT) AS nr FROM gate)
SELECT run_id, CAST(nr AS BIGINT) AS n_refusal_reasons, nr > 0 AS refused, false AS exploratory, '' AS overrides_applied,
  verified AND complete AND nr = 0 AS publication_grade FROM rf""")
def _(t):
    out = V.publication_gate(gated_pairs(t), require_complete=True)
    return out.select("run_id", F.size("refusal_reasons").alias("n_refusal_reasons"), "refused", "exploratory",
                      F.array_join("overrides_applied", ",").alias("overrides_applied"), "publication_grade")


# ---- structures, locks, runs ----------------------------------------------------------------------------------
STRUCT = """SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'arith' WHEN 1 THEN 'path' WHEN 2 THEN 'order' WHEN 3 THEN 'logic' WHEN 4 THEN 'sm' ELSE 'other' END AS family,
  p_size, p_name AS n, p_brand AS b, p_type AS y, string_split(p_name, ' ') AS w FROM part"""


def q(x):
    return f"""('"' || {x} || '"')"""


def qlist(items):
    return f"""('[' || array_to_string(list_transform(list_sort({items}), lambda x: '"' || x || '"'), ', ') || ']')"""


def qnested(items, inner):
    it = f"list_transform({items}, lambda x: list_sort(x))" if inner else items
    return f"""('[' || array_to_string(list_transform(list_sort({it}), lambda x: '[' ||
      array_to_string(list_transform(x, lambda z: '"' || z || '"'), ', ') || ']'), ', ') || ']')"""


SIGNATURE = f"""SELECT p_partkey, family, substr(sha256(CASE family
  WHEN 'arith' THEN '["arith", ' || p_size || ', ' || {q('n')} || ']'
  WHEN 'path' THEN '["path", ' || {q('b')} || ', ' || {q('y')} || ', [' || array_to_string(list_sort([
     '["' || y || '", "' || b || '", ' || p_size || ']', '["' || b || '", "' || n || '", ' || p_partkey % 7 || ']']), ', ') || ']]'
  WHEN 'order' THEN '["order", ' || {qlist('w')} || ', ' || {qnested('[[y, b], w]', False)} || ']'
  WHEN 'logic' THEN '["logic", ' || {qlist('[b, y]')} || ', ' || {qnested('[w, [y, b]]', True)} || ']'
  WHEN 'sm' THEN '["sm", ' || {qnested('[[y, b, n], [b, n, y]]', False)} || ', ' || {q('b')} || ', ' || {q('n')} || ']'
  ELSE '["other"]' END), 1, 16) AS signature FROM ({STRUCT}) s"""


@query("structural_signature", SIGNATURE)
def _(t):
    c, words = F.col, F.split("p_name", " ")
    fams = ["arith", "path", "order", "logic", "sm", "other"]
    family = F.element_at(F.array(*[F.lit(f) for f in fams]), (c("p_size") % 6 + 1).cast("int"))
    edge = lambda a, b, w: F.struct(c(a).alias("from"), c(b).alias("to"), w.cast("bigint").alias("weight"))
    move = lambda a, b, d: F.struct(c(a).alias("state"), c(b).alias("symbol"), c(d).alias("next"))
    structural = F.struct(
        c("p_size").alias("operations"), c("p_name").alias("expression"), c("p_brand").alias("source"),
        c("p_type").alias("target"),
        F.array(edge("p_type", "p_brand", c("p_size")), edge("p_brand", "p_name", c("p_partkey") % 7)).alias("edges"),
        words.alias("items"), F.array(F.array("p_type", "p_brand"), words).alias("constraints"),
        F.array("p_brand", "p_type").alias("variables"), F.array(words, F.array("p_type", "p_brand")).alias("clauses"),
        F.array(move("p_type", "p_brand", "p_name"), move("p_brand", "p_name", "p_type")).alias("transitions"),
        c("p_brand").alias("start"), c("p_name").alias("input"),
    )
    tasks = t("part").select("p_partkey", family.alias("family"), structural.alias("s"))
    return tasks.select("p_partkey", "family", V.structural_signature("family", "s").alias("signature"))


@query("collision_audit", """WITH c AS (SELECT signature, population, count(*) AS n FROM tasks GROUP BY ALL)
SELECT signature, CAST(sum(n) AS BIGINT) AS n_owners, count(*) AS n_pools, min(population) AS first_pool,
  CASE WHEN count(*) > 1 THEN 'cross_pool' ELSE 'within_pool' END AS kind FROM c GROUP BY 1 HAVING sum(n) > 1""")
def _(t):
    return P.collision_audit(t("tasks"), "signature", "population")


LANGS = ("de", "en", "es", "fr")


def shared_sql(kind):
    return f"""SELECT '{kind}' AS id_kind, x.family AS first, y.family AS second, count(DISTINCT x.{kind}) AS overlap FROM tasks x JOIN tasks y
  ON x.{kind} = y.{kind} AND x.family < y.family GROUP BY ALL"""


@query("disjointness", f"""WITH f(first) AS (VALUES {', '.join(f"('{x}')" for x in LANGS)}), k(id_kind) AS (VALUES ('signature'), ('population')),
shared AS ({shared_sql('signature')} UNION ALL {shared_sql('population')})
SELECT k.id_kind, f.first, g.first AS second, coalesce(overlap, 0) AS overlap, coalesce(overlap, 0) = 0 AS disjoint
FROM k JOIN f ON true JOIN f g ON f.first < g.first LEFT JOIN shared s ON s.id_kind = k.id_kind AND s.first = f.first AND s.second = g.first""")
def _(t):
    return P.disjointness(t("tasks"), "family", LANGS, ["signature", "population"])


def digest_sql(item, source, name, group="population"):
    """Root of the digest tree of each group, for up to 256 x 256 items: one digest, or 256 buckets and their fold."""
    return f"""(SELECT {group}, CASE WHEN max(d) = 0 THEN max(dg) ELSE sha256(string_agg(p || ':' || dg, chr(10) ORDER BY p)) END AS {name} FROM (
      SELECT {group}, d, substr(md5(i), 1, d) AS p, sha256(string_agg(leaf, chr(10) ORDER BY leaf)) AS dg FROM (
        SELECT *, CASE WHEN count(*) OVER (PARTITION BY {group}) <= 256 THEN 0 ELSE 2 END AS d FROM (
          SELECT {group}, i, CASE WHEN count(*) = 1 THEN i ELSE i || chr(9) || count(*) END AS leaf
          FROM (SELECT {group}, {item} AS i FROM {source}) x GROUP BY {group}, i) y) z GROUP BY {group}, d, substr(md5(i), 1, d)) w GROUP BY {group})"""


@query("set_digest", f"""SELECT population AS name, 'ids' AS form, ids AS digest FROM {digest_sql('task_id', 'tasks', 'ids')} d
UNION ALL SELECT family, 'members', members FROM {digest_sql('task_id', 'tasks', 'members', 'family')} e
UNION ALL SELECT family, 'populations', populations FROM {digest_sql('population', 'tasks', 'populations', 'family')} f""")
def _(t):
    tasks = t("tasks")
    forms = [("population", "ids", "task_id"), ("family", "members", "task_id"), ("family", "populations", "population")]
    out = [P.set_digest(tasks, [g], F.col(c)).select(F.col(g).alias("name"), F.lit(form).alias("form"), "digest") for g, form, c in forms]
    return out[0].unionByName(out[1]).unionByName(out[2])


def lock_sql(source, specs):
    return f"""(SELECT population, (SELECT count(*) FROM {source} s WHERE s.population = p.population) AS n_tasks, a.task_ids_sha256, b.presentation_ids_sha256,
  c.structural_signature_sha256, (SELECT string_agg(l || '=' || n, ',' ORDER BY l) FROM (SELECT family AS l, count(*) AS n FROM {source} s WHERE s.population = p.population GROUP BY 1)) AS family_counts,
  (SELECT string_agg(l || '=' || n, ',' ORDER BY l) FROM (SELECT level AS l, count(*) AS n FROM {source} s WHERE s.population = p.population GROUP BY 1)) AS difficulty_counts, sp.* EXCLUDE (population)
FROM (SELECT DISTINCT population FROM {source}) p JOIN {digest_sql('task_id', source, 'task_ids_sha256')} a USING (population)
JOIN {digest_sql('presentation_id', source, 'presentation_ids_sha256')} b USING (population)
JOIN {digest_sql("task_id || ':' || signature", source, 'structural_signature_sha256')} c USING (population) JOIN ({specs}) sp USING (population))"""


# Specifications of the populations; the stored locks hold another value of one field each, and one another key.
LOCKED = {"task_pack": ("src8", "'pack-1'", "'pack-0'"), "generator_version": ("src9", "'gen-2'", "'gen-1'"), "split": ("src10", "'main'", "'pilot'"),
          "task_seed": ("src11", "CAST(substr(population, 4) AS BIGINT)", "CAST(-1 AS BIGINT)"), "prompt_policy": ("src12", "'plain'", "'terse'"),
          "n_per_family": ("src13", "CAST(20 AS BIGINT)", "CAST(10 AS BIGINT)")}
SPEC_KEY = sql_id("pop", """('{"families":["arith","path"],"n_per_family":20,"prompt_policy":"plain","split":"main","task_pack":"pack-1","task_seed":' || substr(population, 4) || '}')""")


def specs_sql(stored):
    fields = ", ".join(f"CASE WHEN {stored} AND population = '{p}' THEN {old} ELSE {new} END AS {f}" for f, (p, new, old) in LOCKED.items())
    return f"""SELECT population, CASE WHEN {stored} AND population = 'src14' THEN 'pop-other' ELSE {SPEC_KEY} END AS population_key, {fields},
  CAST({'30' if stored == 'true' else '40'} AS BIGINT) AS expected_executions FROM (SELECT DISTINCT source AS population FROM documents) q"""


def lock_specs(t, stored):
    """The same by the library: keys are hashed from the fields."""
    populations = t("tasks").select("population").distinct()
    seed = F.substring("population", 4, 9).cast("bigint")
    spec = {"task_pack": F.lit("pack-1"), "split": F.lit("main"), "task_seed": seed, "prompt_policy": F.lit("plain"), "n_per_family": F.lit(20)}
    families = F.array(F.lit("path"), F.lit("arith"))
    key = I.population_key(spec, families, families)
    cases = {f: (F.lit(stored) & (F.col("population") == p), F.expr(new), F.expr(old)) for f, (p, new, old) in LOCKED.items()}
    return populations.select(
        "population", F.when(F.lit(stored) & (F.col("population") == "src14"), "pop-other").otherwise(key).alias("population_key"),
        *[F.when(changed, old).otherwise(new).alias(f) for f, (changed, new, old) in cases.items()],
        F.lit(30 if stored else 40).cast("bigint").alias("expected_executions"))


@query("population_lock", f"SELECT * FROM {lock_sql('tasks', specs_sql('false'))} x")
def _(t):
    return P.population_lock(t("tasks"), lock_specs(t, False))


COMPARED = [*P.LOCK_FIELDS, *P.SPEC_FIELDS]
LOCK_CASES = ", ".join(f"CASE WHEN f.population_key = o.population_key AND f.{c} <> o.{c} THEN '{c}' END" for c in COMPARED)


@query("lock_verify", f"""SELECT population, o.n_tasks IS NOT NULL AS locked, coalesce(m, '') = '' AS ok, coalesce(m, '') AS mismatches FROM (
SELECT population, o, array_to_string(list_filter([CASE WHEN f.population_key <> o.population_key THEN 'population_key' END, {LOCK_CASES}], lambda x: x IS NOT NULL), '; ') AS m
FROM {lock_sql('tasks', specs_sql('false'))} f LEFT JOIN (SELECT * FROM {lock_sql('old_tasks', specs_sql('true'))} z WHERE population <> 'src7') o USING (population)) v""")
def _(t):
    old = P.population_lock(t("old_tasks"), lock_specs(t, True)).where(F.col("population") != "src7")
    out = P.lock_verify(P.population_lock(t("tasks"), lock_specs(t, False)), old)
    return out.withColumn("mismatches", F.array_join("mismatches", "; "))


@query("population_key", f"""SELECT run_id, {sql_id('pop', '''('{"families":' || CASE WHEN max_tokens > 2048 THEN '["arith","logic","order","path","sm"]'
  ELSE CASE WHEN decoding < prompt_policy THEN '["' || decoding || '","' || prompt_policy || '"]' ELSE '["' || prompt_policy || '","' || decoding || '"]' END END
  || ',"prompt_policy":"' || prompt_policy || '","split":"' || hardware || '","task_seed":' || run_no || '}')''')} AS population_key FROM runs""")
def _(t):
    families = F.when(F.col("max_tokens") > 2048, F.array().cast("array<string>")).otherwise(F.array("prompt_policy", "decoding"))
    everything = F.array(*[F.lit(f) for f in ("sm", "arith", "logic", "order", "path")])
    spec = {"prompt_policy": F.col("prompt_policy"), "split": F.col("hardware"), "task_seed": F.col("run_no")}
    return t("runs").select("run_id", I.population_key(spec, families, everything).alias("population_key"))


@query("duplicate_runs", """SELECT repo_id || '/' || max_tokens AS spec_hash, revision AS variant, run_id, n_same FROM (
  SELECT *, count(*) OVER (PARTITION BY repo_id, max_tokens, revision) AS n_same FROM runs) r WHERE n_same > 1""")
def _(t):
    runs = t("runs").select("run_id", F.concat_ws("/", "repo_id", "max_tokens").alias("spec_hash"),
                            F.col("revision").alias("variant"))
    return P.duplicate_runs(runs, "run_id", "spec_hash", "variant")


HEART = """SELECT user_id, max(ts) AS modified, CASE max_by(event_type, event_id) WHEN 'click' THEN 'RUNNING' WHEN 'view' THEN 'IN_PROGRESS'
  WHEN 'error' THEN 'FAILED' WHEN 'signup' THEN 'PARTIAL' ELSE 'EVIDENCE_COMPLETE' END AS status FROM events GROUP BY 1"""


@query("live_stale_runs", f"""SELECT user_id, status, age_seconds, CASE WHEN age_seconds < 21600 THEN 'live' ELSE 'stale' END AS liveness FROM (
  SELECT *, CAST(epoch(TIMESTAMP '2024-01-31 00:00:00') - floor(epoch(modified)) AS BIGINT) AS age_seconds FROM ({HEART}) h) x WHERE status <> 'EVIDENCE_COMPLETE'""")
def _(t):
    states = {"click": "RUNNING", "view": "IN_PROGRESS", "error": "FAILED", "signup": "PARTIAL"}
    status = F.lit("EVIDENCE_COMPLETE")
    last = F.max_by("event_type", "event_id")
    for event, name in states.items():
        status = F.when(last == event, name).otherwise(status)
    runs = t("events").groupBy("user_id").agg(F.max("ts").alias("modified"), status.alias("status"))
    return P.live_stale_runs(runs, "user_id", "status", F.col("modified"), F.lit("2024-01-31 00:00:00"), 21600)


CONDS = """FROM (SELECT p_partkey, p_size % 3 AS g, p_size % 4 AS s, 1 + p_size % 2 AS r FROM part) p"""


@query("conditions_expand", f"""SELECT p_partkey, 'greedy' AS mode, CAST(NULL AS BIGINT) AS seed, rep AS repeat {CONDS}, range(0, 3) z(rep) WHERE rep < g
UNION ALL SELECT p_partkey, 'sampled', sd, rep {CONDS}, range(0, 4) y(sd), range(0, 2) z(rep) WHERE sd < s AND rep < r""")
def _(t):
    from ..operators.conditions import conditions_expand

    size = F.col("p_size")
    seeds = F.filter(F.sequence(F.lit(0), F.lit(3)), lambda x: x < size % 4)
    specs = t("part").select("p_partkey", size.alias("p_size"), seeds.alias("seeds"))
    return conditions_expand(specs, ["p_partkey"], size % 3, F.col("seeds"), 1 + size % 2)


@query("distinct_conditions", """SELECT condition_id, mode, min(trial_id) AS first_trial FROM records GROUP BY ALL""")
def _(t):
    from ..operators.conditions import distinct_conditions

    out = distinct_conditions(t("records"), "condition_id", ["trial_id"], ["trial_id", "mode"])
    return out.withColumnRenamed("trial_id", "first_trial")
