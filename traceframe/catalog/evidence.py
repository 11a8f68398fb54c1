from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from ..operators import pairing as M
from ..operators import transitions as T
from ..session import scratch_path
from ..sources import evidence as E
from ..sources import integrity as N
from .population import digest_sql
from .registry import query
from .scalars import STATUS_SQL
from .transitions import OUTCOME, flag


def nested(records):
    """Flat records back in their stored, nested form."""
    c = F.col
    return records.select(
        F.concat(F.lit("run-"), "arm").alias("run_id"), F.concat(F.lit("dep-"), "arm").alias("deployment_id"),
        F.lit("src-1").alias("source_artifact_id"), F.concat(F.lit("wvar-"), "arm").alias("weight_variant_id"),
        "condition_id", "trial_id", "task_id", "presentation_id", "family", F.struct(c("difficulty").alias("level")).alias("difficulty"),
        F.struct("mode", "seed", "repeat").alias("condition"), c("answer_normalized").alias("gold_answer"),
        F.struct(F.transform("tokens", lambda x: x.cast("int")).alias("token_ids"), "wall_ms", "ttft_ms", "finish_reason").alias("trace"),
        "answer_normalized", "correct", "reasoning_tokens", "answer_tokens", "total_tokens",
        F.struct("unique_token_ratio", "repeated_ngram_fraction_4", "text_repeat_ratio").alias("metrics"),
        F.struct("longest_run_length", "longest_run_is_special", "top_motif_count", "degeneration_onset_index").alias("loop"),
        F.struct("finish_reason", "terminated_by_eos", "capped", "think_end_reached", "eos_observed", "missing_answer",
                 "error_type").alias("termination"),
    )


#: Stored records repeat the names of their fields, so they are kept compressed; a compressed file is one task of a scan and holds
#: a bounded number of records.
STORED = {"compression": "gzip", "maxRecordsPerFile": "250000"}


def stored(t):
    path = scratch_path(t.spark, "traces")
    E.write_once(nested(t("records")), path, "json", **STORED)
    return path


@query("scan_traces", """SELECT 'run-' || arm AS run_id, trial_id, task_id, presentation_id, condition_id, mode, seed, repeat, array_to_string(tokens, ' ') AS tokens,
  difficulty, finish_reason, capped, think_end_reached, error_type, answer_normalized, correct, total_tokens, round(wall_ms, 6) AS wall_ms,
  degeneration_onset_index, false AS corrupt FROM records""")
def _(t):
    flat = E.flat_records(E.scan_traces(t.spark, stored(t)))
    return flat.select("run_id", "trial_id", "task_id", "presentation_id", "condition_id", "mode", "seed", "repeat",
                       F.array_join(F.transform("tokens", lambda x: x.cast("string")), " ").alias("tokens"), "difficulty", "finish_reason", "capped", "think_end_reached",
                       "error_type", "answer_normalized", "correct", "total_tokens", "wall_ms", "degeneration_onset_index",
                       F.col("_corrupt_record").isNotNull().alias("corrupt"))


@query("scan_probes", "SELECT arm AS arm_label, task_id AS source_task_id, seed AS source_seed, checkpoint, checkpoint_label, is_full_prefix, outcome FROM probes")
def _(t):
    path = scratch_path(t.spark, "probes")
    p = t("probes")
    E.write_once(p.select(F.col("arm").alias("arm_label"), F.col("task_id").alias("source_task_id"), F.col("seed").alias("source_seed"),
                          "checkpoint", "checkpoint_label", "is_full_prefix", "outcome"), path, "json")
    probes = E.scan_probes(t.spark, [path, scratch_path(t.spark, "absent")])
    return probes.select("arm_label", "source_task_id", "source_seed", "checkpoint", "checkpoint_label", "is_full_prefix", "outcome")


@query("scan_tasks", "SELECT task_id, family, level, population AS pack, signature AS prompt FROM tasks")
def _(t):
    path = scratch_path(t.spark, "tasks")
    E.write_once(t("tasks").select("task_id", "family", F.col("population").alias("pack"), F.col("signature").alias("prompt"),
                                   F.struct("level").alias("difficulty")), path, "json")
    return E.scan_tasks(t.spark, path).select("task_id", "family", F.col("difficulty.level").alias("level"), "pack", "prompt")


@query("scan_runs", """SELECT 'run-' || s_suppkey AS run_id, CASE WHEN s_acctbal > 0 THEN CAST(s_nationkey AS BIGINT) END AS max_tokens, 'EVIDENCE_COMPLETE' AS status,
  CAST(1 + s_nationkey % 2 AS BIGINT) AS n_conditions, s_name AS presentation, true AS has_time FROM supplier""")
def _(t):
    path = scratch_path(t.spark, "manifests")
    conditions = F.transform(F.sequence(F.lit(0), F.col("s_nationkey") % 2), lambda i: F.struct(
        F.concat(F.lit("cond-"), i.cast("string")).alias("condition_id"), F.struct(F.lit("greedy").alias("mode")).alias("decoding")))
    manifest = F.struct(
        F.concat(F.lit("run-"), "s_suppkey").alias("run_id"), conditions.alias("conditions"),
        F.struct(F.when(F.col("s_acctbal") > 0, F.col("s_nationkey")).alias("max_tokens"), F.lit(1).alias("unknown_key")).alias("spec"),
        F.struct(F.array("s_name").alias("presentation_ids")).alias("task_pack"), F.struct(F.lit("EVIDENCE_COMPLETE").alias("run")).alias("status"))
    # a file lists up to about a thousand manifests, so files to write, commit and list stay few
    suppliers = t("supplier").dropDuplicates(["s_suppkey"])  # a run has one manifest
    shard = F.pmod(F.xxhash64(*suppliers.columns), F.lit(1 + suppliers.count() // 1000)).alias("shard")
    files = suppliers.select(shard, manifest.alias("manifest")).groupBy("shard").agg(F.to_json(F.collect_list("manifest")).alias("value"))
    files.select("value").write.option("maxRecordsPerFile", 1).text(path)
    runs = E.scan_runs(t.spark, f"{path}/*.txt")
    return runs.select("run_id", "spec.max_tokens", F.col("status.run").alias("status"), F.size("conditions").alias("n_conditions"),
                       F.get("task_pack.presentation_ids", F.lit(0)).alias("presentation"), F.col("modified").isNotNull().alias("has_time"))


@query("latest_run", """SELECT user_id, epoch_us(ts) AS modified_us, event_id AS run_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
  FROM events) e WHERE rn = 1""")
def _(t):
    last = E.latest_run(t("events").withColumnRenamed("event_id", "run_id"), ["user_id"], "ts", "run_id")
    return last.select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("modified_us"), "run_id")


@query("sink_create_once", "SELECT family, task_id, count(*) AS n, true AS second_write_refused FROM obs GROUP BY 1, 2")
def _(t):
    path = scratch_path(t.spark, "once")
    table = t("obs").groupBy("family", "task_id").agg(F.count(F.lit(1)).alias("n"))
    E.write_once(table, path)
    try:
        E.write_once(table, path)
        refused = False
    except AnalysisException as error:
        refused = error.getCondition() == "PATH_ALREADY_EXISTS"
    return t.spark.read.parquet(path).withColumn("second_write_refused", F.lit(refused))


EXPORT = ["study_id", "study_population", "deployment_arm", "structural_task_id", "trial_id", "sample_seed", "technical_repeat",
          "normalized_answer", "outcome_classification", "success_at_budget", "native_reasoning_closure", "capped", "censored",
          "budget_exhausted_after_closure", "unparseable", "error", "total_tokens", "raw_evidence_reference"]


@query("export_draws", f"""SELECT 'study-1' AS study_id, difficulty AS study_population, arm AS deployment_arm, task_id AS structural_task_id, trial_id, seed AS sample_seed,
  repeat AS technical_repeat, answer_normalized AS normalized_answer, {STATUS_SQL} AS outcome_classification, correct AS success_at_budget,
  think_end_reached AS native_reasoning_closure, capped, {STATUS_SQL} = 'censored' AS censored, (think_end_reached AND capped) AS budget_exhausted_after_closure,
  {STATUS_SQL} = 'unparseable' AS unparseable, {STATUS_SQL} = 'error' AS error, total_tokens, difficulty || '/run-' || arm || '/' || trial_id AS raw_evidence_reference,
  CAST(47 AS BIGINT) AS n_columns FROM records""")
def _(t):
    flat = E.flat_records(E.scan_traces(t.spark, stored(t)))
    out = E.export_draws(flat, F.lit("study-1"), F.col("difficulty"), F.substring("run_id", 5, 1), "v1")
    path = scratch_path(t.spark, "draws")
    E.write_export(out, path)
    back = t.spark.read.parquet(path)
    return back.select(*EXPORT, F.lit(len(back.columns)).alias("n_columns"))


EXPORTED_PAIR = ["study_population", "structural_task_id", "presentation_id", "decoding_condition_id", "sample_seed", "task_family", "a_trial_id",
                 "b_trial_id", "a_outcome", "b_outcome", "a_raw_evidence_reference", "b_raw_evidence_reference", "closure_transition",
                 "success_at_budget_transition"]


@query("export_pairs", f"""WITH {OUTCOME} SELECT coalesce(a.difficulty, b.difficulty, 'none') AS study_population, task_id AS structural_task_id, presentation_id,
  condition_id AS decoding_condition_id, seed AS sample_seed, coalesce(a.family, b.family) AS task_family, a.trial_id AS a_trial_id, b.trial_id AS b_trial_id,
  a.st AS a_outcome, b.st AS b_outcome, a.difficulty || '/run-A/' || a.trial_id AS a_raw_evidence_reference,
  b.difficulty || '/run-B/' || b.trial_id AS b_raw_evidence_reference, {flag('cl')} AS closure_transition, {flag('co')} AS success_at_budget_transition
FROM (SELECT pairs.task_id, pairs.presentation_id, pairs.condition_id, pairs.seed, CASE WHEN ambiguous_a THEN NULL ELSE x END AS a,
  CASE WHEN ambiguous_b THEN NULL ELSE y END AS b FROM pairs JOIN os x ON x.trial_id = rep_a JOIN os y ON y.trial_id = rep_b) q""")
def _(t):
    records = T.with_pair_columns(t("records"))
    records = records.withColumn("evidence_reference", F.concat("difficulty", F.lit("/run-"), "arm", F.lit("/"), "trial_id"))
    pairs = M.paired_draws(records, [*T.PAIR_COLUMNS, "trial_id", "evidence_reference"])
    study = F.coalesce(F.col("a.difficulty"), F.col("b.difficulty"), F.lit("none"))
    path = scratch_path(t.spark, "pairs")
    E.write_export(E.export_pairs(pairs, study), path, "study_population")
    return t.spark.read.parquet(path).select(*EXPORTED_PAIR)


@query("file_integrity", """SELECT run_id, name, expected, actual, CASE WHEN expected IS NULL THEN 'undeclared' WHEN actual IS NULL THEN 'missing'
  WHEN expected = actual THEN 'ok' ELSE 'mismatch' END AS status FROM sealed FULL JOIN actual USING (run_id, name)""")
def _(t):
    return N.file_integrity(t("sealed"), t("actual"))


ENTRIES = digest_sql("name || ':' || actual", "actual", "entries_sha256", "run_id")
SEALED = digest_sql("name || ':' || expected", "sealed", "root", "run_id")
MANIFESTS = "SELECT run_id, sha256(run_id) AS manifest_sha256 FROM (SELECT DISTINCT run_id FROM actual) r"
SEAL = "sha256(run_id || chr(10) || n_units || chr(10) || entries_sha256 || chr(10) || coalesce(manifest_sha256, ''))"


@query("seal_table", f"""SELECT *, {SEAL} AS seal_sha256 FROM (SELECT run_id, count(*) AS n_units FROM actual GROUP BY 1) n JOIN {ENTRIES} e USING (run_id)
JOIN ({MANIFESTS}) m USING (run_id)""")
def _(t):
    return N.seal_table(t("actual"), manifests(t))


def manifests(t):
    return t("actual").select("run_id").distinct().withColumn("manifest_sha256", F.sha2("run_id", 256))


# Seals over the sealed entries; some are lost, cut off or of other entries, and one manifest was changed since.
@query("run_verification", f"""WITH made AS (SELECT *, {SEAL} AS seal_sha256 FROM (
    SELECT run_id, n_units, CASE WHEN run_id = 'src3' THEN sha256('other') ELSE root END AS entries_sha256, manifest_sha256
    FROM (SELECT run_id, count(*) AS n_units FROM sealed GROUP BY 1) n JOIN {SEALED} e USING (run_id) JOIN ({MANIFESTS}) m USING (run_id)) x),
seals AS (SELECT * REPLACE (CASE WHEN run_id = 'src2' THEN NULL ELSE seal_sha256 END AS seal_sha256) FROM made WHERE run_id <> 'src1'),
units AS (SELECT run_id, count(*) FILTER (expected = actual) AS n_ok, count(*) FILTER (expected <> actual) AS n_mismatch, count(*) FILTER (expected IS NULL) AS n_undeclared,
  count(*) FILTER (actual IS NULL) AS n_missing FROM (SELECT * FROM sealed WHERE run_id <> 'src5') s FULL JOIN (SELECT * FROM actual WHERE run_id <> 'src5' UNION ALL
    SELECT run_id, name, expected FROM sealed WHERE run_id = 'src5') a USING (run_id, name) GROUP BY 1),
u AS (SELECT run_id, CASE WHEN run_id = 'src5' THEN n_undeclared ELSE n_ok END AS n_ok, n_mismatch, CASE WHEN run_id = 'src5' THEN 0 ELSE n_undeclared END AS n_undeclared, n_missing FROM units),
v AS (SELECT run_id, CASE WHEN s.n_units IS NULL THEN 'missing' WHEN seal_sha256 IS NULL THEN 'corrupt' WHEN run_id = 'src3' THEN 'mismatching' ELSE 'ok' END AS seal,
  s.n_units IS NOT NULL AND run_id <> 'src4' AS manifest_ok, n_ok, n_mismatch, n_undeclared, n_missing FROM u LEFT JOIN seals s USING (run_id))
SELECT *, seal = 'ok' AND manifest_ok AND n_mismatch + n_undeclared + n_missing = 0 AS passed FROM v""")
def _(t):
    sealed, src = t("sealed"), F.col("run_id")
    actual = t("actual").where(src != "src5").unionByName(sealed.where(src == "src5").withColumnRenamed("expected", "actual"))
    made = N.seal_table(sealed, manifests(t), digest="expected")
    made = made.withColumn("entries_sha256", F.when(src == "src3", F.sha2(F.lit("other"), 256)).otherwise(F.col("entries_sha256")))
    seals = made.withColumn("seal_sha256", F.when(src != "src2", N.seal_digest("run_id"))).where(src != "src1")
    changed = manifests(t).withColumn("manifest_sha256", F.when(src == "src4", F.lit("0")).otherwise(F.col("manifest_sha256")))
    return N.verify_runs(seals, sealed, actual, changed)


FAULTY = """w AS (SELECT *, wall_ms > 100000 AS cut, wall_ms < 950 AS no_term, wall_ms BETWEEN 2000 AND 2100 AS no_mode, wall_ms BETWEEN 3000 AND 3050 AS odd_cond,
  wall_ms BETWEEN 4000 AND 4050 AS odd_dep, 'run-' || arm AS run_id FROM records),
g AS (SELECT *, CASE WHEN odd_cond THEN 'cond-x' ELSE condition_id END AS cid FROM w WHERE NOT cut AND NOT no_term), k AS (SELECT * FROM g WHERE NOT no_mode),
dk AS (SELECT run_id, task_id || '/' || mode || '/' || coalesce(CAST(seed AS VARCHAR), 'null') || '/' || repeat AS item FROM k)"""


@query("structural_audit", f"""WITH {FAULTY}
SELECT run_id, 'unreadable' AS error, '' AS item, count(*) AS n FROM w WHERE cut GROUP BY 1
UNION ALL SELECT run_id, 'fields_absent', 'termination', count(*) FROM w WHERE no_term AND NOT cut GROUP BY 1
UNION ALL SELECT run_id, 'condition_absent', '', count(*) FROM g WHERE no_mode GROUP BY 1
UNION ALL SELECT run_id, 'id_repeated', trial_id, count(*) - 1 FROM (SELECT run_id, CASE WHEN wall_ms BETWEEN 5000 AND 5020 THEN 'same' ELSE trial_id END AS trial_id FROM g) d GROUP BY 1, 3 HAVING count(*) > 1
UNION ALL SELECT run_id, 'key_repeated', item, count(*) - 1 FROM dk GROUP BY 1, 3 HAVING count(*) > 1
UNION ALL SELECT run_id, 'condition_unknown', cid, count(*) FROM k WHERE odd_cond GROUP BY 1, 3
UNION ALL SELECT run_id, 'deployment_id_contradicted', 'dep-x', count(*) FROM k WHERE odd_dep GROUP BY 1""")
def _(t):
    wall = F.col("trace.wall_ms")
    rows = nested(t("records")).withColumn("trial_id", F.when(wall.between(5000, 5020), "same").otherwise(F.col("trial_id")))
    rows = rows.withColumn("condition_id", F.when(wall.between(3000, 3050), "cond-x").otherwise(F.col("condition_id")))
    rows = rows.withColumn("deployment_id", F.when(wall.between(4000, 4050), "dep-x").otherwise(F.col("deployment_id")))
    rows = rows.withColumn("termination", F.when(wall >= 950, F.col("termination")))
    rows = rows.withColumn("condition", F.struct(
        F.when(~wall.between(2000, 2100), F.col("condition.mode")).alias("mode"), "condition.seed", "condition.repeat"))
    lines = rows.select(F.to_json(F.struct(*rows.columns)).alias("value"), wall.alias("__w"), "run_id")
    # cut inside the first field, so that a broken line cannot name its run
    lines = lines.select("run_id", F.when(F.col("__w") > 100000, F.substring("value", 1, 11)).otherwise(F.col("value")).alias("value"))
    path = scratch_path(t.spark, "audited")
    for run in ("run-A", "run-B"):  # a run is a folder
        E.write_once(lines.where(F.col("run_id") == run).select("value"), f"{path}/{run}", "text", **STORED)
    traces = E.scan_traces(t.spark, f"{path}/*")
    declared = t("records").select(F.concat(F.lit("run-"), "arm").alias("run_id"), "condition_id").distinct()
    runs = declared.select("run_id").distinct().select(
        "run_id", F.concat(F.lit("dep-"), F.substring("run_id", 5, 1)).alias("deployment_id"), F.lit("src-1").alias("source_artifact_id"),
        F.lit(None).cast("string").alias("weight_variant_id"))
    return N.structural_audit(traces, declared, runs)


TOKEN = 'token = "[0-9a-f]{40}"'
EMAIL = "[A-Za-z0-9._]+@[A-Za-z0-9.]+"


@query("secret_scan", f"SELECT doc_id, 'text' AS location FROM documents WHERE regexp_matches(text, '{TOKEN}')")
def _(t):
    return N.secret_scan(t.wide("documents"), "doc_id", ["text", "lang"], TOKEN)


@query("redact_with_log", f"""SELECT doc_id, 'text' AS location, sha256(text) AS old_value_sha256, '<address>' AS replacement,
  sha256(regexp_replace(text, '{EMAIL}', '<address>', 'g')) AS new_value_sha256 FROM documents WHERE regexp_matches(text, '{EMAIL}')""")
def _(t):
    docs = t.wide("documents")
    clean = N.redact_with_log(docs, ["text", "source"], EMAIL, "<address>", protected=["lang"])
    return clean.select("doc_id", F.inline("changes"), F.sha2("text", 256).alias("new_value_sha256"))

