"""Scans of stored runs, create-once sinks and exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.status import exhausted_after_close, record_status
from ..operators.transitions import arm_flag, flag_transition
from .schemas import CORRUPT, PROBES, RUNS, TASKS, TRACES


def scan_json(spark: SparkSession, paths: str | Sequence[str], schema: str, multi_line: bool = False) -> DataFrame:
    """JSON records of many files in one scan; unparsable lines land in ``_corrupt_record``."""
    return (
        spark.read.schema(f"{schema.strip()}, {CORRUPT} STRING")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("multiLine", multi_line)
        .json(paths)
    )


def scan_traces(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Trace records; a line that names no run belongs to the run whose folder its file lies in."""
    folder = F.regexp_extract("_metadata.file_path", "([^/]+)/[^/]+$", 1)
    return scan_json(spark, paths, TRACES).withColumn("run_id", F.coalesce("run_id", folder))


def scan_tasks(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    return scan_json(spark, paths, TASKS)


def scan_probes(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Probe records; a run without a probe file adds no rows."""
    out = spark.createDataFrame([], f"{PROBES.strip()}, {CORRUPT} STRING")
    found = []
    for path in paths:
        try:
            spark.read.text(path)
            found.append(path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
    return out.unionByName(scan_json(spark, found, PROBES)) if found else out


def scan_runs(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Run manifests (known fields only) with their modification time."""
    runs = scan_json(spark, paths, RUNS, multi_line=True)
    return runs.select("*", F.col("_metadata.file_modification_time").alias("modified"))


def latest_run(runs: DataFrame, by: Sequence[str], modified: str, name: str) -> DataFrame:
    """Newest run per group by (modification time, name)."""
    last = runs.groupBy(*by).agg(F.max(F.struct(modified, name)).alias("__l"))
    return last.select(*by, F.col(f"__l.{modified}").alias(modified), F.col(f"__l.{name}").alias(name))


def flat_records(traces: DataFrame) -> DataFrame:
    """Nested trace records as the flat record columns every operator uses."""
    return traces.select(
        "run_id", "deployment_id", "source_artifact_id", "weight_variant_id", "trial_id", "stochastic_draw_id", "task_id",
        F.coalesce("presentation_id", "task_id").alias("presentation_id"), "condition_id", "family", "split",
        F.col("difficulty.level").alias("difficulty"), F.col("condition.mode").alias("mode"),
        F.col("condition.seed").alias("seed"), F.col("condition.repeat").alias("repeat"),
        F.col("trace.token_ids").alias("tokens"), F.col("trace.text").alias("text"), F.col("termination.finish_reason").alias("finish_reason"),
        F.col("termination.capped").alias("capped"), F.col("termination.terminated_by_eos").alias("terminated_by_eos"),
        F.col("termination.think_end_reached").alias("think_end_reached"),
        F.col("termination.eos_observed").alias("eos_observed"),
        F.col("termination.missing_answer").alias("missing_answer"),
        F.coalesce("termination.error_type", "trace.error").alias("error_type"),
        "answer_normalized", "correct", "reasoning_tokens", "answer_tokens", "total_tokens", "gold_answer",
        F.col("parse.answer_raw").alias("answer_raw"), F.col("parse.final_raw").alias("final_raw"),
        F.col("natural_final_status").alias("historical_status"),
        F.col("trace.wall_ms").alias("wall_ms"), F.col("trace.ttft_ms").alias("ttft_ms"),
        F.col("trace.tokens_per_sec").alias("tokens_per_sec"),
        F.col("trace.decode_tokens_per_sec").alias("decode_tokens_per_sec"),
        F.col("metrics.unique_token_ratio").alias("unique_token_ratio"),
        F.col("metrics.repeated_ngram_fraction_4").alias("repeated_ngram_fraction_4"),
        F.col("metrics.repeated_ngram_fraction_8").alias("repeated_ngram_fraction_8"),
        F.col("metrics.text_repeat_ratio").alias("text_repeat_ratio"),
        F.col("loop.longest_run_length").alias("longest_run_length"),
        F.col("loop.longest_run_is_special").alias("longest_run_is_special"),
        F.col("loop.degeneration_onset_index").alias("degeneration_onset_index"),
        F.col("loop.top_motif_count").alias("top_motif_count"),
        F.when(F.col("loop").isNotNull(), F.to_json("loop")).alias("loop_json"),
        F.col("deployment.model.source.repo_id").alias("source_model_id"),
        F.col("deployment.model.source.revision").alias("source_revision"),
        CORRUPT,
    )


def write_once(df: DataFrame, path: str, fmt: str = "parquet", **options: str) -> None:
    """Publish a table atomically; an existing one is never overwritten."""
    df.write.mode("errorifexists").options(**options).format(fmt).save(path)


# Names of the published draw columns and the record columns behind them.
DRAW_EXPORT = {
    "population_split": "split", "structural_task_id": "task_id", "presentation_id": "presentation_id",
    "task_family": "family", "task_difficulty": "difficulty", "source_model_id": "source_model_id",
    "source_revision": "source_revision", "source_artifact_id": "source_artifact_id",
    "weight_variant_id": "weight_variant_id", "deployment_id": "deployment_id", "decoding_condition_id": "condition_id",
    "decoding_mode": "mode", "sample_seed": "seed", "technical_repeat": "repeat",
    "stochastic_draw_id": "stochastic_draw_id", "trial_id": "trial_id", "ground_truth": "gold_answer",
    "generated_answer": "answer_raw", "normalized_answer": "answer_normalized", "generated_final_channel": "final_raw",
    "historical_outcome_classification": "historical_status", "finish_reason": "finish_reason",
    "reasoning_tokens": "reasoning_tokens", "answer_tokens": "answer_tokens", "total_tokens": "total_tokens",
    "generation_wall_ms": "wall_ms", "decode_tokens_per_second": "decode_tokens_per_sec",
    "generation_tokens_per_second": "tokens_per_sec", "ttft_ms": "ttft_ms",
    "repeated_ngram_fraction_4": "repeated_ngram_fraction_4", "repeated_ngram_fraction_8": "repeated_ngram_fraction_8",
    "unique_token_ratio": "unique_token_ratio", "loop_diagnostics_json": "loop_json",
}


def export_draws(records: DataFrame, study_id: Column, study: Column, arm: Column, analysis_version: str) -> DataFrame:
    """One published row per record: scalars only, outcome recomputed next to the stored one."""
    status = record_status()
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    return records.withColumn("__st", status).select(
        study_id.alias("study_id"), study.alias("study_population"), arm.alias("deployment_arm"),
        *[F.col(src).alias(name) for name, src in DRAW_EXPORT.items()],
        F.col("__st").alias("outcome_classification"),
        F.lit(analysis_version).alias("outcome_analysis_version"),
        flag("correct").alias("success_at_budget"),
        flag("think_end_reached").alias("native_reasoning_closure"),
        flag("terminated_by_eos").alias("generation_terminated_by_eos"),
        flag("capped").alias("capped"),
        (F.col("__st") == "censored").alias("censored"),
        exhausted_after_close(F.col("think_end_reached"), F.col("capped")).alias("budget_exhausted_after_closure"),
        (F.col("__st") == "unparseable").alias("unparseable"),
        (F.col("__st") == "error").alias("error"),
        F.concat_ws("/", study, "run_id", "trial_id").alias("raw_evidence_reference"),
    )


def write_export(df: DataFrame, path: str, partition: str | None = None) -> None:
    writer = df.write.mode("errorifexists").option("compression", "zstd")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def export_pairs(pairs: DataFrame, study: Column) -> DataFrame:
    """One row per matched draw with both trials, outcomes and transitions.

    ``pairs`` is the one-row-per-draw table of ``paired_draws``, which makes a
    pair unique by construction.  Its arm structs carry trial_id, status, the
    outcome flags and evidence_reference, where the record lies in the evidence.
    """
    a, b = F.col("a"), F.col("b")
    return pairs.select(
        study.alias("study_population"), F.col("task_id").alias("structural_task_id"), "presentation_id",
        F.col("condition_id").alias("decoding_condition_id"), F.col("seed").alias("sample_seed"),
        F.coalesce(a["family"], b["family"]).alias("task_family"),
        F.coalesce(a["difficulty"], b["difficulty"]).alias("task_difficulty"),
        a["trial_id"].alias("a_trial_id"), b["trial_id"].alias("b_trial_id"),
        a["status"].alias("a_outcome"), b["status"].alias("b_outcome"),
        a["evidence_reference"].alias("a_raw_evidence_reference"), b["evidence_reference"].alias("b_raw_evidence_reference"),
        flag_transition(arm_flag(a, "think_end_reached"), arm_flag(b, "think_end_reached")).alias("closure_transition"),
        flag_transition(arm_flag(a, "correct"), arm_flag(b, "correct")).alias("success_at_budget_transition"),
    )
