"""Explicit schemas of the stored evidence, so no scan infers one."""

CORRUPT = "_corrupt_record"

TRACES = """
run_id STRING, deployment_id STRING, source_artifact_id STRING, weight_variant_id STRING, condition_id STRING,
trial_id STRING, stochastic_draw_id STRING, task_id STRING, presentation_id STRING, prompt_policy STRING,
family STRING, split STRING, difficulty STRUCT<level: STRING>, condition STRUCT<mode: STRING, seed: BIGINT, repeat: BIGINT>,
prompt STRING, prompt_tokens BIGINT, gold_answer STRING,
deployment STRUCT<model: STRUCT<source: STRUCT<repo_id: STRING, revision: STRING>>>,
trace STRUCT<token_ids: ARRAY<INT>, text: STRING, ttft_ms: DOUBLE, wall_ms: DOUBLE, tokens_per_sec: DOUBLE,
  decode_tokens_per_sec: DOUBLE, finish_reason: STRING, error: STRING,
  steps: ARRAY<STRUCT<index: INT, token_id: INT, logprob: DOUBLE, entropy: DOUBLE, logprob_digest: STRING, t_ms: DOUBLE>>>,
parse STRUCT<answer_raw: STRING, final_raw: STRING>,
answer_normalized STRING, answer_state STRING, correct BOOLEAN, natural_final_status STRING,
reasoning_tokens BIGINT, answer_tokens BIGINT, total_tokens BIGINT,
metrics STRUCT<unique_token_ratio: DOUBLE, repeated_ngram_fraction_4: DOUBLE, repeated_ngram_fraction_8: DOUBLE, text_repeat_ratio: DOUBLE>,
loop STRUCT<longest_run_length: BIGINT, longest_run_is_special: BOOLEAN, top_motif_count: BIGINT, degeneration_onset_index: BIGINT>,
termination STRUCT<finish_reason: STRING, terminated_by_eos: BOOLEAN, capped: BOOLEAN, think_end_reached: BOOLEAN,
  eos_observed: BOOLEAN, missing_answer: BOOLEAN, error_type: STRING>
"""

PROBES = """
run_id STRING, arm_label STRING, source_task_id STRING, source_seed BIGINT, source_family STRING,
source_native_closed BOOLEAN, source_reasoning_tokens BIGINT, checkpoint BIGINT, checkpoint_label STRING,
checkpoint_index BIGINT, is_full_prefix BOOLEAN, probe_max_tokens BIGINT, outcome STRING, correct BOOLEAN, gold_answer STRING
"""

TASKS = """
task_id STRING, family STRING, pack STRING, version STRING, split STRING, seed BIGINT, index BIGINT, variant STRING,
prompt STRING, answer STRING, prompt_policy STRING, difficulty STRUCT<level: STRING>, structural STRING
"""

RUNS = """
run_id STRING, spec_hash STRING, deployment_id STRING, source_artifact_id STRING, weight_variant_id STRING, prompt_policy STRING,
spec STRUCT<task_pack: STRING, split: STRING, task_seed: BIGINT, n_per_family: BIGINT, families: ARRAY<STRING>, prompt_policy: STRING,
  max_tokens: BIGINT, capture_level: STRING, model_policy: STRING, sampled_seeds: ARRAY<BIGINT>, sampled_repeats_per_seed: BIGINT,
  greedy_repeats: BIGINT>,
conditions ARRAY<STRUCT<condition_id: STRING, decoding: STRUCT<mode: STRING>>>,
task_pack STRUCT<presentation_ids: ARRAY<STRING>, n_tasks: BIGINT, pack_version: STRING, generator_version: STRING,
  task_ids_sha256: STRING, presentation_ids_sha256: STRING>,
weight_variant STRUCT<local_path: STRING, representation: STRING, precision: STRING, quantization: STRING>,
runtime STRUCT<runtime: STRING, runtime_version: STRING, backend: STRING, hardware: STRING>,
status STRUCT<run: STRING>
"""
