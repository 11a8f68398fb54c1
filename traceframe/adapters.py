"""Shapes over the driver tables, written once in SQL that Spark and DuckDB both read.

Each adapter gives one driver table the shape an operator expects and keeps
every row of it.  ``{name}`` marks a table or another adapter.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .session import widen

FAMILY_OF = "CASE {x} % 5 WHEN 0 THEN 'arith' WHEN 1 THEN 'path' WHEN 2 THEN 'order' WHEN 3 THEN 'logic' ELSE 'sm' END"

ADAPTERS: dict[str, str] = {
    # time-to-event observations
    "obs": """
        SELECT l_quantity AS time, (l_linestatus = 'F') AS event, l_returnflag AS family,
               'task-' || CAST(l_suppkey AS STRING) AS task_id,
               CASE WHEN l_linenumber % 2 = 0 THEN 'B' ELSE 'A' END AS arm
        FROM {lineitem}
    """,
    # one row per execution with the scalar fields of a trace record
    "records": f"""
        SELECT CASE WHEN l_tax < 0.04 THEN 'A' ELSE 'B' END AS arm,
               CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' ||
                 CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) AS trial_id,
               'task-' || CAST(l_suppkey AS STRING) AS task_id,
               'pres-' || CAST(l_suppkey AS STRING) || '-' || CAST(year(l_shipdate) AS STRING) || '-' ||
                 CAST(month(l_shipdate) AS STRING) AS presentation_id,
               {FAMILY_OF.format(x='l_suppkey')} AS family,
               CASE l_suppkey % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' ELSE 'hard' END AS difficulty,
               CASE WHEN l_returnflag = 'N' THEN 'cond-greedy' ELSE 'cond-sampled' END AS condition_id,
               CASE WHEN l_returnflag = 'N' THEN 'greedy' ELSE 'sampled' END AS mode,
               CAST(CASE l_returnflag WHEN 'A' THEN 0 WHEN 'R' THEN 1 END AS BIGINT) AS seed,
               CAST(l_linenumber % 2 AS BIGINT) AS repeat,
               split('10 11 12 ' || CASE WHEN l_linestatus = 'F' THEN '13 99 ' ELSE '14 15 16 ' END ||
                     CASE WHEN l_discount < 0.08 THEN '17' ELSE '18' END, ' ') AS tokens,
               CASE WHEN l_discount < 0.06 THEN 'stop' WHEN l_discount < 0.095 THEN 'length' ELSE 'error' END
                 AS finish_reason,
               (l_discount >= 0.06 AND l_discount < 0.095) AS capped,
               (l_discount < 0.06) AS terminated_by_eos,
               (l_linestatus = 'F') AS think_end_reached,
               (l_discount < 0.06 OR l_quantity > 40) AS eos_observed,
               NOT (l_quantity > 10 OR l_tax > 0.02) AS missing_answer,
               CASE WHEN l_discount >= 0.095 THEN 'RuntimeError' END AS error_type,
               CASE WHEN l_quantity > 10 THEN CAST(l_partkey % 7 AS STRING) END AS answer_normalized,
               (l_quantity > 10 AND l_partkey % 7 < 4) AS correct,
               CAST(l_quantity AS BIGINT) * 10 AS reasoning_tokens,
               CAST(l_linenumber AS BIGINT) AS answer_tokens,
               CAST(l_quantity AS BIGINT) * 10 + l_linenumber AS total_tokens,
               l_extendedprice AS wall_ms,
               CASE WHEN l_quantity > 3 THEN l_extendedprice / 10 END AS ttft_ms,
               1 - l_discount AS unique_token_ratio,
               l_discount AS repeated_ngram_fraction_4,
               l_tax AS text_repeat_ratio,
               CAST(l_linenumber AS BIGINT) AS longest_run_length,
               (l_linestatus = 'O' AND l_linenumber > 5) AS longest_run_is_special,
               CASE WHEN l_tax > 0.05 THEN CAST(l_linenumber AS BIGINT) * 3 END AS degeneration_onset_index,
               CAST(l_quantity AS BIGINT) AS top_motif_count
        FROM {{lineitem}}
    """,
    # one record per unambiguous draw (the operator under test for the collapse itself is in operators.draws)
    "primary_draws": """
        SELECT * FROM {records} WHERE trial_id IN (
          SELECT min_by(trial_id, CAST(repeat AS STRING) || '/' || trial_id) FROM {records}
          GROUP BY arm, presentation_id, task_id, condition_id, seed
          HAVING min(array_to_string(tokens, ' ')) = max(array_to_string(tokens, ' ')))
    """,
    # forced-probe outcomes: the last event of a user on a day is that checkpoint's outcome
    "probes": f"""
        SELECT CASE WHEN user_id % 2 = 0 THEN 'A' ELSE 'B' END AS arm,
               'task-' || CAST(CAST(floor(user_id / 6) AS BIGINT) AS STRING) AS task_id,
               CAST(floor(user_id / 2) AS BIGINT) % 3 AS seed,
               {FAMILY_OF.format(x='CAST(floor(user_id / 6) AS BIGINT)')} AS family,
               (user_id % 3 <> 0) AS native_closed,
               CASE WHEN day = 30 AND user_id % 2 = 0 THEN 'full_prefix' ELSE CAST((day - 1) * 64 AS STRING) END
                 AS checkpoint_label,
               CAST((day - 1) * 64 AS BIGINT) AS checkpoint,
               CAST(day - 1 AS BIGINT) AS checkpoint_index,
               (day = 30) AS is_full_prefix,
               CASE last_type WHEN 'purchase' THEN 'correct' WHEN 'error' THEN 'scorable_incorrect'
                 WHEN 'click' THEN 'censored' WHEN 'view' THEN 'unparseable' ELSE 'error' END AS outcome,
               (last_type = 'purchase') AS correct,
               n_events
        FROM (SELECT user_id, day(ts) AS day, max_by(event_type, event_id) AS last_type,
                     count(*) AS n_events
              FROM {{events}} GROUP BY user_id, day(ts)) per_day
    """,
    # probes per checkpoint selection: a full prefix that is also a numeric checkpoint counts for both
    "selected": """
        SELECT arm, task_id, seed, family, native_closed, outcome, correct, checkpoint, checkpoint_label,
               CASE WHEN checkpoint_label = 'full_prefix' THEN 2147483647 ELSE checkpoint END AS checkpoint_index
        FROM {probes}
        UNION ALL
        SELECT arm, task_id, seed, family, native_closed, outcome, correct, checkpoint, 'full_prefix', 2147483647
        FROM {probes} WHERE is_full_prefix AND checkpoint_label <> 'full_prefix'
    """,
    # decoded generations with a family, a gold answer and an answer cue
    "answers": """
        SELECT event_id, family, k, finish_reason, eos_observed, gold, probe_error,
               'work ' || event_type || CASE WHEN value < 5 THEN ' ' ELSE '</think>' END || chr(10) ||
                 CASE WHEN value > 60 THEN 'so ' ELSE 'Answer: ' END || payload || '<|im_end|>' AS text
        FROM (SELECT event_id, event_type, value, k,
                     CASE event_type WHEN 'click' THEN 'arith' WHEN 'view' THEN 'path' WHEN 'signup' THEN 'order'
                       WHEN 'purchase' THEN 'logic' ELSE 'sm' END AS family,
                     CASE WHEN k < 20 THEN 'length' ELSE 'stop' END AS finish_reason,
                     (k % 2 = 0) AS eos_observed,
                     CASE WHEN k = 99 THEN 'timeout' END AS probe_error,
                     CASE WHEN k < 4 THEN '??'
                       WHEN event_type = 'click' THEN '-0' || CAST(k AS STRING)
                       WHEN event_type = 'view' THEN 'cost 0' || CAST(k AS STRING)
                       WHEN event_type = 'signup' THEN 'Amber, basil'
                       WHEN event_type = 'purchase' THEN 'True, false'
                       ELSE 'state S ' || CAST(k AS STRING) END AS payload,
                     CASE event_type
                       WHEN 'click' THEN CASE WHEN k % 10 < 5 THEN '-' ELSE '' END || CAST(k AS STRING)
                       WHEN 'view' THEN CAST(k + CASE WHEN k % 10 < 6 THEN 0 ELSE 1 END AS STRING)
                       WHEN 'signup' THEN CASE WHEN k % 10 < 5 THEN ' Amber  basil' ELSE 'basil,amber' END
                       WHEN 'purchase' THEN CASE WHEN k % 10 < 5 THEN 'true,FALSE' ELSE 'false, true' END
                       ELSE CASE WHEN k % 10 < 5 THEN 'S' ELSE 'q' END || CAST(k AS STRING) END AS gold
              FROM (SELECT event_id, event_type, value, CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k
                    FROM {events}) parsed) shaped
    """,
    # token sequences
    "traces": """
        SELECT doc_id AS trace_id, split(text, ' ') AS tokens, text, lang AS family, source AS condition_id
        FROM {documents}
    """,
    # one run manifest per part
    "runs": """
        SELECT p_partkey AS run_no, 'run-' || CAST(p_partkey AS STRING) AS run_id,
               p_brand AS repo_id, CASE WHEN p_size > 4 THEN p_type END AS revision,
               CASE WHEN p_size > 25 THEN 'bf16' ELSE 'q4' END AS `precision`,
               CASE WHEN p_retailprice > 1000 THEN 'r2' ELSE 'r1' END AS runtime_version,
               CASE WHEN p_size % 2 = 0 THEN 'gpu-a' ELSE 'gpu-b' END AS hardware,
               CASE WHEN p_size % 3 = 0 THEN 'pp-v2' ELSE 'pp-v1' END AS prompt_policy,
               CAST(CASE WHEN p_size > 40 THEN 4096 ELSE 2048 END AS BIGINT) AS max_tokens,
               CASE WHEN p_size < 10 THEN 'research' ELSE 'minimal' END AS capture_level,
               CASE WHEN p_size > 45 THEN 'gen-2' ELSE 'gen-1' END AS generator_version,
               CASE WHEN p_size % 4 = 0 THEN 'sampled' ELSE 'greedy' END AS decoding
        FROM {part}
    """,
    # a task population per source, and an older copy of it with changed texts
    "tasks": """
        SELECT source AS population, 'task-' || CAST(doc_id AS STRING) AS task_id, lang AS family,
               CASE WHEN n_chars < 500 THEN 'easy' WHEN n_chars < 2000 THEN 'medium' ELSE 'hard' END AS level,
               md5(text) AS presentation_id, md5(lower(text)) AS signature
        FROM {documents}
    """,
    "old_tasks": """
        SELECT source AS population, 'task-' || CAST(doc_id AS STRING) AS task_id,
               CASE WHEN source = 'src2' AND lang = 'fr' THEN 'de' ELSE lang END AS family,
               CASE WHEN n_chars < 500 THEN 'easy' WHEN n_chars < CASE WHEN source = 'src3' THEN 1000 ELSE 2000 END
                 THEN 'medium' ELSE 'hard' END AS level,
               md5(CASE WHEN source = 'src4' THEN text || '.' ELSE text END) AS presentation_id,
               md5(lower(CASE WHEN source = 'src5' THEN text || '.' ELSE text END)) AS signature
        FROM {documents} WHERE NOT (source = 'src6' AND lang = 'de')
    """,
    # sealed and actual digests of evidence units
    "sealed": """
        SELECT source AS run_id, 'unit-' || CAST(doc_id AS STRING) AS name,
               sha256(CASE WHEN n_chars > 2000 THEN text || '!' ELSE text END) AS expected
        FROM {documents} WHERE lang <> 'es'
        UNION ALL
        SELECT 'src0' AS run_id, 'lost-' || CAST(item_id AS STRING) AS name, sha256(text) AS expected
        FROM {benchmark}
    """,
    "actual": """
        SELECT source AS run_id, 'unit-' || CAST(doc_id AS STRING) AS name, sha256(text) AS actual
        FROM {documents}
    """,
}


def _spark_sql(text: str) -> str:
    text = text.replace("array_to_string(", "array_join(")
    return re.sub(r"sha256\((CASE.*?END|text)\)", r"sha2(\1, 256)", text, flags=re.S)


class Tables:
    """Driver tables and adapters as DataFrames: ``t("lineitem")``, ``t("records")``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def wide(self, name: str) -> DataFrame:
        """A driver table spread over all cores, for row-local work that costs more than a read."""
        return widen(self(name))

    def __call__(self, name: str) -> DataFrame:
        if name not in ADAPTERS:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        text = ADAPTERS[name]
        inputs = {n: self(n) if n in ADAPTERS else self.wide(n) for n in set(re.findall(r"\{(\w+)\}", text))}
        return self.spark.sql(_spark_sql(text), **inputs)


def adapter_ctes(body: str) -> str:
    """``body`` with a WITH clause defining every adapter it mentions."""
    used = {n for n in ADAPTERS if re.search(rf"\b{n}\b", body)}
    for name in reversed(ADAPTERS):  # later adapters build on earlier ones
        if name in used:
            used |= set(re.findall(r"\{(\w+)\}", ADAPTERS[name])) & set(ADAPTERS)
    ctes = []
    for name, text in ADAPTERS.items():
        if name in used:
            ctes.append(f"{name} AS ({re.sub(r'{(\w+)}', r'\1', text).replace('`', '')})")
    own = re.match(r"\s*WITH\s", body, flags=re.I)
    if own:
        return "WITH " + ",\n".join([*ctes, body[own.end():]])
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + body
