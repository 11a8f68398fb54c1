"""Registered queries of the operators: thin steps from the driver's tables to trace records and back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .exact_dedup import exact_dedup
from .language_filter import identify_language
from .line_dedup import remove_spread_lines
from .lm_scoring import score_cross_entropy
from .mixing import balance_mix
from .packing import pack_traces
from .quality_classifier import score_quality
from .quality_rules import quality_rules
from .records import traces_of_documents
from .sharding import shard_traces
from .simhash_dedup import simhash_dedup
from .spelling_variants import spelling_variants
from .suffix_dedup import remove_repeats
from .whitening import whiten

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces_of_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def by_document(result: DataFrame, *columns) -> DataFrame:
    return result.select(F.col("trial_id").alias("doc_id"), *columns)


@query
def op1_line_dedup(spark, sf_dir):
    return by_document(remove_spread_lines(traces(spark, sf_dir), min_conditions=12), "n_lines", "n_removed", "text")


@query
def op2_quality_classifier(spark, sf_dir):
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out)
    scored = score_quality(traces(spark, sf_dir), labels.select(F.col("doc_id").alias("trial_id"), F.col("quality").alias("good")))
    return by_document(scored, "score", "predicted").select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query
def op3_mixing(spark, sf_dir):
    return by_document(balance_mix(traces(spark, sf_dir)), "size", "source_size", "target", "taken", "copies", "rate")


@query
def op4_suffix_dedup(spark, sf_dir):
    removed = remove_repeats(traces(spark, sf_dir), length=400, keep_first=False)
    n_removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return by_document(removed, "n_bytes", n_removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), "kept_sha256")


@query
def op5_lm_scoring(spark, sf_dir):
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("trial_id"), "text")
    return by_document(score_cross_entropy(traces(spark, sf_dir), target), "n_words", "target_loss", "background_loss", "difference")


@query
def op6_simhash_dedup(spark, sf_dir):
    return by_document(simhash_dedup(traces(spark, sf_dir), shingle=3), "fingerprint", "component_id")


@query
def op7_quality_rules(spark, sf_dir):
    return by_document(quality_rules(traces(spark, sf_dir)), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       "base_failed", "kept", "removed_words")


#: Ids the packed documents are made of, and the one that ends each.
VOCABULARY, END_ID = "byte_bpe_50k.json", 1


@query
def op8_packing(spark, sf_dir):
    import public_tokenizers

    packed = pack_traces(traces(spark, sf_dir), tokenizer=public_tokenizers.path(VOCABULARY), end_id=END_ID, capacity=2048)
    return by_document(packed, "start", "length", "ids_crc32", F.col("trace_tokens").alias("doc_tokens"), "sequence_id", "offset")


@query
def op9_sharding(spark, sf_dir):
    placed = shard_traces(traces(spark, sf_dir), n_shards=40)
    return by_document(placed, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op10_exact_dedup(spark, sf_dir):
    return by_document(exact_dedup(traces(spark, sf_dir), keep="largest"), "keep_id", "group_size", "kept", "text_sha256")


@query
def op11_spelling_variants(spark, sf_dir):
    return spelling_variants(traces(spark, sf_dir), min_length=6, min_count=5, ratio=5, slip_every=199)


@query
def op12_embedding_whitening(spark, sf_dir):
    white = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), components=8)
    # a sum of squares beyond 64 bits has no long; it stays exact in the operator's own result
    return white.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


@query
def op13_language_id(spark, sf_dir):
    documents = traces(spark, sf_dir)
    held_out = F.coalesce(F.crc32(F.col("trial_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    told = identify_language(documents, documents.where(~held_out))
    return by_document(told.withColumn("held_out", held_out), "held_out", F.col("predicted").alias("lang_pred"), "score")


ORACLES["op10_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

ORACLES["op1_line_dedup"] = r"""
WITH lines AS (
  SELECT doc_id, source, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line_no,
         unnest(string_split(coalesce(text, ''), chr(10))) AS line
  FROM documents),
normal AS (SELECT *, trim(lower(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g')), ' ') AS norm FROM lines),
spread AS (SELECT norm FROM normal WHERE norm <> '' GROUP BY norm HAVING count(DISTINCT coalesce(source, chr(0))) >= 12)
SELECT doc_id, count(*) AS n_lines, count(s.norm) AS n_removed,
       coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (s.norm IS NULL), '') AS text
FROM normal n LEFT JOIN spread s USING (norm) GROUP BY doc_id
"""

ORACLES["op7_quality_rules"] = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
t AS (SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM d),
g AS (SELECT doc_id, i, w || ' ' || lead(w, 1) OVER p || ' ' || lead(w, 2) OVER p || ' ' || lead(w, 3) OVER p || ' ' || lead(w, 4) OVER p AS gram
  FROM t WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g WHERE gram IS NOT NULL) x WHERE c > 1),
covered AS (SELECT doc_id, sum(least(5, coalesce(nxt - i, 5))) AS n
  FROM (SELECT *, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM r) x GROUP BY 1),
lines AS (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM d),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1),
norm AS (SELECT *, len(string_split(line, ' ')) AS nw FROM (SELECT DISTINCT coalesce(source, chr(0)) AS source, text, no,
  trim(lower(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g')), ' ') AS line FROM lines) x WHERE line <> ''),
frequent AS (SELECT source, line FROM norm GROUP BY 1, 2 HAVING count(DISTINCT text) > 10),
removed AS (SELECT source, text, sum(nw) AS n FROM norm JOIN frequent USING (source, line) GROUP BY 1, 2),
m AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, length(array_to_string(words, '')) AS word_chars,
  length(d.text) - length(regexp_replace(d.text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines,
  CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(removed.n, 0) AS BIGINT) AS removed_words
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN covered USING (doc_id)
  LEFT JOIN removed ON removed.source = coalesce(d.source, chr(0)) AND removed.text = d.text)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND n_words - removed_words >= 10 AS kept, removed_words FROM m
"""
