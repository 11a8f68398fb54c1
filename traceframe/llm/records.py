"""Trace records as the operators of this package read them.

Every operator works on flat trace records, the executions of an experiment:

- ``trial_id``: the execution (any type that can be ordered; rows that repeat one are allowed),
- ``text``: the whole generated text; null counts as empty,
- ``condition_id``: the decoding condition the execution belongs to, the record's origin; null is a condition of its own,
- ``family``: the task family.

Other columns are ignored by the operators, whatever their names are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: the characters that separate words (space and U+0009 to U+000D), and their complement
GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def whole_text(text: str | Column = "text") -> Column:
    """The text with null as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words_of(text: Column) -> Column:
    """Array of the words of a non-null text."""
    return F.array_remove(F.split(text, GAP), "")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("bigint")


def traces_of_documents(documents: DataFrame) -> DataFrame:
    """The driver's documents as trace records: one execution each, its source as condition, its language as family."""
    return documents.select(
        F.col("doc_id").alias("trial_id"), "text", F.col("source").alias("condition_id"), F.col("lang").alias("family"),
    )
