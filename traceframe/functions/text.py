"""Column expressions over generated text: channel split, answer extraction, normalisation, scoring."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Markers, cues and per-family answer patterns.
THINK_END = "</think>"
SPECIAL_MARKERS = r"<\|[^|]*\|>|<think>|</think>"
ANSWER_CUE = r"(?i)answer\s*[:=]"
LINE_BREAK = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"
INTEGER = r"-?\d+"
WORD = r"[A-Za-z]+"
BOOLEAN_WORD = r"(?i)\b(true|false)\b"
STATE_NAME = r"(?i)\b(?:state\s*)?s\s*(\d+)\b"
FAMILIES = ("arith", "path", "order", "logic", "sm")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def non_blank_lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, LINE_BREAK), strip), lambda line: line != "")


def split_first(text: Column) -> Column:
    """struct(reasoning, final, closed) at the first think-end marker."""
    at = F.locate(THINK_END, text)
    return F.struct(
        F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise(text).alias("reasoning"),
        F.when(at > 0, F.substring(text, at + len(THINK_END), F.length(text))).otherwise(F.lit("")).alias("final"),
        (at > 0).alias("closed"),
    )


def split_last(text: Column, think_end_reached: Column) -> Column:
    """struct(reasoning, final, closed) at the last think-end marker; the flag decides when there is none."""
    tail = F.substring_index(text, THINK_END, -1)
    found = F.locate(THINK_END, text) > 0
    kept = F.length(text) - F.length(tail) - len(THINK_END)
    return F.struct(
        F.when(found, F.substring(text, F.lit(1), kept)).otherwise(text).alias("reasoning"),
        F.when(found, tail).otherwise(F.lit("")).alias("final"),
        (found | think_end_reached).alias("closed"),
    )


def strip_special(text: Column) -> Column:
    return F.regexp_replace(text, SPECIAL_MARKERS, "")


def after_last_cue(text: Column) -> Column:
    return F.element_at(F.split(text, ANSWER_CUE), -1)


def extract_answer(text: Column) -> Column:
    """Text after the last answer cue (possibly empty), else the last non-blank line, else null."""
    clean = strip_special(text)
    return F.when(F.rlike(clean, F.lit(ANSWER_CUE)), strip(after_last_cue(clean))).otherwise(
        F.try_element_at(non_blank_lines(clean), F.lit(-1))
    )


def record_answer(text: Column) -> Column:
    """Answer of a full generation: only the final channel after the first think-end counts."""
    semantic = strip(strip_special(split_first(text)["final"]))
    return F.when(semantic != "", extract_answer(semantic))


def canonical_integer(digits: Column) -> Column:
    """Text form of an integer of any size: no leading zeros, no negative zero."""
    trimmed = F.regexp_replace(digits, "^(-?)0+([0-9])", "$1$2")
    return F.when(trimmed == "-0", F.lit("0")).otherwise(trimmed)


def _first(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _joined_matches(text: Column, pattern: str, separator: str) -> Column:
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(F.size(found) > 0, F.array_join(F.transform(found, F.lower), separator))


def normalize_answer(family: Column, raw: Column) -> Column:
    """Family-specific canonical form of a predicted answer; null when none is found."""
    seg = after_last_cue(raw)
    state = canonical_integer(_first(seg, STATE_NAME, 1))
    return (
        F.when(raw.isNull(), F.lit(None).cast("string"))
        .when(family.isin("arith", "path"), canonical_integer(_first(seg, INTEGER, 0)))
        .when(family == "order", _joined_matches(seg, WORD, ","))
        .when(family == "logic", _joined_matches(seg, BOOLEAN_WORD, ", "))
        .when(family == "sm", F.concat(F.lit("s"), state))
        .otherwise(F.raise_error(F.concat(F.lit("unknown family: "), F.coalesce(family, F.lit("null")))))
    )


def canonical_gold(family: Column, answer: Column) -> Column:
    """Ground truth in the form ``normalize_answer`` produces."""
    a = strip(answer)
    words = F.filter(F.split(a, r"[,\s]+"), lambda w: w != "")
    parts = F.transform(F.split(a, ","), lambda x: F.lower(strip(x)))
    state = canonical_integer(_first(a, STATE_NAME, 1))
    return (
        F.when(family == "order", F.array_join(F.transform(words, F.lower), ","))
        .when(family == "logic", F.array_join(parts, ", "))
        .when(family == "sm", F.coalesce(F.concat(F.lit("s"), state), F.lower(a)))
        .otherwise(a)
    )


def score_exact(normalized: Column, gold: Column) -> Column:
    return F.coalesce(normalized == gold, F.lit(False))


def answer_leaked(prompt: Column, answer: Column) -> Column:
    """The prompt states the answer right after an answer cue or an equals sign."""
    quoted = F.replace(strip(answer), F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    pattern = F.concat(
        F.lit(r"(?i)(?:answer\s*[:=]\s*|=\s*)\Q"), quoted, F.lit(r"\E(?![A-Za-z0-9])")
    )
    return F.rlike(prompt, pattern)
