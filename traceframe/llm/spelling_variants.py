"""Spelling variants of the words in trace texts, met by permuterm rotations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle
from .records import whole_text

# fixed values: the letters words are made of, and the ones that are lower-cased
WORD_RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Ends a word inside its rotations; no letter.
TERMINATOR = "$"
#: Words of more code points are rotated by rolling hashes, so that a word costs work in proportion to its length.
TEXT_ROTATIONS = 64
PRIMES = ((1 << 61) - 1, (1 << 61) - 31)
BASES = (1_000_003_000_091, 987_654_321_009_811)


def word_counts(traces: DataFrame, min_length: int, min_count: int, slip_every: int | None) -> DataFrame:
    """``word, n``: words of the whole table with their occurrences; a slip drops a letter from one occurrence in so many."""
    runs = traces.select("trial_id", F.explode(F.regexp_extract_all(whole_text(), F.lit(WORD_RUN), F.lit(0))).alias("run"))
    runs = runs.where(F.length("run") >= min_length).select("trial_id", F.translate("run", UPPER, LOWER).alias("run"))
    if slip_every:
        h = F.crc32(F.concat(F.coalesce(F.col("trial_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
        at = (F.col("h") % F.length("run")).cast("int")
        slipped = F.concat(F.substring("run", F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
        runs = runs.withColumn("h", h).withColumn("run", F.when(F.col("h") % slip_every == 0, slipped).otherwise(F.col("run")))
    counts = runs.where(F.length("run") >= min_length).groupBy(F.col("run").alias("word")).agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") >= min_count)


def text_rotations(words: DataFrame) -> DataFrame:
    """``id, n, prefix, skips, first, letter``: all rotations of ``word$`` as prefixes, whole and without the letter they end in."""
    ended = F.concat("word", F.lit(TERMINATOR))
    size = F.length("word")
    plain = [F.lit(False).alias("skips"), F.lit(False).alias("first"), F.lit("").alias("letter")]

    def members(at: Column) -> Column:
        """The rotation that begins behind letter ``at``, counted from 1, and so ends in it."""
        skipped = F.concat(F.substring(ended, at + 1, size), F.substring("word", F.lit(1), at - 1))
        letter = F.substring("word", at, F.lit(1))
        first = (at == 1) | (letter != F.substring("word", at - 1, F.lit(1)))
        return F.array(
            F.struct(F.concat(skipped, letter).alias("prefix"), *plain),
            F.struct(skipped.alias("prefix"), F.lit(True).alias("skips"), first.alias("first"), letter.alias("letter")),
        )

    rotations = F.concat(F.array(F.struct(ended.alias("prefix"), *plain)), F.flatten(F.transform(F.sequence(F.lit(1), size), members)))
    return words.select("id", "n", F.inline(rotations)).where(F.length("prefix") <= TEXT_ROTATIONS)


def hashed_rotations(words: DataFrame) -> DataFrame:
    """The same for long words, with two 61-bit rolling hashes in place of a prefix; linear in the length of a word."""
    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ident, word, n in zip(*[batch.column(k) for k in range(3)]):
                text = word.as_py()
                size, keys, end = len(text), [], ord(TERMINATOR)
                for prime, base in zip(PRIMES, BASES):
                    power, head = [1], [0]
                    for c in text:
                        power.append(power[-1] * base % prime)
                        head.append((head[-1] * base + ord(c)) % prime)
                    # text[a:] and the terminator, then text[:a] or text[:a - 1]
                    tail = [((head[size] - head[a] * power[size - a]) * base + end) % prime for a in range(size + 1)]
                    keys.append([(tail[a] * power[a] + head[a]) % prime for a in range(size + 1)]
                                + [(tail[a] * power[a - 1] + head[a - 1]) % prime for a in range(1, size + 1)])
                first = [False] * (size + 1) + [a == 0 or text[a] != text[a - 1] for a in range(size)]
                lengths = [size] * (size + 1) + [size - 1] * size
                yield pa.RecordBatch.from_arrays([
                    pa.array([ident.as_py()] * len(first), pa.string()), pa.array([n.as_py()] * len(first), pa.int64()),
                    pa.array([f"#{m}:{a:x}:{b:x}" for m, a, b in zip(lengths, *keys)]), pa.array(np.arange(len(first)) > size),
                    pa.array(first), pa.array([""] * (size + 1) + list(text)), pa.array(lengths, pa.int64()),
                ], names=["id", "n", "prefix", "skips", "first", "letter", "length"])

    rows = words.select("id", "word", "n").mapInArrow(
        prefixes, "id string, n bigint, prefix string, skips boolean, first boolean, letter string, length bigint")
    return rows.where(F.col("length") >= TEXT_ROTATIONS).drop("length")


def neighbours(rotations: DataFrame) -> DataFrame:
    """``id, near, candidates`` for each word of a group: how many words it is near to there, and the most frequent of them.

    A group is the range of rotations with one prefix.  A letter behind the prefix stands for a word, and so does its
    absence: words that skip a letter there are replacements of each other, and one letter longer than the word whose whole
    rotation the prefix is.  Its members differ in one letter of the alphabet, so a group holds at most 91 rows.  Where a
    letter is doubled, only its first place counts as inserted: every pair of words meets in exactly one group.
    """
    group = Window.partitionBy("prefix")
    # largest count first; words of one group that skip a letter are ordered as the letters are
    everyone = group.orderBy(F.desc("n"), "letter").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    key = F.struct((-F.col("n")).alias("less"), "id")
    member = F.struct("skips", "first", F.expr("NOT skips").alias("whole"), key.alias("key"))
    rows = rotations.withColumn("size", F.count(F.lit(1)).over(group)).where("size > 1")
    rows = rows.withColumn("members", F.collect_list(member).over(everyone))

    def leading(kind: str, k: int = 0) -> Column:
        return F.get(F.filter("members", lambda m: m[kind]), k)["key"]

    def number(kind: str) -> Column:
        return F.size(F.filter("members", lambda m: m[kind]))

    shorter = F.when(F.col("first"), leading("whole"))
    other = F.when(leading("skips")["id"] == F.col("id"), leading("skips", 1)).otherwise(leading("skips"))
    near = F.when(F.col("skips"), number("skips") - 1 + shorter.isNotNull().cast("int")).otherwise(number("first"))
    candidates = F.when(F.col("skips"), F.array_compact(F.array(other, shorter))).otherwise(F.array(leading("first")))
    return rows.select("id", near.cast("bigint").alias("near"), candidates.alias("candidates")).where("near > 0")


def near_words(words: DataFrame) -> DataFrame:
    """``id, n_near, best`` for words that have near words; ``best`` is struct(less, word) of the one that occurs most."""
    short = neighbours(text_rotations(words.where(F.length("word") <= TEXT_ROTATIONS)))
    long = settle(neighbours(hashed_rotations(words.where(F.length("word") >= TEXT_ROTATIONS))), "long-words")
    named = words.select(F.col("id").alias("of"), "word")
    resolved = long.select("id", F.inline("candidates").alias("less", "of")).join(named, "of").select(
        "id", F.lit(0).cast("bigint").alias("near"), F.struct("less", "word").alias("best"))
    unnamed = F.lit(None).cast("struct<less:bigint,word:string>")
    everything = short.select("id", "near", F.array_min("candidates").cast("struct<less:bigint,word:string>").alias("best")).unionByName(
        long.select("id", "near", unnamed.alias("best"))).unionByName(resolved)
    return everything.groupBy("id").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def follow(links: DataFrame) -> DataFrame:
    """``word, root`` for every word with a form: the last of its chain of forms.

    Every round doubles the length of the paths that were followed.  Counts grow along a chain, so it has an end.
    """
    paths = settle(links.select("word", F.col("form").alias("root")), "paths")
    while True:
        onward = paths.select(F.col("word").alias("root"), F.col("root").alias("further"))
        longer = paths.join(onward, "root", "left")
        paths, before = settle(longer.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "paths"), paths
        if paths.where("moved").isEmpty():
            return paths.select("word", "root")
        paths = paths.select("word", "root")


def spelling_variants(traces: DataFrame, min_length: int = 6, min_count: int = 5, ratio: int = 5, slip_every: int | None = None) -> DataFrame:
    """Words of the trace texts that are spelled one letter off a much more frequent word.

    Words are the runs of Latin letters in ``text``, A to Z in lower case, of at least ``min_length`` letters and
    ``min_count`` occurrences in the whole table.  Two words are near when one inserted, deleted or replaced letter turns
    one into the other.  All rotations of the terminated words are sorted into groups with one prefix: what follows the
    prefix is the edited letter, so near words meet without comparing pairs, and every word sends its group's result on.
    The form of a word is the near word that occurs most (ties: the first in code-point order), if it occurs at least
    ``ratio`` times as often.  With ``slip_every`` one occurrence in so many loses a letter first (a planted misspelling,
    told by the crc32 of ``trial_id:word``), to test the grouping.

    Returns one row per word: ``word, form, root`` (the end of the chain of forms, the word itself without a form), ``n,
    n_near, form_n``.  Null texts and texts without letters have no words; repeated rows count as often as they occur; a
    null ``trial_id`` counts as empty in the slip.  Words of any length are allowed: long ones are rotated by two rolling
    hashes of 61 bits.  An empty table gives an empty result.  Other columns are ignored, whatever their names are.
    """
    counts = word_counts(traces, min_length, min_count, slip_every)
    long = F.length("word") > TEXT_ROTATIONS
    words = settle(counts.withColumn("id", F.when(long, F.concat(F.lit("#"), F.sha2("word", 256))).otherwise(F.col("word"))), "words")
    best_n = -F.col("best.less")
    close = best_n >= F.col("n") * ratio
    found = settle(words.join(near_words(words), "id", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
        F.when(close, F.col("best.word")).alias("form"), F.when(close, best_n).alias("form_n"),
    ), "variants")
    roots = follow(found.where("form IS NOT NULL").select("word", "form"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
