"""Language of trace texts from a bit-sliced Bloom filter of character n-grams."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import settle
from .records import whole_text

UNDETERMINED = "und"
#: Lengths of the n-grams; a text of one letter still has one of three, with the gaps around it.
LENGTHS = (3, 4)
#: Hash functions of the filter, and slots for each n-gram of the language with the most.
HASHES, SLOTS_PER_GRAM = 3, 16
WORD_BITS = 64
#: Code points a piece of a long text has; windows overlap the pieces, so none is lost.
PIECE = 1 << 20
#: n-grams that a task holds before it sums them up.
GRAMS_HELD = 1 << 22

# fixed values: multipliers of the 64-bit mixing steps
_STEP, _MIX_A, _MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


@cache
def letter_table() -> np.ndarray:
    """For every code point whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX_A
    h = (h ^ (h >> np.uint64(27))) * _MIX_B
    return h ^ (h >> np.uint64(31))


def letters_and_gaps(text: str) -> np.ndarray:
    """Code points of the lower-cased text, every run of other characters, and both ends, as one zero; empty without letters."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.where(letter_table()[points], points, 0)
    if not points.any():
        return points[:0]
    points = np.concatenate(([0], points, [0])).astype(np.uint64)
    return points[np.concatenate(([True], (points[1:] != 0) | (points[:-1] != 0)))]


def grams_of(points: np.ndarray, length: int) -> np.ndarray:
    """64-bit hash of every window of ``length`` code points, repeats included."""
    n = len(points) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.full(n, length, np.uint64)
    for k in range(length):
        h = mixed(h * _STEP + points[k:k + n])
    return h


def text_grams(text: str) -> Iterator[np.ndarray]:
    """n-gram hashes of a text, a bounded piece at a time."""
    points = letters_and_gaps(text)
    for start in range(0, len(points), PIECE):
        for length in LENGTHS:
            yield grams_of(points[start:start + PIECE + length - 1], length)


def slots_of(grams: np.ndarray, hashes: int, slots: int) -> Iterator[np.ndarray]:
    """The filter slots of each n-gram, one array for every hash function (double hashing; ``slots`` is a power of two)."""
    step = mixed(grams + _STEP) | np.uint64(1)
    for k in range(hashes):
        yield (grams + step * np.uint64(k)) & np.uint64(slots - 1)


def gram_counts(lessons: DataFrame) -> DataFrame:
    """``family, gram, n``: occurrences of every n-gram in the texts of a family."""
    def summed(family: str, parts: list[np.ndarray]) -> pa.RecordBatch:
        grams, n = np.unique(np.concatenate(parts), return_counts=True)
        return pa.RecordBatch.from_arrays(
            [pa.array([family] * len(grams), pa.string()), pa.array(grams.view(np.int64)), pa.array(n.astype(np.int64))],
            names=["family", "gram", "n"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str, list[np.ndarray]] = {}
        size = 0
        for batch in batches:
            for family, text in zip(batch.column(0), batch.column(1)):
                for grams in text_grams(text.as_py()):
                    waiting.setdefault(family.as_py(), []).append(grams)
                    size += len(grams)
                if size >= GRAMS_HELD:
                    yield from (summed(f, parts) for f, parts in waiting.items())
                    waiting, size = {}, 0
        yield from (summed(f, parts) for f, parts in waiting.items())

    found = lessons.select("family", whole_text().alias("text")).mapInArrow(counted, "family string, gram bigint, n bigint")
    return found.groupBy("family", "gram").agg(F.sum("n").alias("n"))


def family_profiles(lessons: DataFrame, share: float) -> DataFrame:
    """``family, gram``: n-grams that make up ``share`` or more of the n-grams of their family, at most 1 / share each."""
    counts = settle(gram_counts(lessons), "grams")
    totals = counts.groupBy("family").agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(totals), "family").where(F.col("n") >= F.col("total") * share).select("family", "gram")


class GramFilter:
    """A Bloom filter whose slots hold one bit per family: one look tells all families that have an n-gram."""

    def __init__(self, families: Sequence[str], slots: int, hashes: int, words: np.ndarray):
        self.families, self.slots, self.hashes = list(families), slots, hashes
        self.words = words  # [slots, ceil(families / 64)]
        filled = np.array([((words[:, k // WORD_BITS] >> np.uint64(k % WORD_BITS)) & np.uint64(1)).mean() for k in range(len(self.families))])
        self.false_rate = filled**hashes

    def hits(self, grams: np.ndarray) -> np.ndarray:
        """Per family the number of n-grams that the filter holds: popcounts of the slices of the common words."""
        common = None
        for at in slots_of(grams, self.hashes, self.slots):
            found = self.words[at]
            common = found if common is None else common & found
        counts = np.zeros(len(self.families), np.int64)
        for k in range(len(self.families)):
            bits = (common[:, k // WORD_BITS] >> np.uint64(k % WORD_BITS)).astype(np.uint8) & 1
            counts[k] = int(np.bitwise_count(np.packbits(bits)).sum())
        return counts

    def decide(self, text: str) -> tuple[str, float]:
        """The family with the largest share of n-grams once false positives are taken off, and its part of all shares."""
        n, hits = 0, np.zeros(len(self.families), np.int64)
        for grams in text_grams(text):
            if len(grams):
                n += len(grams)
                hits += self.hits(grams)
        if not n or not self.families:
            return UNDETERMINED, 0.0
        rest = np.maximum(1 - self.false_rate, 1e-9)
        true = np.clip((hits / n - self.false_rate) / rest, 0.0, 1.0)
        best, total = int(np.argmax(true)), float(true.sum())
        return self.families[best], float(true[best] / total) if total > 0 else 0.0


def build_filter(profiles: DataFrame) -> GramFilter:
    """The filter of all profiles; its slots are filled by one aggregation, and its size follows the bound of a profile."""
    spark = profiles.sparkSession
    sizes = sorted((r["family"], r["n"]) for r in profiles.groupBy("family").agg(F.count(F.lit(1)).alias("n")).toLocalIterator())
    families = [f for f, _ in sizes]
    slots = 1 << (max([n for _, n in sizes], default=1) * SLOTS_PER_GRAM - 1).bit_length()
    words = np.zeros((slots, max(1, -(-len(families) // WORD_BITS))), np.uint64)
    if not families:
        return GramFilter([], slots, HASHES, words)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in slots_of(grams, HASHES, slots):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at.astype(np.int64))], names=["number", "slot"])

    numbers = spark.createDataFrame([(f, k) for k, f in enumerate(families)], "family string, number bigint")
    marks = profiles.join(F.broadcast(numbers), "family").select("number", "gram").mapInArrow(placed, "number bigint, slot bigint")
    marks = marks.groupBy("slot", F.floor(F.col("number") / WORD_BITS).alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(number % {WORD_BITS} as int))")).alias("bits"))
    filled = marks.toArrow()
    words[filled["slot"].to_numpy(), filled["word"].to_numpy()] = filled["bits"].to_numpy().view(np.uint64)
    return GramFilter(families, slots, HASHES, words)


def identify_language(traces: DataFrame, lessons: DataFrame, share: float = 2e-5) -> DataFrame:
    """The language in which each trace is written, learned from traces whose language is their ``family``.

    N-grams of three and four code points (lower case, gaps between letters as one character) are counted per family over
    all of ``lessons``; those that make up ``share`` or more of a family's n-grams enter a Bloom filter whose slots hold
    one bit per family.  For a text each n-gram fetches the families that have it at once; the popcount of each family's
    slice, less the false positives that the filling of the slice predicts, gives its share of the text, and the largest
    decides (ties: the first family in code-point order).

    Returns one row per row of ``traces``: ``trial_id, predicted, score``; the score is the decided family's part of all
    shares, 0 to 1.  Null texts and texts without letters give ``und`` with score 0, as does everything when nothing was
    learned; a text with letters and without any known n-gram gives the first family with score 0.  Lessons with a null
    family or text teach nothing; repeated rows count as often as they occur.  Whole texts are read, long ones in bounded
    pieces.  An empty table gives an empty result.  Other columns are ignored, whatever their names are.  The filter that is
    sent to the tasks is bounded by ``1 / share`` n-grams a family; up to 4096 families are allowed.
    """
    lessons = lessons.select(F.col("family").cast("string").alias("family"), "text").where("family IS NOT NULL AND text IS NOT NULL")
    learned = build_filter(settle(family_profiles(lessons, share), "profiles"))
    if len(learned.families) > 4096:
        raise ValueError(f"{len(learned.families)} families; the filter is meant for 4096 at most")
    model = traces.sparkSession.sparkContext.broadcast(learned)

    def decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.value.decide(text.as_py()) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f for f, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())],
                names=["trial_id", "predicted", "score"])

    rows = traces.select("trial_id", whole_text().alias("text"))
    schema = T.StructType([rows.schema["trial_id"], T.StructField("predicted", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(decided, schema)
