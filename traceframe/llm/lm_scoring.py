"""Cross-entropy difference of trace texts under a target and a background language model."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .records import whole_text

#: Distinct words, or bigrams, that a task counts before it hands them on.
COUNTED = 300_000
#: Ids of the begin of a text (a context only) and of words outside the vocabulary.
BEGIN, UNKNOWN = 0, 1


def raw_texts(traces: DataFrame) -> DataFrame:
    return traces.select(whole_text().cast("binary").alias("text"))


def word_counts(traces: DataFrame) -> DataFrame:
    """``word, n`` of all words, lower case in A-Z; combined in each task first."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Counter()

        def told() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
            seen.clear()
            return out

        for batch in batches:
            for text in batch.column(0):
                seen.update(text.as_py().lower().split())
                if len(seen) > COUNTED:
                    yield told()
        yield told()

    return raw_texts(traces).mapInArrow(count, "word binary, n bigint")


def bigram_counts(traces: DataFrame, words) -> DataFrame:
    """``code, n`` of all pairs of neighbouring ids, the first one of a text preceded by its begin.

    ``words`` is the broadcast vocabulary, word to id.  The code is context * (ids) + word.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, size = words.value, [], 0

        def told() -> pa.RecordBatch:
            code, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(code, pa.int64()), pa.array(n, pa.int64())], names=["code", "n"])

        for batch in batches:
            for text in batch.column(0):
                held.append(text_codes(text.as_py(), ids))
                size += len(held[-1])
                if size > 4 * COUNTED:
                    yield told()
                    held, size = [], 0
        if held:
            yield told()

    return raw_texts(traces).mapInArrow(count, "code bigint, n bigint")


def text_codes(text: bytes, ids: dict[bytes, int]) -> np.ndarray:
    words = text.lower().split()
    known = np.empty(len(words) + 1, np.int64)
    known[0] = BEGIN
    known[1:] = [ids.get(w, UNKNOWN) for w in words]
    return known[:-1] * (len(ids) + 2) + known[1:]


def both_counts(target: DataFrame, background: DataFrame, key: str) -> DataFrame:
    """Counts of both corpora side by side: ``key, target, background``."""
    zero = F.lit(0).cast("bigint")
    rows = target.select(key, F.col("n").alias("target"), zero.alias("background")).unionByName(
        background.select(key, zero.alias("target"), F.col("n").alias("background")))
    return rows.groupBy(key).agg(F.sum("target").alias("target"), F.sum("background").alias("background"))


def frequent(counts: DataFrame, totals, share: float, corpora: tuple[str, ...]) -> DataFrame:
    """Entries that make up ``share`` of a corpus or more and occur twice: at most 1 / share for each, however large it is."""
    return counts.where(" OR ".join(f"{c} >= {max(2, share * (totals[c] or 0))}" for c in corpora))


def fit_bigrams(words: np.ndarray, contexts: np.ndarray, context_n: np.ndarray, context_t: np.ndarray, codes: np.ndarray,
                counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One interpolated bigram model over the shared ids as ``(single, back, kept)``.

    P(w | h) = kept(h, w) + back(h) * single(w), with Witten-Bell weights: where n(h) words and t(h) different ones follow
    the context, a bigram keeps its count / (n(h) + t(h)), and back(h) is what the kept ones leave over.  single is
    smoothed towards equal shares the same way.
    """
    size = len(words)
    n, types = words.sum(), max(int((words > 0).sum()), 1)
    single = np.zeros(size)
    single[1:] = (words[1:] + types / (size - 1)) / (n + types)  # nothing is the begin of a text
    weight = np.zeros(size)
    weight[contexts] = context_n + context_t
    kept = np.where(counts > 0, counts / np.maximum(weight[codes // size], 1), 0.0)
    back = 1 - np.bincount(codes // size, weights=kept, minlength=size)
    return single, np.maximum(back, 1e-12), kept


def losses(model: tuple[np.ndarray, np.ndarray, np.ndarray], codes: np.ndarray, at: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Negative log probabilities (bits) of coded bigrams; ``at`` are their places among the kept ones where ``found``."""
    single, back, kept = model
    p = back[codes // len(single)] * single[codes % len(single)]
    p[found] += kept[at[found]]
    return -np.log2(p)


def fit_models(target: DataFrame, traces: DataFrame, word_share: float, bigram_share: float):
    """Broadcast ``(word ids, kept codes, target model, background model)``.

    Counts cover all data of both corpora and stay distributed; what reaches the driver is bounded by the two shares: words
    and bigrams of at least that share of a corpus, and one row per word as a context.
    """
    context = traces.sparkSession.sparkContext
    words = settle(both_counts(word_counts(target), word_counts(traces), "word"), "words")
    totals = words.agg(F.sum("target").alias("target"), F.sum("background").alias("background")).first()
    listed = sorted((bytes(r["word"]), r["target"], r["background"]) for r in frequent(words, totals, word_share, ("target", "background")).collect())
    ids = {w: i + 2 for i, (w, _, _) in enumerate(listed)}
    shared = context.broadcast(ids)
    pairs = settle(both_counts(bigram_counts(target, shared), bigram_counts(traces, shared), "code"), "bigrams")
    by_context = pairs.groupBy(F.floor(F.col("code") / (len(ids) + 2)).alias("h")).agg(*[
        f(c).alias(f"{c}_{k}") for c in ("target", "background") for k, f in (("n", F.sum), ("t", lambda x: F.count_if(F.col(x) > 0)))]).toPandas()
    kept = frequent(pairs, totals, bigram_share, ("target", "background")).toPandas().sort_values("code")
    codes, h = kept["code"].to_numpy(np.int64), by_context["h"].to_numpy(np.int64)
    models = []
    for k, c in enumerate(("target", "background")):
        counts = np.array([0.0, 0.0] + [x[1 + k] for x in listed])
        counts[UNKNOWN] = (totals[c] or 0) - counts.sum()
        models.append(fit_bigrams(counts, h, by_context[f"{c}_n"].to_numpy(float), by_context[f"{c}_t"].to_numpy(float), codes, kept[c].to_numpy(float)))
    return context.broadcast((ids, codes, *models))


def score_cross_entropy(traces: DataFrame, target: DataFrame, word_share: float = 5e-6, bigram_share: float = 1e-6) -> DataFrame:
    """Scores every whole text by how much better a target model predicts it than a background model.

    The target model is learned from the texts of ``target``, the background model from all ``traces``; both are
    interpolated bigram models with the same smoothing over one vocabulary: the words that make up ``word_share`` of either
    corpus or more (and occur twice there), all others being one unknown word to both.  Bigrams of ``bigram_share`` or more have counts of
    their own, the rest back off.  Since at most 1 / share entries can have that share, models are bounded whatever the
    size of the corpora, and are broadcast; the counts they are made from are not, and follow the input.

    Returns one row per input row: ``trial_id, n_words, target_loss, background_loss`` (bits per word) and ``difference``
    (target less background; lower is closer to the target).  Without words, both losses and the difference are 0.  Null
    text is empty.  An empty target or an empty table is allowed: all words are then unknown to that model.
    """
    models = fit_models(target, traces, word_share, bigram_share)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, kept, target_model, background_model = models.value
        for batch in batches:
            out = []
            for text in batch.column(1):
                codes = text_codes(text.as_py(), ids)
                n = len(codes)
                at = np.searchsorted(kept, codes)
                found = at < len(kept)
                found[found] = kept[at[found]] == codes[found]
                bits = [float(losses(m, codes, at, found).mean()) if n else 0.0 for m in (target_model, background_model)]
                out.append((n, *bits, bits[0] - bits[1]))
            columns = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(columns[0], pa.int64()), *[pa.array(x, pa.float64()) for x in columns[1:]]],
                names=["trial_id", "n_words", "target_loss", "background_loss", "difference"])

    key = traces.schema["trial_id"].dataType.simpleString()
    return traces.select("trial_id", whole_text().cast("binary").alias("text")).mapInArrow(
        score, f"trial_id {key}, n_words bigint, target_loss double, background_loss double, difference double")
