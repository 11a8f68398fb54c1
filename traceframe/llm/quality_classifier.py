"""Quality scores of trace texts by regularised quadratic discriminant analysis."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .records import whole_text

#: Statistics of a text, in the order of the feature vector; each is a logarithm or the log-odds of a share.
FEATURES = (
    "log_words", "log_word_length", "log_lines", "upper", "digits", "punctuation", "symbols", "not_ascii", "blanks",
    "distinct_words", "top_word", "repeated_pairs", "repeated_windows", "repeated_lines", "short_words", "long_words", "sentence_ends",
)

# fixed values: bytes of the classes
_CLASS = np.zeros(256, np.int64)
for _code, _bytes in enumerate((range(65, 91), range(97, 123), range(48, 58), b".,;:!?'\"()-", b"#*$%&|<>{}[]=+_/\\@^~`", range(128, 256), b" \t\n\r\x0b\x0c")):
    _CLASS[list(_bytes)] = _code + 1


def log_odds(part: float, whole: float) -> float:
    """Log-odds of a share, finite for 0 of n and n of n."""
    return math.log((part + 0.5) / (whole - part + 0.5))


def text_features(text: str) -> list[float]:
    """The feature vector of one whole text; defined for empty texts as well."""
    raw = text.encode()
    counts = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=8).tolist()
    words = raw.split()
    n = len(words)
    seen = Counter(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    pairs = set(zip(words, words[1:]))
    windows = Counter(zip(words, words[1:], words[2:], words[3:], words[4:]))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    size, letters = len(raw), counts[1] + counts[2]
    return [
        math.log1p(n), math.log1p(size / (n + 1)), math.log1p(len(lines)), log_odds(counts[1], letters), log_odds(counts[3], size),
        log_odds(counts[4], size), log_odds(counts[5], size), log_odds(counts[6], size), log_odds(counts[7], size),
        log_odds(len(seen), n), log_odds(max(seen.values(), default=0), n), log_odds(max(n - 1, 0) - len(pairs), max(n - 1, 0)),
        log_odds(sum(c for c in windows.values() if c > 1), max(n - 4, 0)), log_odds(len(lines) - len(set(lines)), len(lines)),
        log_odds(int((lengths <= 3).sum()), n), log_odds(int((lengths >= 12).sum()), n), log_odds(sum(w[-1] in b".!?" for w in words), n),
    ]


def feature_table(traces: DataFrame) -> DataFrame:
    """``trial_id, features`` for every row."""
    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [text_features(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["trial_id", "features"])

    key = traces.schema["trial_id"].dataType.simpleString()
    return traces.select("trial_id", whole_text().alias("text")).mapInArrow(measured, f"trial_id {key}, features array<double>")


@dataclass
class Discriminant:
    """Class means, Cholesky factors of the inverse metric and constants of the log densities."""

    mean: np.ndarray  # all features, for standardising
    scale: np.ndarray
    centres: np.ndarray  # classes x features
    factors: list[np.ndarray]  # lower Cholesky factors of the class covariances
    constants: np.ndarray  # log prior - log determinant / 2
    tempering: float

    def scores(self, features: np.ndarray) -> np.ndarray:
        """Probability of the class of good texts from the difference of the two log densities."""
        z = np.clip((features - self.mean) / self.scale, -8, 8)
        logs = []
        for centre, factor, constant in zip(self.centres, self.factors, self.constants):
            y = np.linalg.solve(factor, (z - centre).T)  # squared length is the Mahalanobis distance
            logs.append(constant - 0.5 * (y * y).sum(axis=0))
        return 1 / (1 + np.exp(-np.clip(self.tempering * (logs[1] - logs[0]), -700, 700)))


def class_moments(labelled: DataFrame, n: int) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Rows, sums and sums of products of the features per class (0 and 1), gathered as one row per class."""
    at = [(i, j) for i in range(n) for j in range(i, n)]
    x = [F.col("features")[i] for i in range(n)]
    sums = labelled.groupBy("good").agg(
        F.count("*").alias("n"), F.array(*[F.sum(v) for v in x]).alias("first"), F.array(*[F.sum(x[i] * x[j]) for i, j in at]).alias("second"))
    out = {}
    for row in sums.collect():
        second = np.zeros((n, n))
        for (i, j), v in zip(at, row["second"]):
            second[i, j] = second[j, i] = v
        out[int(row["good"])] = (float(row["n"]), np.array(row["first"]), second)
    return out


def fit_discriminant(labelled: DataFrame, shrink_to_pooled: float = 0.2, shrink_to_diagonal: float = 0.1,
                     tempering: float = 0.5) -> Discriminant | None:
    """Fits the discriminant to ``features, good`` (boolean or 0/1); None when a class has fewer than two rows.

    All labelled rows count; only sums leave the executors.  Each class covariance is shrunk towards the pooled one, then
    towards its own diagonal, so it stays invertible with few rows, and its Cholesky factor is kept.
    """
    n = len(FEATURES)
    moments = class_moments(labelled, n)
    if len(moments) < 2 or min(m[0] for m in moments.values()) < 2:
        return None
    rows = sum(m[0] for m in moments.values())
    mean = sum(m[1] for m in moments.values()) / rows
    scale = np.sqrt(np.maximum(np.diag(sum(m[2] for m in moments.values())) / rows - mean**2, 1e-12))
    scale = np.where(scale > 1e-5, scale, 1.0)
    centres, spreads = [], []
    for k in (0, 1):
        count, first, second = moments[k]
        own = first / count
        centres.append((own - mean) / scale)
        spreads.append((second / count - np.outer(own, own)) / np.outer(scale, scale))
    pooled = sum(moments[k][0] * spreads[k] for k in (0, 1)) / rows
    factors, constants = [], []
    for k in (0, 1):
        spread = (1 - shrink_to_pooled) * spreads[k] + shrink_to_pooled * pooled
        spread = (1 - shrink_to_diagonal) * spread + shrink_to_diagonal * np.diag(np.diag(spread)) + 1e-3 * np.eye(n)
        factors.append(np.linalg.cholesky(spread))
        constants.append(math.log(moments[k][0] / rows) - np.log(np.diag(factors[k])).sum())
    return Discriminant(mean, scale, np.array(centres), factors, np.array(constants), tempering)


def score_quality(traces: DataFrame, verdicts: DataFrame, **shrinkage: float) -> DataFrame:
    """Scores every whole text for quality by a regularised quadratic discriminant.

    ``verdicts`` holds the labels to learn from, ``trial_id, good`` (true or 1 for a good text; null is ignored).  The
    statistics of a text (``FEATURES``) are the only inputs of the score: class means and shrunken class covariances
    (``fit_discriminant``) give two log densities, whose tempered difference goes through the logistic function.
    Features are computed once and written to shared scratch; labels meet them by ``trial_id``.

    Returns one row per input row: ``trial_id, score`` (0 to 1, higher for better), ``predicted`` (1 from 0.5 on).  Null
    text is scored as empty text.  A trace labelled twice counts twice.  Without two labelled rows of each class every
    score is 0.5.  An empty table gives an empty result.
    """
    features = settle(feature_table(traces), "features")
    labels = verdicts.where("good IS NOT NULL AND trial_id IS NOT NULL").select(F.col("trial_id").alias("of"), F.col("good").cast("int").alias("good"))
    model = fit_discriminant(features.join(labels, F.col("trial_id") == F.col("of")).select("features", "good"), **shrinkage)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(-1, len(FEATURES))
            score = np.full(len(x), 0.5) if model is None else model.scores(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["trial_id", "score", "predicted"])

    key = traces.schema["trial_id"].dataType.simpleString()
    return features.mapInArrow(scored, f"trial_id {key}, score double, predicted int")
