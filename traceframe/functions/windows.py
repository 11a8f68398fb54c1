"""Levels of sliding windows over token sequences: numpy over the Arrow batches of a task, linear but for one sort."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Tokens whose places are sorted at once; a longer sequence is taken alone.
TOKENS = 1 << 20

#: (position, previous and next position of an equal item or -1) to the first and last start of the windows that count the item.
Interval = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def _codes(values: pa.Array, gram: int) -> np.ndarray:
    """Numbers of the grams that begin at each value, equal for equal grams; the last ``gram - 1`` are of no use."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    codes = values.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
    size = 1
    while size < gram:
        step = min(size, gram - size)
        later = np.concatenate((codes[step:], np.zeros(min(step, len(codes)), np.int64)))
        codes = np.unique(codes * (len(codes) + 1) + later, return_inverse=True)[1].reshape(-1)
        size += step
    return codes


def window_levels(sequences: pa.ListArray, window: int, gram: int, interval: Interval) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows of sequences, all of ``window`` items at least: the number of counted items for every window start of a row.

    Returns the levels of all rows, where each row begins, and its number of starts.  The sequences of a row share its starts.
    """
    inner = sequences.flatten()
    per_row, size = sequences.value_lengths().to_numpy(), inner.value_lengths().to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(per_row)), per_row)
    starts = np.zeros(len(per_row), np.int64)
    np.maximum.at(starts, row, size - window + 1)
    begin = np.cumsum(starts) - starts

    codes = _codes(inner.flatten(), gram)
    first = np.cumsum(size) - size
    p = np.arange(len(codes)) - np.repeat(first, size)
    row, last = np.repeat(row, size), np.repeat(size - window, size)
    whole = p <= last + window - gram
    codes, p, row, last = codes[whole], p[whole], row[whole], last[whole]

    key = row * (codes.max(initial=0) + 1) + codes
    order = np.lexsort((p, key))
    p, last, key, at = p[order], last[order], key[order], begin[row[order]]
    same = key[1:] == key[:-1]
    before, after = np.full(len(p), -1), np.full(len(p), -1)
    before[1:][same], after[:-1][same] = p[:-1][same], p[1:][same]
    low, high = interval(p, before, after)
    low, high = np.maximum(low, 0), np.minimum(high, last)
    held = low <= high
    ends = held & (high < last)
    total = int(starts.sum())
    change = np.bincount((at + low)[held], minlength=total) - np.bincount((at + high + 1)[ends], minlength=total)
    level = np.cumsum(change)
    return level - np.repeat(level[begin] - change[begin], starts), begin, starts


def windowed(df: DataFrame, trace: str, tokens: str, out: T.StructField, window: int, gram: int, interval: Interval, result) -> DataFrame:
    """(trace, out): ``result(levels, begin, starts)`` of the sequences that fill a window; those of one trace are taken together.

    ``df`` is partitioned by trace, so the sequences of a trace meet without another exchange.
    """
    lists = df.where(F.size(tokens) >= window).groupBy(trace).agg(F.collect_list(tokens).alias("__sequences"))
    most = TOKENS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequences = batch.column(1)
            size = np.concatenate(([0], np.cumsum(sequences.flatten().value_lengths().to_numpy())))
            upto = size[np.cumsum(sequences.value_lengths().to_numpy())]  # tokens up to and with each row
            start = 0
            while start < len(upto):
                taken = upto[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(upto, taken + most, side="right")))
                values = result(*window_levels(sequences.slice(start, stop - start), window, gram, interval))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), values], names=[trace, out.name])
                start = stop

    return lists.mapInArrow(run, T.StructType([df.schema[trace], out]))
