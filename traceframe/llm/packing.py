"""Packing of tokenised traces into sequences of a fixed capacity by harmonic classes."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import settle
from .records import whole_text

#: Words whose ids one Python task keeps; when full, the memory starts anew.
REMEMBERED_WORDS = 250_000
#: Texts with other characters go to the tokenizer as a whole: libraries may differ in the Unicode version of their letters.
PLAIN = "\0-\u04ff"
#: A blank beside another blank or at the end: the splitter then cuts elsewhere than before a blank.
ODD_BLANKS = r"[\t-\r \x85\xa0] | [\t-\r\x85\xa0]| \Z"
# fixed values: the splitter's pattern in a byte-level vocabulary of this kind
SPLITTER = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_of_sign() -> dict[str, int]:
    """The byte each sign of a byte-level vocabulary stands for: printable bytes themselves, the others from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


class TokenBytes:
    """Token ids of texts as little-endian unsigned 32-bit bytes.

    A byte-level tokenizer always cuts before a single blank, so the ids of a text are those of its blank-separated
    words, and most words have been met before.  The new words of a text are encoded together, by the vocabulary of the
    given file, and told apart by the blanks their first tokens begin with.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        signs = byte_of_sign()
        ranks = {bytes(signs[c] for c in token): i for token, i in self.tokenizer.get_vocab().items() if token not in special}
        self.encode = tiktoken.Encoding("words", pat_str=SPLITTER, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.begins = np.zeros(max(ranks.values()) + 1, bool)
        self.begins[[i for token, i in ranks.items() if token.startswith(b" ")]] = True
        self.unusual = re.compile("|".join([f"[^{PLAIN}]", *map(re.escape, special)])).search
        self.odd_blanks = re.compile(ODD_BLANKS).search
        self.known: dict[str, bytes] = {}

    def learn(self, words: list[str]) -> None:
        ids = np.array(self.encode(" " + " ".join(words)), "<u4")
        cuts = (4 * np.flatnonzero(self.begins[ids])).tolist() + [4 * len(ids)]
        ids = ids.tobytes()
        for word, a, b in zip(words, cuts, cuts[1:]):
            self.known[word] = ids[a:b]

    def __call__(self, text: str) -> bytes:
        if self.unusual(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if self.odd_blanks(text):
            return np.array(self.encode(text), "<u4").tobytes()
        first, *words = text.split(" ")
        known = self.known
        new = list({w for w in words if w not in known})
        if new:
            if len(known) > REMEMBERED_WORDS:
                known.clear()
                new = list(set(words))
            self.learn(new)
        return np.array(self.encode(first), "<u4").tobytes() + b"".join(map(known.__getitem__, words))


@lru_cache(maxsize=1)
def token_bytes(path: str) -> TokenBytes:
    """One per Python process: the next task there finds the vocabulary and the words it has met."""
    return TokenBytes(path)


def harmonic_cuts(length: int, capacity: int, max_waste: float) -> list[tuple[int, int]]:
    """Cuts ``length`` tokens into pieces ``(tokens, class)``; ``class`` pieces of a class fill one sequence.

    A piece in (capacity/(k+1), capacity/k] has class k.  Full sequences are cut off first.  A rest that would leave more
    than ``max_waste`` of its share empty gives a piece of exactly the next smaller share, and what remains goes on.
    """
    out = [(capacity, 1)] * (length // capacity)
    rest = length % capacity
    while rest:
        k = capacity // rest
        size = rest if rest * k >= (1 - max_waste) * capacity else capacity // (k + 1)
        out.append((size, capacity // size))
        rest -= size
    return out


def cut_pieces(traces: DataFrame, tokenizer: str, end_id: int, capacity: int, max_waste: float) -> DataFrame:
    """Tokenises every whole text once: ``trial_id, start, length, class, ids_crc32, trace_tokens`` per piece."""
    key = traces.schema["trial_id"]
    schema = f"trial_id {key.dataType.simpleString()}, start bigint, length bigint, class bigint, ids_crc32 bigint, trace_tokens bigint"
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = token_bytes(tokenizer)
        for batch in batches:
            take, start, length, cls, crc, total = [], [], [], [], [], []
            for row, text in enumerate(batch.column(1)):
                ids = memoryview(tokens(text.as_py()) + end)
                at, n = 0, len(ids) // 4
                for size, k in harmonic_cuts(n, capacity, max_waste):
                    take.append(row)
                    start.append(at)
                    length.append(size)
                    cls.append(k)
                    crc.append(zlib.crc32(ids[4 * at:4 * (at + size)]))
                    total.append(n)
                    at += size
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(take, pa.int64()))] + [pa.array(x, pa.int64()) for x in (start, length, cls, crc, total)],
                names=["trial_id", "start", "length", "class", "ids_crc32", "trace_tokens"])

    return traces.select("trial_id", whole_text().alias("text")).mapInArrow(cut, schema)


def first_fit_decreasing(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """(sequence, offset) of each length, given in descending order."""
    used, out, by_room = [], [], {}
    for size in lengths:
        room = min((r for r in by_room if r >= size and by_room[r]), default=None)
        seq = by_room[room].pop() if room is not None else len(used)
        if room is None:
            used.append(0)
        out.append((seq, used[seq]))
        used[seq] += size
        by_room.setdefault(capacity - used[seq], []).append(seq)
    return out


def pack_traces(traces: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 2048,
                max_waste: float = 0.02, parts: int = 64) -> DataFrame:
    """Packs the token ids of all traces into sequences of at most ``capacity`` tokens with little padding.

    Harmonic packing.  Every trace (its ids and ``end_id``) is cut into pieces whose lengths lie just below
    ``capacity / k`` (``harmonic_cuts``); k pieces of class k fill a sequence, whichever they are, so classes are filled
    without looking at other classes and in parallel.  Pieces are numbered inside (class, part), where a part is a hash
    of the trace, ``parts`` per class, and the numbers of the parts are shifted by a small table of counts; piece i of
    class k goes to sequence i / k, slot i % k.  Only the last, unfilled sequence of each class (fewer than ``capacity``
    pieces of at most ``capacity`` classes in all, whatever the input) is taken apart and packed first-fit decreasing.

    Returns one row per piece: ``trial_id, start, length, ids_crc32, trace_tokens, sequence_id, offset``.  ``start`` counts
    the trace's ids before the piece; ``offset`` is gapless from 0 in each sequence; sequence ids are unique, not gapless.
    Null text has the end id alone.  Rows that repeat a trace are packed as often as they occur.  An empty table gives an
    empty result.
    """
    pieces = settle(cut_pieces(traces, tokenizer, end_id, capacity, max_waste), "pieces")
    pieces = pieces.withColumn("part", F.pmod(F.xxhash64("trial_id"), F.lit(parts)))
    # at most capacity * parts rows
    counts = settle(pieces.groupBy("class", "part").agg(F.count("*").alias("n")), "counts")
    before = Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(
        "class", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"), F.sum("n").over(Window.partitionBy("class")).alias("all"))
    # sequences of the classes before, in the order of classes
    classes = counts.groupBy("class").agg(F.floor(F.sum("n") / F.col("class")).alias("full"))
    classes = classes.select("class", "full", F.coalesce(F.sum("full").over(
        Window.orderBy("class").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    shifts = F.broadcast(shifts.join(classes, "class"))
    rank = F.row_number().over(Window.partitionBy("class", "part").orderBy("trial_id", "start", "ids_crc32")) - 1
    numbered = pieces.withColumn("rank", rank).join(shifts, ["class", "part"]).withColumn("rank", F.col("rank") + F.col("shift"))
    seq = F.floor(F.col("rank") / F.col("class"))
    columns = ["trial_id", "start", "length", "ids_crc32", "trace_tokens"]
    numbered = numbered.withColumn("seq", seq)
    within = Window.partitionBy("class", "seq").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    full = numbered.where("seq < full").select(
        *columns, (F.col("base") + F.col("seq")).alias("sequence_id"), F.coalesce(F.sum("length").over(within), F.lit(0)).alias("offset"))
    last = classes.agg(F.coalesce(F.sum("full"), F.lit(0)).alias("sequences"))
    tails = numbered.where("seq >= full").select(*columns).crossJoin(F.broadcast(last))  # one row
    schema = tails.drop("sequences").schema.add("sequence_id", T.LongType()).add("offset", T.LongType())

    def pack(tail: pa.Table) -> pa.Table:
        tail = tail.sort_by([("length", "descending"), ("trial_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        placed = first_fit_decreasing(tail["length"].to_pylist(), capacity)
        taken = tail["sequences"][0].as_py() if placed else 0
        tail = tail.drop_columns(["sequences"])
        tail = tail.append_column("sequence_id", pa.array([taken + s for s, _ in placed], pa.int64()))
        return tail.append_column("offset", pa.array([o for _, o in placed], pa.int64()))

    return full.unionByName(tails.groupBy().applyInArrow(pack, schema))
