"""Removal of long repeated byte strings from trace texts, found by hashes of the strings around chosen positions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .records import whole_text

#: Contexts of one gram that one task compares; beyond it its strings meet in a shuffle.
GRAM_CONTEXTS = 50_000
#: Bytes of a text that are looked at in one step.
BLOCK = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers over the whole range."""
    for _ in range(2):
        x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(32))


class AnchorFinder:
    """Chooses the positions of a text around which strings are compared.

    A position is chosen when the hash of its gram (half a string long) is the smallest of some string of ``length``
    bytes around it.  Equal strings choose equal grams, so every repeated string holds a repeated anchor at the same
    place, at about one position in a hundred.
    """

    def __init__(self, length: int):
        self.gram, self.grams = length // 2, length - length // 2 + 1
        self.length = length
        size = min(BLOCK, 1 << 16)
        self._grow(size)

    def _grow(self, size: int) -> None:
        self.power = np.cumprod(np.full(size, _BASE, np.uint64))
        self.inverse = np.cumprod(np.full(size, pow(_BASE, -1, 1 << 64), np.uint64))

    def _extreme(self, values: np.ndarray, pick: np.ufunc, fill: int) -> np.ndarray:
        """Minimum or maximum of every window of ``grams`` values."""
        n, w = len(values), self.grams
        rows = np.concatenate([values, np.full(-n % w, fill, np.uint64)]).reshape(-1, w)
        ahead = pick.accumulate(rows, axis=1).ravel()[:n]
        behind = pick.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()[:n]
        return pick(behind[: n - w + 1], ahead[w - 1:])

    def __call__(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(positions, gram hashes) of the anchors of a text."""
        found = [self._block(raw, a) for a in range(0, max(len(raw) - self.length + 1, 0), BLOCK)]
        if len(found) < 2:
            return found[0] if found else (np.empty(0, np.int64), np.empty(0, np.int64))
        at, first = np.unique(np.concatenate([x for x, _ in found]), return_index=True)
        return at, np.concatenate([x for _, x in found])[first]

    def _block(self, raw: bytes, a: int) -> tuple[np.ndarray, np.ndarray]:
        codes = np.frombuffer(raw, np.uint8)[a:a + BLOCK + self.length - 1].astype(np.uint64) + np.uint64(1)
        if len(codes) > len(self.power):
            self._grow(len(codes))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * self.power[: len(codes)])])
        grams = len(codes) - self.gram + 1
        hashes = mixed((sums[self.gram:] - sums[: -self.gram]) * self.inverse[:grams])
        least = self._extreme(hashes, np.minimum, (1 << 64) - 1)
        edge = np.zeros(self.grams - 1, np.uint64)
        reach = self._extreme(np.concatenate([edge, least, edge]), np.maximum, 0)
        at = np.flatnonzero(reach == hashes)
        return at + a, hashes[at].view(np.int64)


def context_hashes(sides: list[bytes], width: int, salt: int) -> np.ndarray:
    """Hash of the first 0, 1, ... ``width`` bytes of each side (rows x width + 1)."""
    table = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in sides), np.uint8).reshape(len(sides), width)
    out = np.empty((len(sides), width + 1), np.uint64)
    out[:, 0] = salt
    for j in range(width):
        x = (out[:, j] ^ table[:, j]) * np.uint64(0x9FB21C651E98DF25)
        out[:, j + 1] = x ^ (x >> np.uint64(28))
    return out


def suffix_keys(grams: np.ndarray, left: list[bytes], right: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, key) of every suffix that holds its row's gram in its first ``length`` bytes.

    ``start`` counts the bytes before the gram; two suffixes agree in their first ``length`` bytes when their keys agree.
    """
    gram = length // 2
    width = length - gram
    before, after = context_hashes(left, width, 1), context_hashes(right, width, 2)
    start = np.arange(width + 1)
    keys = mixed(mixed(before + start.astype(np.uint64)) + after[:, ::-1] + grams.view(np.uint64)[:, None])
    inside = (start <= np.array([len(x) for x in left])[:, None]) & (width - start <= np.array([len(x) for x in right])[:, None])
    row, at = np.nonzero(inside)
    return row, at, keys[row, at]


def repeated_suffixes(keys: np.ndarray, keep_first: bool) -> np.ndarray:
    """Which suffixes have an equal one at an earlier place (or, without ``keep_first``, at any other place).

    Keys are hashes, so their order is not that of the suffixes; it only brings equal ones side by side, in the order of
    their places.  That replaces a longest-previous-factor array: a factor reaches ``length`` where an equal key comes before.
    """
    order = np.argsort(keys, kind="stable")  # rows come in the order of their places
    same = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    if not keep_first:
        out[order[:-1][same]] = True
    return out


def merged_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def text_rows(traces: DataFrame) -> DataFrame:
    """Narrow facts of every row: ``trial_id, text_key, n_bytes, text_sha256``."""
    text = whole_text()
    return traces.select("trial_id", F.xxhash64(text).alias("text_key"), F.octet_length(text).cast("bigint").alias("n_bytes"), F.sha2(text, 256).alias("text_sha256"))


def texts_once_a_task(traces: DataFrame, length: int) -> DataFrame:
    """``text_key, text`` of texts that can hold a string; a task passes each of its texts once."""
    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            keep = [i for i, k in enumerate(batch.column(0).to_pylist()) if not (k in seen or seen.add(k))]
            yield batch.take(pa.array(keep, pa.int64()))

    text = whole_text()
    long_ones = traces.where(F.octet_length(text) >= length)
    return long_ones.select(F.xxhash64(text).alias("text_key"), text.alias("text")).mapInArrow(once, "text_key bigint, text string")


def gram_anchors(texts: DataFrame, length: int) -> DataFrame:
    """``gram, text_key, at``: the anchors of every text."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = AnchorFinder(length)
        for batch in batches:
            found = [finder(x.as_py().encode()) for x in batch.column(1)]
            counts = np.array([len(a) for a, _ in found], np.int64)
            keys = np.repeat(batch.column(0).to_numpy(), counts)
            at = np.concatenate([np.empty(0, np.int64), *[a for a, _ in found]])
            grams = np.concatenate([np.empty(0, np.int64), *[g for _, g in found]])
            for part in range(0, len(keys), 100_000):
                cut = slice(part, part + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(x[cut]) for x in (grams, keys, at)], names=["gram", "text_key", "at"])

    return texts.mapInArrow(find, "gram bigint, text_key bigint, at bigint")


def _contexts(batch: pa.RecordBatch, length: int) -> Iterator[tuple[int, bytes, bytes, int, int]]:
    """(row, bytes before the gram, nearest first; bytes after it; gram, at) of the anchors of a batch of texts."""
    gram = length // 2
    width = length - gram
    for row, (text, anchors) in enumerate(zip(batch.column("text"), batch.column("anchors").to_pylist())):
        raw = text.as_py().encode()
        for x in anchors:
            at = x["at"]
            yield row, raw[max(0, at - width):at][::-1], raw[at + gram:at + gram + width], x["gram"], at


def context_keys(touched: DataFrame, length: int) -> DataFrame:
    """``gram, context, text_key, place, at, room, tail``: a hash of all bytes a suffix around the anchor can reach, and how many
    lie before (``room``) and after (``tail``) the gram."""
    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            rows, out = [], []
            for row, left, right, gram, at in _contexts(batch, length):
                rows.append(row)
                out.append((gram, xxhash.xxh64_intdigest(b"%d:" % len(left) + left + right) - (1 << 63), at, len(left), len(right)))
            gram, context, at, room, tail = zip(*out) if out else ([],) * 5
            rows = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(gram, pa.int64()), pa.array(context, pa.int64()), batch.column("text_key").take(rows), batch.column("place").take(rows),
                 *[pa.array(x, pa.int64()) for x in (at, room, tail)]], names=["gram", "context", "text_key", "place", "at", "room", "tail"])

    place = touched.schema["place"].dataType.simpleString()
    return touched.select("text_key", "place", "text", "anchors").mapInArrow(
        keyed, f"gram bigint, context bigint, text_key bigint, place {place}, at bigint, room bigint, tail bigint")


def suffix_spans(sides: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """``text_key, start, end`` of repeated strings around anchors given as ``gram, place, text_key, at, left, right``.

    Tasks take whole grams, in order; those with more than ``GRAM_CONTEXTS`` contexts must be kept out.
    """
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(table: pa.Table) -> pa.RecordBatch:
            grams = table["gram"].to_numpy()
            row, start, key = suffix_keys(grams, table["left"].to_pylist(), table["right"].to_pylist(), length)
            hit = repeated_suffixes(key, keep_first)
            low, high = np.full(len(grams), length), np.full(len(grams), -1)
            np.minimum.at(low, row[hit], start[hit])
            np.maximum.at(high, row[hit], start[hit])
            some = np.flatnonzero(high >= 0)
            at = table["at"].to_numpy()[some]
            # all of them hold the gram, so the outermost two cover what lies between
            return pa.RecordBatch.from_arrays(
                [pa.array(table["text_key"].to_numpy()[some]), pa.array(at - high[some]), pa.array(at - low[some] + length)], names=["text_key", "start", "end"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            table = pa.Table.from_batches(held)
            if len(table) >= 4000:
                grams = table["gram"].to_numpy()
                cut = int(np.flatnonzero(grams != grams[-1])[-1]) + 1 if grams[0] != grams[-1] else 0
                done, table = table.slice(0, cut), table.slice(cut)
                if cut:
                    yield solved(done)
                held = table.combine_chunks().to_batches()
        if held:
            yield solved(pa.Table.from_batches(held))

    ordered = sides.select("gram", "place", "text_key", "at", "left", "right").repartition("gram").sortWithinPartitions("gram", "place", "text_key", "at")
    return ordered.mapInArrow(search, "text_key bigint, start bigint, end bigint")


def shuffled_suffix_spans(sides: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """The same for grams with very many contexts: every string is a row, and Spark brings equal ones together."""
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(0, batch.num_rows, 500):
                some = batch.slice(part, 500)
                row, start, key = suffix_keys(some.column("gram").to_numpy(), some.column("left").to_pylist(), some.column("right").to_pylist(), length)
                rows = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(start), *[some.column(c).take(rows) for c in ("place", "text_key", "at")]],
                    names=["key", "back", "place", "text_key", "at"])

    place = sides.schema["place"].dataType.simpleString()
    suffixes = settle(sides.mapInArrow(spread, f"key bigint, back bigint, place {place}, text_key bigint, at bigint"), "suffixes")
    where = F.struct("place", "text_key", "at")
    runs = suffixes.groupBy("key").agg(F.count("*").alias("n"), F.min(where).alias("first")).where("n > 1")
    hits = suffixes.join(runs, "key")
    if keep_first:
        hits = hits.where(F.col("first") != where)
    return hits.groupBy("text_key", "at").agg(F.max("back").alias("high"), F.min("back").alias("low")).select(
        "text_key", (F.col("at") - F.col("high")).alias("start"), (F.col("at") - F.col("low") + length).alias("end"))


def repeated_spans(traces: DataFrame, copies: DataFrame, length: int, keep_first: bool) -> tuple[DataFrame, DataFrame]:
    """The repeated strings inside distinct texts as ``text_key, start, end``, and the table of the texts that may hold some."""
    texts = texts_once_a_task(traces, length)
    anchors = settle(gram_anchors(texts, length), "anchors")
    repeated = anchors.groupBy("gram").agg(
        F.min("text_key").alias("k1"), F.max("text_key").alias("k2"), F.min("at").alias("a1"), F.max("at").alias("a2")).where("k1 <> k2 OR a1 <> a2")
    repeated = settle(repeated.select("gram"), "repeated")  # as a table of its own, so that a join can split a very common gram
    lists = anchors.join(repeated, "gram", "left_semi").groupBy("text_key").agg(F.collect_set(F.struct("gram", "at")).alias("anchors"))
    lists = lists.join(copies.select("text_key", "place"), "text_key")
    touched = settle(texts.join(lists, "text_key").dropDuplicates(["text_key"]), "touched")
    contexts = settle(context_keys(touched, length), "contexts")
    groups = contexts.groupBy("gram", "context").agg(F.count("*").alias("n"), F.min(F.struct("place", "text_key", "at")).alias("first"))
    groups = settle(groups, "groups")
    width = length - length // 2
    # a context that occurs twice: every string in it does
    again = contexts.where("room + tail >= " + str(width)).join(groups.where("n > 1"), ["gram", "context"])
    if keep_first:
        again = again.where(F.col("first") != F.struct("place", "text_key", "at"))
    whole = again.select("text_key", (F.col("at") - F.least("room", F.lit(width))).alias("start"), (F.col("at") + length - width + F.col("tail")).alias("end"))
    # different contexts of one gram: their suffixes are put in order
    several = groups.groupBy("gram").agg(F.count("*").alias("contexts")).where("contexts > 1")
    firsts = groups.join(several, "gram").select("gram", "contexts", F.col("first.text_key").alias("of"), F.col("first.at").alias("at"))
    chosen = firsts.groupBy("of").agg(F.collect_list(F.struct("gram", "at", "contexts")).alias("anchors"))
    chosen = touched.drop("anchors").join(chosen, F.col("text_key") == F.col("of"))

    def sided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = [], []
            for row, left, right, gram, at in _contexts(batch, length):
                rows.append(row)
                out.append((left, right, gram, at))
            left, right, gram, at = zip(*out) if out else ([],) * 4
            contexts = [x["contexts"] for a in batch.column("anchors").to_pylist() for x in a]
            rows = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(gram, pa.int64()), pa.array(contexts, pa.int64()), batch.column("place").take(rows), batch.column("text_key").take(rows),
                 pa.array(at, pa.int64()), pa.array(left, pa.binary()), pa.array(right, pa.binary())],
                names=["gram", "contexts", "place", "text_key", "at", "left", "right"])

    place = touched.schema["place"].dataType.simpleString()
    sides = chosen.select("text_key", "place", "text", "anchors").mapInArrow(
        sided, f"gram bigint, contexts bigint, place {place}, text_key bigint, at bigint, left binary, right binary")
    spans = whole.unionByName(suffix_spans(sides.where(F.col("contexts") <= GRAM_CONTEXTS), length, keep_first))
    if several.where(F.col("contexts") > GRAM_CONTEXTS).limit(1).count():
        spans = spans.unionByName(shuffled_suffix_spans(sides.where(F.col("contexts") > GRAM_CONTEXTS), length, keep_first))
    return spans, touched


def remove_repeats(traces: DataFrame, length: int = 400, keep_first: bool = True) -> DataFrame:
    """Removes from every whole text, as UTF-8 bytes, what lies in a string of ``length`` bytes that occurs elsewhere.

    With ``keep_first``, a string goes only where an equal one starts earlier: in a trace with a smaller ``trial_id``, or
    before it in the same text.  Otherwise all its occurrences go.  Strings are judged on the input, may overlap, and never
    cross texts.

    There is no suffix order and no longest-previous-factor array: only whether a factor reaches ``length`` matters, so
    the strings of ``length`` bytes around anchors (``AnchorFinder``) whose gram occurs twice are told by a 64-bit hash of
    their bytes and brought together by it; the smallest place of equal ones is the earlier match.  Anchors with the same
    bytes all around are merged before, so a passage that thousands of texts share is compared once; whole copies of a
    text never enter.  A gram with very many contexts is handled by a shuffle.  Equal hashes are taken for equal strings.

    Returns one row per input row: ``trial_id, n_bytes, spans`` (removed runs as ``start, end``, maximal and ascending),
    ``kept_sha256`` (hexadecimal sha256 of the remaining bytes).  Null text is empty.  Rows that repeat a ``trial_id`` and
    its text count as copies of each other, except that ``keep_first`` keeps both.  An empty table gives an empty result.
    """
    rows = settle(text_rows(traces), "rows")
    copies = settle(rows.groupBy("text_key").agg(F.count("*").alias("copies"), F.min("trial_id").alias("place")), "copies")
    spans, touched = repeated_spans(traces, copies, length, keep_first)
    lists = spans.groupBy("text_key").agg(F.collect_set(F.struct("start", "end")).alias("found"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            out, digests = [], []
            for text, found in zip(batch.column(1), batch.column(2).to_pylist()):
                raw = text.as_py().encode()
                gone = merged_spans([(x["start"], x["end"]) for x in found])
                edges = [0, *[x for s in gone for x in s], len(raw)]
                digests.append(hashlib.sha256(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))).hexdigest())
                out.append([{"start": a, "end": b} for a, b in gone])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind), pa.array(digests)], names=["of", "spans", "kept_sha256"])

    removed = touched.select("text_key", "text").join(lists, "text_key").select("text_key", "text", "found").mapInArrow(
        cut, "of bigint, spans array<struct<start:bigint,end:bigint>>, kept_sha256 string")
    joined = rows.join(copies, "text_key").join(removed, F.col("text_key") == F.col("of"), "left")
    copied = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    gone = copied & ~F.col("trial_id").eqNullSafe(F.col("place")) if keep_first else copied
    everything = F.array(F.struct(F.lit(0).cast("bigint").alias("start"), F.col("n_bytes").alias("end")))
    nothing = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return joined.select(
        "trial_id", "n_bytes", F.when(gone, everything).otherwise(F.coalesce("spans", nothing)).alias("spans"),
        F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "text_sha256")).alias("kept_sha256"))
