"""SimHash near-duplicates of trace texts, found by Golay-code fuzzy hashing."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import discard, settle
from .components import connected_components
from .records import whole_text

#: Differing bits up to which no link is lost.
MAX_BITS = 3
#: Fingerprints of one bucket that one task compares; larger buckets are dealt out in pairs of blocks.
BUCKET = 20_000
#: Neighbours in a bucket that are compared by shifting; longer runs are searched breadth first.
SHIFTS = 48
#: Texts, and share of their shingles, that tell which shingles are common.
SAMPLE, COMMON = 20_000, 1e-6
#: Members of each bucket that are verified against all others in the first round.
LEADERS = 2
#: Differing signature bits of pairs that are verified: 12.8 are the mean at a similarity of 0.8, this is 7.4 deviations more.
MOST_BITS = 38
#: Ids (8 bytes each, 16 with what a hash table adds) that are broadcast instead of moving texts; more meet in a shuffle.
BROADCAST_IDS = 1_000_000
#: Odd multipliers of the 128 minima.
MIXERS = np.random.default_rng(128).integers(0, 1 << 63, 128, np.int64).view(np.uint64) * np.uint64(2) + np.uint64(1)

# fixed values: the binary Golay code [23, 12, 7] and its generator polynomial x^11+x^10+x^6+x^5+x^4+x^2+1
LENGTH, MESSAGE, GENERATOR = 23, 12, 0b110001110101
#: Bits of the three segments of a fingerprint, the lowest first.
SEGMENTS = (23, 23, 18)


def golay_remainders(words: np.ndarray) -> np.ndarray:
    """Remainder of each 23-bit word modulo the generator: its 11-bit syndrome."""
    words = words.copy()
    for bit in range(LENGTH - 1, LENGTH - MESSAGE - 1, -1):
        words ^= np.where(words >> bit & 1, GENERATOR << (bit - (LENGTH - MESSAGE)), 0)
    return words


class GolayDecoder:
    """Decodes 23-bit words to the 12-bit index of the nearest codeword.

    The code is perfect: every word lies within 3 bits of exactly one codeword, so the 2048 syndromes name the 2048
    error patterns of up to 3 bits.
    """

    def __init__(self):
        bits = 1 << np.arange(LENGTH)
        two = (bits[:, None] | bits)[np.triu_indices(LENGTH, 1)]
        three = np.unique((two[:, None] | bits).ravel())
        errors = np.concatenate([[0], bits, two, three[np.bitwise_count(three) == 3]])
        self.errors = np.zeros(1 << (LENGTH - MESSAGE), np.int64)
        self.errors[golay_remainders(errors)] = errors
        half = np.arange(1 << MESSAGE)
        self.low, self.high = golay_remainders(half), golay_remainders(half[: 1 << (LENGTH - MESSAGE)] << MESSAGE)

    def __call__(self, words: np.ndarray) -> np.ndarray:
        syndrome = self.low[words & ((1 << MESSAGE) - 1)] ^ self.high[words >> MESSAGE]
        return (words ^ self.errors[syndrome]) >> (LENGTH - MESSAGE)

    def nearby(self, words: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the codewords that a word and its neighbours at one bit decode to, and which of them are new.

        One index for a word within 2 bits of its codeword, else at most six; words that differ in up to two bits
        share one.
        """
        flips = np.concatenate([[0], 1 << np.arange(bits)])
        index = np.sort(self(words[:, None] ^ flips), axis=1)
        return index, np.diff(index, axis=1, prepend=-1) != 0


def segments_of(prints: np.ndarray) -> list[np.ndarray]:
    bits, shift = prints.view(np.uint64), np.concatenate([[0], np.cumsum(SEGMENTS)[:-1]])
    return [(bits >> np.uint64(s) & np.uint64((1 << n) - 1)).astype(np.int64) for s, n in zip(shift, SEGMENTS)]


def index_pairs(first: tuple[np.ndarray, np.ndarray], second: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(row, index of the first * 4096 + index of the second) for all nearby indices of two segments."""
    many = second[1].sum(axis=1)
    row1, at1 = np.nonzero(first[1])
    row2, at2 = np.nonzero(second[1])
    begin = np.cumsum(many) - many
    counts = many[row1]
    left = np.repeat(np.arange(len(row1)), counts)
    right = begin[row1[left]] + np.arange(len(left)) - np.repeat(np.cumsum(counts) - counts, counts)
    return row1[left], first[0][row1[left], at1[left]] << MESSAGE | second[0][row2[right], at2[right]]


def bucket_keys(prints: np.ndarray, golay: GolayDecoder) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) such that prints within 3 bits of each other share a key.

    With e1, e2, e3 differing bits in the segments: where e1 and e2 are 1 at most, the nearby indices of both segments
    meet (family 0).  Otherwise one of them has 2 or more, so the other and the third have 1 together: one of these two is
    equal and the nearby indices of the other meet (families 1 to 4).
    """
    one, two, three = segments_of(prints)
    near = [golay.nearby(w, n) for w, n in zip((one, two, three), SEGMENTS)]
    row, key = index_pairs(near[0], near[1])
    rows, keys = [row], [key]

    def add(family: int, exact: np.ndarray, fuzzy: int) -> None:
        index, new = near[fuzzy]
        row, at = np.nonzero(new)
        rows.append(row)
        keys.append(family << 60 | exact[row] << MESSAGE | index[row, at])

    add(1, two, 2)
    add(2, three, 1)
    add(3, one, 2)
    add(4, three, 0)
    return np.concatenate(rows), np.concatenate(keys)


def shingle_hashes(text: str, shingle: int, seed: int = 42) -> np.ndarray:
    """XXH64 of the word shingles of a text, lower case in A-Z, single blanks; fewer words make one shingle."""
    import xxhash

    words = text.encode().lower().split()  # on bytes both know ASCII only
    if not words:
        return np.empty(0, np.uint64)
    line, size = b" ".join(words), min(shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - size + 1]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], seed) for a, b in zip(starts.tolist(), ends[size - 1:].tolist())], np.uint64)


def majority_bits(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have set, as a signed 64-bit number."""
    ones = np.zeros(64, np.int64)
    for part in range(0, len(hashes), 1 << 14):
        block = hashes[part:part + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def trace_fingerprints(traces: DataFrame, shingle: int) -> DataFrame:
    """``trial_id, print``: the fingerprint of each whole text as a signed 64-bit number, 0 without words."""
    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [majority_bits(shingle_hashes(text, shingle)) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int64())], names=["trial_id", "print"])

    key = traces.schema["trial_id"].dataType.simpleString()
    return traces.select("trial_id", whole_text().alias("text")).mapInArrow(prints, f"trial_id {key}, print bigint")


def _root(parent: dict, x: int) -> int:
    while (up := parent.setdefault(x, x)) != x:
        parent[x] = x = parent[up]
    return x


def differing_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64))  # of signed numbers it would count the absolute value's


def shifted_pairs(keys: np.ndarray, prints: np.ndarray, bits: int, shifts: int) -> list[tuple[int, int]]:
    """Pairs of equal keys, less than ``shifts`` rows apart, whose prints differ in at most ``bits`` bits."""
    pairs = []
    for d in range(1, shifts):
        same = np.flatnonzero(keys[d:] == keys[:-d])
        if not len(same):
            break
        same = same[differing_bits(prints[same], prints[same + d]) <= bits]
        pairs += zip(prints[same].tolist(), prints[same + d].tolist())
    return pairs


def spanning_forest(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    parent, out = {}, []
    for a, b in pairs:
        if (x := _root(parent, a)) != (y := _root(parent, b)):
            parent[x] = y
            out.append((a, b))
    return out


def long_run_links(prints: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """A spanning forest of the links inside one bucket, searched breadth first over what is not reached yet."""
    rest, out = prints, []
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            at = front.pop()
            near = differing_bits(rest, at) <= bits
            if near.any():
                out += [(int(at), int(x)) for x in rest[near]]
                front += list(rest[near])
                rest = rest[~near]
    return out


def bucket_links(keyed: DataFrame, limit: int | None, bits: int, every: int) -> DataFrame:
    """Links ``a, b`` inside the buckets of ``key, print``; buckets above the limit come back as ``key, a``.

    A spanning forest of each bucket, and all links less than ``every`` rows apart.
    """
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(links: list, key=None) -> pa.RecordBatch:
            a, b = [x[0] for x in links], [x[1] for x in links]
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in ([key] * len(a), a, b)], names=["key", "a", "b"])

        held_key, held, dealt = None, [], 0

        def finish() -> Iterator[pa.RecordBatch]:
            nonlocal held, dealt
            run = np.concatenate(held)
            if dealt:
                yield told([(x, None) for x in run.tolist()], held_key)
            else:
                yield told(long_run_links(run, bits) + shifted_pairs(np.zeros(len(run)), run, bits, every))
            held, dealt = [], 0

        for batch in batches:
            keys, prints = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            starts = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1)) if len(keys) else np.empty(0, int)
            if not len(starts):
                continue
            ends = np.append(starts[1:], len(keys))
            # the first run may go on from the batch before, the last one may go on in the next
            short = np.ones(len(keys), bool)
            for i in {0, len(starts) - 1} | set(np.flatnonzero(ends - starts >= SHIFTS).tolist()):
                short[starts[i]:ends[i]] = False
            pairs = shifted_pairs(keys[short], prints[short], bits, SHIFTS)
            yield told(spanning_forest(pairs) + shifted_pairs(keys[short], prints[short], bits, every))
            for i in sorted({0, len(starts) - 1} | set(np.flatnonzero(ends - starts >= SHIFTS).tolist())):
                if held and held_key != keys[starts[i]]:
                    yield from finish()
                held_key = int(keys[starts[i]])
                held.append(prints[starts[i]:ends[i]])
                if limit and sum(map(len, held)) > limit:  # too many for one task: hand them on
                    yield told([(x, None) for x in np.concatenate(held).tolist()], held_key)
                    held, dealt = [prints[:0]], 1
        if held:
            yield from finish()

    ordered = keyed.repartition("key").sortWithinPartitions("key", "print")
    return ordered.mapInArrow(search, "key bigint, a bigint, b bigint")


def print_links(prints: DataFrame, keys=bucket_keys, bits: int = MAX_BITS, every: int = 0) -> DataFrame:
    """Links ``a, b`` between distinct fingerprints (``print``) that share a key and differ in at most ``bits`` bits; enough
    of them to connect all that any such pair connects, or more (``bucket_links``)."""
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        golay = GolayDecoder()
        for batch in batches:
            values = batch.column(0).to_numpy()
            for part in range(0, len(values), 2000):
                some = values[part:part + 2000]
                row, key = keys(some, golay)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(some[row])], names=["key", "print"])

    keyed = prints.select("print").mapInArrow(spread, "key bigint, print bigint")
    found = settle(bucket_links(keyed, BUCKET, bits, every), "links")
    large = found.where("b IS NULL").select("key", F.col("a").alias("print"))
    blocks = large.groupBy("key").agg(F.ceil(2 * F.count("*") / BUCKET).alias("blocks"))
    large = large.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("print"), "blocks"))
    large = large.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    # two blocks meet in one bucket of their own
    large = large.select(F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("key"), "print")
    return found.where("b IS NOT NULL").select("a", "b").unionByName(bucket_links(large, None, bits, every).select("a", "b")).distinct()


def print_components(rows: DataFrame) -> DataFrame:
    """``print, component_id`` for the fingerprints of ``rows`` (``trial_id, print``)."""
    classes = settle(rows.groupBy("print").agg(F.min("trial_id").alias("first")), "classes")
    components = connected_components(print_links(classes))
    named = settle(classes.join(components, F.col("print") == F.col("node"), "left").select(
        "print", "first", F.coalesce("component", "print").alias("component")), "named")
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    return named.join(least, "component").select("print", "component_id")


def simhash_dedup(traces: DataFrame, shingle: int = 3) -> DataFrame:
    """Groups of traces whose SimHash fingerprints are linked by 3 or fewer differing bits, directly or through others.

    Texts are lower-cased in A-Z and cut into words; shingles of ``shingle`` words, repeats included, vote with the bits of
    their XXH64 (seed 42) on the 64 bits of the fingerprint.  A text with fewer words is one shingle; without words it has
    fingerprint zero, which is linked like any other.  Null text is empty.

    Links are found by fuzzy hashing with the perfect Golay code: each segment of a fingerprint is decoded to the indices
    of the codewords nearby, pairs of segments make the keys (``bucket_keys``), and what meets in a bucket is compared bit
    by bit.  Only distinct fingerprints are compared.  A bucket gives a spanning forest of its links instead of all pairs,
    so a group of thousands of near copies gives as many links as it has members; buckets above ``BUCKET`` fingerprints
    are dealt out to tasks in pairs of blocks.  No link is lost.

    Returns one row per input row: ``trial_id, fingerprint`` (16 hexadecimal digits), ``component_id`` (smallest
    ``trial_id`` reachable, itself included; null ids count only where a group has no other).  An empty table gives an
    empty result.
    """
    rows = settle(trace_fingerprints(traces, shingle), "prints")
    return rows.join(print_components(rows), "print").select(
        "trial_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


def set_hashes(text: str, shingle: int) -> np.ndarray:
    """The set of a text's shingles, as signed 64-bit numbers; without words the one member zero."""
    hashes = np.unique(shingle_hashes(text, shingle)).view(np.int64)
    return hashes if len(hashes) else np.zeros(1, np.int64)


def sampled_ranks(named: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Common shingles (ordered) and how many texts of a sample hold each.

    They only say which shingles come last in the order of ``rare_prefixes``; no result depends on them.  At most 1 / ``COMMON``
    reach the driver.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [set_hashes(text, shingle) for text in batch.column(0).to_pylist()]
            if sets:
                token, n = np.unique(np.concatenate(sets), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(n, pa.int64())], names=["token", "n"])

    every = -(-named.count() // SAMPLE)
    some = named.where(F.pmod(F.xxhash64("trial_id"), F.lit(max(every, 1))) == 0).select(whole_text().alias("text"))
    counts = settle(some.mapInArrow(count, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n")), "sampled")
    total = counts.agg(F.sum("n")).first()[0] or 0
    common = counts.where(F.col("n") >= max(2, COMMON * total)).toPandas().sort_values("token")
    return common["token"].to_numpy(np.int64), common["n"].to_numpy(np.int64)


def set_signature(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits, one of each of 128 minima of the set: those of two sets differ in a share of (1 - similarity) / 2."""
    least = np.full(len(MIXERS), np.iinfo(np.uint64).max)
    for part in range(0, len(hashes), 4096):
        least = np.minimum(least, (hashes[part:part + 4096].view(np.uint64)[:, None] * MIXERS).min(axis=0))
    bits = np.packbits((least >> np.uint64(9) & np.uint64(1)).astype(np.uint8)).view(np.int64)
    return int(bits[0]), int(bits[1])


def alike(one: str, other: str) -> Column:
    """Whether signatures (``{one}low``, ``{one}high``) are near enough for similar sets, at 0.8 but for one in 10^13."""
    return F.bit_count(F.col(f"{one}low").bitwiseXOR(F.col(f"{other}low"))) + F.bit_count(
        F.col(f"{one}high").bitwiseXOR(F.col(f"{other}high"))) <= MOST_BITS


def rare_prefixes(named: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """``token, id, size, at``: the first shingles of each text's set in one order of all shingles, rare ones first.

    Sets of that Jaccard similarity share ``similarity`` of the larger one at least, so the first
    size - ceil(similarity * size) + 1 shingles of both have one in common, whatever the order is.  ``at`` is the place
    in the order, ``size`` the number of shingles.
    """
    ranks = named.sparkSession.sparkContext.broadcast(sampled_ranks(named, shingle))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, seen = ranks.value
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                ids, texts = (batch.column(k).slice(first, 500) for k in (0, 1))
                found, sizes = [], []
                for text in texts.to_pylist():
                    hashes = set_hashes(text, shingle)
                    rank = np.zeros(len(hashes), np.int64)
                    if len(common):
                        near = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
                        rank = np.where(common[near] == hashes, seen[near], 0)
                    keep = len(hashes) - math.ceil(similarity * len(hashes) - 1e-6) + 1
                    found.append(hashes[np.lexsort((hashes, rank))[:keep]])
                    sizes.append(len(hashes))
                counts = np.fromiter(map(len, found), np.int64, len(found))
                row = np.repeat(np.arange(len(found)), counts)
                at = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(found)), ids.take(pa.array(row)), pa.array(np.array(sizes, np.int32)[row]), pa.array(at.astype(np.int32))],
                    names=["token", "id", "size", "at"])

    key = named.schema["id"].dataType.simpleString()
    return named.select("id", "text").mapInArrow(cut, f"token bigint, id {key}, size int, at int")


def signatures(named: DataFrame, shingle: int) -> DataFrame:
    """``id, low, high`` of every text."""
    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [set_signature(set_hashes(text.as_py(), shingle)) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)]], names=["id", "low", "high"])

    return named.select("id", "text").mapInArrow(signed, f"id {named.schema['id'].dataType.simpleString()}, low bigint, high bigint")


def rows_of(named: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of the texts with these distinct ids; no text is moved for ids of a proven small size."""
    return named.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "id", "left_semi")


def similar_pairs(pairs: DataFrame, named: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """``a, b, same``: whether the sets of shingles of the texts of a pair are that similar; hashed again from the texts."""
    key = named.schema["id"].dataType.simpleString()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [set_hashes(text.as_py(), shingle) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["id", "shingles"])

    ids = settle(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct(), "pair-ids")
    sets = settle(rows_of(named, ids).select("id", "text").mapInArrow(hashed, f"id {key}, shingles array<bigint>"), "sets")
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("first")), "a").join(
        sets.select(F.col("id").alias("b"), F.col("shingles").alias("second")), "b")
    shared = F.size(F.array_intersect("first", "second"))
    union = F.size("first") + F.size("second") - shared
    told = settle(both.groupBy("a", "b").agg(F.max(shared >= similarity * union).alias("same")), "verified")
    discard(ids, sets)
    return told


def led_pairs(members: DataFrame, leaders: DataFrame, similarity: float) -> DataFrame:
    """``id, a, b``: each leader with the members (``id``) of its bucket that are of another component and can be similar to it.

    The first shared shingle of two sets leaves no more shared ones than the shorter rest; in the bucket of that shingle
    no similar pair is passed over, so it may be in the buckets of later ones.  Signatures tell most of the others apart.
    """
    lead = leaders.select("token", *[F.col(c).alias(f"lead_{c}") for c in ("id", "size", "at", "component", "low", "high")])
    enough = similarity / (1 + similarity) * (F.col("size") + F.col("lead_size")) - 1e-6
    rest = F.least(F.col("size") - F.col("at"), F.col("lead_size") - F.col("lead_at"))
    can = (rest >= enough) & alike("", "lead_")
    met = members.join(lead, (members["token"] == lead["token"]) & (F.col("component") != F.col("lead_component")) & can)
    return met.select("id", F.least("id", "lead_id").alias("a"), F.greatest("id", "lead_id").alias("b")).distinct()


def one_each(pairs: DataFrame) -> DataFrame:
    """Of the pairs (``id, a, b``) of a member one: that with the leader whose hash is least, so that members agree on leaders."""
    other = F.when(F.col("a") == F.col("id"), F.col("b")).otherwise(F.col("a"))
    return pairs.groupBy("id").agg(F.min(F.struct(F.xxhash64(other).alias("at"), "a", "b")).alias("pair")).select("pair.a", "pair.b").distinct()


def verified_links(buckets: DataFrame, named: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """``node, component`` of what the similar pairs inside the buckets (``token, id, size, at, low, high``) connect.

    In rounds: some members of each bucket lead and are verified against the others, each member first against one of all its
    leaders, then against those that are still of another component.  The next leaders are members that are linked by now and
    have not led, then those refuted.  A bucket is left when those that have not led are all of one component; until then each
    pair of different components that can be similar is verified.  Each round has eight times the leaders, so rounds grow with
    the logarithm of the largest bucket.  A group of near copies gives about a link for each member, in however many buckets
    its members meet, and links that are known are handed on as a star of each component.  Tables of a round are deleted when
    the next one no longer reads them.
    """
    columns = ["token", "id", "size", "at", "low", "high"]
    leaders, refuted, groups = LEADERS, None, None
    left = buckets.withColumn("component", F.col("id")).withColumn("linked", F.lit(False))

    def placed(rows: DataFrame, label: str) -> DataFrame:
        return settle(rows.select(columns).join(groups, F.col("id") == F.col("node"), "left").select(
            *columns, F.coalesce("component", "id").alias("component"), F.col("node").isNotNull().alias("linked")), label)

    def verify(pairs: DataFrame, first: bool) -> None:
        nonlocal refuted, groups
        pairs = pairs if refuted is None else pairs.join(refuted, ["a", "b"], "left_anti")
        candidates = settle(one_each(pairs) if first else pairs.select("a", "b").distinct(), "candidates")
        told = similar_pairs(candidates, named, shingle, similarity)
        same, other = told.where("same").select("a", "b"), told.where("NOT same").select("a", "b")
        before = refuted
        stars = None if groups is None else groups.select(F.col("node").alias("a"), F.col("component").alias("b"))
        links = settle(same if stars is None else stars.unionByName(same), "links")
        refuted = settle(other if refuted is None else refuted.unionByName(other), "refuted")
        groups = connected_components(links)
        discard(before, candidates, told, links)

    while True:
        # members of one group choose the same leaders in all their buckets
        order = Window.partitionBy("token").orderBy(F.desc("linked"), F.xxhash64("id"), "id")
        lead = settle(left.withColumn("place", F.row_number().over(order)).where(F.col("place") <= leaders).drop("place"), "leaders")
        verify(led_pairs(left, lead, similarity), True)
        met, led = placed(left, "met"), placed(lead, "led")
        discard(lead, left)
        verify(led_pairs(met, led, similarity), False)
        known = placed(met.join(led.select("token", "id"), ["token", "id"], "left_anti"), "known")
        discard(met, led)
        apart = known.groupBy("token").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most")
        left = settle(known.join(apart.select("token"), "token"), "left")
        discard(known)
        if left.isEmpty():
            discard(refuted, left)
            return groups
        leaders *= 8


def near_copies(traces: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """For every trace the one that stays for it: the smallest ``trial_id`` of its group, itself included.

    Traces are linked when their sets of ``shingle`` words have a Jaccard similarity of ``similarity`` or more; groups are
    what such links connect.  Candidates come from an exact join on the rarest shingles of each set (``rare_prefixes``), and
    verification on the two texts decides every link (``verified_links``), in groups of any size.  Before that, signatures
    of 128 minima drop pairs that are far apart; they lose a pair of the similarity 0.8 once in 10^13.

    Returns ``trial_id, stays_for`` per distinct ``trial_id`` (null ids left out); texts without words are alike.  Null text
    is empty.  Rows that repeat a ``trial_id`` with another text are one trace, linked through each of its texts.  An empty
    table gives an empty result.  Inside, traces are told by a 64-bit hash of the ``trial_id``; should two of them share
    one, by the ``trial_id`` itself.
    """
    named = traces.where("trial_id IS NOT NULL").select("trial_id", F.xxhash64("trial_id").alias("id"), whole_text().alias("text"))
    ids = settle(named.select("trial_id", "id").distinct(), "ids")
    if not ids.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        named = named.withColumn("id", F.col("trial_id"))
        ids = ids.withColumn("id", F.col("trial_id"))
    met = rare_prefixes(named, shingle, similarity).withColumn("met", F.count("*").over(Window.partitionBy("token")))
    shared = settle(met.where("met > 1").drop("met"), "shared")
    signed = settle(signatures(rows_of(named, settle(shared.select("id").distinct(), "members")), shingle), "signatures")
    # bit for bit equal signatures of one id are one; other texts of an id stand beside it
    buckets = settle(shared.join(signed.distinct(), "id").select("token", "id", "size", "at", "low", "high"), "buckets")
    discard(shared, signed)
    groups = verified_links(buckets, named, shingle, similarity)
    placed = ids.join(groups, F.col("id") == F.col("node"), "left").select("trial_id", F.coalesce("component", "id").alias("component"))
    placed = settle(placed, "placed")
    least = placed.groupBy("component").agg(F.min("trial_id").alias("stays_for"))
    return placed.join(least, "component").select("trial_id", "stays_for")
