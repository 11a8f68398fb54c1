"""Each operator against a plain version of its definition, on records with every odd case."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash

from traceframe.llm import mixing, packing, sharding, simhash_dedup, suffix_dedup
from traceframe.llm.exact_dedup import exact_dedup
from traceframe.llm.line_dedup import remove_spread_lines
from traceframe.llm.lm_scoring import score_cross_entropy
from traceframe.llm.quality_classifier import FEATURES, score_quality, text_features
from traceframe.llm.quality_rules import quality_rules

SCHEMA = "trial_id bigint, text string, condition_id string, family string, size string, part string, start string, text_key string"


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}{rng.choice(['', '', ',', '.'])}" for _ in range(n))


@pytest.fixture(scope="session")
def records():
    """Trace records with every odd case: null and empty texts, null ids and conditions, repeated rows, copies, near copies,
    very long texts, shared passages and lines, and columns named like the operators' own."""
    rng = random.Random(5)
    base = [prose(rng, rng.randrange(5, 160)) for _ in range(60)]
    shared, line = prose(rng, 90), "Terms of the shared run apply."
    texts = base + [None, "", " \n\t ", "one", "Éa ß É　x", "a\n\nb\na\n", "rep rep " * 300, prose(rng, 9000, 40)]
    texts += [base[0]] * 4 + [base[1] + " end"] + [f"{prose(rng, 12)}\n{line}\n{shared} {i}" for i in range(14)]
    texts += [" ".join(("zz" if i == 40 else w) for i, w in enumerate(base[2].split())) + " " + shared]
    rows = [(i * 7 % 1009, t, None if i % 17 == 3 else f"cond{i % 5 if i % 3 else 0}", "arith", "x", "y", "z", "k") for i, t in enumerate(texts)]
    rows += [(None, "no id " + shared, "cond1", None, None, None, None, None), (5000, base[3], "cond2", None, None, None, None, None)]
    return rows + [rows[0], rows[0], rows[60]]


@pytest.fixture(scope="session")
def traces(spark, records):
    return spark.createDataFrame(records, SCHEMA).repartition(5, "size")


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def raw(t):
    return (t or "").encode()


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def bag(rows):
    return Counter(map(repr, rows))


def got(df, *columns):
    return Counter(repr(tuple(r[c] for c in columns)) for r in df.collect())


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_dedup(traces, records, keep):
    groups = defaultdict(list)
    for r in records:
        groups[r[1] or ""].append(r[0])
    pick = {t: (min if keep == "smallest" else max)([i for i in ids if i is not None], default=None) for t, ids in groups.items()}
    want = bag((r[0], pick[r[1] or ""], len(groups[r[1] or ""]), r[0] == pick[r[1] or ""], hashlib.sha256(raw(r[1])).hexdigest()) for r in records)
    assert got(exact_dedup(traces, keep, fan_in=2), "trial_id", "keep_id", "group_size", "kept", "text_sha256") == want


def test_runs_are_merged_across_batches(spark):
    """One text fills a third of many small batches; identifiers are structs with nulls."""
    texts = [("copy" if i % 3 == 0 else f"t{i % 50}", None if i % 11 == 0 else i) for i in range(700)]
    df = spark.createDataFrame(texts, "text string, i int").selectExpr("text", "struct(i, 1 AS k) AS trial_id").repartition(9)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        rows = exact_dedup(df, "largest", fan_in=2).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    sizes = Counter(t for t, _ in texts)
    most = {t: max(i for x, i in texts if x == t and i is not None) for t in sizes}
    digests = {hashlib.sha256(t.encode()).hexdigest(): t for t in sizes}
    assert len(rows) == 700 and all((r.group_size, r.keep_id.i) == (sizes[digests[r.text_sha256]], most[digests[r.text_sha256]]) for r in rows)


@pytest.mark.parametrize("limit", [50_000, 3])
@pytest.mark.parametrize("keep_first", [False, True])
def test_remove_repeats(traces, records, keep_first, limit, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "GRAM_CONTEXTS", limit)
    length = 60
    first = {}
    for r in records:
        first.setdefault(r[1] or "", []).append(r[0])
    place = {t: min((i for i in ids if i is not None), default=None) for t, ids in first.items()}
    seen = defaultdict(list)
    for t, p in place.items():
        b = raw(t)
        for i in range(len(b) - length + 1):
            seen[b[i:i + length]].append((p is not None, p or 0, t, i))
    want = []
    for r in records:
        t, b = r[1] or "", raw(r[1])
        gone = np.zeros(len(b), bool)
        copied = len(first[t]) > 1 and len(b) >= length
        for i in range(len(b) - length + 1):
            places = seen[b[i:i + length]]
            hit = any(p < (place[t] is not None, place[t] or 0, t, i) for p in places) if keep_first else len(places) > 1
            if hit or (copied and (not keep_first or r[0] != place[t])):
                gone[i:i + length] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]]))).reshape(-1, 2).tolist()
        want.append((r[0], len(b), [tuple(e) for e in edges], hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    rows = suffix_dedup.remove_repeats(traces, length, keep_first).collect()
    assert bag((r.trial_id, r.n_bytes, [tuple(s) for s in r.spans], r.kept_sha256) for r in rows) == bag(want)


def test_anchor_blocks_agree(monkeypatch):
    rng = np.random.default_rng(1)
    text = rng.integers(97, 100, 5000, np.uint8).tobytes()
    whole = suffix_dedup.AnchorFinder(60)(text)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 700)
    parts = suffix_dedup.AnchorFinder(60)(text)
    assert set(whole[0].tolist()) <= set(parts[0].tolist())
    assert len(whole[0]) and len(text) > 0


def fingerprint(t):
    w = raw(t).lower().split()
    if not w:
        return 0
    grams = [b" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, bits=3):
    parent = {p: p for p in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    some = sorted(parent)
    for i, a in enumerate(some):
        for b in some[:i]:
            if (a ^ b).bit_count() <= bits:
                parent[root(a)] = root(b)
    return {p: root(p) for p in parent}


def test_simhash_dedup(traces, records):
    prints = {r[1]: fingerprint(r[1]) for r in records}
    root = components(set(prints.values()))
    least = {}
    for r in records:
        if r[0] is not None:
            least[root[prints[r[1]]]] = min(least.get(root[prints[r[1]]], r[0]), r[0])
    want = bag((r[0], f"{prints[r[1]]:016x}", least.get(root[prints[r[1]]])) for r in records)
    assert got(simhash_dedup.simhash_dedup(traces), "trial_id", "fingerprint", "component_id") == want


@pytest.mark.parametrize("limit,shifts", [(20_000, 48), (20, 4)])
def test_print_links_lose_none(spark, limit, shifts, monkeypatch):
    monkeypatch.setattr(simhash_dedup, "BUCKET", limit)
    monkeypatch.setattr(simhash_dedup, "SHIFTS", shifts)
    rng = np.random.default_rng(3)
    prints = {0}
    for c in rng.integers(0, 1 << 63, 12, np.uint64).tolist():
        for _ in range(40):
            c ^= sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 6), replace=False))
            prints.add(c)
    signed = {p: p - (1 << 64) if p >> 63 else p for p in prints}
    df = spark.createDataFrame([(s,) for s in signed.values()], "print bigint").repartition(3)
    links = simhash_dedup.print_links(df).collect()
    assert all(((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 3 for r in links)
    root = components(prints)
    parent = {s: s for s in signed.values()}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in links:
        parent[top(r.a)] = top(r.b)
    for p in prints:
        for q in prints:
            assert (root[p] == root[q]) == (top(signed[p]) == top(signed[q]))


def test_golay_decoder_is_perfect():
    golay = simhash_dedup.GolayDecoder()
    some = np.random.default_rng(0).integers(0, 1 << 23, 500)
    index, new = golay.nearby(some, 23)
    assert set(new.sum(axis=1)) == {1, 6}
    for _ in range(3):
        flips = (1 << np.random.default_rng(1).integers(0, 23, (2, 500))).sum(axis=0) if _ else np.zeros(500, int)
        other, _ = golay.nearby(some ^ flips & ((1 << 23) - 1), 23)
        near = np.bitwise_count(flips & ((1 << 23) - 1)) <= 2
        assert all(set(a) & set(b) for a, b, n in zip(index.tolist(), other.tolist(), near) if n)


def test_near_copies(traces, records, spark):
    def shingles(t):
        w = raw(t).lower().split()
        return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    texts = {}
    for r in records:
        if r[0] is not None:
            texts.setdefault(r[0], r[1])
    rows = simhash_dedup.near_copies(traces).collect()
    stays = {r.trial_id: r.stays_for for r in rows}
    assert sorted(r.trial_id for r in rows) == sorted(texts)
    sets = {i: shingles(t) for i, t in texts.items()}
    similar = {(i, j) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert all(stays[i] == stays[j] for i, j in similar)
    linked = {x for p in similar for x in p}
    assert similar and all(s == min(i for i in stays if stays[i] == s) and (t == s or t in linked) for t, s in stays.items())
    original = " ".join(f"t{i}" for i in range(200))
    copies = [(i, original.replace(f"t{50 + i} ", "new ")) for i in range(30)] + [(99, "unrelated " + " ".join(f"u{i}" for i in range(200)))]
    rows = simhash_dedup.near_copies(spark.createDataFrame(copies, "trial_id bigint, text string")).collect()
    assert {r.trial_id for r in rows if r.trial_id == r.stays_for} == {0, 99}


def jaccard_groups(texts):
    """The smallest id of each group that 5-word Jaccard similarities of 0.8 connect, by brute force."""
    sets = {i: {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} for i, t in texts.items() for w in [t.split()]}
    label = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if i < j and label[i] != label[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                low, high = sorted((label[i], label[j]))
                label = {k: low if v == high else v for k, v in label.items()}
    return label


def near_labels(spark, texts):
    df = spark.createDataFrame(list(texts.items()), "trial_id bigint, text string").repartition(4)
    return {r.trial_id: r.stays_for for r in simhash_dedup.near_copies(df).collect()}


def test_near_copies_of_star_groups(spark):
    """Originals in the middle of copies that are no near copies of each other, beside a dense group and strangers that share a passage."""
    rng, texts = random.Random(11), {}
    passage = [f"p{i}" for i in range(100)]
    for star in range(3):
        original = [f"s{star}x{i}" for i in range(200)]
        rows = [original]
        for c in range(40):
            edited = list(original)
            for at in range(4):
                edited[rng.randrange(50 * at, 50 * at + 45)] = f"e{star}x{c}x{at}"
            rows.append(edited)
        rng.shuffle(rows)
        texts |= {1000 * star + i: " ".join(r) for i, r in enumerate(rows)}
    texts |= {5000 + i: " ".join(passage + [f"n{i}x{k}" for k in range(12 + i)]) for i in range(40)}
    want = jaccard_groups(texts)
    assert [want[1000 * s + i] for s in range(3) for i in range(41)] == [1000 * s for s in range(3) for _ in range(41)]
    assert 1 < len({want[5000 + i] for i in range(40)})
    assert near_labels(spark, texts) == want


def test_links_of_near_copies_grow_with_the_members(spark, monkeypatch):
    """Members of a group meet in many buckets of unlike members; each is linked about once all the same."""
    rng, sent = random.Random(5), []
    common = [f"w{k}" for k in range(150)]
    texts = [" ".join(f"x{n}-{k}" if k in changed else w for k, w in enumerate(common)) for n in range(200)
             for changed in [set(rng.sample(range(150), 2))]]

    def counted(links):
        sent.append(links.where("a <> b").distinct().count())
        return components(links)

    components = simhash_dedup.connected_components
    monkeypatch.setattr(simhash_dedup, "connected_components", counted)
    stays = near_labels(spark, dict(enumerate(texts)))
    assert set(stays.values()) == {0} and len(stays) == 200
    assert max(sent) <= 2 * 200, sent


def test_near_copies_recall_at_the_limit(spark):
    """Isolated pairs just above and just below 0.8: text appended, cut off, or a block replaced; none may be missed."""
    rng, texts, above = random.Random(12), {}, 0
    for k in range(600):
        n = rng.randrange(60, 400)
        base = [f"b{k}x{i}" for i in range(n)]
        part = round(n * rng.uniform(0.12, 0.27))
        half = part // 2
        start = rng.randrange(n - half)
        new = [f"c{k}x{i}" for i in range(part)]
        other = [base + new, base[:n - part], base[:start] + new[:half] + base[start + half:]][k % 3]
        texts[2 * k], texts[2 * k + 1] = " ".join(base), " ".join(other)
    want = {}
    for k in range(600):
        pair = jaccard_groups({i: texts[i] for i in (2 * k, 2 * k + 1)})
        above += pair[2 * k + 1] == 2 * k
        want |= pair
    assert 150 < above < 550
    assert near_labels(spark, texts) == want


def test_quality_rules(traces, records):
    texts = defaultdict(set)
    for r in records:
        texts[r[2]].add(r[1] or "")

    def lines(t):
        return [x for x in (" ".join(words(x.lower())) for x in t.split("\n")) if x]

    limit, over = 3, {}
    for c, group in texts.items():
        spread = Counter(x for t in group for x in set(lines(t)))
        over[c] = {x for x, n in spread.items() if n > limit}
    assert any(over.values())
    want = []
    for r in records:
        t, w = r[1] or "", words(r[1])
        grams = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
        covered = {j for i in range(len(w) - 4) if grams[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
        with_word = [x for x in t.split("\n") if words(x)]
        removed = sum(len(x.split()) for x in lines(t) if x in over[r[2]])
        failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
        want.append((r[0], len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(with_word) - len(set(with_word)), len(covered), failed,
                     not failed and len(w) - removed >= 10, removed))
    rows = quality_rules(traces, max_traces=limit)
    assert got(rows, "trial_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words") == bag(want)


def test_line_limit_does_not_grow_with_the_host(spark):
    """Stub pages of four shared lines are rejected, a notice is removed, in a small and in a large host alike."""
    notice = " ".join(f"n{i}" for i in range(12))
    shared = [" ".join(f"s{k}x{i}" for i in range(10)) for k in range(4)]
    for ordinary in (500, 9000):
        pages = [(i, "\n".join([*shared, " ".join(f"own{i}x{k}" for k in range(8))]), "h") for i in range(1000)]
        pages += [(10_000 + i, " ".join(f"t{i}x{k}" for k in range(30)) + ("\n" + notice if i < 90 else ""), "h") for i in range(ordinary)]
        out = {r.trial_id: r for r in quality_rules(spark.createDataFrame(pages, "trial_id int, text string, condition_id string")).collect()}
        assert not any(out[i].kept for i in range(1000)) and all(out[10_000 + i].kept for i in range(ordinary))
        assert {out[i].removed_words for i in range(1000)} == {40} and sum(out[10_000 + i].removed_words == 12 for i in range(ordinary)) == 90


def test_remove_spread_lines(traces, records):
    spread = defaultdict(set)
    for r in records:
        for x in (r[1] or "").split("\n"):
            if n := " ".join(words(x.lower())):
                spread[n].add(r[2])
    gone = {x for x, c in spread.items() if len(c) >= 4}
    want = []
    for r in records:
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if " ".join(words(x.lower())) not in gone]
        want.append((r[0], len(lines), len(lines) - len(kept), "\n".join(kept)))
    for band in (0.15, 0.9):  # trusted estimates, and exact counts of nearly all
        assert got(remove_spread_lines(traces, 4, band=band), "trial_id", "n_lines", "n_removed", "text") == bag(want)
    assert gone


def test_balance_mix(traces, records):
    sizes = defaultdict(int)
    for r in records:
        sizes[r[2]] += len(words(r[1]))
    order = sorted((c for c in sizes if c is not None)) + [None]
    weight = {c: (3, 1, 2)[i % 3] for i, c in enumerate(order)}
    target, full = dict.fromkeys(order, 0.0), set()
    rest = 1.5 * sum(sizes.values())
    while True:
        left = rest - sum(2 * sizes[c] for c in full)
        level = {c: left * weight[c] / sum(weight[d] for d in order if d not in full) for c in order if c not in full}
        new = {c for c, x in level.items() if x > 2 * sizes[c]}
        if not new:
            break
        full |= new
    target = {c: 2.0 * sizes[c] if c in full else level[c] for c in order}
    rows = mixing.balance_mix(traces).collect()
    assert bag((r.trial_id, r.condition_id, r.size, r.source_size) for r in rows) == bag((r[0], r[2], len(words(r[1])), sizes[r[2]]) for r in records)
    taken = defaultdict(int)
    for r in rows:
        taken[r.condition_id] += r.taken
        assert r.target == pytest.approx(target[r.condition_id]) and r.taken == r.copies * r.size and 0 <= r.copies <= 2
    for c in order:
        largest = max(len(words(r[1])) for r in records if r[2] == c)  # copies are whole
        assert abs(taken[c] - target[c]) <= max(5, 0.01 * target[c], largest / 2 if largest > target[c] / 4 else 0)
    key = lambda r: repr(tuple(r))
    assert sorted(map(key, mixing.balance_mix(traces.repartition(3)).collect())) == sorted(map(key, rows))


def test_mix_rates_meet_targets(spark):
    rows = [(i, " ".join("w" * (1 + i * i % 97)), f"c{i % 3}") for i in range(300)]
    mixed = mixing.balance_mix(spark.createDataFrame(rows, "trial_id bigint, text string, condition_id string"), weights=(1, 5, 2), share=1.0).collect()
    for c in ("c0", "c1", "c2"):
        mine = [r for r in mixed if r.condition_id == c]
        assert sum(r.rate * r.size for r in mine) == pytest.approx(mine[0].target, rel=1e-6)
        pairs = sorted((r.size, r.rate) for r in mine)  # one tilt per condition: rates are monotonous in size
        assert all(a[1] <= b[1] + 1e-9 for a, b in zip(pairs, pairs[1:])) or all(a[1] >= b[1] - 1e-9 for a, b in zip(pairs, pairs[1:]))


def test_pack_traces(traces, records):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(VOCABULARY)
    rows = packing.pack_traces(traces, VOCABULARY, capacity=256, parts=3).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.trial_id].append((r.start, r.length, r.ids_crc32, r.trace_tokens))
        sequences[r.sequence_id].append((r.offset, r.length))
    by_id = defaultdict(list)
    for r in records:
        by_id[r[0]].append(tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [1])
    assert set(pieces) == set(by_id)
    for i, texts in by_id.items():
        want = Counter()
        for ids in texts:
            at = 0
            for size, _ in packing.harmonic_cuts(len(ids), 256, 0.02):
                want[at, size, zlib.crc32(np.array(ids[at:at + size], "<u4").tobytes()), len(ids)] += 1
                at += size
            assert at == len(ids)
        assert Counter(pieces[i]) == want
    padding = 0
    for placed in sequences.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 256
        padding += 256 - at
    assert padding < 0.05 * sum(r.length for r in rows)


def test_tasks_of_one_process_share_the_tokenizer_and_its_words():
    shared = packing.token_bytes(VOCABULARY)
    assert packing.token_bytes(VOCABULARY) is shared and shared("some words, some words") == packing.TokenBytes(VOCABULARY)("some words, some words")
    assert "words" in packing.token_bytes(VOCABULARY).known


def test_token_bytes_match_the_tokenizer():
    tokens = packing.TokenBytes(VOCABULARY)
    rng = np.random.default_rng(2)
    signs = list(map(chr, range(0x500))) + ["<|endoftext|>", "漢", "😀", " "]
    for i in range(1500):
        text = "".join(signs[j] if rng.random() < 0.2 else "ab '1\n s_-²ß"[j % 12] for j in rng.integers(0, len(signs), rng.integers(0, 40)))
        assert tokens(text) == np.array(tokens.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text)


def test_shard_traces(traces, records, spark):
    rows = sharding.shard_traces(traces, n_shards=4).collect()
    assert bag((r.trial_id, r["size"], r.text_crc32) for r in rows) == bag((r[0], len(raw(r[1])) + 16, zlib.crc32(raw(r[1]))) for r in records)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(4))
    many = spark.range(20_000).selectExpr("id AS trial_id", "repeat('x', cast(id % 400 AS int)) AS text")
    load = {r.shard: r.b for r in sharding.shard_traces(many, n_shards=10).groupBy("shard").agg({"size": "sum"}).toDF("shard", "b").collect()}
    mean = sum(load.values()) / 10
    assert len(load) == 10 and max(load.values()) < 1.01 * mean and min(load.values()) > 0.97 * mean
    before = {r.trial_id: r.shard for r in sharding.shard_traces(many, n_shards=10).collect()}
    after = {r.trial_id: r.shard for r in sharding.shard_traces(many, n_shards=11).collect()}
    moved = sum(before[i] != s for i, s in after.items())
    assert moved < 0.4 * len(before), moved  # plain modulo would move ten elevenths


def test_score_cross_entropy(traces, records, spark):
    target = spark.createDataFrame([(1, "w1 w2 w1 w2 w1 w2 w3"), (2, None), (3, "W1 w2")], "trial_id bigint, text string")
    rows = score_cross_entropy(traces, target, word_share=1e-3, bigram_share=1e-3).collect()
    corpora = [Counter(w for t in c for w in words((t or "").lower())) for c in (["w1 w2 w1 w2 w1 w2 w3", "W1 w2"], [r[1] for r in records])]
    vocabulary = {w for c in corpora for w, n in c.items() if n >= max(2, 1e-3 * sum(c.values()))}
    assert {"w1", "w2"} < vocabulary and len(vocabulary) > 100

    def model(texts):
        ids = [["<s>"] + [w if w in vocabulary else "?" for w in words((t or "").lower())] for t in texts]
        single = Counter(w for x in ids for w in x[1:])
        pairs = Counter(p for x in ids for p in zip(x, x[1:]))
        return single, pairs, sum(single.values())

    models = [model(["w1 w2 w1 w2 w1 w2 w3", None, "W1 w2"]), model([r[1] for r in records])]
    kept = {p for m in models for p, n in m[1].items() if n >= max(2, 1e-3 * m[2])}

    def loss(m, text):
        single, pairs, n = m
        types, total = max(len(single), 1), 0.0
        x = ["<s>"] + [w if w in vocabulary else "?" for w in words((text or "").lower())]
        for h, w in zip(x, x[1:]):
            weight = max(sum(c for p, c in pairs.items() if p[0] == h) + sum(p[0] == h for p in pairs), 1)
            share = {p: pairs[p] / weight for p in kept if p[0] == h}
            total -= np.log2(share.get((h, w), 0) + max(1 - sum(share.values()), 1e-12) * (single[w] + types / (len(vocabulary) + 1)) / (n + types))
        return total / (len(x) - 1) if len(x) > 1 else 0.0

    want = {r[1]: (loss(models[0], r[1]), loss(models[1], r[1])) for r in records if len(r[1] or "") < 2000}
    by_id = {r[0]: r[1] for r in records}
    assert len(rows) == len(records)
    for r in rows:
        if by_id[r.trial_id] in want:
            assert (r.target_loss, r.background_loss) == pytest.approx(want[by_id[r.trial_id]])
            assert r.difference == pytest.approx(r.target_loss - r.background_loss) and r.n_words == len(words(by_id[r.trial_id]))


def test_score_quality(traces, records, spark):
    good = spark.createDataFrame([(r[0], 0 if len(set(words(r[1]))) < 12 else 1) for r in records if r[0] is not None] + [(1, None), (None, 1)], "trial_id bigint, good int")
    rows = score_quality(traces, good).collect()
    assert Counter(r.trial_id for r in rows) == Counter(r[0] for r in records)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    truth = {r[0]: int(len(set(words(r[1]))) >= 12) for r in records}
    assert np.mean([r.predicted == truth[r.trial_id] for r in rows]) > 0.9
    assert all(r.score == 0.5 for r in score_quality(traces, good.where("good = 1")).collect())
    assert all(len(text_features(t or "")) == len(FEATURES) and np.isfinite(text_features(t or "")).all() for _, t, *_ in records)


def test_scores_are_those_of_a_plain_discriminant(traces, records, spark):
    """Two-pass class moments, dense inverses and determinants, texts scored one by one; labels repeat, some are null."""
    rng = random.Random(9)
    truth = [(r[0], int(len(set(words(r[1]))) >= 25) if rng.random() < 0.95 else rng.randrange(2)) for r in records if r[0] is not None]
    truth += [truth[0], truth[1], (truth[2][0], None), (None, 1)]
    got_rows = score_quality(traces, spark.createDataFrame(truth, "trial_id bigint, good int")).collect()
    by_id = defaultdict(list)
    for r in records:
        by_id[r[0]].append(text_features(r[1] or ""))
    labelled = [(x, good) for i, good in truth if i is not None and good is not None for x in by_id[i]]
    x, y = np.array([a for a, _ in labelled]), np.array([g for _, g in labelled])
    scale = np.sqrt(np.maximum(x.var(axis=0), 1e-12))
    scale[scale <= 1e-5] = 1.0
    z = (x - x.mean(axis=0)) / scale
    spreads = [np.cov(z[y == k].T, bias=True) for k in (0, 1)]
    pooled = sum((y == k).mean() * spreads[k] for k in (0, 1))
    terms = []
    for k in (0, 1):
        s = 0.8 * spreads[k] + 0.2 * pooled
        s = 0.9 * s + 0.1 * np.diag(np.diag(s)) + 1e-3 * np.eye(len(s))
        terms.append((z[y == k].mean(axis=0), np.linalg.inv(s), np.log((y == k).mean()) - np.linalg.slogdet(s)[1] / 2))

    def plain(text):
        v = np.clip((np.array(text_features(text or "")) - x.mean(axis=0)) / scale, -8, 8)
        logs = [c - (v - m) @ inverse @ (v - m) / 2 for m, inverse, c in terms]
        return 1 / (1 + np.exp(-np.clip(0.5 * (logs[1] - logs[0]), -700, 700)))

    want = defaultdict(list)
    for r in records:
        want[r[0]].append(plain(r[1]))
    for i in want:
        assert sorted(r.score for r in got_rows if r.trial_id == i) == pytest.approx(sorted(want[i]), abs=1e-6)


def test_held_out_quality(spark):
    import __spark_entry__ as entry

    base = "/root/testdata/sf0.01"
    rows = entry.queries()["op2_quality_classifier"](spark, base).join(spark.read.parquet(f"{base}/labels.parquet"), "doc_id").where("held_out").collect()
    assert {r.held_out for r in rows} == {True} and all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in rows)
    for quality in (0, 1):
        mine = [r.predicted == quality for r in rows if r.quality == quality]
        assert mine and np.mean(mine) > 0.9


def test_empty_tables(nothing):
    labels = nothing.selectExpr("trial_id", "1 AS good")
    for df in (exact_dedup(nothing), suffix_dedup.remove_repeats(nothing), simhash_dedup.simhash_dedup(nothing), simhash_dedup.near_copies(nothing),
               quality_rules(nothing), remove_spread_lines(nothing), mixing.balance_mix(nothing), packing.pack_traces(nothing, VOCABULARY),
               sharding.shard_traces(nothing), score_cross_entropy(nothing, nothing), score_quality(nothing, labels)):
        assert df.count() == 0


def test_only_empty_texts(spark):
    blank = spark.createDataFrame([(1, None, None), (2, "", "c"), (2, "", "c")], "trial_id bigint, text string, condition_id string")
    labels = blank.selectExpr("trial_id", "1 AS good")
    for df in (exact_dedup(blank), suffix_dedup.remove_repeats(blank), simhash_dedup.simhash_dedup(blank), quality_rules(blank),
               remove_spread_lines(blank), mixing.balance_mix(blank), packing.pack_traces(blank, VOCABULARY), sharding.shard_traces(blank),
               score_cross_entropy(blank, blank), score_quality(blank, labels)):
        assert sorted(r.trial_id for r in df.collect()) == [1, 2, 2]
    assert {r.stays_for for r in simhash_dedup.near_copies(blank).collect()} == {1}
