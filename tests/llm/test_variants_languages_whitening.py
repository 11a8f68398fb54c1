"""Spelling variants, languages and whitened vectors against plain versions of their definitions."""

import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from traceframe.llm import language_filter, whitening
from traceframe.llm.language_filter import identify_language
from traceframe.llm.spelling_variants import spelling_variants
from traceframe.llm.whitening import whiten

SCHEMA = "trial_id bigint, text string, word string, n string, id string, prefix string, family string"


def letters_off(a, b):
    """Exactly one inserted, deleted or replaced code point."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_variants(records, min_length, min_count, ratio, slip_every):
    counts = Counter()
    for ident, text in records:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if ident is None else ident}:{run}".encode())
            if slip_every and h % slip_every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= min_length and n >= min_count}
    by_size = defaultdict(list)
    for w in counts:
        by_size[len(w)].append(w)
    near = {w: [v for d in (-1, 0, 1) for v in by_size[len(w) + d] if v != w and letters_off(v, w)] for w in counts}
    form = {}
    for w, found in near.items():
        if found:
            best = min(found, key=lambda v: (-counts[v], v))
            if counts[best] >= ratio * counts[w]:
                form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: (form.get(w), root(w), n, len(near[w]), counts.get(form.get(w))) for w, n in counts.items()}


def edited(rng, word, alphabet):
    at, kind = rng.randrange(len(word)), rng.randrange(3)
    return word[:at] + (rng.choice(alphabet) if kind < 2 else "") + word[at + (kind > 0):]


@pytest.mark.parametrize("slip_every", [None, 7])
def test_variants_against_all_pairs(spark, slip_every):
    """Chains, ties, doubled letters, letters outside ASCII, words of thousands of letters, repeated rows, odd texts."""
    rng = random.Random(11)
    alphabet = "abcÀéß"
    words = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(5, 9))) for _ in range(40)]
    words += ["aaaaaa", "aaaaaaa", "aaaaaab", "baaaaaa", "abcabc"]
    for size in (62, 63, 64, 65, 66, 3000):
        long = "".join(rng.choice("ab") for _ in range(size))
        words += [long, *[edited(rng, long, alphabet) for _ in range(6)], long[:-1], long + "a"]
    words += [edited(rng, w, alphabet) for w in words if len(w) < 100 for _ in range(4)]
    bag = [w for w in words for _ in range(rng.choice([1, 2, 5, 6, 30, 30, 200]) if len(w) < 100 else rng.choice([2, 11, 60]))]
    rng.shuffle(bag)
    records = [(i // 2, " ".join(bag[k:k + 40]).upper() if i % 3 else "-".join(bag[k:k + 40])) for i, k in enumerate(range(0, len(bag), 40))]
    records += [(None, "aaaaaa aaaaaa"), (None, None), (3, ""), (4, "12 — 漢字"), records[0], records[0]]
    traces = spark.createDataFrame([(i, t, "x", "y", "z", "p", "f") for i, t in records], SCHEMA).repartition(6)
    want = plain_variants(records, 6, 2, 3, slip_every)
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling_variants(traces, 6, 2, 3, slip_every).collect()}
    assert got == want
    assert sum(f is not None for f, *_ in want.values()) > 20 and any(r != (f or w) for w, (f, r, *_) in want.items())


def test_a_word_with_very_many_variants(spark):
    """A third of all words are variants of one word."""
    word = "commonly"
    letters = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïðñòóôõö"
    variants = {word[:i] + c + word[i + k:] for i in range(8) for c in letters for k in (0, 1)} - {word}
    traces = spark.createDataFrame([(i, " ".join(sorted(variants))) for i in range(5)] + [(9, f"{word} " * 500)], "trial_id int, text string")
    got = {r.word: r for r in spelling_variants(traces).collect()}
    assert len(got) == len(variants) + 1 and got[word].n_near == len(variants) and got[word].form is None
    assert all(got[v].form == got[v].root == word and got[v].form_n == 500 for v in variants)


def test_nothing_to_spell(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert spelling_variants(empty).count() == 0
    assert spelling_variants(spark.createDataFrame([(1, None), (2, "")], "trial_id int, text string")).count() == 0


# ---- languages ------------------------------------------------------------------------------------------------
def invented(rng, syllables, n):
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def spoken(spark):
    rng = random.Random(13)
    tongues = {"aa": ["the", "ing", "ou", "re", "an"], "bb": ["ich", "ß", "der", "ung", "an"], "cc": ["ción", "el", "ña", "re", "os"], "dd": ["漢", "字", "語", "文"]}
    rows = [(i, invented(rng, tongues[f], rng.randrange(3, 60)), f) for i, f in enumerate(rng.choices(list(tongues), [20, 3, 3, 2], k=600))]
    return rows, {i: f for i, _, f in rows}


def test_filter_answers_like_sets(spark, spoken, monkeypatch):
    """With sets instead of the filter, hits never exceed the filter's, which has few more; decisions are the same."""
    rows, truth = spoken
    lessons = spark.createDataFrame([r for r in rows if r[0] % 4] + [(1, None, "aa"), (2, "lost", None)], "trial_id int, text string, family string")
    profiles = defaultdict(set)
    counts = defaultdict(Counter)
    for i, text, family in rows:
        if i % 4:
            for length in language_filter.LENGTHS:
                padded = " " + " ".join(re.findall(r"[^\W\d_]+", text.lower())) + " "
                counts[family].update(padded[k:k + length] for k in range(len(padded) - length + 1))
    share = 1e-3
    for family, c in counts.items():
        profiles[family] = {g for g, n in c.items() if n >= share * sum(c.values())}
    learned = language_filter.build_filter(language_filter.family_profiles(lessons.where("family IS NOT NULL"), share))
    assert learned.families == sorted(profiles)
    for i, text, _ in rows[:80]:
        padded = " " + " ".join(re.findall(r"[^\W\d_]+", text.lower())) + " "
        grams = [padded[k:k + n] for n in language_filter.LENGTHS for k in range(len(padded) - n + 1)]
        hits = sum(learned.hits(g) for g in language_filter.text_grams(text))
        exact = np.array([sum(g in profiles[f] for g in grams) for f in learned.families])
        assert (hits >= exact).all() and (hits - exact <= 0.05 * len(grams) + 2).all()
        if i % 4 == 0:
            assert learned.decide(text)[0] == learned.families[int(np.argmax(exact))]
    monkeypatch.setattr(language_filter, "PIECE", 7)
    whole = language_filter.letters_and_gaps(rows[0][1])
    assert sum(len(g) for g in language_filter.text_grams(rows[0][1])) == sum(len(whole) - n + 1 for n in language_filter.LENGTHS)


def test_languages_are_told(spark, spoken):
    rows, truth = spoken
    schema = "trial_id int, text string, family string, predicted string, score string, gram string"
    traces = spark.createDataFrame([(*r, "p", "s", "g") for r in rows], schema).repartition(5)
    odd = [(900, None), (901, ""), (902, "12 !?\n34"), (903, "ß"), (904, "Ω" * 50), (905, "ung " * 400_000), (905, "ung " * 400_000), (None, "der ich")]
    odd = spark.createDataFrame([(i, t, None, "p", "s", "g") for i, t in odd], schema)
    told = identify_language(traces.unionByName(odd), traces.where("trial_id % 4 > 0")).collect()
    assert Counter(r.trial_id for r in told) == Counter([*truth, 900, 901, 902, 903, 904, 905, 905, None])
    assert all(0 <= r.score <= 1 for r in told)
    by_id = {r.trial_id: r for r in told}
    held_out = [by_id[i].predicted == f for i, f in truth.items() if i % 4 == 0]
    assert np.mean(held_out) > 0.97
    assert {by_id[i].predicted for i in (900, 901, 902)} == {"und"} and by_id[904].predicted == "aa" and by_id[904].score == 0
    assert by_id[903].predicted == by_id[905].predicted == by_id[None].predicted == "bb"


def test_more_than_64_families_and_none(spark):
    """Slots of more than one word; nothing learned; empty tables."""
    texts = [(i, chr(0x4E00 + 40 * i) * 3 + chr(0x4E01 + 40 * i) * 3, f"f{i:03}") for i in range(150)]
    traces = spark.createDataFrame(texts, "trial_id int, text string, family string")
    assert all(r.predicted == f"f{r.trial_id:03}" for r in identify_language(traces, traces).collect())
    assert {(r.predicted, r.score) for r in identify_language(traces, traces.where("false")).collect()} == {("und", 0.0)}
    assert identify_language(traces.where("false"), traces).count() == 0


def test_held_out_languages(spark):
    import __spark_entry__ as entry

    base = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{base}/documents.parquet").select("doc_id", "lang")
    told = entry.queries()["op13_language_id"](spark, base).join(docs, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in told)
    held_out = [r for r in told if r.held_out and r.lang_pred != "und"]
    for lang in {r.lang for r in held_out}:
        assert np.mean([r.lang_pred == lang for r in held_out if r.lang == lang]) > 0.9


# ---- whitening ------------------------------------------------------------------------------------------------
def exact_whitening(vectors, components):
    """Integers and fractions throughout; only the eigenvectors are numpy's."""
    x = [[int(np.floor(1024 * float(c))) + 100_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    sums = [sum(r[k] for r in x) for k in range(d)]
    covariance = [[Fraction(n * sum(r[i] * r[j] for r in x) - sums[i] * sums[j], n * n) for j in range(d)] for i in range(d)]
    values, basis = np.linalg.eigh(np.array([[float(c) for c in r] for r in covariance]))
    order = np.argsort(-values)[:components]
    centred = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(r, sums)] for r in x])
    deviation = [sum((n * c - s) ** 2 for c, s in zip(r, sums)) for r in x]
    return n, deviation, centred @ basis[:, order], values[order], values[order] / float(sum(covariance[k][k] for k in range(d)))


def test_whitening_against_exact_arithmetic(spark):
    rng = np.random.default_rng(3)
    good = (rng.normal(size=(333, 9)) @ rng.normal(size=(9, 9)) * np.geomspace(1, 20, 9)).astype(np.float32).tolist()
    rows = [(i, v, "x", "w") for i, v in enumerate(good)] + [(None, good[0], "x", "w"), (5, good[5], "x", "w")]
    bad = [(900, None), (901, []), (902, [None, *good[0][1:]]), (903, [float("nan"), *good[0][1:]]), (904, [float("-inf"), *good[0][1:]]), (905, [1.0])]
    frame = spark.createDataFrame(rows + [(i, v, "x", "w") for i, v in bad], "vec_id bigint, embedding array<float>, x string, w string").repartition(4)
    n, deviation, places, values, shares = exact_whitening([r[1] for r in rows], 4)
    got = whiten(frame, components=4).collect()
    assert len(got) == 4 * len(rows) and {r.n for r in got} == {n}
    by_key = defaultdict(list)
    for r in got:
        by_key[r.vec_id].append(r)
    signs = {}
    for (ident, *_), want, place in zip(rows, deviation, places):
        for r in by_key[ident]:
            assert int(r.deviation) == want
            k = r.component - 1
            value = place[k] / np.sqrt(values[k])
            if abs(value) > 0.1:
                signs.setdefault(k, np.sign(r.whitened * value))
                assert r.whitened * signs[k] == pytest.approx(value, abs=1e-8)
            assert r.explained == pytest.approx(shares[k], rel=1e-9) and r.identity_error < 1e-9


def test_whitening_of_degenerate_tables(spark):
    schema = "vec_id int, embedding array<double>"
    assert whiten(spark.createDataFrame([], schema)).count() == 0
    assert whiten(spark.createDataFrame([(1, None), (2, [])], schema)).count() == 0
    single = whiten(spark.createDataFrame([(1, [0.5, 1.5])], schema)).collect()
    assert [(r.component, r.whitened, r.explained, int(r.deviation)) for r in sorted(single)] == [(1, None, None, 0), (2, None, None, 0)]
    flat = whiten(spark.createDataFrame([(i, [float(i), 7.0]) for i in range(10)], schema)).collect()
    assert {r.component for r in flat if r.whitened is None} == {2} and all(r.identity_error < 1e-9 for r in flat)
    wide = whiten(spark.createDataFrame([(i, [1e300 * i, 1e15 * i, -3e8 * i]) for i in (-2, -1, 0, 1, 2)], schema)).collect()
    assert all(r.identity_error < 1e-6 for r in wide) and len(wide) == 15


def test_planes_give_products():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 1 << 13, size=(137, 5))
    weighted = whitening.plane_products(whitening.bit_planes(x, 13))
    assert (sum(m << w for w, m in enumerate(weighted)) == x.T @ x).all()
    assert sum(v << (whitening.LIMB_BITS * k) for k, v in enumerate(whitening.limbs_of(12345 ** 10))) == 12345 ** 10
