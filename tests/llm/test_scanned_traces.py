"""Every operator on trace records as they are stored: JSON lines of several runs, scanned and flattened."""

import json
import random
from collections import Counter

import public_tokenizers
import pytest

from traceframe.llm import mixing, packing, sharding, simhash_dedup, suffix_dedup
from traceframe.llm.exact_dedup import exact_dedup
from traceframe.llm.language_filter import identify_language
from traceframe.llm.line_dedup import remove_spread_lines
from traceframe.llm.lm_scoring import score_cross_entropy
from traceframe.llm.quality_classifier import score_quality
from traceframe.llm.quality_rules import quality_rules
from traceframe.llm.spelling_variants import spelling_variants
from traceframe.sources.evidence import flat_records, scan_traces

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
LINE = "the answer follows from the steps above and nothing else"


@pytest.fixture(scope="module")
def records(spark, tmp_path_factory):
    """Two runs of forty traces in two families, with copies, one shared line, a trace without text and a broken line."""
    rng, base = random.Random(8), tmp_path_factory.mktemp("runs")
    texts = {}
    for run in ("r1", "r2"):
        (base / run).mkdir()
        rows = []
        for i in range(40):
            words = ["addition", "carry", "digit", "column"] if i % 2 else ["knoten", "kante", "strecke", "länge"]
            text = " ".join(f"{rng.choice(words)} {rng.randrange(1000)}" for _ in range(60)) + "\n" + LINE
            text = texts["r1/0"] if (run, i) == ("r2", 0) else None if i == 39 else text
            texts[f"{run}/{i}"] = text
            rows.append({"run_id": run, "trial_id": f"{run}/{i}", "task_id": f"t{i}", "condition_id": f"{run}-c{i % 2}", "family": "arith" if i % 2 else "path",
                         "condition": {"mode": "greedy", "repeat": 0}, "termination": {"capped": False}, "trace": {"token_ids": [1, 2], "text": text}})
        (base / run / "traces.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n{\"run_id\": \"")
    flat = flat_records(scan_traces(spark, f"{base}/*/traces.jsonl")).where("trial_id IS NOT NULL")
    return flat, texts


def ids(df, column="trial_id"):
    return Counter(r[column] for r in df.collect())


def test_whole_rows_come_back(records):
    """Operators of one row per trace return every trace once."""
    traces, texts = records
    want = Counter(dict.fromkeys(texts, 1))
    labels = traces.selectExpr("trial_id", "CASE WHEN family = 'arith' THEN 1 ELSE 0 END AS good")
    for df in (exact_dedup(traces), suffix_dedup.remove_repeats(traces, length=200), simhash_dedup.simhash_dedup(traces), quality_rules(traces),
               remove_spread_lines(traces), mixing.balance_mix(traces), sharding.shard_traces(traces, n_shards=4), score_cross_entropy(traces, traces),
               score_quality(traces, labels), identify_language(traces, traces)):
        assert ids(df) == want
    assert ids(simhash_dedup.near_copies(traces)) == want
    packed = packing.pack_traces(traces, VOCABULARY).collect()
    assert {r.trial_id for r in packed} == set(texts)


def test_copies_lines_and_languages_of_scanned_traces(records):
    traces, texts = records
    copies = {r.trial_id: r.keep_id for r in exact_dedup(traces).collect()}
    assert copies["r2/0"] == copies["r1/0"] == "r1/0" and copies["r2/1"] == "r2/1"
    stays = {r.trial_id: r.stays_for for r in simhash_dedup.near_copies(traces).collect()}
    assert stays["r2/0"] == "r1/0" and stays["r2/39"] == "r1/39" and stays["r2/2"] == "r2/2"
    rules = {r.trial_id: r for r in quality_rules(traces).collect()}
    assert rules["r1/1"].removed_words == len(LINE.split()) and not rules["r1/39"].kept and rules["r1/1"].kept
    told = {r.trial_id: r.predicted for r in identify_language(traces, traces.where("run_id = 'r1'")).collect()}
    assert all(told[i] == ("und" if t is None else "arith" if int(i[3:]) % 2 else "path") for i, t in texts.items() if i != "r2/0")
    words = {r.word for r in spelling_variants(traces).collect()}
    assert {"addition", "strecke", "column", "knoten"} <= words
