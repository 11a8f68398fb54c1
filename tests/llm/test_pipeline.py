"""The pipeline on a small table, stage by stage, and the registered queries against their SQL."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline

SF = "/root/testdata/sf0.001"
COLUMNS = {"doc_id", "text", "lang", "source", "n_chars"}


def test_queries_are_registered():
    names = list(entry.queries())
    assert "pipeline" in names and all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 14))


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(-1, None, None, None, None), (None, "word " * 3 + "other words of a text that has no id at all", "en", "src1", 1), (10**15, "", "en", None, 0)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema)).unionByName(docs.where("doc_id < 5"))
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, before, SF).collect(), before.schema)
        assert set(docs.columns) == COLUMNS
        was, now = Counter(map(tuple, before.collect())), Counter(map(tuple, docs.collect()))
        assert now and set(now) <= set(was), name
        if name == "quality_rules":
            assert all(len((r[1] or "").split()) >= 10 for r in now) and not any(r[0] == -1 for r in now)
        if name == "exact_dedup":
            assert set(now.values()) == {1} and len({r[1] for r in now}) == len({r[1] for r in was}) == len(now)
        if name == "mixing":
            assert max(now.values()) <= 2 and sum(now.values()) > 1.2 * sum(was.values())
        before = docs
    packed = corpus_pipeline.STAGES[-1][1](spark, before, SF)
    ids = Counter(r.doc_id for r in before.select("doc_id").collect())
    total = Counter()
    for r in packed.collect():
        total[r.doc_id] += r.length / r.doc_tokens
    assert {i: round(n, 6) for i, n in total.items()} == {i: float(n) for i, n in ids.items()}


def test_empty_corpus(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_stages_on_long_texts_ties_and_other_columns(spark):
    """A text of a megabyte, ids that repeat with the same and with other texts, null ids, and columns named like the stages' own."""
    long = " ".join(f"w{i * 7919 % 200_003}" for i in range(150_000))
    texts = [(1, long), (2, long + " end"), (3, "some words " * 3 + "that are few but enough to stay in the corpus"), (3, "another text of the same id, long enough to be kept by the rules"),
             (4, "a text that stands twice with one id and is long enough to be kept"), (4, "a text that stands twice with one id and is long enough to be kept"),
             (None, "a text without an id that is long enough to be kept by the rules"), (5, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "x", "y") for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long, id string, token string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns
        docs = spark.createDataFrame(kept.collect(), docs.schema)
        found = [(r.doc_id, r.text) for r in docs.collect()]
        if name == "simhash_near_dedup":
            assert sorted((i or 0, len(t)) for i, t in found) == sorted((i or 0, len(t)) for i, t in {(1, long), *texts[2:7]})
    assert {r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()} == {r.doc_id for r in docs.collect()}


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if n.startswith("op")])
def test_against_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    df = entry.queries()[name](spark, SF)
    rel = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in rel.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    want = Counter(repr(tuple(r[columns.index(c)] for c in order)) for r in rel.fetchall())
    assert Counter(repr(tuple(r[c] for c in order)) for r in df.collect()) == want
