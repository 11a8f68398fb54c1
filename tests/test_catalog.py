import duckdb
import pytest

import __spark_entry__ as entry
from traceframe.catalog import load_catalog

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def value(v):
    return round(v, 5) + 0.0 if isinstance(v, float) else v


def test_every_query_has_an_oracle():
    plans, oracles = load_catalog()
    assert set(plans) == set(oracles) and len(plans) >= 133 and set(plans) <= set(entry.queries())


def test_every_oracle_binds(duck):
    for name, sql in entry.oracle_sql().items():
        assert duck.execute("EXPLAIN " + sql).fetchall(), name


@pytest.mark.parametrize("name", [
    "kaplan_meier", "survival_by_family", "rmst_delta_bootstrap", "metric_panel", "paired_recoverability", "collapse_draws",
    "population_audit", "paired_outcomes", "repetition_strata", "summarize", "family_reconciliation", "top_motif",
    "degeneration_onset", "trial_draw_ids", "forced_outcome", "comparability_gate", "lock_verify", "structural_audit",
    "stream_stale_runs"])
def test_against_oracle(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    got = sorted(tuple(map(repr, (value(r[c]) for c in sorted(df.columns)))) for r in df.collect())
    rel = duck.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in rel.description]
    pick = [cols.index(c) for c in sorted(cols)]
    assert sorted(cols) == sorted(df.columns)
    assert got == sorted(tuple(map(repr, (value(r[i]) for i in pick))) for r in rel.fetchall())


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 15
