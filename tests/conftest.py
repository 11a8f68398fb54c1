import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))

from traceframe.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[8]", 8, **{"spark.driver.memory": "8g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def rows(df, *order):
    """Rows as dicts, ordered by the given columns (nulls first)."""
    found = [r.asDict(recursive=True) for r in df.collect()]
    return sorted(found, key=lambda r: [(r[c] is not None, r[c]) for c in order]) if order else found


def one(df):
    found = rows(df)
    assert len(found) == 1
    return found[0]
