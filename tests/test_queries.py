"""Every registered query against its SQL in DuckDB on the smallest tables, and shape checks of the registry."""

import math
import os
import re

import pytest

from seriesloom.plans import catalog

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
catalog.load_all()
needs_data = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not present")

# No row at sf0.001 (one at sf0.01); why the smallest tables give none has not been traced.
EMPTY_WHEN_SMALL = {"q14_contagion"}
# Greedy or page-level studies that take long even on small tables; tools/check.py runs them.
SLOW = {"q19_web_evidence", "l10_similar_pairs", "l10_dedup_near"}


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for name in os.listdir(FOLDER):
        con.sql(f"create view {name.split('.')[0]} as select * from '{FOLDER}/{name}'")
    return con


def plain(v):
    return None if v is None or (isinstance(v, float) and math.isnan(v)) else v if isinstance(v, float) else str(v)


def rough(row):
    """Sort key that float noise does not disturb much."""
    return tuple("~" if v is None else f"{v + 0.0:.4e}" if isinstance(v, float) else v for v in row)


def same(a, b):
    return all(x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-6, abs_tol=2e-5)) for x, y in zip(a, b))


def test_every_sql_has_a_query():
    assert set(catalog.SQL) <= set(catalog.QUERIES)
    assert len(catalog.QUERIES) > 180 and all(re.match(r"^[a-z]\d\d_[a-z0-9_]+$", n) for n in catalog.QUERIES)


@needs_data
@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - SLOW))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    cols = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=rough)
    if name not in catalog.SQL:  # the operator's own tests hold its values; here rows come out, and no row twice or empty
        assert (rows or name in EMPTY_WHEN_SMALL) and len(set(rows)) == len(rows)
        assert all(any(v is not None for v in row) for row in rows)
        assert not any(isinstance(v, float) and math.isinf(v) for row in rows for v in row)
        return
    rel = duck.sql(catalog.SQL[name])
    assert sorted(rel.columns) == cols
    at = [list(rel.columns).index(c) for c in cols]
    want = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=rough)
    assert len(rows) == len(want)
    off = [(a, b) for a, b in zip(rows, want) if not same(a, b)]
    assert not off, off[:3]
