"""Every core query runs, and equals its SQL over the same tables."""

import math
import os

import duckdb
import pytest

from annospark.plans import registry

DATA = os.environ.get("ANNOSPARK_TESTDATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "-"
    if isinstance(v, list | tuple):
        return [plain(x) for x in v]
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int | float) or type(v).__name__ == "Decimal":
        return repr(round(float(v), 6) + 0.0)
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    rows = df.collect()
    if name not in registry.sql():
        return
    result = duck.execute(registry.sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted([plain(v) for _, v in sorted(zip(columns, r, strict=True))] for r in result.fetchall())
    got = sorted([plain(r[c]) for c in sorted(df.columns)] for r in rows)
    assert got == want
