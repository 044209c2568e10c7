"""Every query of the core that has SQL, against DuckDB on the smallest tables."""

import math
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from tesserae.plans import registry

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return v.replace(tzinfo=None) if getattr(v, "tzinfo", None) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone='UTC'")
    for p in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, duck, name):
    df = registry.queries()[name](spark, str(DATA))
    columns = sorted(df.columns)
    got = Counter(repr(tuple(norm(r[c]) for c in columns)) for r in df.collect())
    result = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = Counter(repr(tuple(norm(r[names.index(c)]) for c in columns)) for r in result.fetchall())
    assert got == want


def test_names_are_unique_and_sql_has_queries():
    names = [n for m in registry.MODULES for n in m.QUERIES]
    assert len(names) == len(set(names)) and set(registry.oracle_sql()) <= set(names)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
