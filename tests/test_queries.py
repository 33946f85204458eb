"""Every registered query of the engine against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

from tellurion.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def rows(records, columns):
    """Rows in an order that the last digits of numbers don't bear on."""
    plain = [tuple(None if r[c] is None or r[c] != r[c] else r[c] for c in columns) for r in records]
    return sorted(plain, key=lambda r: [(v is not None, f"{v:.3f}" if isinstance(v, float) else str(v)) for v in r])


def same(a, b):
    """Numbers may differ by one in the last digit that was rounded to."""
    return math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-5) if isinstance(a, float) and isinstance(b, float) else str(a) == str(b)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_gives_the_rows_of_its_sql(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    got = [r.asDict() for r in df.collect()]
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    rel = duck.sql(sql)
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    kinds = dict(zip(rel.columns, map(str, rel.types), strict=True))
    assert {c: KINDS.get(k, kinds[c]) for c, k in df.dtypes} == kinds
    ours, theirs = rows(got, columns), rows([dict(zip(rel.columns, r, strict=True)) for r in rel.fetchall()], columns)
    assert len(ours) == len(theirs)
    assert not [(a, b) for a, b in zip(ours, theirs, strict=True) if not all(map(same, a, b))][:3]


def test_most_queries_have_sql():
    assert len(registry.oracle_sql()) > 0.9 * len(registry.queries())
