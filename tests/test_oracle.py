"""Every registered query against its DuckDB oracle on sf0.001 (rows, columns, values)."""

import hashlib

import pytest

import __spark_entry__ as E

ORACLE = E.oracle_sql()
SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
QUERIES = E.queries()


def _digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return hashlib.sha256("\n".join(sorted("|".join(repr(r[i]) for i in order) for r in rows)).encode()).hexdigest()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    rows = [tuple(r) for r in df.collect()]
    res = duck.execute(ORACLE[name])
    ocols = [c[0] for c in res.description]
    orows = res.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    duck_types = {r[0]: r[1] for r in duck.execute(f"DESCRIBE ({ORACLE[name]})").fetchall()}
    assert {c: SPARK_TO_DUCK.get(t, t) for c, t in df.dtypes} == duck_types
    assert len(rows) == len(orows)
    assert _digest(df.columns, rows) == _digest(ocols, orows)


def test_every_query_without_oracle_runs(spark, sf):
    for name in sorted(set(QUERIES) - set(ORACLE)):
        assert QUERIES[name](spark, sf).count() >= 0


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["query_id", "rank", "id", "distance"]
