"""Filters (PF5-PF8): JSON-typed leaves, missing keys, dates, nesting (FIXTURES F4)."""

import datetime as dt

from pyspark.sql import functions as F

from quire.functions.meta import expand_metadata
from quire.operators.predicates import Predicate, apply_filters, metadata_filter

ROWS = [
    (1, '{"category": "Shipping", "price": 150, "created_at": "2024-09-02"}'),
    (2, '{"category": "Services", "price": "200", "created_at": "2024-08-20"}'),
    (3, '{"category": "Shipping", "price": "abc"}'),
    (4, '{"category": null, "price": null}'),
    (5, '{}'),
    (6, '{"category": "Books", "price": 20, "rating": 4.7}'),
]


def _ids(df):
    return sorted(r["id"] for r in df.collect())


def test_leaves_and_missing_keys(spark):
    df = spark.createDataFrame(ROWS, "id int, metadata string")
    f = lambda p: _ids(apply_filters(df, predicates=p))
    assert f(Predicate("price", ">", 100)) == [1, 2]          # numeric text compares as a number
    assert f(Predicate("price", "!=", 150)) == [2, 6]         # missing / null / non-numeric excluded
    assert f(Predicate("category", "!=", "Shipping")) == [2, 6]
    assert f(Predicate("created_at", ">", dt.date(2024, 9, 1))) == [1]
    assert f(Predicate("no_such_key", "==", "x")) == []
    both = (Predicate("category", "==", "Shipping") & Predicate("price", "<", 1000)) | \
           (Predicate("category", "==", "Books") & Predicate("rating", ">=", 4.5))
    assert f(both) == [1, 6]


def test_metadata_filter_dict_and_list(spark):
    df = spark.createDataFrame(ROWS, "id int, metadata string")
    assert _ids(df.filter(metadata_filter({"category": "Shipping"}))) == [1, 3]
    assert _ids(df.filter(metadata_filter({"category": "Shipping", "price": 150}))) == [1]
    assert _ids(df.filter(metadata_filter([{"category": "Books"}, {"category": "Services"}]))) == [2, 6]
    assert _ids(df.filter(metadata_filter({"no_such_key": "x"}))) == []


def test_time_range_bounds(spark):
    rows = [(i, dt.datetime(2024, 9, 1) + dt.timedelta(days=i)) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, ingest_ts timestamp_ntz")
    sept = _ids(apply_filters(df, time=(dt.datetime(2024, 9, 1), dt.datetime(2024, 9, 30))))
    assert sept == list(range(29))                            # end exclusive
    assert _ids(apply_filters(df, time=(dt.datetime(2024, 8, 1), dt.datetime(2024, 8, 30)))) == []
    assert _ids(apply_filters(df, time=(dt.datetime(2024, 10, 8), None))) == list(range(37, 40))


def test_metadata_is_parsed_once(spark):
    df = spark.createDataFrame(ROWS, "id int, metadata string").withColumn("lang", F.lit("de")).withColumn("_parsed", F.lit(0))
    p = (Predicate("price", ">", 100) | Predicate("rating", ">=", 4.5)) & Predicate("category", "!=", "x") & Predicate("lang", "==", "de")
    got = apply_filters(df, filter=[{"category": "Shipping"}, {"category": "Books"}], predicates=p)
    assert got.columns == df.columns and _ids(got) == [1, 6]
    typed = expand_metadata(df, {"category": "string", "price": "double", "rating": "double"}, keep=["id", "_parsed"])
    assert {r["id"]: tuple(r)[1:] for r in typed.collect()}[2] == (0, "Services", 200.0, None)
    for q in (got, typed):
        assert q._jdf.queryExecution().optimizedPlan().toString().lower().count("parsejson") == 1


def test_metadata_values(spark):
    rows = [(1, '{"a b": 1, "it\'s": true, "o": {"x": [1, 2]}, "n": 4.0}'), (2, "not json"), (3, None), (4, ""), (5, "[1]"), (6, '{"n": 1, "n": 2}')]
    df = spark.createDataFrame(rows, "id int, metadata string")
    keys = {"a b": "bigint", "it's": "boolean", "o": "string", "n": "double", "both \"'": "string"}
    got = {r["id"]: tuple(r)[1:] for r in expand_metadata(df, keys, keep=["id"]).collect()}
    assert got == {1: (1, True, '{"x":[1,2]}', 4.0, None), **{i: (None,) * 5 for i in range(2, 7)}}
    assert _ids(apply_filters(df, predicates=Predicate("n", "==", 4))) == [1]
