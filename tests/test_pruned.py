"""Pruned join of many questions: the rows of exact search, and fewer copies of the store (JN1)."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators import search
from quire.operators.pruned import QuestionGroups, nearest_pruned

SMALL = {"max_block_bytes": 1_000, "store_block_bytes": 20_000}


def _rows(df):
    return sorted((r["query_id"], r["rank"], r["id"], round(r["distance"], 9)) for r in df.collect())


def _clustered(spark, n, clusters, spread, seed, dim=8):
    r = np.random.default_rng(seed)
    centers = np.random.default_rng(1).normal(size=(clusters, dim))
    rows = [(f"{i:05d}", (centers[i % clusters] + spread * r.normal(size=dim)).tolist(), dt.datetime(2024, 1, 1 + i % 28), "ab"[i % 2]) for i in range(n)]
    return spark.createDataFrame(rows, "id string, embedding array<double>, ts timestamp_ntz, sender string")


def _questions(spark, n, clusters, spread, seed=5):
    return _clustered(spark, n, clusters, spread, seed).select(F.col("id").cast("bigint").alias("query_id"), "embedding", F.col("sender").alias("s"),
                                                               F.lit(dt.datetime(2024, 1, 5)).alias("a"), F.lit(dt.datetime(2024, 1, 20)).alias("b"))


def test_clustered_vectors_send_few_rows(spark):
    st, q = _clustered(spark, 2_000, 6, 0.05, 2), _questions(spark, 60, 6, 0.05)
    assert _rows(search.nearest(st, q, k=4, prune=True, **SMALL)) == _rows(search.nearest(st, q, k=4))
    g = QuestionGroups(q, "query_id", "embedding", 1_000)
    blocks = -(-60 * g.row_bytes // 1_000)
    first = g.send(st, "embedding")
    hits = search.nearest(st, q, k=4)
    unbound = g.send(st, "embedding", g.reach(hits.limit(0), 4)).select("id", "_g").distinct().count()
    assert unbound == 2_000 * (g.questions.select("_g").distinct().count() - 1)  # no hits, no bound: all other groups
    sent = first.count() + g.send(st, "embedding", g.reach(hits, 4)).count()
    assert sent < 2_000 * blocks / 2


def test_filters_spread_vectors_and_repeats(spark):
    st, q = _clustered(spark, 600, 3, 2.0, 3), _questions(spark, 40, 3, 2.0)
    st = st.unionByName(st.filter("id < '00030'").withColumn("id", F.concat("id", F.lit("x"))))  # equal vectors: ties by id
    qf = search.QuestionFilter(equals=(("sender", "s"),), time_col="ts", start_col="a", end_col="b")
    for f in (None, qf):
        one = search.nearest(st, q, k=5, question_filter=f, payload=["sender"])
        many = search.nearest(st, q, k=5, question_filter=f, payload=["sender"], prune=True, **SMALL)
        assert many.columns == one.columns and _rows(one) == _rows(many) and one.count() == 200


def test_lengths_nulls_and_empty_tables(spark):
    st = spark.createDataFrame([("a", [1.0, 0.1]), ("b", [0.0, 0.0]), ("c", None), ("d", []), ("e", [1.0, 2.0, 3.0]), ("f", [float("nan"), 1.0]), ("g", [-1.0, 0.0]),
                                ("h", [None, 1.0])], "id string, embedding array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [3.0, 2.0, 1.0]), (5, [0.0, 1.0]), (6, []), (7, [1.0, 1.0, 1.0, 1.0])],
                              "query_id bigint, embedding array<double>")
    small = {"max_block_bytes": 80, "store_block_bytes": 80}
    got = _rows(search.nearest(st, q, k=3, prune=True, **small))
    assert got == _rows(search.nearest(st.filter("id <> 'h'"), q, k=3)) and {r[0] for r in got} == {1, 4, 5}
    assert search.nearest(st.limit(0), q, k=3, prune=True, **small).count() == 0
    for none in (q.limit(0), q.filter("query_id IN (3, 6)"), q.filter("query_id = 2")):
        empty = nearest_pruned(st, none, 3, **small)
        assert empty.columns == ["query_id", "distance", "id", "rank"] and empty.count() == 0
    with pytest.raises(Exception, match="embed both the same way"):
        search.nearest(st, q, k=3, prune=True, same_length=True, **small).collect()


def test_one_hot_group_is_many_blocks(spark):
    st, q = _clustered(spark, 300, 1, 0.01, 4), _questions(spark, 200, 1, 0.01)
    g = QuestionGroups(q, "query_id", "embedding", 1_000)
    largest = g.questions.groupBy("_g").count().agg(F.max("count")).first()[0]
    blocks = {r["_g"]: r["_blocks"] for r in g.blocks.collect()}
    assert max(blocks.values()) == -(-largest * g.row_bytes // 1_000)
    assert _rows(search.nearest(st, q, k=2, prune=True, **SMALL)) == _rows(search.nearest(st, q, k=2))
