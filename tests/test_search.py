"""Similarity search properties (JN1, WN1, ST1, SK7)."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators import search
from quire.operators.ivf import IvfIndex
from quire.operators.search import QuestionFilter
from quire.plans import derived
from quire.session import scratch_path


def _rows(df, cols=("query_id", "rank", "id")):
    return [tuple(r[c] for c in cols) for r in df.orderBy(*cols).collect()]


def _store(spark, vecs, extra=None):
    rows = [(i, v, *(extra[i] if extra else ())) for i, v in enumerate(vecs)]
    schema = "id bigint, embedding array<double>" + (", sender string, addressed_to string, ts timestamp_ntz" if extra else "")
    return spark.createDataFrame(rows, schema)


def test_prefix_property(spark, sf):
    s, q = derived.vector_store(spark, sf), derived.label_questions(spark, sf)
    r3 = _rows(search.nearest(s, q, k=3))
    r4 = _rows(search.nearest(s, q, k=4))
    assert r3 == [r for r in r4 if r[1] <= 3]


def test_filter_never_adds_rows(spark, sf):
    s, q = derived.vector_store(spark, sf), derived.label_questions(spark, sf)
    all_ids = {r["id"] for r in search.nearest(s, q, k=1000).collect()}
    some = {r["id"] for r in search.nearest(s.filter("lang = 'en'"), q, k=1000).collect()}
    assert some <= all_ids


def test_zero_and_wrong_length_vectors_excluded(spark):
    st = _store(spark, [[1.0, 0.0], [0.0, 0.0], [1.0, 0.0, 0.0], None, [0.5, 0.5]])
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id bigint, embedding array<double>")
    ids = [r["id"] for r in search.nearest(st, q, k=10).orderBy("rank").collect()]
    assert ids == [0, 4]


def test_ties_break_by_id(spark):
    st = _store(spark, [[0.0, 1.0], [1.0, 0.0], [2.0, 0.0], [3.0, 0.0]])
    q = spark.createDataFrame([(7, [1.0, 0.0])], "query_id bigint, embedding array<double>")
    res = search.nearest(st, q, k=2).orderBy("rank").collect()
    assert [r["id"] for r in res] == [1, 2]
    assert res[0]["distance"] == res[1]["distance"] == 0.0


def test_blocks_equal_single_pass(spark, sf):
    s, q = derived.vector_store(spark, sf), derived.label_questions(spark, sf)
    one = _rows(search.nearest(s, q, k=3))
    many = _rows(search.nearest(s, q, k=3, max_block_bytes=1))  # one question per block
    assert one == many


def test_single_question_sql_equals_kernel(spark, sf):
    s = derived.vector_store(spark, sf)
    v = derived.mean_vector(spark, sf)
    a = [r["id"] for r in search.nearest_one(s, v, k=5).collect()]
    q = spark.createDataFrame([(0, v)], "query_id bigint, embedding array<double>")
    b = [r["id"] for r in search.nearest(s, q, k=5).orderBy("rank").collect()]
    assert a == b


def test_question_filter_or_and_time(spark):
    import datetime as dt
    t = dt.datetime(2024, 1, 10)
    extra = [("Tax", "A", t), ("Health", "B", t), ("Tax", "B", t + dt.timedelta(days=40)), (None, None, t)]
    st = _store(spark, [[1.0, 0.1], [1.0, 0.2], [1.0, 0.3], [1.0, 0.4]], extra)
    qs = spark.createDataFrame([
        (1, [1.0, 0.0], "Tax", None, None, None),
        (2, [1.0, 0.0], "Tax", "B", None, None),
        (3, [1.0, 0.0], None, None, None, None),
        (4, [1.0, 0.0], None, None, dt.datetime(2024, 2, 1), None),
    ], "query_id bigint, embedding array<double>, s string, a string, st timestamp_ntz, en timestamp_ntz")
    qf = QuestionFilter(equals=(("sender", "s"), ("addressed_to", "a")), combine="or", time_col="ts",
                        start_col="st", end_col="en")
    got = {}
    for r in search.nearest(st, qs, k=10, question_filter=qf).collect():
        got.setdefault(r["query_id"], set()).add(r["id"])
    assert got[1] == {0, 2}
    assert got[2] == {0, 1, 2}
    assert got[3] == {0, 1, 2, 3}
    assert got[4] == {2}
    qf_and = QuestionFilter(equals=(("sender", "s"), ("addressed_to", "a")), combine="and")
    got2 = {r["id"] for r in search.nearest(st, qs.filter("query_id = 2"), k=10, question_filter=qf_and).collect()}
    assert got2 == {2}


def test_ivf_recall(spark, sf):
    s, q = derived.vector_store(spark, sf), derived.label_questions(spark, sf)
    exact = {(r["query_id"], r["id"]) for r in search.nearest(s, q, k=5).collect()}
    idx = IvfIndex(spark, scratch_path(spark, "ivf-test")).build(s, n_cells=4)
    full = {(r["query_id"], r["id"]) for r in idx.search(q, k=5, nprobe=4).collect()}
    assert full == exact  # probing every cell is exact
    for strategy in ("broadcast", "grouped"):
        got = {(r["query_id"], r["id"]) for r in idx.search(q, k=5, strategy=strategy).collect()}
        assert got == exact  # by bounds: recall 1.0
    approx = idx.search(q, k=5, nprobe=2).collect()
    assert all(n == 5 for n in np.bincount([r["query_id"] for r in approx]) if n)


def _clusters(n=40, groups=8, dim=6, seed=4):
    rnd = np.random.default_rng(seed)
    centers = rnd.normal(size=(groups, dim))
    return [(g * n + i, "a" if i % 2 else "b", (centers[g] + 0.02 * rnd.normal(size=dim)).tolist()) for g in range(groups) for i in range(n)], centers


def test_cell_bounds_rule_out_cells(spark, tmp_dir):
    """Clustered vectors: the rows of exact search, from fewer cells than there are, and only those cells are read."""
    rows, centers = _clusters()
    df = spark.createDataFrame(rows, "id bigint, tag string, embedding array<double>")
    q = spark.createDataFrame([(i, c.tolist(), "a") for i, c in enumerate(centers[:2])], "query_id bigint, embedding array<double>, q_tag string")
    idx = IvfIndex(spark, f"{tmp_dir}/ivf").build(df, n_cells=8)
    qf = QuestionFilter(equals=(("tag", "q_tag"),))
    for k, kw in ((3, {}), (30, {"question_filter": qf}), (500, {})):  # 30: more than a cell holds
        want = _rows(search.nearest(df, q, k=k, **kw))
        assert _rows(idx.search(q, k=k, strategy="broadcast", **kw).drop("exact")) == want
        assert len(idx.probed) < 8 or k > 3
        assert _rows(idx.search_grouped(q, k=k, rows_per_group=25, questions_per_group=1, **kw)) == want


def test_cells_keep_ties_and_rows_of_every_length(spark, tmp_dir):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(50)] + [(100 + i, [float(i), 1.0, -2.0]) for i in range(50)]
    rows += [(200, [1.0, 1.0]), (201, [2.0, 2.0]), (202, [0.0, 0.0, 0.0]), (203, None), (204, [float("nan"), 1.0, 1.0])]
    df = spark.createDataFrame(rows, "id bigint, embedding array<double>").repartition(4)
    q = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [3.0, 1.0]), (3, [0.0, 0.0, 0.0]), (4, None), (5, [0.0, 1.0, -2.0])], "query_id bigint, embedding array<double>")
    idx = IvfIndex(spark, f"{tmp_dir}/ivf").build(df, n_cells=5)
    want = _rows(search.nearest(df, q, k=4))
    for strategy in ("broadcast", "grouped"):
        assert _rows(idx.search(q, k=4, strategy=strategy).drop("exact")) == want
    assert {r[0] for r in want} == {1, 2, 5}


def test_index_follows_changes(spark, tmp_dir):
    """Upserts and deletes: the rows of exact search over the changed table; only the batch is assigned to cells."""
    rows, centers = _clusters()
    schema = "id bigint, tag string, embedding array<double>"
    df = spark.createDataFrame(rows, schema)
    q = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centers)], "query_id bigint, embedding array<double>")
    idx = IvfIndex(spark, f"{tmp_dir}/ivf").build(df, n_cells=6)
    now = {r[0]: r for r in rows}
    batch = [(i, "new", (-np.array(now[i][2])).tolist()) for i in range(0, 320, 9)] + [(1000 + g, "new", centers[g].tolist()) for g in range(8)]
    gen = idx.upsert(spark.createDataFrame(batch, schema))
    now |= {r[0]: r for r in batch}
    written = spark.read.parquet(f"{tmp_dir}/ivf").groupBy("_gen").count().collect()
    assert {r["_gen"]: r["count"] for r in written} == {0: len(rows), gen: len(batch)}

    def check():
        table = spark.createDataFrame(list(now.values()), schema)
        want = _rows(search.nearest(table, q, k=4))
        assert _rows(idx.search(q, k=4).drop("exact")) == want
        assert not idx.stale(table)

    check()
    assert idx.upsert(spark.createDataFrame(batch, schema), batch=gen) == gen  # the batch again, after a crash: the same generation
    check()
    gone = [0, 9, 1003, 77, 5000]
    idx.delete(spark.createDataFrame([(i,) for i in gone], "id bigint"))
    now = {i: r for i, r in now.items() if i not in gone}
    check()
    idx.upsert(spark.createDataFrame([(77, "back", centers[0].tolist())], schema))
    now[77] = (77, "back", centers[0].tolist())
    check()
    idx.merge()
    assert spark.read.parquet(f"{tmp_dir}/ivf").count() == len(now)
    check()


def test_unfinished_generation_is_not_seen(spark, tmp_dir):
    rows, centers = _clusters()
    df = spark.createDataFrame(rows, "id bigint, tag string, embedding array<double>")
    idx = IvfIndex(spark, f"{tmp_dir}/ivf").build(df, n_cells=4)
    idx._bury(df.select("id"), 1, "id")  # a batch that failed before its statistics
    assert idx.read().count() == len(rows)


def test_hash_embed_counts(spark):
    from quire.operators.embed import hash_embed
    df = spark.createDataFrame([("Hello hello, WORLD!",), ("",), (None,), ("###",)], "t string")
    rows = df.select(hash_embed("t", 16).alias("e")).collect()
    assert sum(rows[0]["e"]) == 3.0 and len(rows[0]["e"]) == 16
    assert rows[1]["e"] is None and rows[2]["e"] is None and rows[3]["e"] is None
    unit = df.select(hash_embed("t", 16, unit=True).alias("e")).first()["e"]
    assert abs(sum(x * x for x in unit) - 1.0) < 1e-6          # float32 by default
    unit64 = df.select(hash_embed("t", 16, unit=True, double=True).alias("e")).first()["e"]
    assert abs(sum(x * x for x in unit64) - 1.0) < 1e-12


def test_embed_batches_user_callable(spark):
    from quire.operators.embed import embed_batches
    def fn(texts):  # runs on the workers, once per Arrow batch
        return np.array([[len(t), 1.0] for t in texts])

    df = spark.createDataFrame([("a\nb",), ("ccc",), (None,)], "t string").coalesce(1)
    out = embed_batches(df, "t", fn, dim=2).collect()
    assert [r["embedding"] for r in out] == [[3.0, 1.0], [3.0, 1.0], None]


def test_hash_embed_matches_sql_token_rule(spark, sf):
    """The vectorised embedder and the SQL token/bucket expressions agree on whole documents."""
    from quire.operators.embed import hash_embed, token_buckets
    from quire.sources.tables import table
    docs = table(spark, sf, "documents").select("doc_id", "text")
    a = docs.select("doc_id", hash_embed("text", 64).alias("e"))
    b = docs.select("doc_id", token_buckets("text", 64).alias("b"))
    got = {r["doc_id"]: r["e"] for r in a.collect()}
    for r in b.collect():
        counts = [0.0] * 64
        for x in r["b"] or []:
            counts[x] += 1.0
        assert got[r["doc_id"]] == (counts if any(counts) else None)


def test_identical_vectors_tie_break_by_id(spark):
    """A store where most rows are the same vector: exactly k rows, smallest ids."""
    rows = [(i, [1.0, 2.0]) for i in range(5000)] + [(5000 + i, [2.0, -1.0]) for i in range(10)]
    st = spark.createDataFrame(rows, "id bigint, embedding array<double>").repartition(4)
    q = spark.createDataFrame([(1, [1.0, 2.0])], "query_id bigint, embedding array<double>")
    res = search.nearest(st, q, k=3).orderBy("rank").collect()
    assert [r["id"] for r in res] == [0, 1, 2]


def test_ivf_ensure_and_drop(spark, sf):
    s = derived.vector_store(spark, sf)
    idx = IvfIndex(spark, scratch_path(spark, "ivf-ensure"))
    assert not idx.exists()
    idx.ensure(s, n_cells=4)
    assert idx.exists()
    idx.ensure(s, n_cells=4)  # already there: nothing rebuilt, no error
    idx.drop()
    assert not idx.exists()


def test_ivf_grouped_equals_broadcast_probe(spark, sf):
    s, q = derived.vector_store(spark, sf), derived.label_questions(spark, sf)
    idx = IvfIndex(spark, scratch_path(spark, "ivf-grouped")).build(s, n_cells=4)
    a = {(r["query_id"], r["rank"], r["id"]) for r in idx.search(q, k=5, nprobe=2, fallback=False).collect()}
    b = {(r["query_id"], r["rank"], r["id"]) for r in idx.search_grouped(q, k=5, nprobe=2, rows_per_group=7).collect()}
    assert a == b  # same probes, same candidates; cells split into many (cell, sub) groups


def test_select_top_k_ties():
    from quire.operators.search import select_top_k
    dist = np.array([[0.1, 0.1, 0.1, 0.5, np.inf], [0.3, 0.2, np.inf, 0.2, 0.9]])
    qi, di = select_top_k(dist, np.array([9, 3, 5, 1, 2]), 2)
    got = {(int(a), int(b)) for a, b in zip(qi, di)}
    assert got == {(0, 1), (0, 2), (1, 1), (1, 3)}


def test_int_and_string_question_ids(spark):
    st = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [1.0, 1.0])], "id string, embedding array<double>")
    q1 = spark.createDataFrame([(1, [1.0, 0.1])], "query_id int, embedding array<double>")
    q2 = spark.createDataFrame([("q", [0.1, 1.0])], "query_id string, embedding array<double>")
    assert [r["id"] for r in search.nearest(st, q1, k=2).orderBy("rank").collect()] == ["a", "c"]
    assert [r["id"] for r in search.nearest(st, q2, k=2).orderBy("rank").collect()] == ["b", "c"]


def test_ivf_grouped_skips_bad_questions(spark, sf):
    s = derived.vector_store(spark, sf)
    idx = IvfIndex(spark, scratch_path(spark, "ivf-badq")).build(s, n_cells=4)
    good = derived.label_questions(spark, sf)
    bad = spark.createDataFrame([(100, [1.0, 2.0]), (101, None)], "query_id bigint, embedding array<double>")
    res = idx.search_grouped(good.unionByName(bad), k=3, nprobe=2).collect()
    assert {r["query_id"] for r in res} == {r["query_id"] for r in good.collect()}


def test_wrong_length_first_question_does_not_empty_the_result(spark):
    st = _store(spark, [[1.0, 0.1, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]], [("Tax", "A", None)] * 3)
    qs = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, None), (4, [0.0, 0.0, 0.0])], "query_id bigint, embedding array<double>")
    for kw in ({}, {"max_block_bytes": 1}):
        got = search.nearest(st, qs, k=2, **kw).collect()
        assert {r["query_id"] for r in got} == {2} and len(got) == 2


@pytest.mark.parametrize("blocks", [{}, {"max_block_bytes": 1, "store_block_bytes": 1}])
def test_same_length_raises_at_every_size(spark, blocks):
    st = _store(spark, [[1.0, 0.1, 0.0], [0.0, 1.0, 0.0]], [("Tax", "A", None)] * 2)
    qs = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "query_id bigint, embedding array<double>")
    with pytest.raises(Exception, match="embed both the same way"):
        search.nearest(st, qs, k=1, same_length=True, **blocks).collect()


def test_question_blocks_keep_filters_and_pushdown(spark, tmp_dir):
    """Many blocks over a stored table: the same rows, one file scan per side, the weeks pruned, no checkpointed store."""
    import datetime as dt
    import random
    from quire.operators.store import VectorTable
    r = random.Random(2)
    rows = [(f"{i:04d}", dt.datetime(2024, 1, 1) + dt.timedelta(days=i % 60), r.choice(["Tax", "Health", None]), [r.random() for _ in range(4)]) for i in range(600)]
    df = spark.createDataFrame(rows, "id string, ingest_ts timestamp_ntz, sender string, embedding array<double>")
    t = VectorTable(spark, f"{tmp_dir}/vt").create(df.selectExpr("*", "to_date(date_trunc('week', ingest_ts)) AS week_start"))
    qs = [(i, [r.random() for _ in range(4)], r.choice(["Tax", "Health"]), dt.datetime(2024, 1, 8), dt.datetime(2024, 1, 20 + i % 5)) for i in range(40)]
    spark.createDataFrame(qs, "query_id bigint, embedding array<double>, q_sender string, a timestamp_ntz, b timestamp_ntz").write.parquet(f"{tmp_dir}/q")
    q = spark.read.parquet(f"{tmp_dir}/q")
    qf = search.QuestionFilter(equals=(("sender", "q_sender"),), time_col="ingest_ts", start_col="a", end_col="b")
    one = search.nearest(t.read(), q, k=3, question_filter=qf)
    many = search.nearest(t.read(), q, k=3, question_filter=qf, max_block_bytes=800, store_block_bytes=4_000)
    assert _rows(one) == _rows(many) and one.count() > 60
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert "Scan ExistingRDD" not in plan and plan.count("FileScan parquet") == 2
    assert "week_start" in plan.split("PartitionFilters:")[1].split("]")[0] or "week_start" in plan.split("PartitionFilters:")[2].split("]")[0]


def test_ivf_filters_zero_vectors_and_staleness(spark, tmp_dir):
    import random
    from quire.operators.ivf import IvfIndex
    r = random.Random(3)
    rows = [(f"{i:03d}", "Tax" if i % 2 else "Health", [r.random() - 0.5 for _ in range(4)]) for i in range(200)]
    rows += [("zero", "Tax", [0.0] * 4), ("short", "Tax", [1.0]), ("none", "Tax", None)]
    df = spark.createDataFrame(rows, "id string, sender string, embedding array<double>")
    idx = IvfIndex(spark, f"{tmp_dir}/ivf").build(df, n_cells=4)
    assert idx.skipped == 3
    q = spark.createDataFrame([(i, [r.random() - 0.5 for _ in range(4)], "Tax") for i in range(5)], "query_id bigint, embedding array<double>, q_sender string")
    qf = search.QuestionFilter(equals=(("sender", "q_sender"),))
    full = df.filter("size(embedding) = 4")
    for where, kw in ((None, {"question_filter": qf}), (F.col("sender") == "Tax", {})):
        want = _rows(search.nearest(full.filter("sender = 'Tax'"), q.drop("q_sender"), k=4))
        for strategy in ("broadcast", "grouped"):
            assert _rows(idx.search(q, k=4, nprobe=4, strategy=strategy, where=where, fallback=False, **kw).drop("exact")) == want
    small = idx.search_grouped(q, k=4, nprobe=4, question_filter=qf, rows_per_group=20, questions_per_group=2)
    assert _rows(small) == want
    top = idx.search(q, k=1, nprobe=4).first()["id"]
    assert not idx.stale(df)
    less = df.filter(F.col("id") != top)
    assert idx.stale(less)
    assert top not in {x["id"] for x in idx.ensure(less, 4).search(q, k=5, nprobe=4).collect()}
