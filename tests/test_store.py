"""Vector table maintenance (SK5-SK10, JN2, AG1) on a written, week-partitioned table."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quire.operators import store as vs
from quire.operators.store import VectorTable

SCHEMA = "id string, ingest_ts timestamp_ntz, week_start date, metadata string, contents string, seq int"


def _rows(spark, items):
    out = []
    for i, day, meta, seq in items:
        ts = dt.datetime(2024, 1, day, 10)
        out.append((i, ts, (ts - dt.timedelta(days=ts.weekday())).date(), meta, f"text {i} v{seq}", seq))
    return spark.createDataFrame(out, SCHEMA)


def _state(t):
    return sorted((r["id"], r["contents"]) for r in t.read().collect())


def test_upsert_update_ignore_and_idempotent(spark, tmp_dir):
    t = VectorTable(spark, f"{tmp_dir}/vt")
    assert t.count() == 0 and not t.exists()
    t.upsert(_rows(spark, [("a", 1, '{"category": "x"}', 1), ("b", 9, '{"category": "y"}', 1)]).drop("seq"))
    assert t.count() == 2
    new = _rows(spark, [("a", 16, '{"category": "x"}', 2), ("c", 2, "{}", 1), ("c", 2, "{}", 3)])
    t.upsert(new, seq_col="seq")
    once = _state(t)
    assert once == [("a", "text a v2"), ("b", "text b v1"), ("c", "text c v3")]
    t.upsert(new, seq_col="seq")
    assert _state(t) == once  # upsert twice = upsert once
    t.upsert(_rows(spark, [("b", 9, "{}", 5)]).drop("seq"), on_conflict="ignore")
    assert ("b", "text b v1") in _state(t)
    # the week that lost its only row ('a' moved from week 1 to week 3) holds nothing stale
    weeks = {r["week_start"] for r in t.read().select("week_start").distinct().collect()}
    assert dt.date(2024, 1, 1) in weeks  # 'c' lives there now


def test_delete_variants(spark, tmp_dir):
    t = VectorTable(spark, f"{tmp_dir}/vt2")
    t.create(_rows(spark, [("a", 1, '{"category": "x"}', 1), ("b", 9, '{"category": "y"}', 1),
                           ("c", 16, '{"other": 1}', 1)]).drop("seq"))
    t.delete(ids=["a"])
    assert [r["id"] for r in t.read().collect()] and "a" not in {r["id"] for r in t.read().collect()}
    assert t.contains(spark.createDataFrame([("a",), ("b",)], "id string")).orderBy("id").collect()[0]["exists"] is False
    assert {r["id"]: r["exists"] for r in t.contains(["a", "b"]).collect()} == {"a": False, "b": True}
    t.delete(metadata_filter={"category": "y"})
    assert {r["id"] for r in t.read().collect()} == {"c"}  # row without the key stays
    t.delete(delete_all=True)
    assert t.count() == 0
    with pytest.raises(ValueError):
        t.delete()
    with pytest.raises(ValueError):
        t.delete(ids=["a"], delete_all=True)
    with pytest.raises(ValueError):
        t.delete(ids=[], metadata_filter={})


def test_frame_ops(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    new = spark.createDataFrame([("b", 20), ("c", 30)], "id string, v int")
    up = sorted(tuple(r) for r in vs.merge_upsert(old, new).collect())
    ig = sorted(tuple(r) for r in vs.merge_upsert(old, new, on_conflict="ignore").collect())
    assert up == [("a", 1), ("b", 20), ("c", 30)]
    assert ig == [("a", 1), ("b", 2), ("c", 30)]
    ex = {r["id"]: r["exists"] for r in vs.flag_existing(new.select("id"), old).collect()}
    assert ex == {"b": True, "c": False}
    assert sorted(r["id"] for r in vs.remove_matching(old, F.col("v") > 1).collect()) == ["a"]


def test_dedupe_hot_key_last_wins(spark):
    rows = [("hot", i, f"v{i}") for i in range(3000)] + [("cold", 1, "c")]
    df = spark.createDataFrame(rows, "id string, seq int, v string").repartition(8)
    got = {r["id"]: (r["seq"], r["v"]) for r in vs.dedupe_last(df, "id", "seq").collect()}
    assert got == {"hot": (2999, "v2999"), "cold": (1, "c")}


def test_rows_without_a_week(spark, tmp_dir):
    def rows(items):
        return spark.createDataFrame([(i, dt.datetime(2024, 1, 3) if dated else None, dt.date(2024, 1, 1) if dated else None, "{}", f"text {i} {v}") for i, dated, v in items],
                                     "id string, ingest_ts timestamp_ntz, week_start date, metadata string, contents string")
    t = VectorTable(spark, f"{tmp_dir}/vt3").create(rows([("a", False, 1), ("b", True, 1), ("d", False, 1)]))
    t.upsert(rows([("c", False, 1)]))
    assert _state(t) == [("a", "text a 1"), ("b", "text b 1"), ("c", "text c 1"), ("d", "text d 1")]
    t.upsert(rows([("a", True, 2), ("b", False, 2)]))
    assert _state(t) == [("a", "text a 2"), ("b", "text b 2"), ("c", "text c 1"), ("d", "text d 1")]
    t.delete(ids=["b", "c"])
    assert _state(t) == [("a", "text a 2"), ("d", "text d 1")]
    t.delete(metadata_filter=[{"id": "d"}])
    assert _state(t) == [("a", "text a 2")]  # the folder of the rows without a week is gone


def test_few_files_per_week(spark, tmp_dir):
    import glob
    df = spark.range(4000).repartition(40).select(
        F.col("id").cast("string").alias("id"), F.expr("timestamp_ntz'2024-01-01' + make_interval(0, 0, cast(id % 40 as int))").alias("ingest_ts"))
    df = df.withColumn("week_start", F.to_date(F.date_trunc("week", "ingest_ts")))
    VectorTable(spark, f"{tmp_dir}/vt4").create(df)
    assert len(glob.glob(f"{tmp_dir}/vt4/week_start=*/*.parquet")) <= 40 * vs.WEEK_FILES


def test_ids_with_their_week_read_no_other_week(spark, tmp_dir):
    import glob
    t = VectorTable(spark, f"{tmp_dir}/vt5")
    undated = _rows(spark, [("n", 1, "{}", 1)]).withColumn("week_start", F.lit(None).cast("date"))
    t.create(_rows(spark, [("a", 1, "{}", 1), ("b", 2, "{}", 1), ("c", 9, "{}", 1), ("d", 16, "{}", 1)]).unionByName(undated).drop("seq"))
    whole = {p: open(p, "rb").read() for p in glob.glob(f"{tmp_dir}/vt5/week_start=2024-01-15/*.parquet")}
    for p in whole:  # a week nobody names can no longer be read
        with open(p, "wb") as f:
            f.write(b"x" * 100)
    # 'c' of the first week is another row than 'c' of the second; the batch's last row of a key wins
    new = _rows(spark, [("a", 1, "{}", 2), ("a", 1, "{}", 3), ("c", 2, "{}", 4), ("c", 9, "{}", 5)])
    t.upsert(new.unionByName(undated.selectExpr("id", "ingest_ts", "week_start", "metadata", "'text n v2' AS contents", "2 AS seq")), seq_col="seq", id_in_week=True)
    with pytest.raises(Exception):
        t.upsert(new, seq_col="seq")
    t.upsert(_rows(spark, [("b", 2, "{}", 9), ("e", 9, "{}", 1)]).drop("seq"), on_conflict="ignore", id_in_week=True)
    t.upsert(_rows(spark, [("b", 2, "{}", 9)]).drop("seq").withColumn("metadata", F.lit("new")), keep_stored=("contents",), id_in_week=True)
    t.delete(ids=spark.createDataFrame([("c", dt.date(2024, 1, 1)), ("e", dt.date(2024, 1, 1)), ("z", dt.date(2023, 1, 2))], "id string, week_start date"), id_in_week=True)
    for p, data in whole.items():
        with open(p, "wb") as f:
            f.write(data)
    assert _state(t) == [("a", "text a v3"), ("b", "text b v1"), ("c", "text c v5"), ("d", "text d v1"), ("e", "text e v1"), ("n", "text n v2")]
    assert t.read().filter("id = 'b'").first()["metadata"] == "new"
    t.delete(ids=spark.createDataFrame([("n", None)], "id string, week_start date"), id_in_week=True)
    assert "n" not in dict(_state(t))
    for ids in (["a"], spark.createDataFrame([("a",)], "id string")):
        with pytest.raises(ValueError):
            t.delete(ids=ids, id_in_week=True)
