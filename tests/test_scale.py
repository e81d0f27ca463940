"""What must not grow with the tables: broadcasts, rows a file, cells, training rows, memory of a batch."""

from quire.operators import rag
from quire.plans import derived


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_customers_are_never_broadcast(spark, sf):
    for df in (derived.doc_records(spark, sf), derived.raw_records(spark, sf), derived.broken_records(spark, sf), derived.questions(spark, sf)):
        assert "BroadcastExchange" not in _plan(df)
    assert derived.doc_records(spark, sf).count() == spark.read.parquet(f"{sf}/orders.parquet").count()


def test_actions_are_not_built_to_be_replaced(spark, sf):
    bad = derived.broken_records(spark, sf)
    assert "Treasury" in _plan(derived.doc_records(spark, sf)) and "Treasury" not in _plan(bad)
    assert bad.filter(~bad["record"].contains('"required_actions":[')).count() == 0


def test_runs_of_words_and_names_are_never_broadcast(spark, tmp_dir):
    q = spark.createDataFrame([(i, f"a letter for Anna Maria {i}, please?") for i in range(50)] + [(None, "for 7"), (3, None)], "query_id bigint, question string")
    names = spark.createDataFrame([(f"Anna Maria {i}",) for i in range(0, 50, 2)] + [("7",), ("7",), (None,)], "name string")
    q.write.parquet(f"{tmp_dir}/q")  # tables of a known, small size
    names.write.parquet(f"{tmp_dir}/names")
    found = rag.named_in_questions(spark.read.parquet(f"{tmp_dir}/q"), spark.read.parquet(f"{tmp_dir}/names"))
    assert "BroadcastExchange" not in _plan(found)
    got = sorted((r["query_id"] is None, r["query_id"], r["name"]) for r in found.collect())
    assert got == sorted([(False, i, f"Anna Maria {i}") for i in range(0, 50, 2)] + [(False, 7, "7"), (True, None, "7")])


def test_files_of_a_week_grow_with_its_rows(spark, tmp_dir, monkeypatch):
    from pyspark.sql import functions as F

    from quire.operators import store
    monkeypatch.setattr(store, "FILE_ROWS", 20)
    rows = spark.range(1_000).select("id", F.expr("IF(id < 990, DATE '2024-01-01', IF(id < 995, DATE '2024-01-08', NULL))").alias("week_start"))
    t = store.VectorTable(spark, f"{tmp_dir}/t")
    t.upsert(rows)
    t.upsert(rows.filter("id % 2 = 0").unionByName(rows.limit(1)))
    files = t.read().select("id", "week_start", F.col("_metadata.file_path").alias("f"))
    sizes = {r["week_start"]: (r["n"],) for r in files.groupBy("week_start", "f").count().groupBy("week_start").agg(F.count("*").alias("n")).collect()}
    (large,) = [v for k, v in sizes.items() if str(k) == "2024-01-01"]
    assert large[0] > 2 * store.WEEK_FILES and len(sizes) == 3
    assert sorted((r["id"], str(r["week_start"])) for r in t.read().collect()) == sorted((r["id"], str(r["week_start"])) for r in rows.collect())


def test_cells_and_training_rows_are_bounded(spark, tmp_dir, monkeypatch):
    from pyspark.ml.clustering import KMeans
    from pyspark.sql import functions as F

    from quire.operators import ivf
    assert ivf.cells_for(100_000_000, 64) <= 1_024
    trained, fit = [], KMeans.fit
    monkeypatch.setattr(KMeans, "fit", lambda self, df, *a: (trained.append(df.count()), fit(self, df, *a))[1])
    monkeypatch.setattr(ivf, "TRAIN_ROWS", 200)
    rows = spark.range(2_000).select("id", F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.cos(F.col("id") * (i + 1)) + 0.01).alias("embedding"))
    idx = ivf.IvfIndex(spark, f"{tmp_dir}/ivf").build(rows)
    assert 100 < trained[0] < 400 and idx.read().count() == 2_000
    assert idx.signature(idx.read()) == idx.signature(rows) and not idx.stale(rows)


def test_folders_are_listed_by_few_tasks(spark, tmp_dir):
    from pyspark.sql import functions as F

    from quire.sources import pages
    spark.range(120).select("id", F.concat(F.lit("text "), F.col("id").cast("string")).alias("value")).write.partitionBy("id").text(f"{tmp_dir}/in")
    before, asked = spark.conf.get(pages.LISTING, None), []
    spark.sparkContext.setJobGroup("listing", "listing")
    got = pages.read_files(spark, f"{tmp_dir}/in", recursive=True)
    tracker = spark.sparkContext.statusTracker()
    for job in tracker.getJobIdsForGroup("listing"):
        asked += [tracker.getStageInfo(s).numTasks for s in tracker.getJobInfo(job).stageIds if tracker.getStageInfo(s)]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got.count() == 120 and spark.conf.get(pages.LISTING, None) == before
    assert asked and max(asked) <= pages.LISTING_TASKS * spark.sparkContext.defaultParallelism


def test_token_counts_are_made_in_small_slices(monkeypatch):
    import pyarrow as pa

    from quire.operators import embed
    texts = pa.array(["a b", None, "", "x " * 50, "c"] * 40)
    whole = embed._counts(texts, 16, False)
    monkeypatch.setattr(embed, "SLICE_ROWS", 7)
    monkeypatch.setattr(embed, "SLICE_BYTES", 60)
    parts = embed._slices(texts)
    assert len(parts) > 1 and max(len(p) for p in parts) <= 7
    assert pa.concat_arrays([embed._counts(p, 16, False) for p in parts]).equals(whole)
    assert [len(p) for p in embed._slices(texts.slice(0, 0))] == [0]
    assert embed._counts_udf(16, False, False).func(texts).equals(whole)


def test_full_probe_indexes_only_what_it_searches(spark, sf, monkeypatch):
    from quire.operators.ivf import IvfIndex
    from quire.plans import catalog
    seen, build = [], IvfIndex.build
    monkeypatch.setattr(IvfIndex, "build", lambda self, store, *a, **kw: (seen.append(store.columns), build(self, store, *a, **kw))[1])
    assert catalog.ann_full_probe(spark, sf).count() > 0
    assert seen == [["id", "lang", "embedding"]]


def test_tile_of_scores_is_small():
    from quire.operators import search
    assert search.TILE_ELEMENTS * 8 <= 8 << 20  # bytes of one of its arrays


def test_next_document_without_a_join_of_all_rows(spark):
    from pyspark.sql import functions as F

    from quire.llm import imatch
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(40)] + [(7, "t7"), (None, "none")], "_id bigint, _text string")
    d = imatch.with_next(rows, 5, lambda df: df.withColumn("_n", F.length("_text")))
    assert "Join" not in _plan(d).split("Union")[0]  # above the rows and the copies
    got = d.select("_id", "_n", "_next._id", "_next._n").toDF("id", "n", "next", "next_n").collect()
    follows = sorted((r["id"] if r["id"] is not None else -1, r["next"] if r["next"] is not None else -1) for r in got)
    assert follows == sorted([(i, i - 1) for i in range(40)] + [(7, 7), (-1, 39)])
    assert all(r["n"] == (len(f"t{r['id']}") if r["id"] is not None else 4) for r in got) and {r["next_n"] for r in got} == {2, 3, 4}


def _kept(spark) -> set:
    """Files of rows that a step left in the shared checkpoint folder, and of shuffles."""
    import glob
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    files = glob.glob(f"{folder}/**/*part-*", recursive=True) + [f for d in dirs for f in glob.glob(f"{d.getPath()}/*/shuffle_*.data")]
    return {f for f in files if "quire-pyfiles" not in f}


def _nothing_more(spark, before: set) -> bool:
    import time
    for _ in range(50):  # Spark removes shuffle files without waiting for it
        if not _kept(spark) - before:
            return True
        time.sleep(0.2)
    return False


def _vectors(spark, ids, week, dim=4):
    from pyspark.sql import functions as F
    rows = spark.range(*ids).select(F.col("id").cast("string").alias("id"), F.to_date(F.lit(week)).alias("week_start"), F.concat(F.lit("text "), "id").alias("contents"),
                                    F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.cos(F.col("id") * (i + 1)).cast("float")).alias("embedding"))
    return rows.repartition(4, "contents")


def test_an_upsert_leaves_no_file_but_the_tables(spark, tmp_dir):
    import glob

    from quire.operators import store
    t, before = store.VectorTable(spark, f"{tmp_dir}/t"), _kept(spark)
    t.upsert(_vectors(spark, (0, 100), "2024-01-01"))
    t.upsert(_vectors(spark, (50, 150), "2024-01-08"))
    t.upsert(_vectors(spark, (140, 160), "2024-01-15"), keep_stored=("week_start",))
    t.upsert(_vectors(spark, (0, 10), "2024-01-22"), on_conflict="ignore")
    t.delete(metadata_filter={"id": "7"})
    assert _nothing_more(spark, before)
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    weeks = {r["week_start"].day: r["n"] for r in t.read().groupBy("week_start").agg({"id": "count"}).toDF("week_start", "n").collect()}
    assert weeks == {1: 49, 8: 100, 15: 10}
    files = glob.glob(f"{tmp_dir}/t/*/*.parquet")
    assert files and all(f.endswith(".zstd.parquet") for f in files)


def test_an_index_that_follows_an_upsert_leaves_no_copy(spark, tmp_dir):
    from quire.operators import ivf
    idx, before = ivf.IvfIndex(spark, f"{tmp_dir}/ivf").build(_vectors(spark, (1, 100), "2024-01-01"), n_cells=3), _kept(spark)
    idx.upsert(_vectors(spark, (50, 150), "2024-01-08"))
    assert not [f for f in _kept(spark) - before if "shuffle_" not in f]  # it reads its statistics, a row per cell, by small shuffles
    assert idx.read().count() == 149


def test_a_stream_into_a_table_leaves_no_copy(spark, tmp_dir):
    import json

    from pyspark.sql import functions as F

    from quire.operators.records import write_records
    from quire.operators.store import VectorTable
    from quire.schemas import DOC
    from quire.streaming.ingest import run_ingest
    action = {"action_type": "no_action"}
    rec = {"title_in_original_language": "T", "title_in_english": "Notice", "sender": "Tax", "sent_date": "2024-01-03", "addressed_to": "Sam",
           "content_in_original_language": "x", "content_in_english": "y", "summary_in_english": "s", "required_actions": [action]}
    docs = spark.range(60).select(F.from_json(F.lit(json.dumps(rec)), DOC).alias("r"), "id").select("r.*", "id")
    docs = docs.withColumn("summary_in_english", F.col("id").cast("string")).withColumn("sender", F.when(F.col("id") % 3 == 0, "Bank").otherwise(F.col("sender"))).drop("id")
    before = _kept(spark)
    write_records(docs.repartition(2, "summary_in_english"), f"{tmp_dir}/in", compression="gzip", maxRecordsPerFile=20)
    for n in range(2):  # the second is a replay
        run_ingest(spark, f"{tmp_dir}/in", f"{tmp_dir}/t", f"{tmp_dir}/ck{n}", f"{tmp_dir}/rejects").awaitTermination()
    assert _nothing_more(spark, before)
    assert VectorTable(spark, f"{tmp_dir}/t").read().count() == 40
    bad = spark.read.parquet(f"{tmp_dir}/rejects")
    assert {r["reason"] for r in bad.collect()} == {"sender outside domain"} and bad.filter("record LIKE '{%\"Bank\"%}' AND source LIKE '%.gz'").count() == 20


def test_texts_for_a_stream_are_packed(spark, sf):
    import glob

    from quire.plans import catalog
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    seen = set(glob.glob(f"{folder}/quire-*-src-*/part-*"))
    catalog.stream_ingest(spark, sf)
    catalog.stream_rejects(spark, sf)
    new = set(glob.glob(f"{folder}/quire-*-src-*/part-*")) - seen
    assert new and all(f.endswith(".gz") for f in new)
