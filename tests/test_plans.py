"""Physical plan checks: filters reach the scan, weeks prune, top-k limits before the shuffle."""

import datetime as dt

from quire.operators import search
from quire.operators.predicates import Predicate, apply_filters
from quire.operators.store import VectorTable
from quire.plans import catalog, derived


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _physical(df) -> str:
    # the final plan after AQE has run
    df.write.format("noop").mode("overwrite").save()
    return _plan(df)


def test_hot_key_filter_pushed_to_scan(spark, sf):
    s = apply_filters(derived.vector_store(spark, sf), filter={"lang": "de"},
                      predicates=Predicate("source", "!=", "src0"))
    p = s._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,de)" in p or "EqualTo(lang,de)" in p
    assert "Not(EqualTo(source,src0))" in p


def test_time_range_prunes_week_partitions(spark, sf, tmp_dir):
    t = VectorTable(spark, f"{tmp_dir}/store").create(derived.vector_store(spark, sf).drop("embedding"))
    f = apply_filters(t.read(), time=(dt.datetime(2024, 1, 1, 6), dt.datetime(2024, 1, 2)))
    p = _plan(f)
    assert "PartitionFilters: [isnotnull(week_start" in p and "week_start#" in p
    assert "(week_start" in p.split("PartitionFilters:")[1].split("]")[0]
    empty = apply_filters(t.read(), time=(dt.datetime(2024, 8, 1), dt.datetime(2024, 8, 30)))
    assert empty.count() == 0


def test_topk_window_group_limit(spark, sf):
    df = search.nearest(derived.vector_store(spark, sf), derived.label_questions(spark, sf), k=3)
    p = _physical(df)
    assert p.count("WindowGroupLimit") >= 1


def test_single_question_take_ordered(spark, sf):
    p = _plan(catalog.topk_single(spark, sf))
    assert "TakeOrderedAndProject" in p


def test_search_scan_reads_only_needed_columns(spark, sf):
    df = search.nearest(derived.vector_store(spark, sf), derived.label_questions(spark, sf), k=3)
    p = _plan(df)
    docs_scan = [ln for ln in p.splitlines() if "documents.parquet" in ln or "ReadSchema: struct<doc_id" in ln]
    assert all("text" not in ln for ln in docs_scan)


def test_ivf_search_reads_only_probed_cells(spark, sf):
    from quire.operators.ivf import IvfIndex
    from quire.session import scratch_path
    idx = IvfIndex(spark, scratch_path(spark, "ivf-plan")).build(derived.vector_store(spark, sf), n_cells=8)
    hits = search.nearest(idx.read(), derived.label_questions(spark, sf), k=3, probe=idx.probe(2))
    p = _plan(hits)
    part = p.split("PartitionFilters:")[1].split("]")[0]
    assert "cell" in part and " IN " in part.upper()


def test_question_envelope_prunes_weeks(spark, sf, tmp_dir):
    from pyspark.sql import functions as F
    from quire.operators.search import QuestionFilter
    t = VectorTable(spark, f"{tmp_dir}/store2").create(derived.vector_store(spark, sf).select("id", "ingest_ts", "week_start", "lang", "embedding"))
    q = derived.label_questions(spark, sf).select(
        "query_id", "embedding", F.lit(dt.datetime(2024, 1, 1, 6)).cast("timestamp_ntz").alias("s"),
        F.lit(dt.datetime(2024, 1, 2)).cast("timestamp_ntz").alias("e"), F.lit("de").alias("lang_q"))
    qf = QuestionFilter(equals=(("lang", "lang_q"),), time_col="ingest_ts", start_col="s", end_col="e")
    hits = search.nearest(t.read(), q, k=3, question_filter=qf)
    p = _plan(hits)
    part = p.split("PartitionFilters:")[1].split("]")[0]
    assert "week_start" in part
    import contextlib
    import io
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        hits.explain("formatted")
    pushed = [ln for ln in buf.getvalue().splitlines() if ln.startswith("PushedFilters") and "lang" in ln]
    assert pushed and ("In(lang, [de])" in pushed[0] or "EqualTo(lang,de)" in pushed[0])
    assert all(r["rank"] <= 3 for r in hits.collect())
