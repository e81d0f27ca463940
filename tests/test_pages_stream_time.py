"""Page extraction (SR1/SR2), streaming (SM1/SM2) and time functions (SC3-SC7, SC17)."""

import datetime as dt
import json
import os
import uuid

from pyspark.sql import functions as F

from quire.functions import times
from quire.operators import assembly
from quire.operators.store import VectorTable
from quire.plans import catalog, derived
from quire.sources import pages
from quire.streaming.fold import read_latest, run_fold
from quire.streaming.ingest import run_ingest


def _write(path, data: bytes):
    with open(path, "wb") as f:
        f.write(data)


def test_extract_pages_and_text(spark, tmp_dir):
    d = os.path.join(tmp_dir, "files")
    os.makedirs(d)
    _write(f"{d}/a.txt", "page one\fpage two\fpage three".encode())
    _write(f"{d}/b.txt", b"FAIL\fonly good page")
    _write(f"{d}/c.txt", b"FAIL\fFAIL")
    _write(f"{d}/e.txt", b"%NOPAGES")  # a file the extractor opens but finds no page in

    def extract(content):
        parts = content.decode().split("\f") if content != b"%NOPAGES" else []

        def page(t):
            def run():
                if t == "FAIL":
                    raise RuntimeError("unreadable")
                return t
            return run
        return [page(t) for t in parts]

    files = pages.read_files(spark, d, glob="*.txt")
    txt = {os.path.basename(r["doc_id"]): r for r in pages.extract_text(files, extract).collect()}
    assert txt["a.txt"]["text"] == "page one\npage two\npage three"
    assert txt["b.txt"]["text"] == "only good page" and txt["b.txt"]["n_failed"] == 1
    assert txt["c.txt"]["text"] == ""          # every page failed
    assert txt["e.txt"]["text"] is None         # no pages at all
    pg = pages.extract_pages(files, extract)
    errs = pg.filter(F.col("error").isNotNull()).count()
    assert errs == 3
    # assembling the page table gives the same texts, in page order whatever the row order
    shuffled = pg.orderBy(F.rand(3))
    asm = {os.path.basename(r["doc_id"]): r["text"] for r in assembly.assemble_pages(shuffled).collect()}
    assert asm["a.txt"] == txt["a.txt"]["text"] and asm["c.txt"] == ""


def test_assemble_with_document_list(spark):
    p = spark.createDataFrame([("x", 2, "b", None), ("x", 1, "a", None), ("y", 1, None, "err")],
                              "doc_id string, page_no int, text string, error string")
    docs = spark.createDataFrame([("x",), ("y",), ("z",)], "doc_id string")
    got = {r["doc_id"]: r["text"] for r in assembly.assemble_pages(p, docs).collect()}
    assert got == {"x": "a\nb", "y": "", "z": None}


def test_stream_fold_equals_batch(spark, sf, tmp_dir):
    run_fold(spark, f"{sf}/conversations.parquet", "conv_id bigint, turn bigint, role string, text string",
             f"{tmp_dir}/out", f"{tmp_dir}/ck", rename={"conv_id": "doc_id", "turn": "seq", "text": "record"}).awaitTermination()
    s = sorted(tuple(r) for r in read_latest(spark, f"{tmp_dir}/out").select("doc_id", "seq", "record").collect())
    b = sorted(tuple(r) for r in assembly.last_partial(derived.conversation_partials(spark, sf)).collect())
    assert s == b


def test_stream_reads_a_table_of_one_file_or_of_a_folder(spark, sf, tmp_dir):
    spark.read.parquet(f"{sf}/conversations.parquet").repartition(3).write.parquet(f"{tmp_dir}/conversations.parquet")
    rows = []
    for d in (sf, tmp_dir):
        rows.append({f.__name__: sorted(tuple(r) for r in f(spark, d).collect()) for f in (catalog.stream_last_partial, catalog.stream_fold_state)})
    assert rows[0] == rows[1] and rows[0]["stream_fold_state"] == rows[0]["stream_last_partial"] and rows[0]["stream_fold_state"]


def test_stream_ingest_replay_is_idempotent(spark, tmp_dir):
    src = os.path.join(tmp_dir, "in")
    os.makedirs(src)
    rec = {"title_in_original_language": "T", "title_in_english": "Tax notice", "sender": "Tax", "sent_date": "2024-01-03",
           "addressed_to": "Sam", "content_in_original_language": "x", "content_in_english": "please reply",
           "summary_in_english": "s", "required_actions": [{"action_type": "no_action"}]}
    with open(f"{src}/1.json", "w") as f:
        json.dump(rec, f)
    with open(f"{src}/2.json", "w") as f:
        json.dump(dict(rec, sender="Bank"), f)
    tpath, rej = f"{tmp_dir}/table", f"{tmp_dir}/rejects"
    run_ingest(spark, src, tpath, f"{tmp_dir}/ck1", rej).awaitTermination()
    t = VectorTable(spark, tpath)
    first = sorted(r["id"] for r in t.read().collect())
    assert len(first) == 1
    assert spark.read.parquet(rej).first()["reason"] == "sender outside domain"
    run_ingest(spark, src, tpath, f"{tmp_dir}/ck2", rej).awaitTermination()  # a full replay
    assert sorted(r["id"] for r in t.read().collect()) == first
    assert spark.read.parquet(rej).count() == 1
    with open(f"{src}/3.json", "w") as f:
        f.write("{broken")
    run_ingest(spark, src, tpath, f"{tmp_dir}/ck2", rej).awaitTermination()  # the next batch
    assert sorted((r["_batch"], r["reason"]) for r in spark.read.parquet(rej).collect()) == [(0, "sender outside domain"), (1, "unparseable")]


def test_time_functions(spark):
    u = uuid.uuid1()
    ref = dt.datetime(1582, 10, 15) + dt.timedelta(microseconds=u.time // 10)
    df = spark.createDataFrame([(str(u), "2024-07-01T10:00:00+02:00", "2024-07-01T10:00:00", "bad",
                                 dt.datetime(2024, 7, 1, 10), dt.datetime(2024, 1, 10, 10))],
                               "u string, off string, plain string, bad string, summer timestamp_ntz, winter timestamp_ntz")
    r = df.select(times.uuid_v1_time("u").alias("t"), times.parse_iso("off").alias("o"), times.parse_iso("plain").alias("p"),
                  times.parse_iso("bad").alias("b"), times.to_utc("summer").alias("s"), times.to_utc("winter").alias("w"),
                  times.rfc3339_utc("summer").alias("due"), times.week_start("winter").alias("wk"),
                  times.plus_hours("winter").alias("h")).first()
    assert abs((r["t"] - ref).total_seconds()) < 0.001
    assert r["o"] == dt.datetime(2024, 7, 1, 10) and r["p"] == dt.datetime(2024, 7, 1, 10) and r["b"] is None
    assert r["s"] == dt.datetime(2024, 7, 1, 8) and r["w"] == dt.datetime(2024, 1, 10, 9)
    assert r["due"] == "2024-07-01T08:00:00Z" and r["wk"] == dt.date(2024, 1, 8)
    assert r["h"] == dt.datetime(2024, 1, 10, 11)


def test_assembly_chunks_equal_single_join(spark):
    rows = [("d", i, None if 4 <= i <= 7 else f"p{i}", None) for i in range(12)] + [("e", 3, "x", None)]
    p = spark.createDataFrame(rows, "doc_id string, page_no int, text string, error string")
    expect = {"d": "\n".join(f"p{i}" for i in range(12) if not 4 <= i <= 7), "e": "x"}
    for chunk in (1, 2, 4, 256):
        got = {r["doc_id"]: r["text"] for r in assembly.assemble_pages(p, chunk=chunk).collect()}
        assert got == expect


def test_fold_keeps_no_state_and_compacts(spark, tmp_dir):
    from quire.streaming.fold import compact
    rows = [(i % 5, i, f"r{i}") for i in range(40)]
    for n in range(2):  # two files, the later partials first
        part = rows[20:] if n == 0 else rows[:20]
        spark.createDataFrame(part, "doc_id bigint, seq bigint, record string").coalesce(1).write.mode("append").parquet(f"{tmp_dir}/in")
        q = run_fold(spark, f"{tmp_dir}/in", "doc_id bigint, seq bigint, record string", f"{tmp_dir}/log", f"{tmp_dir}/ck")
        q.awaitTermination()
        assert not any(p["stateOperators"] for p in q.recentProgress)
    want = {i: (35 + i, f"r{35 + i}") for i in range(5)}
    got = lambda path: {r["doc_id"]: (r["seq"], r["record"]) for r in read_latest(spark, path).collect()}
    assert got(f"{tmp_dir}/log") == want
    compact(spark, f"{tmp_dir}/log", f"{tmp_dir}/log2")
    assert got(f"{tmp_dir}/log2") == want and spark.read.parquet(f"{tmp_dir}/log2").count() == 5


def test_fold_with_state_closes_documents_and_ignores_late_partials(spark, tmp_dir):
    from quire.streaming.fold import run_fold_with_state
    schema = "doc_id string, seq bigint, record string, at timestamp, extra int"
    t0 = dt.datetime(2024, 1, 1)
    hour = dt.timedelta(hours=1)
    batches = [
        [("a", 1, "a1", t0, 0), ("a", 2, "a2", t0, 0), ("a", 2, "a2b", t0, 0), ("b", 3, None, t0, 0), ("b", 3, None, t0, 0),
         (None, 1, "x", t0, 0), ("n", None, "x", t0, 0), ("n", 1, "x", None, 0)],
        [("a", 1, "old", t0, 0), ("c", 1, "c1", t0 + 5 * hour, 0)],  # an earlier partial of a: no update
        [("d", 1, "d1", t0 + 5 * hour, 0), ("a", 9, "late", t0, 0)],  # behind the watermark: ignored
        [("b", 4, "b4", t0 + 6 * hour, 0)],  # closed, opened again
    ]
    state = []
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_dir}/in")
        q = run_fold_with_state(spark.readStream.schema(schema).parquet(f"{tmp_dir}/in"), f"{tmp_dir}/log", f"{tmp_dir}/ck", "at")
        q.awaitTermination()
        state.append([p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]])
    log = sorted((r["doc_id"], r["seq"], r["record"]) for r in spark.read.parquet(f"{tmp_dir}/log").collect())
    assert log == [("a", 2, "a2b"), ("b", 3, None), ("b", 4, "b4"), ("c", 1, "c1"), ("d", 1, "d1")]
    got = {r["doc_id"]: (r["seq"], r["record"]) for r in read_latest(spark, f"{tmp_dir}/log").collect()}
    assert got == {"a": (2, "a2b"), "b": (4, "b4"), "c": (1, "c1"), "d": (1, "d1")}
    assert max(state[0]) == 2 and max(state[1]) == 3
    assert state[1][-1] == 1  # a and b are closed once the watermark has passed them
    assert state[3][-1] <= 3
