"""Record parsing, validation and JSON scan/sink (SR3, SR5, SK1, UD1) on synthetic F1 records."""

import json

from quire.operators import records as rec
from quire.operators.model import apply_model, echo_model, model_outcomes, model_partials
from quire.schemas import ANSWER

BASE = {
    "title_in_original_language": "Bescheid über Beiträge", "title_in_english": "Contribution notice",
    "sender": "Tax", "sent_date": "2024-03-01", "addressed_to": "Alex Example",
    "content_in_original_language": "Sehr geehrte Person,\nbitte zahlen Sie.", "content_in_english": "Dear person,\nplease pay.",
    "summary_in_english": "A payment is due.",
}


def _doc(actions, **kw):
    d = dict(BASE, required_actions=actions)
    d.update(kw)
    return json.dumps(d, ensure_ascii=False)


REPLY = {"action_type": "reply_required", "appointment": None, "payment": None,
         "reply": {"documents_to_send_in_original_language": ["Formular A"], "documents_to_send_in_english": ["Form A"],
                   "deadline": "2024-03-20T12:00:00", "address_to_send_to": "PO Box 1"}}
APPT = {"action_type": "appointment", "reply": None, "payment": None,
        "appointment": {"date": "2024-04-02T09:30:00", "location": "Room 4", "required_documents": None, "additional_notes": None}}
PAY = {"action_type": "payment_required", "appointment": None, "reply": None,
       "payment": {"recipient": "City", "amount": 12.5, "deadline": "2024-03-15T00:00:00",
                   "bank_details": {"iban": "DE00"}, "reference_number": None}}


def test_values_of_another_type_are_rejected(spark):
    """Where the schema wants a text or a list of texts, nothing else is reshaped into one."""
    def appt(docs):
        return dict(APPT, appointment=dict(APPT["appointment"], required_documents=docs))
    cases = {
        1: (_doc([appt("passport, form")]), "value of another type"),
        2: (_doc([appt([1, {"x": 2}])]), "value of another type"),
        3: (_doc([appt(["passport", None])]), "value of another type"),
        4: (_doc([REPLY], title_in_english=["a", "b"]), "value of another type"),
        5: (_doc([REPLY], title_in_english=7), "value of another type"),
        6: (_doc([REPLY]) + " and more", "more than one value"),
        7: (_doc([REPLY]) + _doc([REPLY]), "more than one value"),
        8: (_doc([REPLY]) + "," + _doc([REPLY]), "more than one value"),
        9: (_doc([dict(PAY, payment=dict(PAY["payment"], bank_details={"iban": 5}))]), "value of another type"),
        10: (_doc([{"action_type": "no_action", "appointment": "x"}]), "value of another type"),
        11: (_doc([dict(APPT, appointment=dict(APPT["appointment"], date=5))]), None),
        12: (_doc("none"), "missing required_actions"),
        13: ("[" + _doc([REPLY]) + "]", "unparseable"),
        14: (_doc([appt([])]) + " \n", "ok"), 15: ("\n " + _doc([appt(["a [b]", "{c}"])]), "ok"), 16: (_doc([appt(None)], title_in_english='["a"]'), "ok"),
        17: (None, "unparseable"), 18: ("", "unparseable"), 19: ("7", "unparseable"),
    }
    df = spark.createDataFrame([(i, t) for i, (t, _) in cases.items()], "doc_id int, record string")
    got = {r["doc_id"]: r["reason"] or "ok" for r in rec.validate_records(df).collect()}
    assert got[11] != "ok"
    assert {i: r for i, r in got.items() if i != 11} == {i: want for i, (_, want) in cases.items() if i != 11}


def test_texts_that_look_like_other_values(spark):
    """A text may look like a number, word or list; only a value that is one is refused, however it is spaced."""
    def pay(**kw):
        return _doc([dict(PAY, payment=dict(PAY["payment"], **kw))])
    cases = {
        1: (pay(reference_number="4711"), "ok"), 2: (pay(reference_number="-1.5e3"), "ok"), 3: (pay(bank_details={"iban": "12"}), "ok"),
        4: (pay(recipient="true"), "ok"), 5: (_doc([], summary_in_english="{}"), "ok"), 6: (_doc([], summary_in_english=""), "ok"),
        7: (pay(reference_number=4711), "value of another type"), 8: (pay(recipient=True), "value of another type"),
        9: (_doc([], summary_in_english="@").replace('"@"', " -1.5e3 "), "value of another type"),
        10: (_doc([], summary_in_english="@").replace('"@"', "NaN"), "value of another type"),
        11: (_doc([], summary_in_english={"a": "b"}), "value of another type"), 12: (_doc([], sent_date=2024), "value of another type"),
        13: (pay(bank_details={"iban": None}), "value of another type"), 14: (_doc([], title_in_original_language=None), "missing title_in_original_language"),
    }
    df = spark.createDataFrame([(i, t) for i, (t, _) in cases.items()], "doc_id int, record string")
    rows = {r["doc_id"]: r for r in rec.validate_records(df).collect()}
    assert {i: r["reason"] or "ok" for i, r in rows.items()} == {i: want for i, (_, want) in cases.items()}
    assert rows[1]["rec"]["required_actions"][0]["payment"]["reference_number"] == "4711"


def test_columns_kept_may_have_any_name(spark):
    df = spark.createDataFrame([(_doc([REPLY]), "a", "b", "c")], "record string, text string, json string, found string")
    ok, _ = rec.parse_records(df)
    assert ok.select("text", "json", "found").first() == ("a", "b", "c")


def test_records_are_read_in_compiled_stages(spark):
    """Nothing is computed in a generator (Spark would interpret it), none of it twice; JSON is read again for doubtful records alone."""
    import re
    df = spark.createDataFrame([(1, _doc([REPLY]))], "doc_id int, record string")
    ok, bad = rec.parse_records(df)
    for part in (rec.validate_records(df), ok, bad, ok.filter("sender = 'Tax'")):
        plan = part._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_json(") == 2 and "from_json(" in plan.split("CASE WHEN (NOT _sure", 1)[1]
        assert re.findall(r"inline\(.*?\)\)\)", re.sub(r"#\d+", "", plan)) == ["inline(array(struct(rec, rec, reason, reason)))"]


def test_parse_ok_and_rejects(spark):
    cases = [
        (1, _doc([REPLY])), (2, _doc([APPT])), (3, _doc([PAY])), (4, _doc([REPLY, PAY])),
        (5, _doc([{"action_type": "no_action"}])), (6, _doc([])),
        (7, _doc([{"action_type": "payment_required"}])),          # tag without its struct
        (8, _doc([REPLY], sender="Bank")),                          # outside the domain
        (9, _doc([REPLY], sent_date="not a date")),                 # bad date text
        (10, "{broken json"),
        (11, _doc([PAY], title_in_english=None)),                   # missing field
        (12, _doc([dict(REPLY, reply=dict(REPLY["reply"], deadline="2024-03-20T12:00:00+01:00"))])),  # offset kept
        (13, _doc([dict(REPLY, reply=dict(REPLY["reply"], deadline="soon"))])),  # bad time inside an action
        (14, _doc([None])), (15, _doc([{"action_type": None}])),    # null action, null tag
        (16, _doc([dict(PAY, payment=dict(PAY["payment"], amount="oops"))])),
        (17, _doc([dict(APPT, appointment={"location": "Room 4"})])),
    ]
    df = spark.createDataFrame(cases, "doc_id int, record string")
    ok, bad = rec.parse_records(df)
    assert sorted(r["doc_id"] for r in ok.collect()) == [1, 2, 3, 4, 5, 6, 12]
    reasons = {r["doc_id"]: r["reason"] for r in bad.collect()}
    assert reasons[7] == "action tag without its details"
    assert reasons[8] == "sender outside domain"
    assert reasons[9] == "bad date or time text"
    assert reasons[10] == "unparseable"
    assert reasons[11] == "missing title_in_english"
    assert reasons[13] == "bad date or time text"
    assert reasons[14] == reasons[15] == "action tag without its details"
    assert reasons[16] == reasons[17] == "action detail without a required field"
    import datetime as dt
    assert ok.filter("doc_id = 12").first()["required_actions"][0]["reply"]["deadline"] == dt.datetime(2024, 3, 20, 12)
    row = ok.filter("doc_id = 3").first()
    assert row["required_actions"][0]["payment"]["bank_details"] == {"iban": "DE00"}
    assert "ü" in ok.filter("doc_id = 1").first()["title_in_original_language"]


def test_json_sink_scan_roundtrip(spark, tmp_dir):
    df = spark.createDataFrame([(i, _doc([REPLY, PAY], title_in_english=f"n {i}")) for i in range(10)], "doc_id int, record string")
    ok, _ = rec.parse_records(df)
    rec.write_records(ok.drop("doc_id").coalesce(1), f"{tmp_dir}/out")  # ten records in one file
    back = rec.read_records(spark, f"{tmp_dir}/out")
    assert sorted(r["title_in_english"] for r in back.collect()) == sorted(f"n {i}" for i in range(10))
    assert back.first()["required_actions"][1]["payment"]["amount"] == 12.5
    txt = "".join(open(p).read() for p in __import__("glob").glob(f"{tmp_dir}/out/*.json"))
    assert '"reference_number":null' in txt and "2024-03-20T12:00:00" in txt


def test_vector_records_deterministic_ids(spark):
    df = spark.createDataFrame([(1, _doc([REPLY]))], "doc_id int, record string")
    ok, _ = rec.parse_records(df)
    a = rec.vector_records(ok, embed=True).first()
    b = rec.vector_records(ok, embed=True).first()
    assert a["id"] == b["id"] and len(a["id"]) == 64
    assert a["contents"].startswith("Sender: Tax\nAddressed to: Alex Example\nDear person")
    assert "\nRequired Action: {\"action_type\":\"reply_required\"" in a["contents"]
    assert json.loads(a["metadata"])["sent_date"] == "2024-03-01"
    assert len(a["embedding"]) == 64


def test_apply_model_parses_and_rejects(spark):
    df = spark.createDataFrame([(1, [{"role": "user", "content": "q"}, {"role": "assistant", "content": "# ctx\nline two"}])],
                               "id int, messages array<struct<role:string,content:string>>")
    ok, bad = apply_model(df, "messages", echo_model, ANSWER)
    r = ok.first()
    assert r["answer"] == "line two" and r["thought_process"] == ["read the retrieved documents"]
    assert bad.count() == 0

    def broken(inputs, **_):
        return ["not json"] * len(inputs)

    ok2, bad2 = apply_model(df, "messages", broken, ANSWER)
    assert ok2.count() == 0 and bad2.first()["reason"] == "unparseable output"

    def failing(inputs, **_):
        raise RuntimeError("offline")

    _, bad3 = apply_model(df, "messages", failing, ANSWER, max_retries=2)
    assert "offline" in bad3.first()["reason"]


def test_one_record_per_file_and_rejects(spark, tmp_dir):
    import os
    os.makedirs(f"{tmp_dir}/in")
    open(f"{tmp_dir}/in/a.json", "w").write(json.dumps(json.loads(_doc([REPLY])), indent=2))
    open(f"{tmp_dir}/in/b.json", "w").write("{broken")
    ok, bad = rec.scan_records(spark, f"{tmp_dir}/in", one_per_file=True)
    assert ok.first()["source"].endswith("a.json") and ok.count() == 1
    assert bad.first()["source"].endswith("b.json") and bad.first()["reason"] == "unparseable"


def test_letters_with_equal_text_keep_their_ids(spark):
    docs = [(1, _doc([])), (2, _doc([], sent_date="2024-03-02")), (3, _doc([], title_in_english="Other title"))]
    ok, _ = rec.parse_records(spark.createDataFrame(docs, "doc_id int, record string"))
    assert rec.vector_records(ok.drop("doc_id"), embed=False).select("id").distinct().count() == 3


def test_one_failing_prompt_rejects_itself_alone(spark):
    df = spark.createDataFrame([(i, f"p{i}") for i in range(20)], "id int, prompt string").coalesce(1)

    def model(prompts, **_):
        if "p7" in prompts:
            raise RuntimeError("bad prompt")
        return [json.dumps({"answer": p}) for p in prompts]

    from pyspark.sql import types as T
    ok, bad = apply_model(df, "prompt", model, T.StructType([T.StructField("answer", T.StringType())]), max_retries=1)
    assert sorted(r["id"] for r in ok.collect()) == [i for i in range(20) if i != 7]
    assert [(r["id"], "bad prompt" in r["reason"]) for r in bad.collect()] == [(7, True)]


def test_filed_documents_are_written_by_addressee_and_sender(spark, sf, tmp_dir):
    import glob
    from quire.operators import actions as act
    from quire.plans import derived
    docs = derived.doc_records(spark, sf)
    act.file_documents(docs, f"{tmp_dir}/filed")
    back = spark.read.parquet(f"{tmp_dir}/filed")
    want = {(r["doc_id"], r["folder_path"], r["name"]) for r in act.stored_files(docs).collect()}
    assert {(r["doc_id"], r["addressed_to"] + "/" + r["sender"], r["name"]) for r in back.collect()} == want
    folders = glob.glob(f"{tmp_dir}/filed/addressed_to=*/sender=*")
    assert len(folders) == len({f for _, f, _ in want})


def test_empty_notes_read_as_none(spark):
    from quire.operators import actions as act
    ok, _ = rec.parse_records(spark.createDataFrame([(1, _doc([dict(APPT, appointment=dict(APPT["appointment"], additional_notes=""))]))], "doc_id int, record string"))
    assert "Additional Notes: None" in act.calendar_events(ok).first()["description"]


def test_refused_outputs_alone_are_asked_again(spark, tmp_dir):
    """Every third output is no JSON at first: it is asked once more with the reason, its batch is not; number 6 never answers."""
    import glob
    import os
    from pyspark.sql import types as T
    log = f"{tmp_dir}/calls"
    os.makedirs(log)

    def model(prompts, **_):
        open(f"{log}/{os.urandom(6).hex()}", "w").write("\n".join(p.replace("\n", " ") for p in prompts))
        return ["hm" if p[:2] == "p6" or (int(p.split("\n")[0][1:]) % 3 == 0 and "not accepted: unparseable" not in p) else json.dumps({"answer": p[:3].strip()}) for p in prompts]

    df = spark.createDataFrame([(i, f"p{i}") for i in range(10)], "id int, prompt string").coalesce(1)
    schema = T.StructType([T.StructField("answer", T.StringType())])
    rows = model_outcomes(df, "prompt", model, schema, max_retries=3).collect()
    assert {r["id"]: (r["answer"], r["reason"]) for r in rows} == {i: (None, "unparseable output") if i == 6 else (f"p{i}", None) for i in range(10)}
    calls = sorted(len(open(f).read().split("\n")) for f in glob.glob(f"{log}/*"))
    assert calls == [1, 4, 10]  # all; 0, 3, 6 and 9 again; 6 for the last time


def test_own_check_and_message_lists(spark):
    """A check of the caller's decides what is refused; a list of messages gets the answer and the reason as two more."""
    from pyspark.sql import types as T

    def model(chats, **_):
        return [json.dumps({"answer": str(len(c)), "note": c[-1]["content"]}) for c in chats]

    msgs = [{"role": "user", "content": "hello"}]
    df = spark.createDataFrame([(1, msgs)], "id int, messages array<struct<role string, content string>>")
    schema = T.StructType([T.StructField("answer", T.StringType()), T.StructField("note", T.StringType())])
    r = model_outcomes(df, "messages", model, schema, check=lambda o: None if json.loads(o)["answer"] == "5" else "answer too short").first()
    assert (r["answer"], r["reason"]) == ("5", None) and r["note"].endswith("answer too short")
    r = model_outcomes(df, "messages", model, schema, max_retries=2, check=lambda o: "never").first()
    assert (r["answer"], r["reason"]) == (None, "never")


def test_partial_outputs(spark):
    """Partials in order; an input that breaks off keeps its own; a failing call and an input without partials."""
    def parts(p):
        yield {"a": 1}
        if p == "stop":
            raise ValueError("stop")
        yield '{"a": 2}'

    def model(prompts, **_):
        return [[] if p == "none" else (str(i) for i in range(9000)) if p == "many" else parts(p) for p in prompts]

    df = spark.createDataFrame([(1, "go"), (2, "stop"), (3, "none"), (4, "many")], "id int, prompt string").coalesce(1)
    rows = model_partials(df, "prompt", model).collect()
    got = {}
    for r in rows:
        got.setdefault(r["id"], []).append((r["seq"], r["record"], r["error"]))
    assert got[1] == [(0, '{"a": 1}', None), (1, '{"a": 2}', None)]
    assert got[2] == [(0, '{"a": 1}', None), (1, None, "ValueError: stop")]
    assert 3 not in got and [x[0] for x in got[4]] == list(range(9000))

    def offline(prompts, **_):
        raise RuntimeError("offline")

    assert {(r["id"], r["seq"], r["error"]) for r in model_partials(df, "prompt", offline).collect()} == {(i, 0, "RuntimeError: offline") for i in range(1, 5)}
    assert model_partials(df.limit(0), "prompt", model).collect() == []


def test_folders_of_names_with_slashes_and_without_names(spark):
    from quire.operators.folders import get_or_create_folders
    none = spark.createDataFrame([], "id string, name string, parent_id string, path string")
    paths = spark.createDataFrame([("A/B", "C"), ("A", "B/C"), (None, "C"), ("D", None), ("1:A", "x"), ("A", "B/C")], "addressed_to string, sender string")
    made = get_or_create_folders(paths, none)
    rows = made.collect()
    assert len(rows) == len({r["id"] for r in rows}) == 7  # four top folders, three below
    assert all(r["id"] and r["name"] and r["path"] for r in rows)
    assert sorted(map(tuple, get_or_create_folders(paths, made).collect()), key=str) == sorted(map(tuple, rows), key=str)
