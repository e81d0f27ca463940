"""Question preprocessing (PF12) and partial-record folding (AG5) on FIXTURES F5 / F7 cases."""

import datetime as dt

from quire.operators import assembly, rag

AS_OF = dt.date(2024, 5, 15)  # a Wednesday


def _pre(spark, rows, names=("Alex Example", "Kim Lee")):
    qs = spark.createDataFrame([(i, q, AS_OF) for i, q in rows], "query_id bigint, question string, as_of date")
    ad = spark.createDataFrame([(n,) for n in names], "name string")
    return {r["query_id"]: r for r in rag.preprocess_questions(qs, ad).collect()}


def test_phrases_and_fields(spark):
    got = _pre(spark, [
        (1, "What did I get?"),
        (2, "Letters from the tax office"),
        (3, "Letters for Alex Example from Immigration"),
        (4, "What arrived last week?"),
        (5, "Anything last month for Kim Lee?"),
        (6, "Health letters this year"),
        (7, "Employment agency letters"),
    ])
    assert (got[1]["q_sender"], got[1]["q_addressed_to"], got[1]["start_ts"], got[1]["end_ts"]) == (None, None, None, None)
    assert got[2]["q_sender"] == "Tax" and got[2]["q_addressed_to"] is None
    assert got[3]["q_sender"] == "Immigration" and got[3]["q_addressed_to"] == "Alex Example"
    assert (got[4]["start_ts"], got[4]["end_ts"]) == (dt.datetime(2024, 5, 6), dt.datetime(2024, 5, 13))
    assert (got[5]["start_ts"], got[5]["end_ts"]) == (dt.datetime(2024, 4, 1), dt.datetime(2024, 5, 1))
    assert got[5]["q_addressed_to"] == "Kim Lee"
    assert (got[6]["start_ts"], got[6]["end_ts"]) == (dt.datetime(2024, 1, 1), dt.datetime(2025, 1, 1))
    assert got[7]["q_sender"] == "Employment Agency"


def test_last_partial_wins_out_of_order(spark):
    rows = [("d1", 2, "v2"), ("d1", 0, "v0"), ("d1", 5, "v5"), ("d1", 1, "v1"), ("d2", 0, "only")]
    df = spark.createDataFrame(rows, "doc_id string, seq int, record string").repartition(3)
    got = {r["doc_id"]: (r["seq"], r["record"]) for r in assembly.last_partial(df).collect()}
    assert got == {"d1": (5, "v5"), "d2": (0, "only")}


def _filters_model(inputs, **_):
    import json
    out = []
    for msgs in inputs:
        q = msgs[-1]["content"]
        if "garbage" in q:
            out.append("not json")
        elif "tax" in q.lower():
            out.append(json.dumps({"sender": "Tax", "addressed_to": None, "start_date": "2024-04-01", "end_date": "2024-05-01"}))
        else:
            out.append(json.dumps({"sender": "Bank", "addressed_to": "Kim Lee", "start_date": None, "end_date": None}))
    return out


def test_preprocess_with_model(spark):
    qs = spark.createDataFrame([(1, "tax letters last month", AS_OF), (2, "for Kim", AS_OF), (3, "garbage", AS_OF)],
                               "query_id bigint, question string, as_of date")
    got = {r["query_id"]: r for r in rag.preprocess_with_model(qs, _filters_model).collect()}
    assert got[1]["q_sender"] == "Tax" and got[1]["start_ts"] == dt.datetime(2024, 4, 1)
    assert got[2]["q_sender"] is None and got[2]["q_addressed_to"] == "Kim Lee"   # sender outside the domain dropped
    assert got[3]["q_sender"] is None and got[3]["start_ts"] is None              # unparseable: no filter


def test_names_that_share_words_meet_by_the_whole_name(spark):
    """Names with a common first word: the join sees one candidate per question and name length, not every name."""
    from quire.operators.rag import named_in_questions
    n = 3000
    names = spark.createDataFrame([(f"Anna P{i}",) for i in range(n)] + [("Anna",), ("P5",), ("a b c d e f g h",)], "name string")
    q = spark.createDataFrame([(i, f"Any letter for Anna P{i}, please?") for i in range(n)] + [(n, "Anna"), (n + 1, "(P5) and Anna"), (n + 2, ""), (n + 3, None)], "query_id int, question string")
    found = named_in_questions(q, names)
    got = {(r["query_id"], r["name"]) for r in found.collect()}
    assert got == {(i, f"Anna P{i}") for i in range(n)} | {(i, "Anna") for i in [*range(n + 2)]} | {(5, "P5"), (n + 1, "P5")}
    join = [ln for ln in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in ln][0]
    assert "run#" in join and "nw#" in join  # whole names are the join's keys
