"""Tables Spark derives from the driver's parquet tables.

Every registered query reads these (or the raw tables), so its work grows
with the data. The same derivations are written as SQL in ``oracle.py``.

- ``vector_store``: documents joined to their given embedding (vec_id = doc_id),
  ingest time from events (event_id = doc_id), typed hot metadata columns and
  the JSON ``metadata`` text; ``week_start`` is the Monday partition key.
- ``label_questions``: one question vector per embedding label (the label's
  mean vector).
- ``text_store`` / ``text_questions``: whole documents and benchmark items
  embedded by the hashed bag-of-words embedder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import week_start
from ..operators.embed import hash_embed
from ..sources.tables import table

HASH_DIM = 64


def vector_store(spark: SparkSession, d: str) -> DataFrame:
    emb = table(spark, d, "embeddings").select("vec_id", "embedding", "label")
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", "source")
    ev = table(spark, d, "events").select("event_id", "ts")
    s = (emb.join(docs, emb.vec_id == docs.doc_id)
         .join(ev, ev.event_id == emb.vec_id, "left"))
    return s.select(
        F.col("vec_id").alias("id"),
        F.col("ts").alias("ingest_ts"),
        week_start("ts").alias("week_start"),
        "lang", "source", "label",
        F.to_json(F.struct("lang", "source", "label"), {"ignoreNullFields": "false"}).alias("metadata"),
        F.col("text").alias("contents"),
        "embedding",
    )


def label_questions(spark: SparkSession, d: str) -> DataFrame:
    """Mean vector per label (MLlib Summarizer: one partial aggregate per partition, any dimension)."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    emb = table(spark, d, "embeddings").select("label", "embedding")
    return (emb.groupBy("label")
            .agg(Summarizer.mean(array_to_vector("embedding")).alias("m"))
            .select(F.col("label").cast("bigint").alias("query_id"), vector_to_array("m").alias("embedding")))


def mean_vector(spark: SparkSession, d: str) -> list[float]:
    """Mean of all given embeddings (one bounded row: ``dim`` numbers)."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    emb = table(spark, d, "embeddings").select("embedding")
    row = emb.agg(vector_to_array(Summarizer.mean(array_to_vector("embedding"))).alias("m")).first()
    return [float(x) for x in row["m"]]


def text_store(spark: SparkSession, d: str, dim: int = HASH_DIM) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", "source")
    return docs.select(F.col("doc_id").alias("id"), "lang", "source", F.col("text").alias("contents"),
                       hash_embed("text", dim).alias("embedding"))


def text_questions(spark: SparkSession, d: str, dim: int = HASH_DIM) -> DataFrame:
    b = table(spark, d, "benchmark").select("item_id", "text")
    return b.select(F.col("item_id").alias("query_id"), F.col("text").alias("question"),
                    hash_embed("text", dim).alias("embedding"))


# ---------------------------------------------------------------- extracted document records (F1)
# Fixed mapping used to derive records from the driver tables: market segment -> sender domain.
SEGMENT_SENDER = {
    "AUTOMOBILE": "Employment Agency",
    "BUILDING": "Tax",
    "FURNITURE": "Health",
    "HOUSEHOLD": "Immigration",
    "MACHINERY": "Other",
}


def _with_customers(rows: DataFrame, customers: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``rows`` joined to their customers by a shuffle: customers grow with the data, so they are never sent whole through the driver."""
    return rows.join(customers.hint("shuffle_hash"), F.col(key) == F.col("c_custkey"), how)


def doc_records(spark: SparkSession, d: str) -> DataFrame:
    """One extracted record per order (schemas.DOC + doc_id, source_path).

    sender from the customer's segment, addressee = customer name, sent_date =
    order date, title from the priority. Actions: status P -> payment, O ->
    appointment, F -> reply; priority 5-LOW -> no actions, 4-NOT SPECIFIED ->
    only ``no_action``, 3-MEDIUM -> the action plus ``no_action``.
    """
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                                         "o_orderdate", "o_orderpriority")
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    j = _with_customers(o, c, "o_custkey")
    seg = F.col("c_mktsegment")
    sender = F.coalesce(*[F.when(seg == k, F.lit(v)) for k, v in SEGMENT_SENDER.items()], F.lit("Other"))
    pr, od, nk = F.col("o_orderpriority"), F.col("o_orderdate"), F.col("c_nationkey").cast("string")
    null_s = F.lit(None).cast("string")
    appt = F.struct(
        F.expr("o_orderdate + INTERVAL 7 DAYS + INTERVAL 9 HOURS").alias("date"),
        F.concat(F.lit("Office "), nk).alias("location"),
        F.when(pr == "2-HIGH", F.lit(None).cast("array<string>"))
         .otherwise(F.array(F.lit("passport"), F.concat(F.lit("form "), pr))).alias("required_documents"),
        F.when(pr == "1-URGENT", F.lit("Bring originals")).otherwise(null_s).alias("additional_notes"))
    reply = F.struct(
        F.array(F.lit("Antwortbogen")).alias("documents_to_send_in_original_language"),
        F.array(F.lit("Reply form")).alias("documents_to_send_in_english"),
        F.expr("o_orderdate + INTERVAL 30 DAYS + INTERVAL 12 HOURS").alias("deadline"),
        F.concat(F.lit("PO Box "), nk).alias("address_to_send_to"))
    pay = F.struct(
        F.concat(F.lit("Treasury "), nk).alias("recipient"),
        F.col("o_totalprice").alias("amount"),
        F.expr("o_orderdate + INTERVAL 14 DAYS").alias("deadline"),
        F.create_map(F.lit("iban"), F.concat(F.lit("DE"), F.lpad(F.col("c_custkey").cast("string"), 20, "0"))).alias("bank_details"),
        F.when(pr == "1-URGENT", F.concat(F.lit("REF-"), F.col("o_orderkey").cast("string"))).otherwise(null_s)
         .alias("reference_number"))
    from ..schemas import ACTION
    none_a, none_r, none_p = (F.lit(None).cast(ACTION["appointment"].dataType), F.lit(None).cast(ACTION["reply"].dataType),
                              F.lit(None).cast(ACTION["payment"].dataType))

    def act(tag, a=none_a, r=none_r, p=none_p):
        return F.struct(F.lit(tag).alias("action_type"), a.alias("appointment"), r.alias("reply"), p.alias("payment"))

    st = F.col("o_orderstatus")
    main = (F.when(st == "P", act("payment_required", p=pay)).when(st == "O", act("appointment", a=appt))
            .otherwise(act("reply_required", r=reply)))
    no_action = act("no_action")
    # each struct appears once in the expression: [main unless 4-NOT SPECIFIED, no_action for 3/4], 5-LOW -> []
    actions = F.filter(F.array(F.when(~pr.isin("4-NOT SPECIFIED", "5-LOW"), main),
                               F.when(pr.isin("3-MEDIUM", "4-NOT SPECIFIED"), no_action)),
                       lambda a: a.isNotNull())
    return j.select(
        F.col("o_orderkey").alias("doc_id"),
        F.concat(F.lit("Bescheid "), pr).alias("title_in_original_language"),
        F.concat(F.lit("Notice "), F.substring(pr, 3, 100)).alias("title_in_english"),
        sender.alias("sender"),
        F.to_date(od).alias("sent_date"),
        F.col("c_name").alias("addressed_to"),
        F.concat(F.lit("Betrag "), F.format_string("%.2f", F.col("o_totalprice"))).alias("content_in_original_language"),
        F.concat(F.lit("Amount "), F.format_string("%.2f", F.col("o_totalprice"))).alias("content_in_english"),
        F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"), F.lit(" status "), st).alias("summary_in_english"),
        actions.alias("required_actions"),
        F.concat(F.lit("/scans/"), F.col("o_orderkey").cast("string"), F.lit(".pdf")).alias("source_path"),
    )


def conversation_pages(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as extracted pages: (doc_id, page_no, text, error)."""
    c = table(spark, d, "conversations").select("conv_id", "turn", "text")
    return c.select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("page_no"), "text",
                    F.lit(None).cast("string").alias("error"))


def conversation_partials(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as a stream of partial records: (doc_id, seq, record)."""
    c = table(spark, d, "conversations").select("conv_id", "turn", "text")
    return c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("seq"), F.col("text").alias("record"))


def partial_records(spark: SparkSession, d: str) -> DataFrame:
    """Last partial record per conversation as a document record with the fields seen so far.

    Turn t fills the first t+1 of (sender, addressed_to, title_in_english,
    summary_in_english); the rest are still missing (null).
    """
    from ..operators.assembly import last_partial
    last = last_partial(conversation_partials(spark, d))
    s = F.col("seq")
    return last.select(
        "doc_id",
        F.when(s >= 0, F.concat(F.lit("Sender "), F.col("doc_id").cast("string"))).alias("sender"),
        F.when(s >= 1, F.concat(F.lit("Person "), F.col("doc_id").cast("string"))).alias("addressed_to"),
        F.when(s >= 2, F.concat(F.lit("Title "), F.col("seq").cast("string"))).alias("title_in_english"),
        F.when(s >= 3, F.col("record")).alias("summary_in_english"),
    )


def raw_records(spark: SparkSession, d: str) -> DataFrame:
    """Record fields before the rules: honorific-prefixed names, long titles, open sender text."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    j = _with_customers(o, c, "o_custkey")
    st = F.col("o_orderstatus")
    prefix = F.when(st == "P", F.lit("Herr ")).when(st == "O", F.lit("Frau Dr. ")).otherwise(F.lit(""))
    sender = F.coalesce(*[F.when(F.col("c_mktsegment") == k, F.lit(v)) for k, v in SEGMENT_SENDER.items()
                          if k != "MACHINERY"], F.col("c_mktsegment"))
    return j.select(F.col("o_orderkey").alias("doc_id"),
                    F.concat(F.lit("Notice of "), F.col("o_orderpriority"), F.lit(" order status")).alias("title_in_english"),
                    sender.alias("sender"),
                    F.concat(prefix, F.col("c_name")).alias("addressed_to"))


# ---------------------------------------------------------------- question answering inputs
AS_OF = "2001-07-20"


def doc_store(spark: SparkSession, d: str, dim: int = HASH_DIM) -> DataFrame:
    """Every extracted record as a vector table row (ingested the day after it was sent, 08:00)."""
    from ..operators.records import vector_records
    docs = doc_records(spark, d)
    ts = F.expr("CAST(sent_date AS TIMESTAMP_NTZ) + INTERVAL 1 DAY + INTERVAL 8 HOURS")
    return vector_records(docs, embed=True, dim=dim, ingest_ts=ts)


def questions(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark items as user questions; four phrasings name no filter, a sender and a month,
    an addressee (the customer with the item's number), or an addressee, a sender and a year."""
    b = table(spark, d, "benchmark").select("item_id", "text")
    c = table(spark, d, "customer").select("c_custkey", "c_name")
    j = _with_customers(b, c, "item_id", "left")
    form = F.pmod(F.col("item_id"), F.lit(4))
    name = F.coalesce(F.col("c_name"), F.lit("nobody"))
    suffix = (F.when(form == 1, F.lit(" Which letters came from the tax office last month?"))
              .when(form == 2, F.concat(F.lit(" Show letters addressed to "), name, F.lit(" please.")))
              .when(form == 3, F.concat(F.lit(" Anything for "), name, F.lit(" from health this year?")))
              .otherwise(F.lit("")))
    return j.select(F.col("item_id").alias("query_id"), F.concat(F.col("text"), suffix).alias("question"),
                    F.lit(AS_OF).cast("date").alias("as_of"))


def addressees(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_name").alias("name"))


#: Text of a payment that breaks one rule, and the reason it is rejected for; records take them in turn by id.
BROKEN_ACTIONS = [
    ('{"action_type": "payment_required"}', "action tag without its details"),
    ('{"action_type": null}', "action tag without its details"),
    ('null', "action tag without its details"),
    ('{"action_type": "call"}', "action tag without its details"),
    ('{"action_type": "appointment", "appointment": {"location": "Room 1"}}', "action detail without a required field"),
    ('{"action_type": "appointment", "appointment": {"date": "soon", "location": "Room 1"}}', "bad date or time text"),
    ('{"action_type": "payment_required", "payment": {"recipient": "x", "deadline": "2024-01-01T00:00:00", "bank_details": {}}}', "action detail without a required field"),
    ('{"action_type": "payment_required", "payment": {"recipient": "x", "amount": "oops", "deadline": "2024-01-01T00:00:00", "bank_details": {}}}', "action detail without a required field"),
    ('{"action_type": "reply_required", "reply": {"documents_to_send_in_english": [], "deadline": "2024-01-01T00:00:00+02:00", "address_to_send_to": "x"}}', "action detail without a required field"),
    ('{"action_type": "appointment", "appointment": {"date": "2024-01-01T00:00:00", "location": "x", "required_documents": "passport, form"}}', "value of another type"),
    ('{"action_type": "appointment", "appointment": {"date": "2024-01-01T00:00:00", "location": "x", "required_documents": [1, {"x": 2}]}}', "value of another type"),
    ('{"action_type": "appointment", "appointment": {"date": "2024-01-01T00:00:00", "location": ["a", "b"]}}', "value of another type"),
    ('{"action_type": "no_action"}]} and more', "more than one value"),
]


def broken_records(spark: SparkSession, d: str) -> DataFrame:
    """(src, record): every record with one action that breaks a rule."""
    from ..operators.records import record_json
    docs = doc_records(spark, d)
    texts = F.array(*[F.lit(t) for t, _ in BROKEN_ACTIONS])
    one = F.element_at(texts, (F.pmod("doc_id", F.lit(len(BROKEN_ACTIONS))) + 1).cast("int"))
    empty = docs.withColumn("required_actions", F.array().cast(docs.schema["required_actions"].dataType))  # the actions need not be built
    return empty.select(F.concat(F.lit("bad-"), F.col("doc_id").cast("string")).alias("src"),
                        F.replace(record_json(empty), F.lit('"required_actions":[]'), F.concat(F.lit('"required_actions":['), one, F.lit("]"))).alias("record"))


def name_questions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Questions naming each customer by one to five words, and the known names: the long one and its last word alone."""
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey")
    before = F.array(F.lit(""), F.lit("Anna "), F.lit("Anna Maria "), F.lit("Anna Maria von "), F.lit("Dr Anna Maria von "))
    c = c.withColumn("name", F.concat(F.element_at(before, (F.pmod("c_custkey", F.lit(5)) + 1).cast("int")), "c_name"))
    q = c.select(F.col("c_custkey").alias("query_id"), F.concat(F.lit("Is there a letter for "), "name", F.lit(", please?")).alias("question"), F.lit(AS_OF).cast("date").alias("as_of"))
    return q, c.select("name").unionByName(c.select(F.col("c_name").alias("name"))).distinct()


# ---------------------------------------------------------------- deterministic models over the tables (UD1, UD6)


def letter_files(spark: SparkSession, d: str) -> DataFrame:
    """Every order as a letter file (path, content), as ``binaryFile`` reads them: a page of fields and a page of text."""
    docs = doc_records(spark, d).select("doc_id", "title_in_english", "sender", "addressed_to", "sent_date", "summary_in_english")
    line = lambda label, c: F.concat(F.lit(f"{label}: "), F.col(c).cast("string"), F.lit("\n"))
    text = F.concat(line("From", "sender"), line("To", "addressed_to"), line("Date", "sent_date"), line("Subject", "title_in_english"), F.lit("\f"), "summary_in_english")
    return docs.select(F.concat(F.lit("/letters/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), text.cast("binary").alias("content"))


def read_letter(prompts: list[str], **_) -> list[str]:
    """A model that reads the fields of ``letter_files``: a reply is due for letters from the tax office."""
    import json
    out = []
    for p in prompts:
        head = dict(x.split(": ", 1) for x in p.splitlines() if ": " in x)
        body = p.splitlines()[-1]
        actions = [{"action_type": "reply_required", "reply": {"documents_to_send_in_original_language": ["Antwort"], "documents_to_send_in_english": ["Reply"],
                                                                "deadline": f"{head['Date']}T12:00:00", "address_to_send_to": "PO Box 1"}}] if head["From"] == "Tax" else []
        out.append(json.dumps({"title_in_original_language": head["Subject"], "title_in_english": head["Subject"], "sender": head["From"], "sent_date": head["Date"],
                               "addressed_to": head["To"], "content_in_original_language": body, "content_in_english": body, "summary_in_english": body, "required_actions": actions}))
    return out


def forgetful(prompts: list[str], **_) -> list[str]:
    """A model that answers with the number in its prompt; every third number gets no JSON at first, every fifteenth never."""
    import json
    out = []
    for p in prompts:
        number, *told = p.split("\n\n")
        n = int(number)
        out.append("let me see" if n % 15 == 0 or (n % 3 == 0 and not told) else json.dumps({"answer": f"answer {n} after {len(told)}"}))
    return out


def step_by_step(prompts: list[str], **_) -> list:
    """A model that fills a record one field after the other: number n gets 1 + n % 4 partial records; every ninth breaks off with an error."""

    def parts(n: int):
        record = {}
        for name in ("title", "sender", "summary", "addressee")[:1 + n % 4]:
            record[name] = f"{name} {n}"
            yield dict(record)
        if n % 9 == 0:
            raise RuntimeError("connection lost")

    return [parts(int(p)) for p in prompts]
