"""Question answering over the vector table (PF9-PF12, PF20, UD4, UD5).

``answer_questions`` runs, for a whole DataFrame of questions at once:
  PF12 preprocess (sender / addressee / time window per question)
  -> UD2 embed the question text
  -> JN1/WN1 filtered top-k (PF11 as the per-question mask inside the kernel)
  -> PF9 context JSON per question (AG4)
  -> UD4 answer (default extractive answerer, or a model callable via UD1).

The default preprocessor is a rule job, not a model: the sender comes from
the fixed sender domain named in the text, the addressee from an equi-join of
the question's word n-grams with the table of known addressees (no pairwise
comparison of questions and names), relative dates from ``as_of``.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import SENDERS
from ..session import reliable_checkpoint
from .search import QuestionFilter, nearest

# Fields kept from metadata for the answer context (PF10).
CONTEXT_KEYS = ["title_in_english", "title_in_original_language", "sender", "sent_date", "addressed_to",
                "summary_in_english", "required_actions"]
#: Keys whose value is a list or object in the metadata and stays one in the context.
NESTED_KEYS = frozenset(["required_actions"])
# Words that name each sender in a question.
SENDER_WORDS = {
    "Employment Agency": ["employment agency", "employment"],
    "Tax": ["tax"],
    "Health": ["health"],
    "Immigration": ["immigration"],
}
NO_ANSWER = "I cannot answer this from the stored documents."
DEFAULT_THRESHOLD = 0.35

SYSTEM_PROMPT = (
    "You answer questions about the user's official letters using only the retrieved documents. "
    "Name the title and date of the document you rely on, keep the answer short, "
    "and say clearly when the documents do not contain the answer."
)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def detect_sender(question) -> Column:
    q = F.lower(_c(question))
    hit = None
    for sender in SENDERS:
        words = SENDER_WORDS.get(sender)
        if not words:
            continue
        cond = None
        for w in words:
            c = q.rlike(r"(^|[^a-z])" + w + r"([^a-z]|$)")
            cond = c if cond is None else (cond | c)
        hit = F.when(cond, F.lit(sender)) if hit is None else hit.when(cond, F.lit(sender))
    return hit


def time_window(question, as_of) -> tuple[Column, Column]:
    """Relative date phrases -> [start, end) as timestamp_ntz; null when none is named."""
    q, d = F.lower(_c(question)), _c(as_of).cast("date")
    wk = F.to_date(F.date_trunc("week", d))
    mo = F.trunc(d, "month")
    yr = F.trunc(d, "year")
    rules = [
        ("last week", F.date_sub(wk, 7), wk),
        ("this week", wk, F.date_add(wk, 7)),
        ("last month", F.add_months(mo, -1), mo),
        ("this month", mo, F.add_months(mo, 1)),
        ("last year", F.add_months(yr, -12), yr),
        ("this year", yr, F.add_months(yr, 12)),
        ("yesterday", F.date_sub(d, 1), d),
        ("today", d, F.date_add(d, 1)),
    ]
    start = end = None
    for phrase, s, e in rules:
        cond = q.contains(phrase)
        start = F.when(cond, s) if start is None else start.when(cond, s)
        end = F.when(cond, e) if end is None else end.when(cond, e)
    return start.cast("timestamp_ntz"), end.cast("timestamp_ntz")


def _words(text: str) -> Column:
    """Words of a text, punctuation trimmed at their ends."""
    return F.transform(F.split(F.trim(F.col(text)), r"\s+"), lambda w: F.regexp_replace(w, r"^[^\w#]+|[^\w#]+$", ""))


def named_in_questions(questions: DataFrame, names: DataFrame, qid: str = "query_id", text: str = "question") -> DataFrame:
    """(qid, name): names of any length that occur in a question as whole words.

    Every run of words of a question, of the lengths that names have, meets the names of
    the same hash (an equi-join on the whole name, so names that share words cost nothing),
    and the words themselves are compared inside the join.
    """
    n = names.select(F.col("name"), F.filter(_words("name"), lambda w: w != "").alias("nw")).filter(F.size("nw") > 0)
    lengths = sorted(r[0] for r in n.select(F.size("nw")).distinct().collect())  # a row per length of a name
    if not lengths:
        return questions.select(qid, F.lit(None).cast("string").alias("name")).limit(0)
    n = n.withColumn("h", F.xxhash64("nw"))
    q = questions.select(qid, text).repartition(qid, text).select(qid, _words(text).alias("w")).withColumn("n", F.explode(F.array(*[F.lit(x) for x in lengths]))).filter(F.col("n") <= F.size("w"))
    q = q.select(qid, F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1), lambda at: F.slice("w", at, F.col("n")))).alias("run"))
    return q.withColumn("h", F.xxhash64("run")).join(n.hint("shuffle_hash"), ["h"]).filter(F.col("run") == F.col("nw")).select(qid, "name").distinct()


def preprocess_questions(questions: DataFrame, addressees: DataFrame | None = None, *, qid: str = "query_id",
                         text: str = "question", as_of: str = "as_of", name_col: str = "name") -> DataFrame:
    """PF12: add ``sender``, ``addressed_to``, ``start_ts``, ``end_ts`` (each nullable).

    ``addressees`` is the table of known recipient names, of any number of words; of
    several names in a question the one with most words wins, then the smallest.
    """
    start, end = time_window(text, as_of)
    out = questions.select("*", detect_sender(text).alias("q_sender"), start.alias("start_ts"), end.alias("end_ts"))
    if addressees is None:
        return out.withColumn("q_addressed_to", F.lit(None).cast("string"))
    names = addressees.select(F.col(name_col).alias("name")).filter("name IS NOT NULL").distinct()
    found = named_in_questions(questions, names, qid, text)
    longest = found.withColumn("n", F.size(F.split(F.trim("name"), r"\s+")))
    hits = longest.groupBy(qid).agg(F.min(F.struct((-F.col("n")).alias("less"), "name")).alias("x")).select(qid, F.col("x.name").alias("q_addressed_to"))
    return out.join(hits, qid, "left")


PREPROCESS_PROMPT = "You turn a user's question into search filters. Today is "


def preprocess_with_model(questions: DataFrame, model: Callable, *, qid: str = "query_id", text: str = "question",
                          as_of: str = "as_of", **model_options) -> DataFrame:
    """PF12 through a model (UD1): the callable gets one message list per question and returns JSON
    ``{"sender", "addressed_to", "start_date", "end_date"}``; a sender outside the domain is dropped.
    A question the model fails on keeps its row, with null fields and the reason in ``preprocess_error``."""
    from pyspark.sql import types as T
    from ..functions.times import parse_iso
    from .model import model_outcomes
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("sender", "addressed_to", "start_date", "end_date")])
    msgs = F.array(
        F.struct(F.lit("system").alias("role"),
                 F.concat(F.lit(PREPROCESS_PROMPT), F.date_format(F.col(as_of), "yyyy-MM-dd")).alias("content")),
        F.struct(F.lit("user").alias("role"), F.concat(F.lit("Question: "), F.col(text)).alias("content")))
    # the model answers once: the search and the answer both use its checkpointed output
    done = reliable_checkpoint(model_outcomes(questions.select(qid, msgs.alias("messages")), "messages", model, schema, keep=[qid], **model_options))
    got = done.select(qid, F.col("reason").alias("preprocess_error"), F.when(F.col("sender").isin(*SENDERS), F.col("sender")).alias("q_sender"),
                    F.col("addressed_to").alias("q_addressed_to"),
                    parse_iso(F.col("start_date")).alias("start_ts"), parse_iso(F.col("end_date")).alias("end_ts"))
    return questions.join(got, qid, "left")


def context_record(contents: str = "contents", metadata: str = "metadata", keep: list[str] | None = None) -> Column:
    """PF9: {'content': .., then each kept key present in metadata, in ``keep`` order} as JSON text."""
    keep = keep or CONTEXT_KEYS
    m = F.from_json(F.col(metadata), "map<string,string>")
    # read as a map of texts, an object or list keeps its JSON text
    member = lambda name, value: F.concat(F.lit(f'"{name}":'), value)
    quoted = lambda v: F.regexp_extract(F.to_json(F.array(v)), r"(?s)^\[(.*)\]$", 1)
    parts = [member("content", F.coalesce(quoted(F.col(contents)), F.lit("null")))]
    for k in keep:
        v = m[k]
        value = F.when(v.isNull(), F.lit("null")).otherwise(v if k in NESTED_KEYS else quoted(v))
        parts.append(F.when(F.map_contains_key(m, F.lit(k)), member(k, value)))
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def contexts(hits: DataFrame, qid: str = "query_id", keep: list[str] | None = None) -> DataFrame:
    """AG4: per question, the JSON array of its hits' context records in rank order,
    plus the nearest hit's metadata (``top_metadata``) so answers need no second pass over the hits."""
    rec = hits.select(qid, "rank", "distance", "metadata", context_record(keep=keep).alias("rec"))
    return (rec.groupBy(qid)
            .agg(F.array_sort(F.collect_list(F.struct("rank", "rec"))).alias("items"),
                 F.min("distance").alias("min_distance"), F.count(F.lit(1)).alias("n_context"),
                 F.min_by("metadata", "rank").alias("top_metadata"))
            .select(qid, F.concat(F.lit("["), F.array_join(F.transform("items", lambda x: x["rec"]), ","), F.lit("]"))
                    .alias("context"), "min_distance", "n_context", "top_metadata"))


def messages(question: Column, context: Column) -> Column:
    """PF20: the message list handed to an answer model."""
    msg = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(msg("system", F.lit(SYSTEM_PROMPT)),
                   msg("user", F.concat(F.lit("Question:\n"), question)),
                   msg("assistant", F.concat(F.lit("Documents found:\n"), F.coalesce(context, F.lit("[]")))))


def default_answer(ctx: DataFrame, qid: str = "query_id", threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """UD4 default: cite the nearest document's title and date; enough_context = min distance <= threshold."""
    top = lambda k: F.get_json_object("top_metadata", f"$.{k}")
    enough = F.coalesce(F.col("min_distance") <= F.lit(threshold), F.lit(False))
    answer = F.when(enough, F.concat(F.lit("According to '"), top("title_in_english"), F.lit("' ("), top("sent_date"),
                                     F.lit("): "), top("summary_in_english"))).otherwise(F.lit(NO_ANSWER))
    thoughts = F.array(F.concat(F.lit("retrieved "), F.col("n_context").cast("string"), F.lit(" documents")),
                       F.concat(F.lit("nearest distance "), F.format_string("%.4f", F.col("min_distance"))))
    return ctx.select(qid, thoughts.alias("thought_process"), answer.alias("answer"), enough.alias("enough_context"),
                      "n_context", "context")


#: Store column -> question column of the equality filters.
KEY_MAP = {"sender": "q_sender", "addressed_to": "q_addressed_to"}


def retrieve(store: DataFrame, pre: DataFrame, k: int = 3, *, qid: str = "query_id", combine: str = "or",
             time_col: str = "ingest_ts", end_inclusive: bool = False, key_map: dict[str, str] | None = None,
             embed: Callable[[Column], Column] | None = None) -> DataFrame:
    """PF11 + JN1 + WN1: filtered top-k per preprocessed question.

    ``embed`` must be the embedder the store was built with; vectors of another length raise.
    """
    from .embed import hash_embed
    embed = embed or (lambda c: hash_embed(c))
    q = pre.withColumn("embedding", embed(F.col("question")))
    qf = QuestionFilter(equals=tuple((key_map or KEY_MAP).items()), combine=combine,
                        time_col=time_col, start_col="start_ts", end_col="end_ts", end_inclusive=end_inclusive)
    payload = [c for c in ("id", "doc_id", "metadata", "contents") if c in store.columns]
    return nearest(store, q, k=k, qid_col=qid, question_filter=qf, payload=payload, same_length=True)


def answer_questions(questions: DataFrame, store: DataFrame, addressees: DataFrame | None = None, k: int = 3, *,
                     threshold: float = DEFAULT_THRESHOLD, model: Callable | None = None,
                     preprocess_model: Callable | None = None, embed: Callable[[Column], Column] | None = None,
                     combine: str = "or", time_col: str = "ingest_ts", end_inclusive: bool = False,
                     key_map: dict[str, str] | None = None) -> DataFrame:
    """UD5: one row per question, with its answer and the filters used.

    Columns: ``query_id``, the answer fields, ``n_context``, ``context``, the preprocessing
    result (``q_sender``, ``q_addressed_to``, ``start_ts``, ``end_ts``, ``preprocess_error``)
    and ``answer_error``. Questions without any hit, and those a model failed on, keep their row.
    """
    pre = (preprocess_with_model(questions, preprocess_model) if preprocess_model is not None
           else preprocess_questions(questions, addressees).withColumn("preprocess_error", F.lit(None).cast("string")))
    hits = retrieve(store, pre, k, combine=combine, time_col=time_col, end_inclusive=end_inclusive, key_map=key_map, embed=embed)
    used = pre.select("query_id", "q_sender", "q_addressed_to", "start_ts", "end_ts", "preprocess_error")
    ctx = questions.select("query_id").join(contexts(hits), "query_id", "left") \
        .withColumn("n_context", F.coalesce("n_context", F.lit(0)))
    if model is None:
        return default_answer(ctx, threshold=threshold).withColumn("answer_error", F.lit(None).cast("string")).join(used, "query_id")
    from .model import model_outcomes
    from ..schemas import ANSWER
    m = ctx.join(questions.select("query_id", "question"), "query_id") \
        .select("query_id", "n_context", "context", messages(F.col("question"), F.col("context")).alias("messages"))
    done = model_outcomes(m, "messages", model, ANSWER, keep=["query_id", "n_context", "context"])
    return reliable_checkpoint(done.drop("output").withColumnRenamed("reason", "answer_error")).join(used, "query_id")  # the model answers once
