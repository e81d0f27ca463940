"""Fixed schemas: extracted document record, vector table row, answers, outputs."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values that must equal the reference's domains (sender and action tags).
SENDERS = ["Employment Agency", "Tax", "Health", "Immigration", "Other"]
ACTION_TYPES = ["no_action", "appointment", "reply_required", "payment_required"]
DEFAULT_SENDER = "Other"

APPOINTMENT = T.StructType([
    T.StructField("date", T.TimestampNTZType()),
    T.StructField("location", T.StringType()),
    T.StructField("required_documents", T.ArrayType(T.StringType())),
    T.StructField("additional_notes", T.StringType()),
])

REPLY = T.StructType([
    T.StructField("documents_to_send_in_original_language", T.ArrayType(T.StringType())),
    T.StructField("documents_to_send_in_english", T.ArrayType(T.StringType())),
    T.StructField("deadline", T.TimestampNTZType()),
    T.StructField("address_to_send_to", T.StringType()),
])

PAYMENT = T.StructType([
    T.StructField("recipient", T.StringType()),
    T.StructField("amount", T.DoubleType()),
    T.StructField("deadline", T.TimestampNTZType()),
    T.StructField("bank_details", T.MapType(T.StringType(), T.StringType())),
    T.StructField("reference_number", T.StringType()),
])

ACTION = T.StructType([
    T.StructField("action_type", T.StringType()),
    T.StructField("appointment", APPOINTMENT),
    T.StructField("reply", REPLY),
    T.StructField("payment", PAYMENT),
])

# Field order as the extracted record.
DOC = T.StructType([
    T.StructField("title_in_original_language", T.StringType()),
    T.StructField("title_in_english", T.StringType()),
    T.StructField("sender", T.StringType()),
    T.StructField("sent_date", T.DateType()),
    T.StructField("addressed_to", T.StringType()),
    T.StructField("content_in_original_language", T.StringType()),
    T.StructField("content_in_english", T.StringType()),
    T.StructField("summary_in_english", T.StringType()),
    T.StructField("required_actions", T.ArrayType(ACTION)),
])

# Fields every record must carry (non-optional in the record model).
DOC_REQUIRED = [f.name for f in DOC.fields]

# Vector table row. Hot metadata keys are real columns so filters reach the scan.
STORE = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("ingest_ts", T.TimestampNTZType()),
    T.StructField("week_start", T.DateType()),
    T.StructField("sender", T.StringType()),
    T.StructField("addressed_to", T.StringType()),
    T.StructField("sent_date", T.DateType()),
    T.StructField("metadata", T.StringType()),
    T.StructField("contents", T.StringType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("norm", T.FloatType()),
])

ANSWER = T.StructType([
    T.StructField("thought_process", T.ArrayType(T.StringType())),
    T.StructField("answer", T.StringType()),
    T.StructField("enough_context", T.BooleanType()),
])

REMINDER = T.StructType([
    T.StructField("method", T.StringType()),
    T.StructField("minutes", T.IntegerType()),
])

PAGE = T.StructType([
    T.StructField("doc_id", T.StringType()),
    T.StructField("page_no", T.IntegerType()),
    T.StructField("text", T.StringType()),
    T.StructField("error", T.StringType()),
])
