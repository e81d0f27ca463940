"""Required actions -> overview, calendar events, tasks, filed documents (PF13-PF19, SK2-SK4, JN6).

Input: a documents DataFrame with ``doc_id`` and the record fields of
``schemas.DOC``. Everything is a projection or an ``explode`` of the action
array: map-only, no shuffle, except the event-to-file join (JN6), which is an
equi-join on ``doc_id`` of two frames derived from the same rows and
co-partitioned by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.times import EVENT_TZ, ISO_NTZ, plus_hours, rfc3339_utc

# Event reminders (method, minutes).
REMINDERS = [("email", 10), ("popup", 10)]
DETAIL_TS = "yyyy-MM-dd HH:mm:ss"

# Event titles per action type, and the labels of event descriptions,
# the action overview and the summary page.
EVENT_TITLE = {
    "appointment": "Appointment: ",
    "reply_required": "Deadline: Reply Required - ",
    "payment_required": "Deadline: Payment Required - ",
}
L_SUMMARY = "Summary: "
L_REQUIRED_DOCS = "Required Documents: "
L_NOTES = "Additional Notes: "
L_LINK = "Document Link: "
L_DOCS_ORIGINAL = "Documents to send (Original): "
L_DOCS_ENGLISH = "Documents to send (English): "
L_ADDRESS = "Address: "
L_AMOUNT = "Amount: "
L_RECIPIENT = "Recipient: "
L_REFERENCE = "Reference: "
L_BANK = "Bank Details: "
L_DATE = "Date: "
L_LOCATION = "Location: "
L_DEADLINE = "Deadline: "
PAGE_TITLE = "Document Summary"
PAGE_SENDER = "Sender: "
PAGE_ADDRESSEE = "Addressed To: "
PAGE_DOC_TITLE = "Document Title: "
PAGE_ACTIONS = "Required Actions:"
PAGE_APPOINTMENT = "Appointment:"
PAGE_REPLY = "Reply Required:"
PAGE_PAYMENT = "Payment Required:"
PAGE_OTHER_ACTION = "No specific action details"
PAGE_ITEM = "- "
DOCS_ORIGINAL_SHORT = "Documents (Original): "
DOCS_ENGLISH_SHORT = "Documents (English): "


def has_actions(docs: DataFrame) -> DataFrame:
    """PF13 / D11: documents whose action list is non-empty (null lists drop too)."""
    return docs.filter(F.size("required_actions") > 0)


def explode_actions(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """PF14: one row per action with its position (``action_no`` from 0)."""
    keep = keep or [c for c in docs.columns if c != "required_actions"]
    return docs.select(*keep, F.posexplode("required_actions").alias("action_no", "a"))


def _ts(c: Column, fmt: str = ISO_NTZ) -> Column:
    return F.date_format(c, fmt)


def action_overview(docs: DataFrame) -> DataFrame:
    """PF16: (doc_id, action_no, type label, details) for documents that have actions."""
    a = explode_actions(has_actions(docs), ["doc_id"])
    t = F.col("a.action_type")
    details = (F.when(t == "appointment", F.concat(F.lit(L_DATE), _ts(F.col("a.appointment.date"), DETAIL_TS),
                                                    F.lit("\n" + L_LOCATION), F.col("a.appointment.location")))
               .when(t == "reply_required", F.concat(F.lit(L_DEADLINE), _ts(F.col("a.reply.deadline"), DETAIL_TS),
                                                      F.lit("\n" + L_ADDRESS), F.col("a.reply.address_to_send_to")))
               .when(t == "payment_required", F.concat(F.lit(L_AMOUNT), tx.money(F.col("a.payment.amount")),
                                                        F.lit("\n" + L_DEADLINE), _ts(F.col("a.payment.deadline"), DETAIL_TS)))
               .otherwise(F.lit("")))
    return a.select("doc_id", "action_no", tx.type_label(t).alias("type"), details.alias("details"))


def stored_files(docs: DataFrame, source_col: str = "source_path") -> DataFrame:
    """SK2 + SC9-SC11: where each document with actions is filed.

    name = '<sent_date>_<title>.pdf'; folder = 'addressee/sender'; the uploaded
    file is the original with the summary page in front ('<stem>_with_summary.pdf').
    """
    d = has_actions(docs)
    name = tx.file_name("sent_date", "title_in_english")
    return d.select(
        "doc_id",
        name.alias("name"),
        tx.folder_path("addressed_to", "sender").alias("folder_path"),
        tx.folder_path("addressed_to", "sender", name).alias("path"),
        tx.with_summary_name(F.col(source_col)).alias("uploaded_from"),
    )


def file_documents(docs: DataFrame, path: str, mode: str = "append") -> None:
    """SK2: writes the documents with actions under ``path`` in one folder per addressee and sender, with their filed name.

    Rows meet their folder in a few tasks (a hash of the id salts each folder), so a
    folder gets a few files however many documents it holds.
    """
    d = has_actions(docs).withColumn("name", tx.file_name("sent_date", "title_in_english"))
    d = d.repartition("addressed_to", "sender", F.pmod(F.xxhash64("doc_id"), F.lit(4)))
    d.write.mode(mode).partitionBy("addressed_to", "sender").parquet(path)


def calendar_events(docs: DataFrame, files: DataFrame | None = None, tz: str = EVENT_TZ) -> DataFrame:
    """PF15 + SK3 + JN6: one event per dated action; end = start + 1 hour; no_action gives none.

    The description of appointment and reply events links the filed document;
    payment events carry no link and an empty location (D26). Without a
    ``files`` table the link is the document's own filing path (computed in the
    same pass, no join); with one (e.g. ids assigned by an external store) it is
    joined on ``doc_id`` (JN6).
    """
    keep = ["doc_id", "title_in_english", "summary_in_english"]
    if files is None:
        d = has_actions(docs).withColumn(
            "link", tx.folder_path("addressed_to", "sender", tx.file_name("sent_date", "title_in_english")))
        a = explode_actions(d, keep + ["link"])
    else:
        a = explode_actions(has_actions(docs), keep)
        a = a.join(files.select("doc_id", F.col("path").alias("link")), "doc_id", "left")
    t = F.col("a.action_type")
    title = F.col("title_in_english")
    summary = F.concat(F.lit(L_SUMMARY), tx.or_default("summary_in_english", tx.NA))
    link = F.concat(F.lit(L_LINK), tx.or_default("link", tx.NA))
    appt, reply, pay = F.col("a.appointment"), F.col("a.reply"), F.col("a.payment")
    start = (F.when(t == "appointment", appt["date"]).when(t == "reply_required", reply["deadline"])
             .when(t == "payment_required", pay["deadline"]))
    summ = (F.when(t == "appointment", F.concat(F.lit(EVENT_TITLE["appointment"]), title))
            .when(t == "reply_required", F.concat(F.lit(EVENT_TITLE["reply_required"]), title))
            .when(t == "payment_required", F.concat(F.lit(EVENT_TITLE["payment_required"]), title)))
    loc = (F.when(t == "appointment", appt["location"]).when(t == "reply_required", reply["address_to_send_to"])
           .when(t == "payment_required", F.lit("")))
    desc = (F.when(t == "appointment", F.concat_ws(
                "\n", summary,
                F.concat(F.lit(L_REQUIRED_DOCS), tx.join_or(appt["required_documents"])),
                F.concat(F.lit(L_NOTES), tx.text_or(appt["additional_notes"], tx.NONE_TEXT)),
                link))
            .when(t == "reply_required", F.concat_ws(
                "\n", summary,
                F.concat(F.lit(L_DOCS_ORIGINAL), tx.join_or(reply["documents_to_send_in_original_language"])),
                F.concat(F.lit(L_DOCS_ENGLISH), tx.join_or(reply["documents_to_send_in_english"])),
                F.concat(F.lit(L_ADDRESS), tx.or_default(reply["address_to_send_to"], tx.NA)),
                link))
            .when(t == "payment_required", F.concat_ws(
                "\n", summary,
                F.concat(F.lit(L_AMOUNT), tx.money(pay["amount"])),
                F.concat(F.lit(L_RECIPIENT), tx.or_default(pay["recipient"], tx.NA)),
                F.concat(F.lit(L_REFERENCE), tx.text_or(pay["reference_number"], tx.NONE_TEXT)),
                F.concat(F.lit(L_BANK), F.coalesce(F.to_json(pay["bank_details"]), F.lit("{}"))))))
    reminders = F.array(*[F.struct(F.lit(m).alias("method"), F.lit(n).alias("minutes")) for m, n in REMINDERS])
    ev = a.filter(start.isNotNull()).select(
        "doc_id", "action_no", summ.alias("summary"), loc.alias("location"), desc.alias("description"),
        start.alias("start_ts"), plus_hours(start, 1).alias("end_ts"), F.lit(tz).alias("tz"),
        reminders.alias("reminders"))
    return ev


def tasks(docs: DataFrame, tz: str = EVENT_TZ) -> DataFrame:
    """SK4: one task per action with a deadline; due as RFC 3339 UTC text."""
    a = explode_actions(has_actions(docs), ["doc_id", "title_in_english", "summary_in_english"])
    t = F.col("a.action_type")
    due = F.when(t == "reply_required", F.col("a.reply.deadline")).when(t == "payment_required", F.col("a.payment.deadline"))
    title = (F.when(t == "reply_required", F.concat(F.lit("Reply: "), F.col("title_in_english")))
             .otherwise(F.concat(F.lit("Pay: "), F.col("title_in_english"))))
    return a.filter(due.isNotNull()).select("doc_id", "action_no", title.alias("title"),
                                            F.col("summary_in_english").alias("notes"),
                                            rfc3339_utc(due, tz).alias("due"))


def document_card(docs: DataFrame) -> DataFrame:
    """PF17: From / To / Title / Summary with placeholders while fields are missing."""
    return docs.select("doc_id",
                       tx.or_default("sender", tx.PROCESSING).alias("from_"),
                       tx.or_default("addressed_to", tx.PROCESSING).alias("to_"),
                       tx.or_default("title_in_english", tx.PROCESSING).alias("title"),
                       tx.or_default("summary_in_english", tx.PROCESSING_SUMMARY).alias("summary"))


def _action_text(a: Column) -> Column:
    t = a["action_type"]
    ap, rp, py = a["appointment"], a["reply"], a["payment"]
    return (F.when(t == "appointment", F.concat_ws(
                "\n", F.lit(PAGE_APPOINTMENT),
                F.concat(F.lit(PAGE_ITEM + L_DATE), F.coalesce(_ts(ap["date"], DETAIL_TS), F.lit(tx.NA))),
                F.concat(F.lit(PAGE_ITEM + L_LOCATION), tx.or_default(ap["location"], tx.NA)),
                F.concat(F.lit(PAGE_ITEM + L_REQUIRED_DOCS), tx.join_or(ap["required_documents"]))))
            .when(t == "reply_required", F.concat_ws(
                "\n", F.lit(PAGE_REPLY),
                F.concat(F.lit(PAGE_ITEM + L_DEADLINE), F.coalesce(_ts(rp["deadline"], DETAIL_TS), F.lit(tx.NA))),
                F.concat(F.lit(PAGE_ITEM + DOCS_ORIGINAL_SHORT), tx.join_or(rp["documents_to_send_in_original_language"])),
                F.concat(F.lit(PAGE_ITEM + DOCS_ENGLISH_SHORT), tx.join_or(rp["documents_to_send_in_english"]))))
            .when(t == "payment_required", F.concat_ws(
                "\n", F.lit(PAGE_PAYMENT),
                F.concat(F.lit(PAGE_ITEM + L_AMOUNT), F.coalesce(tx.money(py["amount"]), F.lit(tx.NA))),
                F.concat(F.lit(PAGE_ITEM + L_DEADLINE), F.coalesce(_ts(py["deadline"], DETAIL_TS), F.lit(tx.NA))),
                F.concat(F.lit(PAGE_ITEM + L_RECIPIENT), tx.or_default(py["recipient"], tx.NA))))
            .otherwise(F.lit(PAGE_OTHER_ACTION)))


def summary_text(docs: DataFrame) -> DataFrame:
    """PF18: the summary page as text (one column per document)."""
    acts = F.when(F.coalesce(F.size("required_actions"), F.lit(0)) > 0,
                  F.array_join(F.transform("required_actions", _action_text), "\n")).otherwise(F.lit(tx.NO_ACTIONS))
    body = F.concat_ws(
        "\n", F.lit(PAGE_TITLE),
        F.concat(F.lit(PAGE_SENDER), tx.or_default("sender", tx.NA)),
        F.concat(F.lit(PAGE_ADDRESSEE), tx.or_default("addressed_to", tx.NA)),
        F.concat(F.lit(PAGE_DOC_TITLE), tx.or_default("title_in_english", tx.NA)),
        F.concat(F.lit(L_SUMMARY), tx.or_default("summary_in_english", tx.NA)),
        F.lit(PAGE_ACTIONS), acts)
    return docs.select("doc_id", body.alias("summary_text"))


def record_rules(docs: DataFrame) -> DataFrame:
    """PF21: apply the record rules (title <= 3 words, sender domain, addressee without prefixes)."""
    return docs.select("doc_id", tx.short_title("title_in_english").alias("title_in_english"),
                       tx.sender_in_domain("sender").alias("sender"),
                       tx.strip_name_prefix("addressed_to").alias("addressed_to"))
