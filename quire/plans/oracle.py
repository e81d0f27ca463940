"""DuckDB SQL giving the same rows as each catalogue query (brute force).

Shared derivations are CTE text reused by several queries; they restate in SQL
what ``derived.py`` builds with the DataFrame API.
"""

from __future__ import annotations

from ..operators.rag import SYSTEM_PROMPT
from .derived import BROKEN_ACTIONS

STORE_CTE = """
store AS (
  SELECT e.vec_id AS id, ev.ts AS ingest_ts, CAST(date_trunc('week', ev.ts) AS DATE) AS week_start,
         d.lang, d.source, e.label, d.text AS contents, e.embedding::DOUBLE[] AS embedding
  FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id
  LEFT JOIN events ev ON ev.event_id = e.vec_id
)"""

LABEL_Q_CTE = """
eu AS (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
lq AS (SELECT CAST(label AS BIGINT) AS query_id, list(m ORDER BY pos) AS q
       FROM (SELECT label, pos, avg(x) AS m FROM eu GROUP BY label, pos) GROUP BY label)"""


def _hash_counts(name: str, table: str, key: str, text: str = "text", dim: int = 64) -> str:
    return f"""
{name}_t AS (SELECT {key} AS k, unnest(string_split_regex(lower({text}), '[^a-z0-9]+')) AS t FROM {table}),
{name}_b AS (SELECT k, ('0x' || substr(md5(t), 1, 4))::INTEGER % {dim} AS b, count(*)::DOUBLE AS c
             FROM {name}_t WHERE t <> '' GROUP BY ALL),
{name}_n AS (SELECT k, sqrt(sum(c * c)) AS n FROM {name}_b GROUP BY k)"""


def _rank(pairs: str, k: int) -> str:
    return f"""
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM {pairs})
SELECT query_id, rank, id, round(distance, 6) AS distance FROM ranked WHERE rank <= {k}"""


ORACLE = {
    "topk_single": f"""
WITH {STORE_CTE},
eu AS (SELECT unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
q AS (SELECT list(m ORDER BY pos) AS v FROM (SELECT pos, avg(x) AS m FROM eu GROUP BY pos)),
p AS (SELECT s.id, 1 - list_dot_product(s.embedding, q.v) / (sqrt(list_dot_product(s.embedding, s.embedding)) * sqrt(list_dot_product(q.v, q.v))) AS distance FROM store s, q)
SELECT id, round(distance, 6) AS distance FROM p ORDER BY distance, id LIMIT 5""",

    "topk_batch": f"""
WITH {STORE_CTE}, {LABEL_Q_CTE},
pairs AS (SELECT lq.query_id, s.id,
   1 - list_dot_product(s.embedding, lq.q) / (sqrt(list_dot_product(s.embedding, s.embedding)) * sqrt(list_dot_product(lq.q, lq.q))) AS distance
   FROM lq, store s),
{_rank('pairs', 3)}""",

    "text_search": f"""
WITH {_hash_counts('d', 'documents', 'doc_id')}, {_hash_counts('q', 'benchmark', 'item_id')},
dots AS (SELECT q.k AS qk, d.k AS dk, sum(q.c * d.c) AS dot FROM q_b q JOIN d_b d USING (b) GROUP BY ALL),
pairs AS (SELECT qn.k AS query_id, dn.k AS id, 1 - coalesce(dots.dot, 0) / (qn.n * dn.n) AS distance
          FROM q_n qn CROSS JOIN d_n dn LEFT JOIN dots ON dots.qk = qn.k AND dots.dk = dn.k),
{_rank('pairs', 5)}""",
}


def _ftopk(where: str, k: int = 3) -> str:
    return f"""
WITH {STORE_CTE}, {LABEL_Q_CTE},
fs AS (SELECT * FROM store WHERE {where}),
pairs AS (SELECT lq.query_id, s.id,
   1 - list_dot_product(s.embedding, lq.q) / (sqrt(list_dot_product(s.embedding, s.embedding)) * sqrt(list_dot_product(lq.q, lq.q))) AS distance
   FROM lq, fs s),
{_rank('pairs', k)}"""


FLAT_STORE = """
flat AS (SELECT e.vec_id AS id, ev.ts AS ingest_ts, d.lang, d.source, e.label, d.text AS contents
         FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id LEFT JOIN events ev ON ev.event_id = e.vec_id),
relab AS (SELECT l.doc_id AS id, ev.ts AS ingest_ts, d.lang, d.source, l.quality AS label, d.text AS contents
          FROM labels l JOIN documents d ON d.doc_id = l.doc_id LEFT JOIN events ev ON ev.event_id = l.doc_id)"""

STORE_REPORT = "id, strftime(ingest_ts, '%Y-%m-%dT%H:%M:%S') AS ingest_ts, lang, source, label, length(contents) AS n_chars"

ORACLE.update({
    "topk_filtered_eq": _ftopk("lang = 'de' AND source = 'src1'"),
    "topk_filter_list": _ftopk("lang = 'de' OR source = 'src3'"),
    "topk_predicates": _ftopk("(lang = 'en' AND label >= 5) OR (lang = 'fr' AND label < 3)"),
    "topk_metadata_json": _ftopk("(label > 6 AND source <> 'src0' AND NULL) OR lang = 'es'"),
    "topk_unknown_key": _ftopk("NULL"),
    "topk_time_range": _ftopk("ingest_ts >= TIMESTAMP '2024-01-01 06:00:00' AND ingest_ts < TIMESTAMP '2024-01-02'"),
    "topk_time_empty": _ftopk("ingest_ts >= TIMESTAMP '2024-08-01' AND ingest_ts < TIMESTAMP '2024-08-30'"),
    "upsert_update": f"""WITH {FLAT_STORE},
m AS (SELECT * FROM flat WHERE id NOT IN (SELECT id FROM relab) UNION ALL SELECT * FROM relab)
SELECT {STORE_REPORT} FROM m""",
    "upsert_ignore": f"""WITH {FLAT_STORE},
m AS (SELECT * FROM flat UNION ALL SELECT * FROM relab WHERE id NOT IN (SELECT id FROM flat))
SELECT {STORE_REPORT} FROM m""",
    "delete_ids": f"""WITH {FLAT_STORE}
SELECT {STORE_REPORT} FROM flat WHERE id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""",
    "delete_metadata": f"""WITH {FLAT_STORE}
SELECT {STORE_REPORT} FROM flat WHERE NOT coalesce(lang = 'de' AND label = 3, false)""",
    "exists_flag": f"""WITH {STORE_CTE}
SELECT l.doc_id AS id, l.doc_id IN (SELECT id FROM store) AS "exists" FROM labels l""",
    "record_count": f"""WITH {STORE_CTE} SELECT count(*) AS record_count FROM store""",
    "metadata_expand": f"""WITH {STORE_CTE}
SELECT CAST(id AS VARCHAR) AS id, json_object('lang', lang, 'source', source, 'label', label)::VARCHAR AS metadata,
       lang, source, CAST(label AS BIGINT) AS label FROM store""",
    "event_props": """SELECT CAST(event_id AS VARCHAR) AS id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k,
       json_extract_string(props, '$.missing') AS missing FROM events""",
})


DOCS_CTE = """
docs AS (
  SELECT o.o_orderkey AS doc_id, 'Notice ' || substr(o.o_orderpriority, 3) AS title,
    CASE c.c_mktsegment WHEN 'AUTOMOBILE' THEN 'Employment Agency' WHEN 'BUILDING' THEN 'Tax'
      WHEN 'FURNITURE' THEN 'Health' WHEN 'HOUSEHOLD' THEN 'Immigration' ELSE 'Other' END AS sender,
    CAST(o.o_orderdate AS DATE) AS sent_date, c.c_name AS addressed_to,
    'Amount ' || printf('%.2f', o.o_totalprice) AS content,
    'Order ' || o.o_orderkey || ' status ' || o.o_orderstatus AS summary,
    o.o_orderstatus AS st, o.o_orderpriority AS pr, o.o_totalprice AS amount, o.o_orderdate AS od,
    CAST(c.c_nationkey AS VARCHAR) AS nk, c.c_custkey AS custkey, '/scans/' || o.o_orderkey || '.pdf' AS source_path
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey),
acts AS (
  SELECT d.*, 0 AS action_no,
         CASE st WHEN 'P' THEN 'payment_required' WHEN 'O' THEN 'appointment' ELSE 'reply_required' END AS action_type
  FROM docs d WHERE pr NOT IN ('5-LOW', '4-NOT SPECIFIED')
  UNION ALL SELECT d.*, 0, 'no_action' FROM docs d WHERE pr = '4-NOT SPECIFIED'
  UNION ALL SELECT d.*, 1, 'no_action' FROM docs d WHERE pr = '3-MEDIUM'),
actd AS (SELECT *,
   od + INTERVAL 7 DAY + INTERVAL 9 HOUR AS appt_date, 'Office ' || nk AS appt_loc,
   CASE WHEN pr = '2-HIGH' THEN NULL ELSE 'passport, form ' || pr END AS appt_docs,
   CASE WHEN pr = '1-URGENT' THEN 'Bring originals' END AS appt_notes,
   od + INTERVAL 30 DAY + INTERVAL 12 HOUR AS reply_deadline, 'PO Box ' || nk AS reply_addr,
   'Treasury ' || nk AS pay_recipient, od + INTERVAL 14 DAY AS pay_deadline,
   CASE WHEN pr = '1-URGENT' THEN 'REF-' || doc_id END AS pay_ref,
   json_object('iban', 'DE' || lpad(CAST(custkey AS VARCHAR), 20, '0'))::VARCHAR AS bank,
   addressed_to || '/' || sender || '/' || strftime(sent_date, '%Y-%m-%d') || '_' || replace(title, ' ', '_') || '.pdf' AS link
  FROM acts)"""

RECORD_ID = """sha256(concat(doc_id, chr(10), 'Bescheid ' || pr, chr(10), title, chr(10), strftime(sent_date, '%Y-%m-%d'), chr(10),
  'Betrag ' || printf('%.2f', amount), chr(10), summary, chr(10), contents))"""

TS = "'%Y-%m-%dT%H:%M:%S'"
DTS = "'%Y-%m-%d %H:%M:%S'"

ORACLE.update({
    "calendar_events": f"""WITH {DOCS_CTE},
e AS (SELECT *, CASE action_type WHEN 'appointment' THEN appt_date WHEN 'reply_required' THEN reply_deadline
                 ELSE pay_deadline END AS st_ts FROM actd WHERE action_type <> 'no_action')
SELECT doc_id, action_no,
  CASE action_type WHEN 'appointment' THEN 'Appointment: ' || title WHEN 'reply_required' THEN 'Deadline: Reply Required - ' || title
       ELSE 'Deadline: Payment Required - ' || title END AS summary,
  CASE action_type WHEN 'appointment' THEN appt_loc WHEN 'reply_required' THEN reply_addr ELSE '' END AS location,
  CASE action_type
    WHEN 'appointment' THEN concat_ws(chr(10), 'Summary: ' || summary, 'Required Documents: ' || coalesce(appt_docs, 'None'),
         'Additional Notes: ' || coalesce(appt_notes, 'None'), 'Document Link: ' || link)
    WHEN 'reply_required' THEN concat_ws(chr(10), 'Summary: ' || summary, 'Documents to send (Original): Antwortbogen',
         'Documents to send (English): Reply form', 'Address: ' || reply_addr, 'Document Link: ' || link)
    ELSE concat_ws(chr(10), 'Summary: ' || summary, 'Amount: ' || printf('%.2f', amount), 'Recipient: ' || pay_recipient,
         'Reference: ' || coalesce(pay_ref, 'None'), 'Bank Details: ' || bank) END AS description,
  strftime(st_ts, {TS}) AS start_ts, strftime(st_ts + INTERVAL 1 HOUR, {TS}) AS end_ts, 'Europe/Berlin' AS tz,
  '[{{"method":"email","minutes":10}},{{"method":"popup","minutes":10}}]' AS reminders
FROM e""",

    "action_overview": f"""WITH {DOCS_CTE}
SELECT doc_id, action_no,
  CASE action_type WHEN 'no_action' THEN 'No Action' WHEN 'appointment' THEN 'Appointment'
       WHEN 'reply_required' THEN 'Reply Required' ELSE 'Payment Required' END AS type,
  CASE action_type
    WHEN 'appointment' THEN 'Date: ' || strftime(appt_date, {DTS}) || chr(10) || 'Location: ' || appt_loc
    WHEN 'reply_required' THEN 'Deadline: ' || strftime(reply_deadline, {DTS}) || chr(10) || 'Address: ' || reply_addr
    WHEN 'payment_required' THEN 'Amount: ' || printf('%.2f', amount) || chr(10) || 'Deadline: ' || strftime(pay_deadline, {DTS})
    ELSE '' END AS details
FROM actd""",

    "tasks": f"""WITH {DOCS_CTE},
t AS (SELECT *, CASE action_type WHEN 'reply_required' THEN reply_deadline WHEN 'payment_required' THEN pay_deadline END AS due_ts FROM actd)
SELECT doc_id, action_no, CASE action_type WHEN 'reply_required' THEN 'Reply: ' || title ELSE 'Pay: ' || title END AS title,
  summary AS notes, strftime(timezone('UTC', timezone('Europe/Berlin', due_ts)), '%Y-%m-%dT%H:%M:%SZ') AS due
FROM t WHERE due_ts IS NOT NULL""",

    "file_paths": f"""WITH {DOCS_CTE},
f AS (SELECT *, strftime(sent_date, '%Y-%m-%d') || '_' || replace(title, ' ', '_') || '.pdf' AS name FROM docs WHERE pr <> '5-LOW')
SELECT doc_id, name, addressed_to || '/' || sender AS folder_path, addressed_to || '/' || sender || '/' || name AS path,
  regexp_replace(source_path, '\\.[^./]*$', '') || '_with_summary.pdf' AS uploaded_from
FROM f""",

    "folder_get_or_create": f"""WITH {DOCS_CTE},
d AS (SELECT DISTINCT addressed_to AS a, sender AS s, sent_date < DATE '1998-01-01' AS old FROM docs WHERE pr <> '5-LOW'),
w AS (SELECT * FROM d UNION ALL SELECT a || '/B', s, false FROM d UNION ALL SELECT a, 'B/' || s, false FROM d UNION ALL SELECT a || ' again', NULL, false FROM d),
l1 AS (SELECT a AS name, bool_or(old) AS old FROM w GROUP BY a),
l2 AS (SELECT a, s, bool_or(old) AS old FROM w WHERE s IS NOT NULL GROUP BY a, s),
f1 AS (SELECT CASE WHEN old THEN 'old-' || sha256(name) ELSE sha256(strlen(name) || ':' || name) END AS id,
              name, CAST(NULL AS VARCHAR) AS parent_id, name AS path FROM l1),
f2 AS (SELECT CASE WHEN l2.old THEN 'old-' || sha256(a || '/' || s) ELSE sha256(strlen(a) || ':' || a || strlen(s) || ':' || s) END AS id,
              s AS name, f1.id AS parent_id, a || '/' || s AS path
       FROM l2 JOIN f1 ON f1.name = a)
SELECT * FROM f1 UNION ALL SELECT * FROM f2""",

    "document_card": """WITH last AS (SELECT conv_id AS doc_id, max(turn) AS seq, arg_max(text, turn) AS record FROM conversations GROUP BY conv_id)
SELECT doc_id,
  coalesce(CASE WHEN seq >= 0 THEN 'Sender ' || doc_id END, 'Processing...') AS from_,
  coalesce(CASE WHEN seq >= 1 THEN 'Person ' || doc_id END, 'Processing...') AS to_,
  coalesce(CASE WHEN seq >= 2 THEN 'Title ' || seq END, 'Processing...') AS title,
  coalesce(CASE WHEN seq >= 3 THEN record END, 'Processing summary...') AS summary
FROM last""",

    "summary_text": f"""WITH {DOCS_CTE},
atext AS (SELECT doc_id, action_no, CASE action_type
   WHEN 'appointment' THEN concat_ws(chr(10), 'Appointment:', '- Date: ' || strftime(appt_date, {DTS}), '- Location: ' || appt_loc,
        '- Required Documents: ' || coalesce(appt_docs, 'None'))
   WHEN 'reply_required' THEN concat_ws(chr(10), 'Reply Required:', '- Deadline: ' || strftime(reply_deadline, {DTS}),
        '- Documents (Original): Antwortbogen', '- Documents (English): Reply form')
   WHEN 'payment_required' THEN concat_ws(chr(10), 'Payment Required:', '- Amount: ' || printf('%.2f', amount),
        '- Deadline: ' || strftime(pay_deadline, {DTS}), '- Recipient: ' || pay_recipient)
   ELSE 'No specific action details' END AS t FROM actd),
agg AS (SELECT doc_id, string_agg(t, chr(10) ORDER BY action_no) AS acts FROM atext GROUP BY doc_id)
SELECT d.doc_id, concat_ws(chr(10), 'Document Summary', 'Sender: ' || d.sender, 'Addressed To: ' || d.addressed_to,
  'Document Title: ' || d.title, 'Summary: ' || d.summary, 'Required Actions:', coalesce(agg.acts, 'No actions required')) AS summary_text
FROM docs d LEFT JOIN agg USING (doc_id)""",

    "record_rules": """SELECT o.o_orderkey AS doc_id,
  array_to_string(list_slice(string_split_regex(trim('Notice of ' || o.o_orderpriority || ' order status'), '\\s+'), 1, 3), ' ') AS title_in_english,
  CASE c.c_mktsegment WHEN 'AUTOMOBILE' THEN 'Employment Agency' WHEN 'BUILDING' THEN 'Tax' WHEN 'FURNITURE' THEN 'Health'
       WHEN 'HOUSEHOLD' THEN 'Immigration' ELSE 'Other' END AS sender,
  regexp_replace(trim(CASE o.o_orderstatus WHEN 'P' THEN 'Herr ' WHEN 'O' THEN 'Frau Dr. ' ELSE '' END || c.c_name),
                 '^((Herr|Frau|Dr\\.)\\s+)+', '') AS addressed_to
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey""",

    "embedding_text": f"""WITH {DOCS_CTE},
aj AS (SELECT doc_id, action_no, json_object('action_type', action_type,
    'appointment', CASE WHEN action_type = 'appointment' THEN json_object('date', strftime(appt_date, {TS}), 'location', appt_loc,
        'required_documents', CASE WHEN pr = '2-HIGH' THEN NULL ELSE ['passport', 'form ' || pr] END, 'additional_notes', appt_notes) END,
    'reply', CASE WHEN action_type = 'reply_required' THEN json_object('documents_to_send_in_original_language', ['Antwortbogen'],
        'documents_to_send_in_english', ['Reply form'], 'deadline', strftime(reply_deadline, {TS}), 'address_to_send_to', reply_addr) END,
    'payment', CASE WHEN action_type = 'payment_required' THEN json_object('recipient', pay_recipient, 'amount', amount,
        'deadline', strftime(pay_deadline, {TS}), 'bank_details', json_object('iban', 'DE' || lpad(CAST(custkey AS VARCHAR), 20, '0')),
        'reference_number', pay_ref) END)::VARCHAR AS j FROM actd),
lines AS (SELECT doc_id, string_agg(chr(10) || 'Required Action: ' || j, '' ORDER BY action_no) AS l FROM aj GROUP BY doc_id),
c AS (SELECT d.*, 'Sender: ' || d.sender || chr(10) || 'Addressed to: ' || d.addressed_to || chr(10) || d.content || coalesce(lines.l, '') AS contents
      FROM docs d JOIN lines USING (doc_id))
SELECT doc_id, {RECORD_ID} AS id, contents, sender, addressed_to, strftime(sent_date, '%Y-%m-%d') AS sent_date FROM c""",

    "hash_embed_stats": f"""WITH {_hash_counts('d', 'documents', 'doc_id')}
SELECT doc_id, CAST(sum(c) AS BIGINT) AS n_tokens, CASE WHEN count(b) = 0 THEN NULL ELSE count(b) END::BIGINT AS n_buckets,
       CAST(sum((b + 1) * c) AS BIGINT) AS checksum
FROM documents LEFT JOIN d_b ON d_b.k = documents.doc_id GROUP BY doc_id""",

    "page_assembly": """SELECT conv_id AS doc_id, coalesce(string_agg(text, chr(10) ORDER BY turn), '') AS text
FROM conversations GROUP BY conv_id""",

    "page_prepend": """WITH p AS (SELECT conv_id AS doc_id, turn AS page_no, text FROM conversations
  UNION ALL SELECT conv_id, -1, 'Summary: ' || count(*) || ' pages' FROM conversations GROUP BY conv_id)
SELECT doc_id, coalesce(string_agg(text, chr(10) ORDER BY page_no), '') AS text FROM p GROUP BY doc_id""",

    "last_partial": """SELECT conv_id AS doc_id, max(turn) AS seq, arg_max(text, turn) AS text FROM conversations GROUP BY conv_id""",
})


_SENDER_RE = "(^|[^a-z]){w}([^a-z]|$)"


def _sender_case(q: str) -> str:
    def m(w):
        return f"regexp_matches(lower({q}), '{_SENDER_RE.format(w=w)}')"
    return (f"CASE WHEN {m('employment agency')} OR {m('employment')} THEN 'Employment Agency' "
            f"WHEN {m('tax')} THEN 'Tax' WHEN {m('health')} THEN 'Health' WHEN {m('immigration')} THEN 'Immigration' END")


def _window(q: str, d: str, part: str) -> str:
    wk, mo, yr = f"CAST(date_trunc('week', {d}) AS DATE)", f"CAST(date_trunc('month', {d}) AS DATE)", f"CAST(date_trunc('year', {d}) AS DATE)"
    rules = [("last week", f"{wk} - INTERVAL 7 DAY", wk), ("this week", wk, f"{wk} + INTERVAL 7 DAY"),
             ("last month", f"{mo} - INTERVAL 1 MONTH", mo), ("this month", mo, f"{mo} + INTERVAL 1 MONTH"),
             ("last year", f"{yr} - INTERVAL 1 YEAR", yr), ("this year", yr, f"{yr} + INTERVAL 1 YEAR"),
             ("yesterday", f"{d} - INTERVAL 1 DAY", d), ("today", d, f"{d} + INTERVAL 1 DAY")]
    idx = 1 if part == "start" else 2
    whens = " ".join(f"WHEN contains(lower({q}), '{r[0]}') THEN CAST({r[idx]} AS TIMESTAMP)" for r in rules)
    return f"CASE {whens} END"


QUESTIONS_CTE = f"""
qs AS (SELECT b.item_id AS query_id,
   b.text || CASE b.item_id % 4 WHEN 1 THEN ' Which letters came from the tax office last month?'
     WHEN 2 THEN ' Show letters addressed to ' || coalesce(c.c_name, 'nobody') || ' please.'
     WHEN 3 THEN ' Anything for ' || coalesce(c.c_name, 'nobody') || ' from health this year?' ELSE '' END AS question,
   DATE '2001-07-20' AS as_of
   FROM benchmark b LEFT JOIN customer c ON b.item_id = c.c_custkey),
pre AS (SELECT qs.*, {_sender_case('question')} AS q_sender,
   (SELECT min(c_name) FROM customer WHERE contains(qs.question, c_name)) AS q_addressed_to,
   {_window('question', 'as_of', 'start')} AS start_ts, {_window('question', 'as_of', 'end')} AS end_ts FROM qs)"""

DOC_ROWS_CTE = f"""{DOCS_CTE},
aj AS (SELECT doc_id, action_no, json_object('action_type', action_type,
    'appointment', CASE WHEN action_type = 'appointment' THEN json_object('date', strftime(appt_date, {TS}), 'location', appt_loc,
        'required_documents', CASE WHEN pr = '2-HIGH' THEN NULL ELSE ['passport', 'form ' || pr] END, 'additional_notes', appt_notes) END,
    'reply', CASE WHEN action_type = 'reply_required' THEN json_object('documents_to_send_in_original_language', ['Antwortbogen'],
        'documents_to_send_in_english', ['Reply form'], 'deadline', strftime(reply_deadline, {TS}), 'address_to_send_to', reply_addr) END,
    'payment', CASE WHEN action_type = 'payment_required' THEN json_object('recipient', pay_recipient, 'amount', amount,
        'deadline', strftime(pay_deadline, {TS}), 'bank_details', json_object('iban', 'DE' || lpad(CAST(custkey AS VARCHAR), 20, '0')),
        'reference_number', pay_ref) END)::VARCHAR AS j FROM actd),
lines AS (SELECT doc_id, string_agg(chr(10) || 'Required Action: ' || j, '' ORDER BY action_no) AS l,
                 string_agg(j, ',' ORDER BY action_no) AS a FROM aj GROUP BY doc_id),
ds AS (SELECT d.*, '[' || coalesce(lines.a, '') || ']' AS actions, 'Sender: ' || d.sender || chr(10) || 'Addressed to: ' || d.addressed_to || chr(10) || d.content || coalesce(lines.l, '') AS contents,
        CAST(d.sent_date AS TIMESTAMP) + INTERVAL 1 DAY + INTERVAL 8 HOUR AS ingest_ts
      FROM docs d LEFT JOIN lines USING (doc_id)),
dsi AS (SELECT *, {RECORD_ID} AS id FROM ds)"""


def _doc_store(dim: int) -> str:
    return DOC_ROWS_CTE + f""",
{_hash_counts('s', 'dsi', 'id', 'contents', dim)}, {_hash_counts('q', 'pre', 'query_id', 'question', dim)},
dots AS (SELECT q.k AS qk, s.k AS sk, sum(q.c * s.c) AS dot FROM q_b q JOIN s_b s USING (b) GROUP BY ALL),
cand AS (SELECT pre.query_id, dsi.id, dsi.doc_id, dsi.title, dsi.sender, dsi.sent_date, dsi.addressed_to, dsi.summary, dsi.contents, dsi.pr, dsi.actions,
           1 - coalesce(dots.dot, 0) / (qn.n * sn.n) AS distance
   FROM pre JOIN q_n qn ON qn.k = pre.query_id CROSS JOIN dsi JOIN s_n sn ON sn.k = dsi.id
   LEFT JOIN dots ON dots.qk = pre.query_id AND dots.sk = dsi.id
   WHERE ((pre.q_sender IS NULL AND pre.q_addressed_to IS NULL) OR dsi.sender = pre.q_sender OR dsi.addressed_to = pre.q_addressed_to)
     AND (pre.start_ts IS NULL OR dsi.ingest_ts >= pre.start_ts) AND (pre.end_ts IS NULL OR dsi.ingest_ts < pre.end_ts)),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM cand) WHERE rank <= 3)"""


DOC_STORE_CTE = _doc_store(64)

CONTEXT_SQL = """'[' || string_agg(json_object('content', contents, 'title_in_english', title, 'title_in_original_language', 'Bescheid ' || pr, 'sender', sender,
   'sent_date', strftime(sent_date, '%Y-%m-%d'), 'addressed_to', addressed_to, 'summary_in_english', summary, 'required_actions', actions::JSON)::VARCHAR, ',' ORDER BY rank) || ']'"""

ORACLE.update({
    "question_filters": f"""WITH {QUESTIONS_CTE}
SELECT query_id, q_sender AS sender, q_addressed_to AS addressed_to, strftime(start_ts, {TS}) AS start_ts,
       strftime(end_ts, {TS}) AS end_ts FROM pre""",
    "rag_search": f"""WITH {QUESTIONS_CTE}, {DOC_STORE_CTE}
SELECT query_id, rank, doc_id, round(distance, 6) AS distance FROM hits""",
    "rag_context": f"""WITH {QUESTIONS_CTE}, {DOC_STORE_CTE}
SELECT query_id, {CONTEXT_SQL} AS context, count(*) AS n_context FROM hits GROUP BY query_id""",
})


def _answers(dim: int, more: str = "") -> str:
    return f"""WITH {QUESTIONS_CTE}, {_doc_store(dim)},
agg AS (SELECT query_id, min(distance) AS md, count(*) AS n FROM hits GROUP BY query_id),
top AS (SELECT * FROM hits WHERE rank = 1)
SELECT qs.query_id,
  CASE WHEN coalesce(agg.md <= 0.35, false) THEN 'According to ''' || top.title || ''' (' || strftime(top.sent_date, '%Y-%m-%d') || '): ' || top.summary
       ELSE 'I cannot answer this from the stored documents.' END AS answer,
  coalesce(agg.md <= 0.35, false) AS enough_context, coalesce(agg.n, 0) AS n_context{more}
FROM pre AS qs LEFT JOIN agg USING (query_id) LEFT JOIN top USING (query_id)"""


ORACLE["default_answer"] = _answers(64)
ORACLE["answer_with_embedder"] = _answers(128, ", qs.q_sender AS sender, qs.q_addressed_to AS addressed_to")

ORACLE["stream_last_partial"] = ORACLE["last_partial"]

_REASONS = ", ".join(f"'{reason}'" for _, reason in BROKEN_ACTIONS)

ORACLE["record_parse"] = f"""WITH {DOCS_CTE}
SELECT 'doc-' || doc_id AS src, 'ok' AS status,
       CAST(CASE pr WHEN '5-LOW' THEN 0 WHEN '3-MEDIUM' THEN 2 ELSE 1 END AS INTEGER) AS n_actions FROM docs
UNION ALL SELECT 'bad-' || doc_id, [{_REASONS}][doc_id % {len(BROKEN_ACTIONS)} + 1], CAST(NULL AS INTEGER) FROM docs
UNION ALL SELECT 'page-' || page_id, 'unparseable', CAST(NULL AS INTEGER) FROM pages"""

ORACLE["uuid_time_ids"] = """WITH u AS (
  SELECT event_id, ts, lpad(lower(hex(epoch_us(ts) * 10 + 122192928000000000)), 15, '0') AS h,
         lpad(lower(hex(32768 + event_id % 16384)), 4, '0') AS clock, lpad(lower(hex(user_id % 281474976710656)), 12, '0') AS node
  FROM events),
ids AS (SELECT event_id, ts, substr(h, 8, 8) || '-' || substr(h, 4, 4) || '-1' || substr(h, 1, 3) || '-' || clock || '-' || node AS id FROM u),
back AS (SELECT *, make_timestamp(((('0x' || substr(id, 16, 3) || substr(id, 10, 4) || substr(id, 1, 8))::BIGINT - 122192928000000000) // 10)) AS t FROM ids)
SELECT event_id, id, strftime(t, '%Y-%m-%dT%H:%M:%S') AS id_time, t = ts AS "exact" FROM back"""

ORACLE["event_file_links"] = f"""WITH {DOCS_CTE}
SELECT doc_id, action_no,
  CASE action_type WHEN 'payment_required' THEN 'Bank Details: ' || bank
       ELSE 'Document Link: file/' || sha256(link) END AS link_line
FROM actd WHERE action_type <> 'no_action'"""

ORACLE["doc_search_sent_date"] = f"""WITH {DOC_ROWS_CTE},
f AS (SELECT * FROM dsi WHERE sent_date >= DATE '1996-01-01' AND sent_date < DATE '1997-01-01'),
{_hash_counts('s', 'f', 'id', 'contents')}, {_hash_counts('q', 'benchmark', 'item_id')},
dots AS (SELECT q.k AS qk, s.k AS sk, sum(q.c * s.c) AS dot FROM q_b q JOIN s_b s USING (b) GROUP BY ALL),
pairs AS (SELECT qn.k AS query_id, f.doc_id, f.id, 1 - coalesce(dots.dot, 0) / (qn.n * sn.n) AS distance
          FROM q_n qn CROSS JOIN f JOIN s_n sn ON sn.k = f.id LEFT JOIN dots ON dots.qk = qn.k AND dots.sk = f.id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM pairs)
SELECT query_id, rank, doc_id, round(distance, 6) AS distance FROM ranked WHERE rank <= 3"""

ORACLE["event_utc"] = f"""WITH {DOCS_CTE},
e AS (SELECT *, CASE action_type WHEN 'appointment' THEN appt_date WHEN 'reply_required' THEN reply_deadline
                 ELSE pay_deadline END AS st_ts FROM actd WHERE action_type <> 'no_action')
SELECT doc_id, action_no,
  strftime(timezone('UTC', timezone('Europe/Berlin', st_ts)), {TS}) AS start_utc,
  strftime(timezone('UTC', timezone('Europe/Berlin', st_ts + INTERVAL 1 HOUR)), {TS}) AS end_utc
FROM e"""


ORACLE["record_roundtrip"] = f"""WITH {DOCS_CTE}
SELECT summary AS summary_in_english, sender, addressed_to, strftime(sent_date, '%Y-%m-%d') AS sent_date, 'Betrag ' || printf('%.2f', amount) AS content_in_original_language,
       CAST(CASE pr WHEN '5-LOW' THEN 0 WHEN '3-MEDIUM' THEN 2 ELSE 1 END AS BIGINT) AS n_actions FROM docs"""

UNDATED_REPORT = "id, CASE WHEN id % 4 <> 1 THEN strftime(ingest_ts, '%Y-%m-%dT%H:%M:%S') END AS ingest_ts, lang, source, label, length(contents) AS n_chars"

ORACLE["table_upsert"] = f"""WITH {FLAT_STORE},
m AS (SELECT * FROM flat WHERE id NOT IN (SELECT id FROM relab) UNION ALL SELECT * FROM relab)
SELECT {UNDATED_REPORT} FROM m"""

ORACLE["table_delete"] = f"""WITH {FLAT_STORE}
SELECT {UNDATED_REPORT} FROM flat WHERE id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) AND NOT coalesce(lang = 'de' AND source = 'src1', false)"""

ORACLE["table_in_week"] = ORACLE["table_upsert"] + " WHERE id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)"

ORACLE["table_clear"] = f"""WITH {FLAT_STORE} SELECT count(*) AS n_before, CAST(0 AS BIGINT) AS n_after FROM flat"""

ORACLE["stream_ingest"] = f"""WITH {DOC_ROWS_CTE}
SELECT contents, sender, addressed_to, strftime(sent_date, '%Y-%m-%d') AS sent_date, CAST(64 AS BIGINT) AS dim FROM dsi"""

ORACLE["page_files"] = """SELECT source, doc_id // 200 AS part,
       sha256(string_agg(translate(text, chr(10) || chr(13), '  '), chr(10) || chr(10) ORDER BY doc_id) || chr(10) || chr(10)) AS digest, count(*) + 1 AS n_pages
FROM documents GROUP BY ALL"""

ORACLE["ann_full_probe"] = ORACLE["ann_topk"] = ORACLE["ann_topk_grouped"] = ORACLE["topk_batch"]
ORACLE["ann_after_changes"] = f"""
WITH {STORE_CTE}, {LABEL_Q_CTE},
changed AS (SELECT id, CASE WHEN id % 5 = 0 THEN list_reverse(embedding) ELSE embedding END AS embedding FROM store
            UNION ALL SELECT id + 100000000, list_transform(embedding, lambda x: -x) FROM store WHERE id % 7 = 0),
fs AS (SELECT * FROM changed WHERE id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL)),
pairs AS (SELECT lq.query_id, s.id,
   1 - list_dot_product(s.embedding, lq.q) / (sqrt(list_dot_product(s.embedding, s.embedding)) * sqrt(list_dot_product(lq.q, lq.q))) AS distance
   FROM lq, fs s),
{_rank('pairs', 3)}"""
ORACLE["ann_full_probe_filtered"] = _ftopk("lang = 'de'")
ORACLE["topk_question_blocks"] = ORACLE["topk_batch"]

ORACLE["question_names"] = """SELECT c_custkey AS query_id,
       ['', 'Anna ', 'Anna Maria ', 'Anna Maria von ', 'Dr Anna Maria von '][c_custkey % 5 + 1] || c_name AS addressed_to FROM customer"""

_SYSTEM = SYSTEM_PROMPT.replace("'", "''")
ORACLE["answer_messages"] = f"""WITH {QUESTIONS_CTE}, {DOC_STORE_CTE},
ctx AS (SELECT query_id, {CONTEXT_SQL} AS context FROM hits GROUP BY query_id)
SELECT query_id, CAST(0 AS BIGINT) AS "no", 'system' AS role, sha256('{_SYSTEM}') AS digest FROM qs
UNION ALL SELECT query_id, 1, 'user', sha256('Question:' || chr(10) || question) FROM qs
UNION ALL SELECT query_id, 2, 'assistant', sha256('Documents found:' || chr(10) || coalesce(context, '[]')) FROM qs LEFT JOIN ctx USING (query_id)"""

ORACLE["model_retries"] = """SELECT o_orderkey AS doc_id,
  CASE WHEN o_orderkey % 15 <> 0 THEN 'answer ' || o_orderkey || ' after ' || (CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END) END AS answer,
  CASE WHEN o_orderkey % 15 = 0 THEN 'unparseable output' END AS reason FROM orders"""
ORACLE["model_partials"] = """SELECT o_orderkey AS doc_id, o_orderkey % 4 AS seq,
  '{"title": "title ' || o_orderkey || CASE WHEN o_orderkey % 4 > 0 THEN '", "sender": "sender ' || o_orderkey ELSE '' END
  || CASE WHEN o_orderkey % 4 > 1 THEN '", "summary": "summary ' || o_orderkey ELSE '' END
  || CASE WHEN o_orderkey % 4 > 2 THEN '", "addressee": "addressee ' || o_orderkey ELSE '' END || '"}' AS record,
  o_orderkey % 4 + 1 AS n_partials, CASE WHEN o_orderkey % 9 = 0 THEN 'RuntimeError: connection lost' END AS error FROM orders"""
ORACLE["process_documents_tables"] = f"""WITH {DOCS_CTE}
SELECT doc_id, sender, addressed_to, title AS title_in_english, strftime(sent_date, '%Y-%m-%d') AS sent_date, summary AS summary_in_english,
  CASE WHEN sender = 'Tax' THEN 'Deadline: Reply Required - ' || title END AS event,
  CASE WHEN sender = 'Tax' THEN strftime(sent_date, '%Y-%m-%dT12:00:00') END AS start_ts FROM docs"""
ORACLE["ingest_table"] = ORACLE["stream_ingest"]
ORACLE["stream_rejects"] = f"""SELECT reason, count(*) AS n FROM (
  SELECT [{_REASONS}][o_orderkey % {len(BROKEN_ACTIONS)} + 1] AS reason FROM orders JOIN customer ON o_custkey = c_custkey
  UNION ALL SELECT 'unparseable' FROM documents WHERE trim(translate(text, chr(10) || chr(13), '  ')) <> '') GROUP BY reason"""

ORACLE["stream_fold_state"] = ORACLE["last_partial"]
ORACLE["topk_question_groups"] = ORACLE["topk_batch"]
