"""Document records: parse/validate (SR5), JSON scan/sink (SR3, SK1), vector record projection (PF1-PF3).

Validation never aborts a batch: every record lands either in ``ok`` or in
``rejects`` with a reason (D12).
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_
from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.meta import pack_metadata
from ..functions.times import ISO_NTZ, parse_iso, week_start
from ..functions.vectors import l2_norm
from ..schemas import ACTION_TYPES, DOC, DOC_REQUIRED, SENDERS
from ..session import shuffles_removed
from .embed import embedding_text, hash_embed

CORRUPT = "_corrupt_record"
JSON_OPTS = {"timestampNTZFormat": ISO_NTZ, "dateFormat": "yyyy-MM-dd"}


# Fields every action detail must carry.
DETAIL_REQUIRED = {
    "appointment": ("date", "location"),
    "reply": ("documents_to_send_in_original_language", "documents_to_send_in_english", "deadline", "address_to_send_to"),
    "payment": ("recipient", "amount", "deadline", "bank_details"),
}


def _tag_ok(a: Column) -> Column:
    """The action has a known tag and the details its tag names; a null action or tag does not."""
    t = a["action_type"]
    return F.coalesce(t.isin(*ACTION_TYPES)
                      & ((t != "appointment") | a["appointment"].isNotNull())
                      & ((t != "reply_required") | a["reply"].isNotNull())
                      & ((t != "payment_required") | a["payment"].isNotNull()), F.lit(False))


def _details_ok(a: Column) -> Column:
    """Every detail the action carries has all its required fields (text that is no number reads as missing)."""
    whole = [a[d].isNull() | reduce(and_, [a[d][f].isNotNull() for f in fields]) for d, fields in DETAIL_REQUIRED.items()]
    return reduce(and_, whole)


def reject_reason(doc: Column | None = None) -> Column:
    """First failing rule of a parsed record (null = valid)."""
    r = F.col("rec") if doc is None else doc
    missing = [F.when(r[f].isNull(), F.lit(f"missing {f}")) for f in DOC_REQUIRED]
    return F.coalesce(
        F.when(r.isNull(), F.lit("unparseable")),
        *missing,
        F.when(~r["sender"].isin(*SENDERS), F.lit("sender outside domain")),
        F.when(~F.forall(r["required_actions"], _tag_ok), F.lit("action tag without its details")),
        F.when(~F.forall(r["required_actions"], _details_ok), F.lit("action detail without a required field")),
    )


def _leaves(dt: T.DataType, leaf: T.DataType) -> T.DataType:
    """The schema with every text, date and time replaced by ``leaf``."""
    if isinstance(dt, (T.TimestampNTZType, T.TimestampType, T.DateType, T.StringType)):
        return leaf
    if isinstance(dt, T.StructType):
        return T.StructType([T.StructField(f.name, _leaves(f.dataType, leaf), f.nullable) for f in dt.fields])
    if isinstance(dt, T.ArrayType):
        return T.ArrayType(_leaves(dt.elementType, leaf), dt.containsNull)
    if isinstance(dt, T.MapType):
        return T.MapType(dt.keyType, _leaves(dt.valueType, leaf), dt.valueContainsNull)
    return dt


def _wrapped(leaf: T.DataType) -> T.StructType:
    """A record between the brackets of an array: text after it makes the whole malformed."""
    return T.StructType([T.StructField("r", T.ArrayType(_leaves(DOC, leaf))), T.StructField(CORRUPT, T.StringType())])


#: Texts as Spark reads them, which turns other JSON values into text too; and as variants, which keep the JSON type they had.
AS_TEXT, AS_FOUND = _wrapped(T.StringType()), _wrapped(T.VariantType())
#: How the texts begin, and look, that Spark makes of JSON lists, objects, numbers and words.
OTHER_FIRST = [ord(x) for x in '[{"+-0123456789tfNI']
OTHER = r'^([\[{"]|([-+]?[0-9.]+([eE][-+]?[0-9]+)?|true|false|NaN|[-+]?(INF|Infinity))\s*$)'


def _is_text(dt: T.DataType) -> bool:
    return isinstance(dt, (T.StringType, T.TimestampNTZType, T.DateType))


def _texts(c: Column, dt: T.DataType) -> Column:
    """Value as found -> the same with its variants as text."""
    if _is_text(dt):
        return F.try_variant_get(c, "$", "string")
    if isinstance(dt, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[_texts(c[f.name], f.dataType).alias(f.name) for f in dt.fields]))
    if isinstance(dt, T.ArrayType):
        return F.transform(c, lambda x: _texts(x, dt.elementType))
    if isinstance(dt, T.MapType):
        return F.transform_values(c, lambda _, v: _texts(v, dt.valueType))
    return c


def _typed(c: Column, dt: T.DataType) -> Column:
    """Value with its dates as text -> ``dt``; bad date/time text becomes null."""
    if isinstance(dt, T.TimestampNTZType):
        return parse_iso(c)
    if isinstance(dt, T.DateType):
        return F.to_date(parse_iso(c))
    if isinstance(dt, T.StructType) and _dated(dt):
        return F.when(c.isNotNull(), F.struct(*[_typed(c[f.name], f.dataType).alias(f.name) for f in dt.fields]))
    if isinstance(dt, T.ArrayType) and _dated(dt):
        return F.transform(c, lambda x: _typed(x, dt.elementType))
    return c


def _any(parts: list[Column]) -> Column:
    return reduce(or_, [F.coalesce(p, F.lit(False)) for p in parts], F.lit(False))


def _dated(dt: T.DataType) -> bool:
    if isinstance(dt, T.StructType):
        return any(_dated(f.dataType) for f in dt.fields)
    return _dated(dt.elementType) if isinstance(dt, T.ArrayType) else isinstance(dt, (T.TimestampNTZType, T.DateType))


def _bad_dates(text: Column, typed: Column, dt: T.DataType) -> Column:
    """True when some date/time text did not parse."""
    if isinstance(dt, (T.TimestampNTZType, T.DateType)):
        return text.isNotNull() & typed.isNull()
    if isinstance(dt, T.StructType):
        return text.isNotNull() & _any([_bad_dates(text[f.name], typed[f.name], f.dataType) for f in dt.fields if _dated(f.dataType)])
    pairs = F.zip_with(text, typed, lambda x, y: _bad_dates(x, y, dt.elementType))
    return F.coalesce(F.exists(pairs, lambda bad: bad), F.lit(False))


def _looks_other(c: Column) -> Column:
    """True for every text that Spark may have made of a JSON list, object, number or word (and for some that are texts)."""
    return F.ascii(c).isin(*OTHER_FIRST) & c.rlike(OTHER)


def _perhaps_mistyped(c: Column, dt: T.DataType, inner: bool = False) -> Column:
    """False only when every text is surely one: then ``_mistyped`` of the value as found is false too."""
    if _is_text(dt):
        return (c.isNull() | _looks_other(c)) if inner else _looks_other(c)
    if isinstance(dt, T.StructType):
        return c.isNotNull() & _any([_perhaps_mistyped(c[f.name], f.dataType) for f in dt.fields if not isinstance(f.dataType, T.DoubleType)])
    if isinstance(dt, T.ArrayType):
        return F.exists(c, lambda x: F.coalesce(_perhaps_mistyped(x, dt.elementType, True), F.lit(False)))
    if isinstance(dt, T.MapType):
        return _perhaps_mistyped(F.map_values(c), T.ArrayType(dt.valueType))
    return F.lit(False)


def _mistyped(found: Column, dt: T.DataType, inner: bool = False) -> Column:
    """True when a value is no text where text is due; only lists and maps (``inner``) take no null for one."""
    if _is_text(dt):
        kind = F.schema_of_variant(found)
        return (kind != "STRING") if inner else ~kind.isin("STRING", "VOID")
    if isinstance(dt, T.StructType):
        return _any([_mistyped(found[f.name], f.dataType) for f in dt.fields if not isinstance(f.dataType, T.DoubleType)])
    if isinstance(dt, T.ArrayType):
        return F.exists(found, lambda x: F.coalesce(_mistyped(x, dt.elementType, True), F.lit(False)))
    if isinstance(dt, T.MapType):
        return F.exists(F.map_values(found), lambda x: F.coalesce(_mistyped(x, dt.valueType, True), F.lit(False)))
    return F.lit(False)


def _barrier(df: DataFrame, *names: str) -> DataFrame:
    """``names`` as a one-element ``inline`` generator gives them: no filter on them is pushed below, where it would take all their steps along."""
    return df.select(*[c for c in df.columns if c not in names], F.inline(F.array(F.struct(*names))))


def validate_records(df: DataFrame, text_col: str = "record", keep: list[str] | None = None) -> DataFrame:
    """SR5 in one pass: ``keep`` columns, ``_raw`` text, typed ``rec`` struct and ``reason`` (null = valid).

    ``from_json`` (PERMISSIVE) reads texts, dates and times as text; dates and times are then parsed
    as ISO, offsets allowed (D22). Only a record that Spark could not read whole, or with a text that
    may have been another JSON value, is read again with variants, which tell what JSON type it was.
    Reasons: malformed JSON (``unparseable``), more than one JSON value, unparseable dates,
    the record rules (``reject_reason``), and a value of another type than the schema's: a
    list or number as text, a text as list, a list with anything but texts.
    """
    keep = keep or [c for c in df.columns if c != text_col]
    between = F.concat(F.lit('{"r":['), F.col("_raw"), F.lit("]}"))
    opts = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    # one stage for every value read more than once: Spark keeps such stages apart, so each is computed once and compiled
    p = df.select(*keep, F.col(text_col).alias("_raw")).withColumn("_read", F.from_json(between, AS_TEXT, opts))
    as_text = F.get("_read.r", F.lit(0))
    # absent or null is the same in a text, not in a variant: a record without its first field is read again too
    sure = F.col(f"_read.{CORRUPT}").isNull() & (F.size("_read.r") == 1) & as_text[DOC.fields[0].name].isNotNull() & ~_perhaps_mistyped(as_text, DOC)
    p = p.withColumn("_sure", F.coalesce(sure, F.lit(False)))
    p = p.withColumn("_json", F.when(~F.col("_sure") & F.col("_read.r").isNotNull(), F.from_json(between, AS_FOUND, opts)))  # what is no JSON as text is none as variants
    p = p.withColumn("_found", F.when(F.size("_json.r") == 1, F.element_at("_json.r", 1)))
    # PERMISSIVE gives nulls for what it cannot read: treat all-null as unparseable
    some = F.coalesce(*[F.col("_found")[f.name].isNotNull() for f in DOC.fields], F.lit(False))
    p = p.withColumn("_found", F.when(some, F.col("_found")))
    p = p.withColumn("_text", F.when(F.col("_sure"), as_text).otherwise(_texts(F.col("_found"), DOC)))
    p = p.withColumn("rec", _typed(F.col("_text"), DOC))
    first = F.schema_of_variant(F.try_parse_json("_raw"))  # reads one value and stops; asked of unreadable texts alone
    p = p.withColumn("reason", F.coalesce(
        F.when(F.col("_text").isNull(), F.when(first.startswith("OBJECT") & ~F.coalesce(F.size("_json.r") == 1, F.lit(False)), F.lit("more than one value"))),
        F.when(_bad_dates(F.col("_text"), F.col("rec"), DOC), F.lit("bad date or time text")), reject_reason(),
        F.when(~F.col("_sure") & (F.col(f"_json.{CORRUPT}").isNotNull() | _mistyped(F.col("_found"), DOC)), F.lit("value of another type"))))
    return _barrier(p.select(*keep, "_raw", "rec", "reason"), "rec", "reason")


def parse_records(df: DataFrame, text_col: str = "record", keep: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """SR5 + UD1 tail: JSON text -> typed record; returns (ok, rejects) filtered from ``validate_records``.

    Use ``validate_records`` directly when both outcomes are needed in one job.
    """
    keep = keep or [c for c in df.columns if c != text_col]
    p = validate_records(df, text_col, keep)
    ok = p.filter(F.col("reason").isNull()).select(*keep, "rec.*")
    rejects = p.filter(F.col("reason").isNotNull()).select(*keep, F.col("_raw").alias(text_col), "reason")
    return ok, rejects


def record_texts(spark: SparkSession, path: str, one_per_file: bool = False, stream: bool = False) -> DataFrame:
    """(record, source): one row per line, the format ``write_records`` writes, or with ``one_per_file`` one per file; blank ones are dropped."""
    reader = spark.readStream if stream else spark.read
    rows = reader.text(path, wholetext=one_per_file)
    return rows.select(F.col("value").alias("record"), F.col("_metadata.file_path").alias("source")).filter(F.trim("record") != "")


def scan_records(spark: SparkSession, path: str, one_per_file: bool = False) -> tuple[DataFrame, DataFrame]:
    """SR3 + SR5: (valid records with ``source``, rejects with ``source``, ``record`` and ``reason``) of the record files at ``path``."""
    return parse_records(record_texts(spark, path, one_per_file))


def read_records(spark: SparkSession, path: str, one_per_file: bool = False) -> DataFrame:
    """SR3: the valid records of record files; see ``scan_records`` for those that are not."""
    return scan_records(spark, path, one_per_file)[0].drop("source")


def write_records(df: DataFrame, path: str, mode: str = "overwrite", **options) -> None:
    """SK1: JSON lines, dates as ISO text, null fields kept; ``options`` of Spark's writer, such as ``compression``."""
    with shuffles_removed(df.sparkSession):
        df.write.mode(mode).options(ignoreNullFields="false", **JSON_OPTS, **options).json(path)


def record_json(df: DataFrame) -> Column:
    """One record as JSON text (null fields kept, ISO dates)."""
    return F.to_json(F.struct(*[F.col(f.name) for f in DOC.fields]), {"ignoreNullFields": "false", **JSON_OPTS})


def compose_text(sender="sender", addressed_to="addressed_to", content="content_in_english",
                 actions="required_actions") -> Column:
    """PF1: 'Sender: ..\\nAddressed to: ..\\n<content>' + one '\\nRequired Action: <json>' per action."""
    lines = F.transform(F.col(actions), lambda a: F.concat(
        F.lit("\nRequired Action: "), F.to_json(a, {"ignoreNullFields": "false", **JSON_OPTS})))
    return F.concat(F.lit("Sender: "), F.coalesce(F.col(sender), F.lit("None")),
                    F.lit("\nAddressed to: "), F.coalesce(F.col(addressed_to), F.lit("None")),
                    F.lit("\n"), F.coalesce(F.col(content), F.lit("")),
                    F.coalesce(F.array_join(lines, ""), F.lit("")))


# Keys of the metadata, in order.
METADATA_KEYS = ["title_in_original_language", "title_in_english", "sender", "sent_date", "addressed_to",
                 "content_in_original_language", "summary_in_english", "required_actions"]


def record_id(contents: Column, columns: list[str]) -> Column:
    """Whole sha256 over the record's fields, each closed by a line end; the actions are part of ``contents``."""
    fields = [c for c in ("doc_id", "title_in_original_language", "title_in_english", "sent_date", "content_in_original_language", "summary_in_english") if c in columns]
    return F.sha2(F.concat(*[x for f in fields for x in (F.coalesce(F.col(f).cast("string"), F.lit("")), F.lit("\n"))], contents), 256)


def vector_records(docs: DataFrame, embed: bool | Callable[[Column], Column] = True, dim: int = 64, ingest_ts: Column | None = None) -> DataFrame:
    """PF1-PF3 + D20: records ready for the vector table.

    id = sha256 over every field of the record, and its ``doc_id`` where there is one
    (re-ingesting the same document gives the same id, letters with equal text but
    another date or title keep their own); ingest time is its own column (default: now, UTC wall time), week_start derives
    from it; hot keys stay typed; the other keys go into JSON metadata.
    """
    contents = compose_text()
    ts = ingest_ts if ingest_ts is not None else F.convert_timezone(None, F.lit("UTC"), F.current_timestamp())
    out = docs.select(
        *[c for c in ("doc_id",) if c in docs.columns],
        record_id(contents, docs.columns).alias("id"),
        ts.alias("ingest_ts"),
        "sender", "addressed_to", "sent_date",
        pack_metadata(*METADATA_KEYS, options=JSON_OPTS).alias("metadata"),
        contents.alias("contents"))
    out = out.withColumn("week_start", week_start("ingest_ts"))
    if embed:
        of = embed if callable(embed) else (lambda c: hash_embed(c, dim))
        out = out.withColumn("embedding", of(embedding_text("contents")))
        out = out.withColumn("norm", l2_norm("embedding").cast("float"))
    return out


__all__ = ["parse_records", "read_records", "record_texts", "scan_records", "write_records", "vector_records", "compose_text", "record_json",
           "reject_reason", "pack_metadata"]
