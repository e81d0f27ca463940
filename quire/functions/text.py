"""Text functions (SC2, SC8-SC13, PF21) as Spark SQL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import DEFAULT_SENDER, SENDERS

# Placeholders and defaults shown for missing fields.
NA = "N/A"
NONE_TEXT = "None"
NO_ACTIONS = "No actions required"
PROCESSING = "Processing..."
PROCESSING_SUMMARY = "Processing summary..."
# Honorifics removed from addressee names.
NAME_PREFIX_RE = r"^((Herr|Frau|Dr\.)\s+)+"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def type_label(action_type) -> Column:
    """SC8: 'reply_required' -> 'Reply Required'."""
    return F.initcap(F.replace(_c(action_type), F.lit("_"), F.lit(" ")))


def join_or(xs, sep: str = ", ", default: str = NONE_TEXT) -> Column:
    """SC12: list joined with ``sep``; null or empty list -> ``default`` (null elements skipped)."""
    j = F.array_join(_c(xs), sep)
    return F.when(F.coalesce(F.size(_c(xs)), F.lit(0)) > 0, j).otherwise(F.lit(default))


def or_default(x, default: str) -> Column:
    """SC13."""
    return F.coalesce(_c(x).cast("string"), F.lit(default))


def text_or(x, default: str) -> Column:
    """SC13 where an empty text counts as missing, too."""
    return F.when(F.coalesce(_c(x), F.lit("")) != "", _c(x)).otherwise(F.lit(default))


def money(x) -> Column:
    return F.format_string("%.2f", _c(x))


def file_name(sent_date, title) -> Column:
    """SC9: '<sent_date>_<title with _>.pdf'."""
    return F.concat(F.date_format(_c(sent_date), "yyyy-MM-dd"), F.lit("_"),
                    F.replace(_c(title), F.lit(" "), F.lit("_")), F.lit(".pdf"))


def folder_path(*parts) -> Column:
    """SC10: 'addressee/sender[/name]'."""
    return F.concat_ws("/", *[_c(p) for p in parts])


def with_summary_name(path) -> Column:
    """SC11: '<dir>/<stem>_with_summary.pdf', next to the original."""
    return F.concat(F.regexp_replace(_c(path), r"\.[^./]*$", ""), F.lit("_with_summary.pdf"))


def short_title(title, words: int = 3) -> Column:
    """PF21: at most three words."""
    return F.array_join(F.slice(F.split(F.trim(_c(title)), r"\s+"), 1, words), " ")


def sender_in_domain(sender) -> Column:
    """PF21: unknown sender -> 'Other'."""
    return F.when(_c(sender).isin(*SENDERS), _c(sender)).otherwise(F.lit(DEFAULT_SENDER))


def strip_name_prefix(name) -> Column:
    """PF21: addressee without titles or prefixes."""
    return F.regexp_replace(F.trim(_c(name)), NAME_PREFIX_RE, "")
