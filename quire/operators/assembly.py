"""Page text assembly and partial-record folding (SR2, AG3, PF19, AG5).

Pages are ``(doc_id, page_no, text, error)``. A failing page carries a null
text and an error and is skipped (D23); a document whose pages all failed
assembles to ''; a document without any page row stays null when a document
list is given (left join). Ordering inside a group is explicit
(``listagg ... WITHIN GROUP (ORDER BY page_no)``), never the arrival order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def assemble_pages(pages: DataFrame, documents: DataFrame | None = None, key: str = "doc_id",
                   order: str = "page_no", sep: str = "\n", chunk: int = 256) -> DataFrame:
    """SR2 + AG3: one text per document.

    Two ordered stages: pages are first joined within chunks of ``chunk``
    consecutive page numbers, then the chunks of a document are joined in
    order. A document with a huge number of pages is concatenated by many
    tasks, and the last stage sees one row per chunk. Null texts are skipped
    in both stages, so the result equals a single ordered join.
    """
    sep_sql = sep.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n")
    bucket = F.floor(F.col(order) / F.lit(chunk)).alias("_chunk")
    parts = (pages.groupBy(key, bucket)
             .agg(F.expr(f"listagg(text, '{sep_sql}') WITHIN GROUP (ORDER BY {order})").alias("text")))
    agg = parts.groupBy(key).agg(
        F.coalesce(F.expr(f"listagg(text, '{sep_sql}') WITHIN GROUP (ORDER BY _chunk)"), F.lit("")).alias("text"))
    if documents is None:
        return agg
    return documents.select(key).join(agg, key, "left")


def prepend_page(pages: DataFrame, first: DataFrame, key: str = "doc_id", order: str = "page_no") -> DataFrame:
    """PF19: ``first`` (key, text) becomes the page before every existing page."""
    lead = first.select(key, F.lit(-1).cast(pages.schema[order].dataType).alias(order), "text",
                        F.lit(None).cast("string").alias("error"))
    return lead.unionByName(pages.select(key, order, "text", "error"))


def last_partial(parts: DataFrame, key: str = "doc_id", seq: str = "seq", record: str = "record") -> DataFrame:
    """AG5: the highest-``seq`` record of each key (``max_by``; partial aggregation before the shuffle)."""
    return parts.groupBy(key).agg(F.max(seq).alias(seq), F.max_by(record, seq).alias(record))
