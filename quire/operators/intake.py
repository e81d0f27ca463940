"""End-to-end jobs: document intake (UD6) and vector ingest (UD7).

``process_documents`` takes the files DataFrame (``binaryFile``) and returns
every output table of the intake as lazy DataFrames; the caller decides which
sinks to write (the reference's "confirm" step). ``ingest`` writes extracted
records into the vector table and (optionally) builds the IVF index.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import reliable_checkpoint
from ..sources.pages import default_extractor, extract_text
from . import actions as act
from .model import model_outcomes
from .records import parse_records, vector_records
from .store import VectorTable
from ..schemas import DOC

PROMPT = ("You are an expert in official letters. Read the document below and return one JSON object with "
          "the record fields (titles, sender, sent date, addressee, contents, summary, required actions).\n\n"
          "Text of the letter:\n")


def process_documents(files: DataFrame, model: Callable, extract: Callable = default_extractor,
                      **model_options) -> dict[str, DataFrame]:
    """UD6: SR1+SR2 -> UD1 -> SR5 -> PF13-PF18 / SK2-SK4 tables; the model runs here, once per document, the tables are lazy."""
    texts = extract_text(files, extract).withColumn("prompt", F.concat(F.lit(PROMPT), F.coalesce("text", F.lit(""))))
    # the model answers once: every table below derives from its written answers
    answers = reliable_checkpoint(model_outcomes(texts.select("doc_id", "prompt"), "prompt", model, _record_text_schema(), keep=["doc_id"], **model_options))
    ok, rejects = parse_records(answers.filter("reason IS NULL").select("doc_id", "record"), "record")
    model_rejects = answers.filter("reason IS NOT NULL").select("doc_id", F.col("output").alias("record"), "reason")
    docs = ok.withColumn("source_path", F.col("doc_id"))
    files_t = act.stored_files(docs)
    return {
        "texts": texts.drop("prompt"),
        "records": docs,
        "rejects": rejects.unionByName(model_rejects),
        "overview": act.action_overview(docs),
        "stored_files": files_t,
        "events": act.calendar_events(docs, files_t),
        "tasks": act.tasks(docs),
        "summaries": act.summary_text(docs),
        "cards": act.document_card(docs),
    }


def _record_text_schema():
    """The model returns the record as JSON; keep it as text and parse with the record schema (SR5)."""
    from pyspark.sql.types import StringType, StructField, StructType
    return StructType([StructField("record", StringType())])


def wrap_record_model(fn: Callable) -> Callable:
    """Adapt a ``prompt -> record JSON`` callable to the ``{"record": text}`` shape ``process_documents`` reads."""
    import json

    def run(prompts, **kw):
        return [json.dumps({"record": r}) for r in fn(prompts, **kw)]
    return run


def ingest(spark: SparkSession, docs: DataFrame, table_path: str, mode: str = "upsert", dim: int = 64,
           ingest_ts=None, index_path: str | None = None, n_cells: int | None = None,
           embed: Callable[[Column], Column] | None = None) -> VectorTable:
    """UD7: records -> vector rows -> table (``mode`` "overwrite" drops first, D19) -> optional cell index.

    An index that is there follows the table: an upsert assigns the batch's rows alone to its cells.

    ``embed`` maps the text column to its vector (e.g. ``embed.embed_column(model)``); the default is the hashed embedder.
    """
    if mode not in ("overwrite", "upsert"):
        raise ValueError("mode must be 'overwrite' or 'upsert'")
    rows = vector_records(docs.select(*[c for c in ("doc_id",) if c in docs.columns], *[f.name for f in DOC.fields]), embed=embed or True, dim=dim, ingest_ts=ingest_ts).drop("doc_id")
    table = VectorTable(spark, table_path)
    if mode == "overwrite":
        table.drop()
    table.upsert(rows)
    if index_path:
        from .ivf import IvfIndex
        index = IvfIndex(spark, index_path)
        if mode == "upsert" and index.exists():
            index.upsert(table.read().join(rows.select("id").distinct(), "id", "left_semi"))
        else:
            index.build(table.read(), n_cells=n_cells)
    return table
