"""SM2: continuous ingest of extracted record files into the vector table.

Text ``readStream`` (a record per line, or per file) -> the same parsing and rules as
a batch (SR5, offsets in times included) -> vector records (PF1-PF3, UD2) ->
``foreachBatch`` upsert into a ``VectorTable``. Ids are deterministic and an update
keeps the stored ingest time, so a replayed micro-batch leaves the table unchanged.
Rejected records go to a rejects folder with their reason, a partition per micro-batch
(``_batch``) that a replay writes anew; the folder belongs to one checkpoint.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.records import record_texts, validate_records, vector_records
from ..operators.store import VectorTable
from ..session import staged
from .fold import write_batch


def _batch(df: DataFrame, batch_id: int, table: VectorTable, rejects_path: str | None, dim: int, embed: Callable[[Column], Column] | None) -> None:
    valid = F.col("reason").isNull()
    fields = ["source", F.when(~valid, F.col("_raw")).alias("record")] if rejects_path else []  # what each outcome needs
    with staged(validate_records(df).select(*fields, F.when(valid, F.col("rec")).alias("rec"), "reason")) as checked:  # parsed once for both
        if rejects_path:
            write_batch(checked.filter(~valid).select("source", "record", "reason"), rejects_path, batch_id)
        ok = checked.filter(valid).select("rec.*")
        table.upsert(vector_records(ok, embed=embed or True, dim=dim), keep_stored=("ingest_ts", "week_start"))


def run_ingest(spark: SparkSession, source_dir: str, table_path: str, checkpoint: str, rejects_path: str | None = None, dim: int = 64,
               available_now: bool = True, one_per_file: bool = False, embed: Callable[[Column], Column] | None = None):
    s = record_texts(spark, source_dir, one_per_file, stream=True)
    table = VectorTable(spark, table_path)
    w = (s.writeStream.option("checkpointLocation", checkpoint)
         .foreachBatch(lambda df, bid: _batch(df, bid, table, rejects_path, dim, embed)))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
