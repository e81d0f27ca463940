"""SM1: fold a stream of partial records into the latest version per document.

``readStream`` -> ``foreachBatch``: a micro-batch keeps the last partial of each of
its documents (``max_by``, combined before the shuffle) and appends those rows to an
update log, O(batch) work and no state between batches. The log is the state: readers
take the latest row per document (``read_latest``), and ``compact`` writes the log
anew with that row alone. A replayed micro-batch replaces its own partition of the log,
a late one adds rows the fold ranks by ``seq`` like any other, so the sink is idempotent
and the order of arrival does not matter.

Where partials carry a time of arrival, ``fold_with_state`` keeps the last partial of each
open document as stream state instead, writes a row only when it changes, and lets a
watermark close documents and ignore late partials.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shuffles_removed


def fold_partials(batch: DataFrame, key: str = "doc_id", seq: str = "seq", record: str = "record") -> DataFrame:
    return batch.groupBy(key).agg(F.max(seq).alias(seq), F.max_by(record, seq).alias(record))


def write_batch(rows: DataFrame, path: str, batch_id: int) -> None:
    """Write a micro-batch's rows as its own partition (``_batch``) of the table at ``path``; a replay replaces them.

    A batch without rows has no partition. The rows of a batch are one file a task, so small batches stay small files.
    """
    with shuffles_removed(rows.sparkSession):
        (rows.withColumn("_batch", F.lit(batch_id).cast("bigint")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .option("compression", "zstd").partitionBy("_batch").parquet(path))


def append_updates(batch: DataFrame, path: str, batch_id: int) -> None:
    """Add one micro-batch of updated documents to the update log at ``path``."""
    write_batch(batch, path, batch_id)


def read_latest(spark: SparkSession, path: str, key: str = "doc_id", seq: str = "seq") -> DataFrame:
    """The folded state: the highest-``seq`` row of each document in the update log."""
    log = spark.read.parquet(path).drop("_batch")
    others = [c for c in log.columns if c not in (key, seq)]
    return log.groupBy(key).agg(F.max(seq).alias(seq), *[F.max_by(c, seq).alias(c) for c in others])


def compact(spark: SparkSession, path: str, target: str, key: str = "doc_id", seq: str = "seq") -> None:
    """Writes the folded state of the log at ``path`` as a new log at ``target``, one row per document; swap readers and stream over to it."""
    read_latest(spark, path, key, seq).withColumn("_batch", F.lit(-1).cast("bigint")).write.partitionBy("_batch").parquet(target)


def parquet_stream(spark: SparkSession, source: str, schema: T.StructType | str) -> DataFrame:
    """A stream of the Parquet files at ``source``: a folder, or one file, which Spark takes for a stream only as a pattern."""
    head, dot, ext = source.rstrip("/").rpartition(".")
    return spark.readStream.schema(schema).parquet(f"{head}[.]{ext}" if dot and ext == "parquet" else source)


def run_fold(spark: SparkSession, source: str, schema: T.StructType | str, out_path: str, checkpoint: str,
             key: str = "doc_id", seq: str = "seq", record: str = "record", rename: dict | None = None,
             available_now: bool = True):
    """Start the fold over Parquet files at ``source``; returns the StreamingQuery."""
    s = parquet_stream(spark, source, schema)
    for a, b in (rename or {}).items():
        s = s.withColumnRenamed(a, b)
    w = (s.writeStream.option("checkpointLocation", checkpoint)
         .foreachBatch(lambda df, bid: append_updates(fold_partials(df, key, seq, record), out_path, bid)))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


# ---------------------------------------------------------------- with state and a watermark


def _keep_last(to_key, names: list[str], idle_ms: int):
    """The function ``applyInPandasWithState`` runs for each document with new partials, or whose time is up."""
    import pandas as pd

    def rank(partial):
        seq, record = partial
        return seq, record is not None, record or ""

    def run(group, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        held = state.get if state.exists else None
        before, last = ((held[0], held[1]), held[2]) if held else (None, 0)
        best = before
        for f in frames:
            seqs, texts, times = (f[c].to_numpy() for c in ("seq", "record", "ms"))  # arrays: most documents have a few rows
            last, top = max(last, int(times.max())), seqs.max()
            found = [(int(top), t if isinstance(t, str) else None) for t in texts[seqs == top]]
            best = max(found if best is None else [best, *found], key=rank)
        state.update((*best, last))
        state.setTimeoutTimestamp(max(last + idle_ms, state.getCurrentWatermarkMs() + 1))
        if best != before:
            yield pd.DataFrame(dict(zip(names, ([to_key(group[0])], [best[0]], pd.Series([best[1]], dtype=object)), strict=True)))

    return run


def fold_with_state(partials: DataFrame, time: str, key: str = "doc_id", seq: str = "seq", record: str = "record",
                    late: str = "10 minutes", idle_seconds: int = 3600) -> DataFrame:
    """A stream of partials as a stream of updates (key, seq, record): one row whenever a document's last partial changes.

    State is the last partial of each open document. A document is open until the
    watermark (greatest ``time`` seen, less ``late``) has passed its last partial by
    ``idle_seconds``; then its state is dropped, so the state is bounded by the documents
    in progress. Partials older than the watermark are ignored. One that comes after its
    document was closed, but not late, opens it again; its update ranks by ``seq`` in
    ``read_latest`` like any other. Of partials with one ``seq`` the greatest record text
    counts, a null record least. Rows whose key, ``seq`` or ``time`` is null take no part.
    ``key`` is an integer or text, ``record`` text, ``time`` a timestamp; other columns
    are dropped. A document's partials reach its task as Arrow batches, never as one frame.
    """
    key_type = partials.schema[key].dataType
    if not isinstance(key_type, T.IntegralType | T.StringType):
        raise ValueError(f"{key} must be an integer or text")
    out = T.StructType([T.StructField(key, key_type), T.StructField(seq, T.LongType()), T.StructField(record, T.StringType())])
    held = T.StructType([T.StructField("seq", T.LongType()), T.StructField("record", T.StringType()), T.StructField("last", T.LongType())])
    at = F.col(time).cast("timestamp")
    rows = partials.select(F.col(key).alias("key"), F.col(seq).cast("bigint").alias("seq"), F.col(record).cast("string").alias("record"),
                           at.alias("time"), F.unix_millis(at).alias("ms")).dropna(subset=["key", "seq", "time"])
    to_key = int if isinstance(key_type, T.IntegralType) else str
    return rows.withWatermark("time", late).groupBy("key").applyInPandasWithState(
        _keep_last(to_key, out.names, idle_seconds * 1000), out, held, "update", "EventTimeTimeout")


def run_fold_with_state(partials: DataFrame, out_path: str, checkpoint: str, time: str, key: str = "doc_id", seq: str = "seq", record: str = "record",
                        late: str = "10 minutes", idle_seconds: int = 3600, available_now: bool = True):
    """Start the fold with state over the streaming frame ``partials``; its updates go to the log at ``out_path`` (``read_latest``)."""
    updates = fold_with_state(partials, time, key, seq, record, late, idle_seconds)
    w = (updates.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
         .foreachBatch(lambda df, bid: append_updates(df, out_path, bid)))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
