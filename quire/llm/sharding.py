"""Sharding by a two-pass external shuffle (op 4).

Pass one scatters the records uniformly into buckets that fit in memory: a seeded
hash names a record's bucket, and Spark's shuffle (partition = bucket) holds them.
Pass two reads each bucket alone, puts it into a canonical order, shuffles it with a
seeded Fisher-Yates permutation and writes it. Bucket after bucket, the shuffled
records are one random order of the table; shard ``s`` is its ``s``-th equal part, so
the counts differ by at most one (law ``rows``) and a bucket meets few shards.

A first count over the hashes alone gives each bucket's place in that order. The hash
covers the id and the record's place in the input, so equal records and hot or null
ids spread as well; both passes read the input with the same splits, and what was
written is compared with the count (an input that changes in between is an error).
Null texts are records of size 16 without a checksum; repeated rows are separate
records; all columns of a record are kept in one struct, so no name can clash; an
empty table gives empty shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path
from .common import written

SHARDS = 40
SEED = 4321
#: Bytes of records in a bucket, about.
BUCKET_BYTES = 16 << 20
ROW_BYTES = 16


def record_size(text_col: str = "text") -> Column:
    return (F.coalesce(F.octet_length(text_col), F.lit(0)) + ROW_BYTES).cast("bigint")


def shard(docs: DataFrame, path: str | None = None, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES,
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes (row, shard, slot) under ``path`` (default: the shared folder), one folder per shard, and returns the table read back.

    ``row`` is the record with all its columns; a shard's slots run without gaps from 0.
    """
    spark = docs.sparkSession
    path = path or scratch_path(spark, "shards")
    total = docs.agg(F.sum(record_size(text_col))).first()[0] or 0
    n_buckets = max(1, -(-total // bucket_bytes))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                        F.xxhash64(F.lit(seed), F.col(f"`{id_col}`"), F.monotonically_increasing_id()).alias("place"))
    keyed = keyed.withColumn("bucket", F.pmod("place", F.lit(n_buckets)).cast("int"))
    counts = written(keyed.groupBy("bucket").count(), "bucket-counts")  # a row per bucket
    running = counts.select("bucket", F.sum("count").over(Window.orderBy("bucket")).alias("end"), "count").collect()
    first = {r["bucket"]: r["end"] - r["count"] for r in running}
    n = max((r["end"] for r in running), default=0)
    starts = np.array([-(-s * n // shards) for s in range(shards + 1)], np.int64)  # shard s holds positions starts[s] to starts[s + 1]

    def shuffle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        bucket = pa.Table.from_batches(held)
        held.clear()
        number, rows = bucket.column("bucket")[0].as_py(), bucket.column("row").combine_chunks()
        order = np.argsort(bucket.column("place").to_numpy(), kind="stable")  # arrival order of a shuffle is not fixed
        np.random.default_rng([seed, number]).shuffle(order)  # Fisher-Yates
        for lo in range(0, len(order), 1024):
            take = order[lo:lo + 1024]
            at = first[number] + np.arange(lo, lo + len(take))
            to = np.searchsorted(starts, at, side="right") - 1
            yield pa.RecordBatch.from_arrays([rows.take(pa.array(take)), pa.array(to, pa.int32()),
                                              pa.array(at - starts[to], pa.int64())], names=["row", "shard", "slot"])

    schema = T.StructType([keyed.schema["row"], T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])
    out = keyed.repartitionById(n_buckets, "bucket").mapInArrow(shuffle, schema)
    out.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    back = spark.read.schema(out.schema).parquet(path)
    sizes = {r["shard"]: (r["n"], r["last"]) for r in back.groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("last")).collect()}  # a row per shard
    for s in range(shards):
        want = int(starts[s + 1] - starts[s])
        if sizes.get(s, (0, -1)) != (want, want - 1):
            raise RuntimeError(f"shard {s}: {sizes.get(s)} written, {want} records counted; the input changed between the passes")
    return back


def shard_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """Per record: id, size, text_crc32, law, shard, slot, grown_shard (null under the law ``rows``)."""
    text = F.col(f"row.`{text_col}`")
    return shard(docs, id_col=id_col, text_col=text_col, **kw).select(
        F.col(f"row.`{id_col}`").alias(id_col), (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
