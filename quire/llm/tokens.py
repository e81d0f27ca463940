"""Token-ID output in Simple-8b blocks (op 7).

Documents are range-partitioned and sorted by id, tokenized, each closed by the end
id, and packed into blocks of whole documents (about ``BLOCK_IDS`` ids). A partition
is a file; a file is a run of blocks, each with its header, the offsets of its
documents and its words, so that any block can be decoded alone. Spark's Parquet
writer holds the blocks (one binary value per block), as it commits safely when tasks
are repeated. A file's place among all ids follows from the sizes of the files before
it.

Texts are read whole; a null text is empty and encodes to the end id alone. A null id
sorts first. Rows of one id follow in the order of their text's hash; equal rows are
equal entries. Extra columns are ignored; an empty table writes no block.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ..session import scratch_path
from .simple8b import decode, encode
from .wordcache import word_encoder

END_ID = 2
BLOCK_IDS = 1 << 17
MAGIC = b"QS8B"
HEADER = struct.Struct("<4sIQQII")  # magic, documents, first id of the block in its file, ids, words, escapes


def pack_block(first: int, doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    """One block: header, ids and lengths of its documents (a null id has its flag set), words, escapes."""
    every = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    words, escapes = encode(every)
    return b"".join([
        HEADER.pack(MAGIC, len(doc_ids), first, len(every), len(words), len(escapes)),
        np.array([d is None for d in doc_ids], np.uint8).tobytes(), np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
        np.array([len(x) for x in ids], "<u8").tobytes(), words.astype("<u8").tobytes(), escapes.astype("<u8").tobytes(),
    ])


def read_block(data: bytes) -> tuple[int, list[int | None], np.ndarray, np.ndarray]:
    """(first id in the file, document ids, offsets of the documents in the block and their end, ids)."""
    magic, docs, first, n, n_words, n_escapes = HEADER.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a token block")
    at = HEADER.size

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, kind, count, at)
        at += out.nbytes
        return out

    null, doc_ids, lengths = take("u1", docs), take("<i8", docs), take("<u8", docs)
    words, escapes = take("<u8", n_words), take("<u8", n_escapes)
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    return first, [None if f else d for f, d in zip(null.tolist(), doc_ids.tolist(), strict=True)], offsets, decode(words, escapes, n)


def write_tokens(docs: DataFrame, tokenizer_path: str, path: str | None = None, end_id: int = END_ID, block_ids: int = BLOCK_IDS,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the blocks of ``docs`` in ascending id order under ``path`` (default: the shared folder) and returns them read back: (file, block, n_ids, data)."""
    Tokenizer.from_file(tokenizer_path)  # fails here rather than in every task
    path = path or scratch_path(docs.sparkSession, "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, file = word_encoder(tokenizer_path), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4")
        block, first = 0, 0
        doc_ids: list[int | None] = []
        ids: list[np.ndarray] = []
        held = 0

        def emit() -> pa.RecordBatch:
            nonlocal block, first, held
            data = pack_block(first, doc_ids, ids)
            out = pa.RecordBatch.from_arrays([pa.array([file], pa.int32()), pa.array([block], pa.int32()), pa.array([held], pa.int64()), pa.array([data], pa.binary())],
                                             names=["file", "block", "n_ids", "data"])
            block, first, held = block + 1, first + held, 0
            doc_ids.clear()
            ids.clear()
            return out

        for b in batches:
            for doc, found in zip(b.column(0).to_pylist(), encoder.encode(b.column(1)), strict=True):
                found = np.concatenate([found, end])
                doc_ids.append(doc)
                ids.append(found)
                held += len(found)
                if held >= block_ids:
                    yield emit()
            pa.default_memory_pool().release_unused()
        if doc_ids:
            yield emit()

    src = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    src = src.withColumns({"tie": F.xxhash64("text"), "place": F.monotonically_increasing_id()})  # place: a hot id or text is divided as well
    src = src.repartitionByRange("id", "tie", "place").sortWithinPartitions("id", "tie", "place").select("id", "text")
    out = src.mapInArrow(run, "file int, block int, n_ids bigint, data binary")
    out.write.parquet(path)
    return docs.sparkSession.read.schema(out.schema).parquet(path)


def token_report(blocks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document, decoded from the blocks: id, start (ids of all documents before it), n_tokens, ids_crc32."""
    sizes = {r["file"]: r["n"] for r in blocks.groupBy("file").agg(F.sum("n_ids").alias("n")).collect()}  # a row per file
    before, total = {}, 0
    for f in sorted(sizes):
        before[f], total = total, total + sizes[f]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, data in zip(b.column(0), b.column(1), strict=True):
                first, doc_ids, offsets, ids = read_block(data.as_py())
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * lo:4 * hi]) for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(before[file.as_py()] + first + offsets[:-1], pa.int64()),
                                                  pa.array(np.diff(offsets), pa.int64()), pa.array(crc, pa.int64())], names=["id", "start", "n_tokens", "ids_crc32"])

    return blocks.select("file", "data").mapInArrow(run, "id bigint, start bigint, n_tokens bigint, ids_crc32 bigint").withColumnRenamed("id", id_col)
