"""Text embedding (UD2), batched.

Default embedder: hashed bag of words, deterministic and offline, computed in
an Arrow UDF that works on whole batches with vectorised Arrow compute:
lower-case, RE2 split, ``unique`` over the batch's tokens, MD5 only once per
*distinct* token of the batch, ``index_in`` to map every token to its bucket
and one ``np.bincount`` for all rows. No Python work per row or per token
occurrence; map-only (no shuffle), linear in the text volume, whole texts.

The vector holds raw term counts (cosine distance does not depend on scale);
integer-valued vectors make every dot product exact, so copies of a text tie
exactly and rankings are reproducible across engines. ``unit=True`` gives the
L2-normalised vector instead.

Token rule (shared with the SQL oracle and with ``token_buckets``, its SQL
form): lower-case, split on every run of characters outside ``[a-z0-9]``,
drop empty pieces. Bucket: the first four hex digits of the token's MD5 read
as an integer, modulo ``dim``.

A user embedder (e.g. a model client) plugs in via ``embed_batches``: a
callable ``list[str] -> array (n, dim)`` invoked once per Arrow batch.
"""

from __future__ import annotations

import hashlib
from typing import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN_SPLIT = "[^a-z0-9]+"
#: Rows and bytes of text whose tokens are counted at a time.
SLICE_ROWS = 2_000
SLICE_BYTES = 4 << 20


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def embedding_text(text) -> Column:
    """SC2: newlines become spaces before embedding."""
    return F.replace(_c(text), F.lit("\n"), F.lit(" "))


def tokens(text) -> Column:
    return F.filter(F.split(F.lower(_c(text)), TOKEN_SPLIT), lambda t: t != "")


def token_buckets(text, dim: int) -> Column:
    return F.transform(tokens(text),
                       lambda t: F.pmod(F.conv(F.substring(F.md5(t), 1, 4), 16, 10).cast("int"), F.lit(dim)))


def _bucket_of(tok: str, dim: int) -> int:
    return int(hashlib.md5(tok.encode("utf-8")).hexdigest()[:4], 16) % dim


def _counts(texts: pa.Array, dim: int, unit: bool, dtype=np.float32) -> pa.Array:
    n = len(texts)
    if n == 0:
        return pa.array([], type=pa.list_(pa.from_numpy_dtype(dtype)))
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    pieces = pc.split_pattern_regex(pc.utf8_lower(texts), pattern=TOKEN_SPLIT)
    lens = pc.fill_null(pc.list_value_length(pieces), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    rows = np.repeat(np.arange(n, dtype=np.int64), lens)
    toks = pc.list_flatten(pieces)
    keep = pc.not_equal(toks, "").to_numpy(zero_copy_only=False)
    toks, rows = toks.filter(pa.array(keep)), rows[keep]
    vocab = pc.unique(toks)
    buckets = np.fromiter((_bucket_of(t, dim) for t in vocab.to_pylist()), dtype=np.int64, count=len(vocab))
    idx = pc.index_in(toks, value_set=vocab).to_numpy(zero_copy_only=False).astype(np.int64)
    m = np.bincount(rows * dim + buckets[idx], minlength=n * dim).reshape(n, dim).astype(np.float64)
    norm = np.sqrt(np.einsum("ij,ij->i", m, m))
    if unit:
        with np.errstate(invalid="ignore", divide="ignore"):
            m = m / norm[:, None]
        m[~(norm > 0)] = 0.0
    offsets = pa.array(np.arange(n + 1, dtype=np.int32) * dim, type=pa.int32())
    values = pa.array(m.ravel().astype(dtype), type=pa.from_numpy_dtype(dtype))
    return pa.ListArray.from_arrays(offsets, values, mask=pa.array(~(norm > 0)))


def _counts_udf(dim: int, unit: bool, double: bool):
    dtype, sql = (np.float64, "array<double>") if double else (np.float32, "array<float>")

    @F.arrow_udf(sql)
    def counts(texts: pa.Array) -> pa.Array:
        done = [_counts(part, dim, unit, dtype) for part in _slices(texts)]
        return pa.concat_arrays(done) if len(done) != 1 else done[0]
    return counts


def _slices(texts: pa.Array) -> list:
    """A batch in slices of at most ``SLICE_ROWS`` rows and about ``SLICE_BYTES`` of text, so that the arrays made for its tokens stay small."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    out, lo = [], 0
    while lo < len(texts):
        before = ends[lo - 1] if lo else 0
        hi = max(lo + 1, min(lo + SLICE_ROWS, int(np.searchsorted(ends, before + SLICE_BYTES, side="right"))))
        out.append(texts.slice(lo, hi - lo))
        lo = hi
    return out or [texts]


def hash_embed(text, dim: int = 64, unit: bool = False, double: bool = False) -> Column:
    """Hashed bag-of-words vector of up to 65,536 buckets (16 bits of the token's hash); null when the text has no token.

    ``array<float>`` by default: term counts are exact in float32 (below 2^24), so
    storage and scan IO halve with identical rankings; the search kernel
    computes in float64. ``double=True`` for ``array<double>``.
    """
    if not 0 < dim <= 1 << 16:
        raise ValueError("the bucket hash has 16 bits: dim is at most 65536")
    return _counts_udf(dim, unit, double)(_c(text))


def embed_column(fn: Callable[[list], np.ndarray]) -> Callable[[Column], Column]:
    """A user embedder (list of texts -> matrix) as a function of a text column, for every ``embed=`` argument; null stays null."""
    @F.arrow_udf("array<double>")
    def run(texts: pa.Array) -> pa.Array:
        values = texts.to_pylist()
        idx = [i for i, t in enumerate(values) if t is not None]
        full: list = [None] * len(values)
        if idx:
            for i, v in zip(idx, np.asarray(fn([values[i].replace("\n", " ") for i in idx]), dtype=np.float64), strict=True):
                full[i] = v
        return pa.array(full, type=pa.list_(pa.float64()))
    return lambda text: run(_c(text))


def embed_batches(df: DataFrame, text_col: str, fn: Callable[[list], np.ndarray], dim: int,
                  out_col: str = "embedding") -> DataFrame:
    """Apply a user embedder once per Arrow batch (never one call per row)."""
    out_schema = T.StructType(df.schema.fields + [T.StructField(out_col, T.ArrayType(T.DoubleType()))])
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow_schema = to_arrow_schema(out_schema)

    def run(batches):
        for batch in batches:
            texts = batch.column(text_col).to_pylist()
            idx = [i for i, t in enumerate(texts) if t is not None]
            vecs = np.asarray(fn([texts[i].replace("\n", " ") for i in idx]), dtype=np.float64).reshape(len(idx), dim) \
                if idx else np.zeros((0, dim))
            full = [None] * batch.num_rows
            for j, i in enumerate(idx):
                full[i] = vecs[j].tolist()
            cols = list(batch.columns) + [pa.array(full, type=pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(cols, schema=arrow_schema)

    return df.mapInArrow(run, out_schema)
