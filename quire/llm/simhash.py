"""SimHash near-duplicates by multi-index hashing (op 2).

A text's fingerprint is the bitwise majority of the XXH64 hashes of its word
shingles. Two fingerprints link when they differ in at most ``max_bits`` bits.
With the 64 bits cut into two segments of 32, a pair within 3 bits differs in at
most one bit in one of the segments, so every fingerprint looks up the 33 values
of that radius-1 ball in a table of segment values; each match is then verified
on all 64 bits. A segment value shared by more than ``bucket_rows`` fingerprints
is divided further by the two 16-bit halves of the other segment with the same
argument; such a sub-bucket holds at most 2^16 distinct fingerprints. Fingerprints
are distinct before the search (copies of a text are one entry), and links become
components by large-star / small-star rounds over tables in the shared folder.

Nulls, empties, repeats: a null or empty text has no shingles and fingerprint
zero, which links like any other. Repeated rows and rows with a null id keep one
output row each; a component whose ids are all null has a null ``component_id``.
Extra columns are ignored by ``near_duplicates`` and kept by ``keep_one``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import packed, unpacked, written

SEED = 42
MAX_BITS = 3
SEGMENT = 32
HALF = 16
#: Texts are hashed in slices of this many shingles, which bounds a task's memory for a very long text.
SLICE = 1 << 18


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """SimHash of one text as an unsigned 64-bit integer."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for lo in range(0, n, SLICE):
        hi = min(n, lo + SLICE)
        joined = map(b" ".join, zip(*(words[lo + k:hi + k] for k in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
        h = np.fromiter((digest(s, SEED) for s in joined), np.uint64, hi - lo)
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint as signed long, md5 of the text) of every row; texts are read whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps), b.column(2)], names=["id", "fp", "md5"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("fp", T.LongType()), T.StructField("md5", T.StringType())])
    text = F.col(text_col).cast("binary")
    src = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.md5(F.coalesce(text, F.lit(b""))).alias("md5"))
    return src.mapInArrow(run, schema)


def _ball(n: int) -> str:
    """SQL array of the masks of the radius-1 ball of an ``n``-bit value."""
    return "array(0L, " + ", ".join(f"{1 << i}L" for i in range(n)) + ")"


def _segments(fps: DataFrame) -> DataFrame:
    """fp -> (seg, val, fp) for both segments; ``rest`` is the other segment."""
    low, high = F.expr("fp & 4294967295L"), F.expr("shiftrightunsigned(fp, 32)")
    seg = F.explode(F.array(F.struct(F.lit(0).alias("seg"), low.alias("val"), high.alias("rest")),
                            F.struct(F.lit(1).alias("seg"), high.alias("val"), low.alias("rest"))))
    return fps.select("fp", seg.alias("s")).select("fp", "s.seg", "s.val", "s.rest")


def _halves(df: DataFrame) -> DataFrame:
    """Adds (half, hval): the 16-bit halves of ``rest``."""
    h = F.explode(F.array(F.struct(F.lit(0).alias("half"), F.expr("rest & 65535L").alias("hval")),
                          F.struct(F.lit(1).alias("half"), F.expr("shiftrightunsigned(rest, 16)").alias("hval"))))
    return df.select("fp", "seg", "val", h.alias("h")).select("fp", "seg", "val", "h.half", "h.hval")


def links(fps: DataFrame, max_bits: int = MAX_BITS, bucket_rows: int = 1024) -> DataFrame:
    """(a, b), a < b: all pairs of distinct fingerprints within ``max_bits`` (at most 3) differing bits.

    Both lookups compare inside the join (``bit_count`` of the XOR is a join
    condition), so only verified links leave it. A link can be found by both
    segments; the duplicates are removed.
    """
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError("two segments with radius 1 find distances up to 3")
    table = _segments(fps)
    probes = table.withColumn("val", F.expr(f"explode(transform({_ball(SEGMENT)}, m -> val ^ m))"))
    hot = table.groupBy("seg", "val").count().filter(F.col("count") > bucket_rows).select("seg", "val")
    near = F.expr(f"p.fp < t.fp AND bit_count(p.fp ^ t.fp) <= {max_bits}")
    cold = table.join(hot, ["seg", "val"], "left_anti")
    same = lambda *c: [F.col(f"p.{x}") == F.col(f"t.{x}") for x in c]
    pair = [F.col("p.fp").alias("a"), F.col("t.fp").alias("b")]
    plain = probes.alias("p").join(cold.alias("t"), [*same("seg", "val"), near]).select(*pair)
    hot_probes = _halves(probes.join(hot, ["seg", "val"], "left_semi"))
    hot_probes = hot_probes.withColumn("hval", F.expr(f"explode(transform({_ball(HALF)}, m -> hval ^ m))"))
    hot_table = _halves(table.join(hot, ["seg", "val"], "left_semi"))
    divided = hot_probes.alias("p").join(hot_table.alias("t"), [*same("seg", "val", "half", "hval"), near]).select(*pair)
    return plain.unionByName(divided).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 100) -> DataFrame:
    """(node, root): root is the smallest node of the node's component; nodes are those of ``edges``.

    Alternating large-star and small-star: each round is a grouped minimum and a
    join on the node, written to the shared folder. Ends when a round changes nothing.
    """
    cur = written(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").distinct(), "edges")
    last = None
    for _ in range(max_rounds):
        # large-star: every larger neighbour of u links to the smallest of u and its neighbours
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small-star: u (the larger end) and its smaller neighbours link to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        cur = written(small.filter("u <> v").distinct(), "edges")
        state = cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last:
            break
        last = state
    else:
        raise RuntimeError("components did not settle")
    roots = cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
    own = cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return roots.unionByName(own)


def _members(fp: DataFrame, max_bits: int, bucket_rows: int) -> DataFrame:
    """(fp, root, first): each distinct fingerprint, the smallest fingerprint of its component, and its first row by id and text digest."""
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "md5")).alias("first")
    distinct = written(fp.groupBy("fp").agg(first), "distinct-fingerprints")
    roots = components(links(distinct.select("fp"), max_bits, bucket_rows))
    return distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = MAX_BITS, bucket_rows: int = 1024,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id (smallest id reachable)."""
    fp = written(with_fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    member = _members(fp, max_bits, bucket_rows)
    first = member.groupBy("root").agg(F.min("first").alias("first"))
    named = member.select("fp", "root").join(first, "root").select("fp", F.col("first.id").alias("component_id"))
    return fp.join(named, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, max_bits: int = MAX_BITS, bucket_rows: int = 1024,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of every component, that of the smallest id (then text digest); columns unchanged."""
    fp = written(with_fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    keep = _members(fp, max_bits, bucket_rows).groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.id").alias("_keep_id"), F.col("first.md5").alias("_keep_md5"))
    text = F.coalesce(F.col("row").getField(text_col).cast("binary"), F.lit(b""))
    keyed = packed(docs).select("row", F.col("row").getField(id_col).alias("_id"), F.md5(text).alias("_md5"))
    kept = keyed.join(keep, F.col("_id").eqNullSafe(F.col("_keep_id")) & (F.col("_md5") == F.col("_keep_md5")), "left_semi")
    return unpacked(kept.dropDuplicates(["_id", "_md5"]), docs.columns)
