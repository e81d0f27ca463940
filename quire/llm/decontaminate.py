"""Benchmark decontamination with a broadcast set of item n-grams (op 3).

Texts are normalised (A-Z lower-cased, words of letters and digits, everything
outside ASCII kept). An item's windows are its runs of ``n`` consecutive words; an
item with fewer words, but not none, is one window. Every document position is
hashed for each window length that occurs, the hash is looked up in the item
windows, and a match is verified word by word in the join condition. Item windows
are broadcast while they measure at most ``max_broadcast_bytes``; a larger set
meets the document windows in a shuffled join with the same rows.

DataFrame functions only. Rows are identified by id and text digest, so repeated
rows get equal results. Null and empty texts have no words and are never
contaminated; empty items have no window; a null item id counts as one item with
an empty id; an empty benchmark contaminates nothing. Extra columns of
``documents`` are ignored by ``contamination`` and kept by ``decontaminate``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NOT_ALNUM, ascii_lower, packed, row_key, unpacked, words, written

WINDOW = 10
MAX_BROADCAST_BYTES = 64 << 20
#: A word of the original text (before lower-casing) with the separators that precede it.
PIECE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _norm(col: str) -> Column:
    return words(ascii_lower(col), NOT_ALNUM)


def item_windows(benchmark: DataFrame, n: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(h, win, items): each distinct window, its hash and the ids (as text) of the items that hold it."""
    b = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), _norm(text_col).alias("w")).filter(F.size("w") > 0)
    at = F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1))))
    win = b.select("item", "w", at.alias("p")).select("item", F.slice("w", F.col("p"), F.lit(n)).alias("win"))
    return win.groupBy("win").agg(F.collect_set("item").alias("items")).select(F.xxhash64("win").alias("h"), "win", "items")


def hits(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row key, hit, items) of documents with an occurring window: distinct 1-based word positions and sorted item ids."""
    grams = written(item_windows(benchmark, n), "item-windows")
    kinds = grams.groupBy(F.size("win").alias("n")).agg(F.sum(F.length(F.concat_ws(" ", "win")) + F.length(F.concat_ws(" ", "items")) + 64).alias("bytes")).collect()  # n rows at most
    lengths = sorted(r["n"] for r in kinds)
    key = row_key(id_col, text_col)
    d = docs.select(*key, _norm(text_col).alias("w"))
    least = min(lengths, default=1)
    at = d.filter(F.size("w") >= least).select("*", F.explode(F.sequence(F.lit(1), F.size("w") - least + 1)).alias("p"))
    names = [id_col, "_text_md5", "_text_null"]
    if len(lengths) > 1:
        at = at.withColumn("n", F.explode(F.array(*[F.lit(x) for x in lengths]))).filter(F.col("p") + F.col("n") - 1 <= F.size("w"))
    else:
        at = at.withColumn("n", F.lit(least))
    at = at.select(*names, "p", "n", F.slice("w", F.col("p"), F.col("n")).alias("w_win")).withColumn("w_h", F.xxhash64("w_win"))
    small = sum(r["bytes"] for r in kinds) <= max_broadcast_bytes
    found = at.join(F.broadcast(grams) if small else grams, (F.col("w_h") == F.col("h")) & (F.col("w_win") == F.col("win")))
    spans = F.array_distinct(F.flatten(F.transform(F.collect_set(F.struct("p", "n")), lambda x: F.sequence(x["p"], x["p"] + x["n"] - 1))))
    return found.groupBy(*names).agg(spans.alias("hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))


def _joined(left: DataFrame, found: DataFrame, id_col: str, how: str) -> DataFrame:
    right = found.withColumnsRenamed({id_col: "_found_id", "_text_md5": "_found_md5", "_text_null": "_found_null"})
    on = F.col(id_col).eqNullSafe(F.col("_found_id")) & (F.col("_text_md5") == F.col("_found_md5")) & (F.col("_text_null") == F.col("_found_null"))
    return left.join(right, on, how)


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: n_words, n_hit (words inside any occurrence), n_items, items_sha256, contaminated."""
    found = hits(docs, benchmark, n, max_broadcast_bytes, id_col, text_col)
    base = docs.select(*row_key(id_col, text_col), F.size(_norm(text_col)).cast("bigint").alias("n_words"))
    out = _joined(base, found, id_col, "left")
    n_hit = F.when(F.col("hit").isNull(), 0).otherwise(F.size("hit")).cast("bigint")
    n_items = F.when(F.col("items").isNull(), 0).otherwise(F.size("items")).cast("bigint")
    digest = F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256)
    return out.select(id_col, "n_words", n_hit.alias("n_hit"), n_items.alias("n_items"), digest.alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", n: int = WINDOW,
                  max_broadcast_bytes: int = MAX_BROADCAST_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the contaminated documents, or (``mode="spans"``) with the hit words and the separators before them cut out.

    Columns stay, whatever their names.
    """
    found = hits(docs, benchmark, n, max_broadcast_bytes, id_col, text_col)
    text = F.col("row").getField(text_col)
    keyed = packed(docs).select("row", F.col("row").getField(id_col).alias(id_col), F.md5(F.coalesce(text, F.lit("")).cast("binary")).alias("_text_md5"), text.isNull().alias("_text_null"))
    if mode == "documents":
        return unpacked(_joined(keyed, found, id_col, "left_anti"), docs.columns)
    if mode != "spans":
        raise ValueError("mode is 'documents' or 'spans'")
    out = _joined(keyed, found, id_col, "left")
    pieces = F.regexp_extract_all(text, F.lit(f"({PIECE})"), F.lit(1))
    tail = F.regexp_extract(text, r"([\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*)\z", 1)
    kept = F.concat(F.array_join(F.filter(pieces, lambda x, i: ~F.array_contains(F.col("hit"), i + 1)), ""), tail)
    cut = F.when(F.col("hit").isNull(), text).otherwise(kept)
    return out.select(*[(cut if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns])
