"""Mixing sources to target weights by capped water-filling (op 8).

Sources share ``total_ratio`` of all sizes by weight; no source gets more than
``max_epochs`` times its size, and what it gives up is shared again by weight until
no source is above. That fixed point is ``min(cap, level * weight)`` with one water
level, which a running sum over the sources in the order of cap / weight finds
without iterating. A source's target becomes whole epochs of all its documents plus
a seeded fraction: documents in hash order are taken once more while their midpoint
lies within the remaining words, so the source ends within half a document of its
target. The order runs in two levels (hash cells, then inside a cell), so a hot
source is divided over many tasks.

DataFrame functions only. A null source is a source of its own (last in the order
of weights); null and empty texts have size 0 and are copied like the others;
repeated rows are separate documents; an empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_WORD, packed, unpacked, written

WEIGHTS = (3.0, 1.0, 2.0)
TOTAL_RATIO = 1.5
MAX_EPOCHS = 2.0
SEED = 20240
#: Documents per hash cell, about.
CELL_ROWS = 1_000


def word_count(col: Column | str) -> Column:
    return F.coalesce(F.regexp_count(col, F.lit(SPACE_WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights=WEIGHTS, total_ratio: float = TOTAL_RATIO, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, n_docs, target) from (source, size) rows; one row per source."""
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    s = written(s, "source-sizes")
    # from here on a row per source; code-point order is the order of the UTF-8 bytes
    rank = F.row_number().over(Window.orderBy(F.col("source").cast("binary").asc_nulls_last()))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int"))
    s = s.withColumn("weight", w).withColumn("cap", max_epochs * F.col("source_size"))
    everything = Window.partitionBy()
    s = s.withColumns({"total": F.least(total_ratio * F.sum("source_size").over(everything), F.sum("cap").over(everything)),
                       "all_weight": F.sum("weight").over(everything)})
    order = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").cast("binary").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    of = F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    s = s.withColumn("at", F.row_number().over(order)).withColumn("level", left / of)  # the level if exactly the sources before this one are full
    first_free = F.min(F.when(F.col("level") * F.col("weight") < F.col("cap"), F.struct("at", "level")))
    s = s.withColumn("water", first_free.over(everything)["level"])
    target = F.when(F.col("water").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("water") * F.col("weight")))
    return s.select("source", "source_size", "n_docs", target.alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, total_ratio: float = TOTAL_RATIO, max_epochs: float = MAX_EPOCHS, seed: int = SEED,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per input row: id, _text_md5, _text_null, source, size, source_size, target, copies (times the mix takes it)."""
    h = F.xxhash64(F.lit(seed), F.col(id_col).cast("string"), F.col("_text_md5"))
    d = docs.select(F.col(id_col), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("_text_md5"), F.col(text_col).isNull().alias("_text_null"),
                    F.col(source_col).alias("source"), word_count(text_col).alias("size")).withColumn("_h", h)
    d = written(d, "mix-sizes")
    t = written(source_targets(d, weights, total_ratio, max_epochs), "source-targets").withColumnRenamed("source", "_source")
    n_sources = t.count()
    t = F.broadcast(t) if n_sources <= 100_000 else t
    d = d.join(t, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint")
    cells = F.greatest(F.lit(1), F.ceil(F.col("n_docs") / CELL_ROWS)).cast("bigint")
    d = d.withColumns({"_epochs": epochs, "_rest": F.col("target") - epochs * F.col("source_size"),
                       "_cell": F.floor(F.shiftrightunsigned("_h", 33) / F.lit(float(1 << 31)) * cells)})
    cell_sum = d.groupBy("source", "_cell").agg(F.sum("size").alias("_cell_size"))
    before = Window.partitionBy("source").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cell_sum = cell_sum.withColumn("_before", F.coalesce(F.sum("_cell_size").over(before), F.lit(0))).select(F.col("source").alias("_s"), F.col("_cell").alias("_c"), "_before")
    inside = Window.partitionBy("source", "_cell").orderBy("_h", id_col, "_text_md5").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    d = d.join(cell_sum, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_cell") == F.col("_c")))
    extra = (F.col("_before") + F.col("_in") + F.col("size") / 2.0 <= F.col("_rest")).cast("int")
    return d.select(id_col, "_text_md5", "_text_null", "source", "size", "source_size", "target", (F.col("_epochs") + extra).alias("copies"))


def mix_report(docs: DataFrame, **kw) -> DataFrame:
    """Per document: doc_id, size, source_size, target (its source's), taken (words the mix takes, repeats counted)."""
    m = mix(docs, **kw)
    return m.select(m.columns[0], "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, **kw) -> DataFrame:
    """The mix itself: ``docs`` with every row as often as the mix takes it, columns unchanged, whatever their names.

    Rows that share id, text and source share their copies: each gets the whole part
    of the mean and, by a seeded draw, one more for the rest (a row on its own gets
    exactly its copies).
    """
    m = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, seed=seed, **kw)
    key = ["_i", "_text_md5", "_text_null", "_s"]
    m = m.withColumnsRenamed({id_col: "_i", "source": "_s"}).groupBy(*key).agg((F.sum("copies") / F.count("*")).alias("_copies"))
    field = F.col("row").getField
    d = packed(docs).select("row", F.md5(F.coalesce(field(text_col), F.lit("")).cast("binary")).alias("_m"), field(text_col).isNull().alias("_n"),
                            (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.monotonically_increasing_id()), 33) / F.lit(float(1 << 31))).alias("_draw"))
    on = field(id_col).eqNullSafe(F.col("_i")) & (F.col("_m") == F.col("_text_md5")) & (F.col("_n") == F.col("_text_null")) & field(source_col).eqNullSafe(F.col("_s"))
    n = F.floor("_copies") + (F.col("_draw") < F.col("_copies") - F.floor("_copies")).cast("int")
    out = d.join(m, on).withColumn("_n_copies", n).filter("_n_copies > 0")
    return unpacked(out.select("row", F.explode(F.sequence(F.lit(1), F.col("_n_copies")))), docs.columns)
