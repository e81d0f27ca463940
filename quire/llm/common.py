"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: A word between ASCII white space.
SPACE_WORD = r"[^\x20\x09-\x0D]+"
#: What separates words: ASCII white space, or all of ASCII but digits and lower-case letters.
SPACE = r"[\x20\x09-\x0D]+"
NOT_ALNUM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def ascii_lower(col: Column | str) -> Column:
    """A-Z in lower case; every other character stays."""
    return F.translate(col, UPPER, LOWER)


def words(col: Column | str, separator: str = SPACE) -> Column:
    """The words of a text in order, repeats included; null has none."""
    return F.array_remove(F.split(F.coalesce(col, F.lit("")), separator), "")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` refers to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def written(df: DataFrame, name: str, mode_cols: tuple[str, ...] = ()) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder: computed once, safe when executors are lost."""
    path = scratch_path(df.sparkSession, name)
    w = df.write
    if mode_cols:
        w = w.partitionBy(*mode_cols)
    w.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """Key of a row by its content: rows that share it hold the same id and text, so they get the same result."""
    return [F.col(id_col), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("_text_md5"),
            F.col(text_col).isNull().alias("_text_null")]


def packed(docs: DataFrame) -> DataFrame:
    """``docs`` as one struct column ``row``: columns added beside it clash with none of its own."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def unpacked(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of ``row`` again."""
    return df.select(*[F.col("row").getField(c).alias(c) for c in columns])


def crc_mod(id_col: str, mod: int) -> Column:
    """crc32 of the id as text (null: of the empty text), modulo ``mod``."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % mod
