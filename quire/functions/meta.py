"""JSON metadata helpers (PF2, PF4, PF9).

Metadata text is parsed once into a variant, from which each key is read. Text that is not
one JSON value, or repeats a key of an object, counts as metadata without keys.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SIMPLE = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*$")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def json_path(key: str) -> str | None:
    """Path of a top-level key; None for a key with both kinds of quotes, which no path can name."""
    if _SIMPLE.match(key):
        return f"$.{key}"
    quote = "'" if "'" not in key else '"'
    return None if quote in key else f"$[{quote}{key}{quote}]"


def parse_metadata(metadata) -> Column:
    """The metadata text as a variant."""
    return F.try_parse_json(_c(metadata))


def value_of(parsed: Column, key: str, sql_type: str = "string") -> Column:
    """Value of ``key`` in parsed metadata: null if missing, JSON null or not of the type; objects and lists as text."""
    path = json_path(key)
    v = F.try_variant_get(parsed, path, "string") if path else F.lit(None).cast("string")
    return v if sql_type == "string" else v.try_cast(sql_type)


def with_parsed(df: DataFrame, metadata: str = "metadata") -> tuple[DataFrame, str]:
    """``df`` with its metadata parsed once per row, and the name of that column (one that ``df`` does not have).

    A one-element ``inline`` generator keeps the variant as an attribute; Catalyst would
    repeat a plain expression for every key read from it.
    """
    name = "_parsed"
    while name in df.columns:
        name += "_"
    return df.select("*", F.inline(F.array(F.struct(parse_metadata(F.col(metadata)).alias(name))))), name


def pack_metadata(*cols, keep_nulls: bool = True, options: dict | None = None) -> Column:
    """PF2: columns -> JSON object text, null-valued keys kept; ``options`` go to ``to_json`` (e.g. date formats)."""
    return F.to_json(F.struct(*cols), {"ignoreNullFields": "false" if keep_nulls else "true", **(options or {})})


def expand_metadata(df: DataFrame, keys: dict[str, str], metadata: str = "metadata", keep: list[str] | None = None) -> DataFrame:
    """PF4: the ``keep`` columns (default: all) and one typed column per key ({key: sql_type}); missing / badly typed -> null."""
    parsed, name = with_parsed(df, metadata)
    kept = [F.col(f"`{c}`") for c in (df.columns if keep is None else keep)]
    return parsed.select(*kept, *[value_of(F.col(name), k, t).alias(k) for k, t in keys.items()])
