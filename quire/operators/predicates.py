"""Search filters as Spark Columns (PF5-PF8, PF11).

A key that is a real column of the table (hot keys such as ``sender``,
``addressed_to``, ``lang``) is compared directly, so the filter reaches the
Parquet scan (``PushedFilters``). Any other key is read from the JSON
``metadata`` text, parsed once per row that passes the column filters, and typed from the
Python literal with ``try_cast``; a missing key or an uncastable value gives null, which
excludes the row for every operator, ``!=`` included (SQL three-valued logic).
"""

from __future__ import annotations

import datetime as _dt
import operator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.meta import parse_metadata, value_of, with_parsed
from ..functions.times import ntz_lit, week_start

OPS = {
    "==": operator.eq, "=": operator.eq, "!=": operator.ne, "<>": operator.ne,
    ">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le,
}


def _sql_type(value) -> str:
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, int):
        return "bigint"
    if isinstance(value, float):
        return "double"
    if isinstance(value, _dt.datetime):
        return "timestamp_ntz"
    if isinstance(value, _dt.date):
        return "date"
    return "string"


def key_column(key: str, value, columns: set[str] | None, metadata_col: str = "metadata", parsed: Column | None = None) -> Column:
    """The value of ``key`` typed like ``value``: a real column if the table has one, else from JSON (``parsed`` if given)."""
    t = _sql_type(value)
    if columns is not None and key in columns:
        c = F.col(key)
        return c if t in ("string", "bigint", "double", "boolean") else c.try_cast(t)
    # 4.0 and 4 compare equal, as in JSON
    return value_of(parse_metadata(metadata_col) if parsed is None else parsed, key, "double" if t == "bigint" else t)


class Predicate:
    """(key, op, value) leaf combined with ``&`` and ``|`` (PF6, PF7)."""

    def __init__(self, key: str | None = None, op: str | None = None, value=None, *, _kind="leaf", _kids=()):
        if _kind == "leaf" and op not in OPS:
            raise ValueError(f"unsupported operator {op!r}")
        self.key, self.op, self.value, self.kind, self.kids = key, op, value, _kind, tuple(_kids)

    def __and__(self, other: "Predicate") -> "Predicate":
        return Predicate(_kind="and", _kids=(self, other))

    def __or__(self, other: "Predicate") -> "Predicate":
        return Predicate(_kind="or", _kids=(self, other))

    def keys(self) -> set[str]:
        return {self.key} if self.kind == "leaf" else set().union(*[k.keys() for k in self.kids])

    def conjuncts(self) -> list["Predicate"]:
        return [c for k in self.kids for c in k.conjuncts()] if self.kind == "and" else [self]

    def to_column(self, columns: set[str] | None = None, metadata_col: str = "metadata", parsed: Column | None = None) -> Column:
        if self.kind == "and":
            return reduce(lambda a, b: a & b, [k.to_column(columns, metadata_col, parsed) for k in self.kids])
        if self.kind == "or":
            return reduce(lambda a, b: a | b, [k.to_column(columns, metadata_col, parsed) for k in self.kids])
        v = self.value
        lit = F.lit(v) if not isinstance(v, (_dt.date, _dt.datetime)) else ntz_lit(v)
        if isinstance(v, int) and not isinstance(v, bool) and not (columns and self.key in columns):
            lit = F.lit(float(v))
        return OPS[self.op](key_column(self.key, v, columns, metadata_col, parsed), lit)

    def __repr__(self) -> str:
        if self.kind == "leaf":
            return f"Predicate({self.key!r}, {self.op!r}, {self.value!r})"
        return f"({f' {self.kind} '.join(map(repr, self.kids))})"


def metadata_predicate(spec: dict | list) -> Predicate | None:
    """PF5: a dict is an AND of equalities; a list of dicts is an OR of those. None where nothing is asked."""
    if isinstance(spec, dict):
        return reduce(Predicate.__and__, [Predicate(k, "==", v) for k, v in spec.items()]) if spec else None
    some = [metadata_predicate(s) for s in spec]
    return reduce(Predicate.__or__, some) if some and all(p is not None for p in some) else None


def metadata_filter(spec: dict | list, columns: set[str] | None = None, metadata_col: str = "metadata") -> Column:
    """``metadata_predicate`` as a Column."""
    p = metadata_predicate(spec)
    return F.lit(True) if p is None else p.to_column(columns, metadata_col)


def time_range(start=None, end=None, time_col: str = "ingest_ts", part_col: str | None = "week_start",
               start_inclusive: bool = True, end_inclusive: bool = False) -> Column:
    """PF8: ``[start, end)`` on ``time_col`` plus the matching range on the week partition column.

    A filter on the timestamp alone cannot prune partitions; the derived
    ``week_start`` bounds make the scan skip every week outside the range.
    A null end is open; both null = no filter.
    """
    conds = []
    if start is not None:
        s = ntz_lit(start)
        conds.append(F.col(time_col) >= s if start_inclusive else F.col(time_col) > s)
        if part_col:
            conds.append(F.col(part_col) >= week_start(s))
    if end is not None:
        e = ntz_lit(end)
        conds.append(F.col(time_col) <= e if end_inclusive else F.col(time_col) < e)
        if part_col:
            conds.append(F.col(part_col) <= week_start(e))
    return reduce(lambda a, b: a & b, conds) if conds else F.lit(True)


def apply_filters(store: DataFrame, *, filter: dict | list | None = None, predicates: Predicate | None = None,
                  time: tuple | None = None, time_col: str = "ingest_ts", part_col: str | None = "week_start",
                  metadata_col: str = "metadata") -> DataFrame:
    """All global search filters of one search call, as ``filter`` nodes Catalyst can push down."""
    cols = set(store.columns)
    out = store
    if time:
        start, end = time
        out = out.filter(time_range(start, end, time_col, part_col if part_col in cols else None))
    wanted = [p for p in (metadata_predicate(filter) if filter else None, predicates) if p is not None]
    parts = [c for p in wanted for c in p.conjuncts()]
    for p in parts:
        if p.keys() <= cols:
            out = out.filter(p.to_column(cols))
    in_text = [p for p in parts if not p.keys() <= cols]
    if in_text:
        out, name = with_parsed(out, metadata_col)
        out = out.filter(reduce(Predicate.__and__, in_text).to_column(cols, metadata_col, F.col(name))).drop(name)
    return out
