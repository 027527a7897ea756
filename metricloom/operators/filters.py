"""Row filters as pushdown-friendly column predicates."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metricloom.model import Filter, SemanticModel, quoted, resolve_column


def _comparable(df: DataFrame, name: str, value: Any) -> tuple[Column, Column]:
    """Column and literal of one common type, without ever raising on odd text.

    The literal is cast to the column's type where that loses nothing, so the
    predicate still reaches the Parquet scan.
    """
    column, dtype = F.col(quoted(name)), df.schema[name].dataType
    if isinstance(value, (dt.date, dt.datetime)):
        value = value.isoformat(sep=" ") if isinstance(value, dt.datetime) else value.isoformat()
    if isinstance(dtype, T.StringType):
        if isinstance(value, bool):
            return F.lower(column), F.lit(str(value).lower())
        if isinstance(value, (int, float)):
            return column.try_cast("double"), F.lit(float(value))
        return column, F.lit(value)
    if isinstance(value, str):
        return column, F.lit(value).try_cast(dtype)
    if isinstance(dtype, T.BooleanType) != isinstance(value, bool):
        # true is 1 and false is 0; a flag compares as a number, a number with the flag's number.
        return (column.cast("int"), F.lit(value)) if isinstance(dtype, T.BooleanType) else (column, F.lit(int(value)))
    return column, F.lit(value)


def predicate(df: DataFrame, item: Filter) -> Column | None:
    """Predicate of one filter; None when the filter is to be ignored."""
    name = resolve_column(df, item.column)
    op, value = item.op, item.value
    if op in ("in", "not_in"):
        if not isinstance(value, (list, tuple, set)) or not value:
            return None
        pairs = [_comparable(df, name, v) for v in value]
        # Literals of one form share one isin(); mixed forms are ORed.
        first = str(pairs[0][0])
        if all(str(c) == first for c, _ in pairs):
            inside = pairs[0][0].isin([v for _, v in pairs])
        else:
            inside = reduce(Column.__or__, [c == v for c, v in pairs])
        return inside if op == "in" else ~inside
    if op == "between":
        if not isinstance(value, (list, tuple)) or len(value) != 2:
            return None
        (low_col, low), (high_col, high) = (_comparable(df, name, v) for v in value)
        return (low_col >= low) & (high_col <= high)
    if op == "like":
        # `%` and `_` of the user stay wildcards; a backslash is a plain character.
        pattern = "%" + str(value).replace("\\", "\\\\") + "%"
        return F.col(quoted(name)).cast("string").ilike(pattern)
    column, literal = _comparable(df, name, value)
    return {"eq": column == literal, "neq": column != literal, "gt": column > literal,
            "gte": column >= literal, "lt": column < literal, "lte": column <= literal}[op]


def apply_filters(df: DataFrame, filters: Iterable[Filter] = ()) -> DataFrame:
    """Keep the rows that pass every filter."""
    parts = [p for p in (predicate(df, f) for f in filters) if p is not None]
    return df.filter(reduce(Column.__and__, parts)) if parts else df


def equality_filters(model: SemanticModel, wanted: Mapping[str, Any]) -> list[Filter]:
    """Equality filters on columns that are dimensions or identifiers of the model."""
    allowed = {*model.dimensions, *model.identifiers}
    for column in wanted:
        if column not in allowed:
            raise ValueError(f"'{column}' is not a dimension or identifier of the dataset")
    return [Filter(column, "eq", value) for column, value in wanted.items()]


def value_filters(pairs: Iterable[tuple[str, Any]]) -> list[Filter]:
    """(column, value) pairs as one IN filter per column; every value counts."""
    grouped: dict[str, list[Any]] = {}
    for column, value in pairs:
        values = grouped.setdefault(column, [])
        if value not in values:
            values.append(value)
    return [Filter(column, "in", values) for column, values in grouped.items()]


def toggle_filter(filters: Iterable[Filter], column: str, value: Any) -> list[Filter]:
    """Dashboard click: same pick again removes it, another pick on the column replaces it."""
    filters = list(filters)
    same = [f for f in filters if f.column.lower() == column.lower()]
    if any(f.value == value for f in same):
        return [f for f in filters if not (f.column.lower() == column.lower() and f.value == value)]
    if same:
        return [Filter(f.column, "eq", value) if f is same[0] else f for f in filters]
    return [*filters, Filter(column, "eq", value)]


def text_equals(df: DataFrame, column: str, value: Any, ignore_case: bool = False) -> DataFrame:
    """Rows whose value, written as text, equals ``value`` written as text."""
    text, wanted = F.col(quoted(resolve_column(df, column))).cast("string"), str(value)
    return df.filter(F.lower(text) == wanted.lower() if ignore_case else text == wanted)


def search(df: DataFrame, text: str, equals: Mapping[str, Any] | None = None,
           ignore_case: bool = False) -> DataFrame:
    """Rows where any column contains ``text`` (case-insensitive), after up to two equality filters."""
    equals = dict(equals or {})
    if len(equals) > 2:
        raise ValueError("at most two equality filters")
    for column, value in equals.items():
        df = text_equals(df, column, value, ignore_case)
    needle = text.lower()
    if not needle.strip():
        return df
    hits = [F.coalesce(F.lower(F.col(quoted(c)).cast("string")).contains(needle), F.lit(False))
            for c in df.columns]
    return df.filter(reduce(Column.__or__, hits))
