"""Record explorer: paging, single-record inspection and value lists."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metricloom.functions.quantiles import value_at_rank
from metricloom.model import quoted, resolve_column


def page_count(df: DataFrame, size: int = 40) -> DataFrame:
    """One row (records, pages); an empty result still has one page."""
    return df.agg(F.count(F.lit(1)).alias("records")).select(
        "records", F.greatest(F.lit(1), F.ceil(F.col("records") / size)).cast("long").alias("pages"))


#: The column of a row's hash while pages are cut.
TIE = "_tie"
#: Rows that a task may pass over by sorting; what lies before them is skipped by counting.
PASSED = 10_000
#: Characters by which a search among text keys goes on.
PREFIX = 2
#: Where all pages are cut at once: the column of a row's range, rows of a range, the most ranges, and rows picked for the
#: bounds of each.
PART, RANGE, RANGES, PICKED = "_part", 200_000, 512, 64


def _text_start(df: DataFrame, name: str, rank: int) -> tuple[Column, int]:
    """(condition of the rows from a key prefix on, rows before them) for the text key at a rank.

    Each round counts the rows by a few more characters after what the keys in question share.
    """
    column, inside, passed = F.col(quoted(name)), F.col(quoted(name)).isNotNull(), 0
    while True:
        low, high, rows = df.filter(inside).agg(F.min(column), F.max(column), F.count(F.lit(1))).first()
        if rows == 0:
            return column.isNull(), passed
        if rows <= PASSED or low == high or rank - passed <= PASSED:
            return column >= F.lit(low), passed
        shared = next((i for i, (a, b) in enumerate(zip(low, high)) if a != b), min(len(low), len(high)))
        prefix = F.substring(column, 1, shared + PREFIX)
        counts = df.filter(inside).groupBy(prefix.alias("prefix")).agg(F.count(F.lit(1)).alias("n"))
        upto = F.sum("n").over(W.orderBy("prefix"))  # a row per pair of characters
        found = (counts.withColumn("upto", upto).filter(F.col("upto") > rank - passed).orderBy("prefix")
                 .limit(1).first())
        if found is None:
            return column.isNull(), passed + rows
        passed += found["upto"] - found["n"]
        inside = inside & (prefix == F.lit(found["prefix"]))


def _start(df: DataFrame, name: str, rank: int) -> tuple[Column | None, int]:
    """Where to read from so that few rows come before a rank of the key: (condition, rows left out)."""
    column, dtype = F.col(quoted(name)), df.schema[name].dataType
    if isinstance(dtype, T.StringType):
        return _text_start(df, name, rank)
    if isinstance(dtype, T.DateType):
        number = F.unix_date(column)
    elif isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        number = F.unix_micros(column.cast("timestamp"))
    elif isinstance(dtype, (T.NumericType, T.BooleanType)):
        number = column.cast("double")
    else:
        return None, 0
    keys = df.select(number.alias("key"))
    first = value_at_rank(keys, "key", rank)
    if first is None:  # among the nulls
        return column.isNull(), df.filter(column.isNotNull()).count()
    number = number.cast("double")
    return (number >= F.lit(first)) | column.isNull(), df.filter(number < F.lit(first)).count()


def _with_tie(df: DataFrame) -> DataFrame:
    """Add a hash of the row, of 52 bits: exact as a double, so that ranks of it can be searched."""
    return df.withColumn(TIE, F.shiftrightunsigned(F.xxhash64(*[F.col(quoted(c)) for c in df.columns]), 12))


def _row_order(df: DataFrame, key: str) -> list[Column]:
    """By key, then by hash; rows that share both are ordered by their cells, after which only equal rows are left."""
    return [F.col(quoted(key)).asc_nulls_last(), F.col(TIE), *[F.col(quoted(c)) for c in df.columns if c != key and
            isinstance(df.schema[c].dataType, T.AtomicType)]]


def page(df: DataFrame, key: str, number: int = 1, size: int = 40) -> DataFrame:
    """One page of the rows in key order; a number past the end gives the last page.

    Rows of equal keys are ordered by a hash of the whole row, so that pages neither repeat nor lose any. The key at the
    page's first rank is found by counting and the rows are read from there; many equal keys are searched by that hash.
    To walk through a table use :func:`page_after`, which needs no ranks; for all pages :func:`numbered_pages`.
    """
    key = resolve_column(df, key)
    tie, rows = TIE, _with_tie(df)
    shape = page_count(df, size).first()
    records, pages = shape["records"], shape["pages"]
    start = (min(max(1, number), pages) - 1) * size
    column = F.col(quoted(key))
    order = _row_order(df, key)
    if start > PASSED:
        condition, passed = _start(df, key, start)
        if condition is not None:
            rows, start = rows.filter(condition), start - passed
        if start > PASSED:  # many rows of one key
            first = rows.orderBy(column.asc_nulls_last()).select(column.alias("key")).first()["key"]
            same = column.eqNullSafe(F.lit(first).cast(df.schema[key].dataType))
            least = value_at_rank(rows.filter(same), tie, start)
            if least is not None:
                start -= rows.filter(same & (F.col(tie) < F.lit(least))).count()
                rows = rows.filter(~same | (F.col(tie) >= F.lit(least)))
    return rows.orderBy(*order).offset(start).limit(size).drop(tie)


@dataclass(frozen=True)
class Cursor:
    """The last row of a page: its key, the hash of the row, and how many rows up to it bear both."""

    key: Any
    tie: int
    seen: int


def page_after(df: DataFrame, key: str, last_key: Any = None, size: int = 40,
               cursor: Cursor | None = None) -> DataFrame:
    """The page that follows a row, in order of the key (nulls last) and, for equal keys, of a hash of the row.

    After ``last_key`` alone come the rows of other keys. To walk through all rows, of equal and of no keys too, take the
    ``cursor`` of the page before from :func:`cursor_after`. The key's condition is pushed to the scan.
    """
    key = resolve_column(df, key)
    column, rows, skipped = F.col(quoted(key)), _with_tie(df), 0
    if cursor is not None:
        here = F.col(TIE) >= F.lit(cursor.tie)
        skipped = cursor.seen
        if cursor.key is None:
            rows = rows.filter(column.isNull() & here)
        else:
            # The first condition follows from the second; it is the one that reaches the scan.
            last = F.lit(cursor.key).cast(df.schema[key].dataType)
            rows = rows.filter((column >= last) | column.isNull()).filter((column != last) | column.isNull() | here)
    elif last_key is not None:
        rows = rows.filter((column > F.lit(last_key)) | column.isNull())
    rows = rows.orderBy(*_row_order(df, key))
    return (rows.offset(skipped) if skipped else rows).limit(size).drop(TIE)


def _bounds(rows: DataFrame, key: str, records: int) -> list:
    """(key, tie) at which ranges of about ``RANGE`` rows end, from a share of the rows picked by their hash."""
    ranges = min(RANGES, records // RANGE + 1)
    one_of = max(1, records // (ranges * PICKED))
    picked = (rows.filter(F.xxhash64(TIE) % one_of == 0).groupBy(F.col(quoted(key)).alias("key"), F.col(TIE).alias("tie"))
              .agg(F.count(F.lit(1)).alias("n")))
    order = F.col("key").asc_nulls_last(), F.col("tie")
    # About PICKED rows a range: few, however many there are.
    upto = F.sum("n").over(W.orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))
    cut = F.floor(upto / PICKED)
    ends = picked.select("key", "tie", cut.alias("cut"), F.floor((upto - F.col("n")) / PICKED).alias("before"))
    return ends.filter(F.col("cut") > F.col("before")).orderBy(*order).collect()


def _range_of(bounds: list, column: Column, dtype: T.DataType, first: int = 0) -> Column:
    """The number of bounds up to a row's (key, tie), as a search tree of conditions."""
    if not bounds:
        return F.lit(first)
    at = len(bounds) // 2
    bound, tie = bounds[at], F.col(TIE) < F.lit(bounds[at]["tie"])
    if bound["key"] is None:
        before = column.isNotNull() | tie
    else:
        value = F.lit(bound["key"]).cast(dtype)
        before = F.coalesce((column < value) | ((column == value) & tie), F.lit(False))
    return (F.when(before, _range_of(bounds[:at], column, dtype, first))
            .otherwise(_range_of(bounds[at + 1:], column, dtype, first + at + 1)))


def numbered_pages(df: DataFrame, key: str, size: int = 40) -> DataFrame:
    """All rows with the number (``page``, from 0) of the page that holds them in a walk by :func:`page_after`.

    One plan for all pages, where a walk reads the table anew for each. Rows are dealt to ranges of the walk's order, by
    bounds that only decide how even the ranges are; each numbers its own rows and starts at the count of those before it.
    """
    key = resolve_column(df, key)
    rows = _with_tie(df)
    part = _range_of(_bounds(rows, key, df.count()), F.col(quoted(key)), df.schema[key].dataType)
    rows = rows.withColumn(PART, part)
    counts = {r[PART]: r["n"] for r in rows.groupBy(PART).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per range
    starts, passed = [], 0
    for n in range(max(counts, default=0) + 1):
        starts.append(passed)
        passed += counts.get(n, 0)
    place = F.row_number().over(W.partitionBy(PART).orderBy(*_row_order(df, key))).cast("long") - 1
    start = F.get(F.array(*[F.lit(s).cast("long") for s in starts]), F.col(PART))
    return rows.withColumn("page", F.floor((place + start) / F.lit(size)).cast("long")).drop(TIE, PART)


def cursor_after(page: DataFrame, key: str, cursor: Cursor | None = None) -> Cursor | None:
    """The cursor of a page's last row, where the page itself follows ``cursor``; None for a page without rows."""
    key = resolve_column(page, key)
    place = F.struct(F.col(quoted(key)).isNull().alias("none"), F.col(quoted(key)).alias("key"), F.col(TIE))
    last = (_with_tie(page).select(place.alias("place")).groupBy("place").agg(F.count(F.lit(1)).alias("seen"))
            .orderBy(F.desc("place")).first())
    if last is None:
        return None
    found = Cursor(last["place"]["key"], last["place"][TIE], last["seen"])
    again = cursor is not None and (found.key, found.tie) == (cursor.key, cursor.tie)
    return replace(found, seen=found.seen + cursor.seen) if again else found


def inspect_record(df: DataFrame, key: str, value: Any) -> DataFrame:
    """One record as rows (position, field, value, is_numeric, is_null): of several with this key the first page's first."""
    key = resolve_column(df, key)
    row = _with_tie(df.filter(F.col(quoted(key)) == F.lit(value))).orderBy(*_row_order(df, key)).limit(1)
    cells = F.explode(F.array(*[
        F.struct(F.lit(n).alias("position"), F.lit(f.name).alias("field"),
                 F.col(quoted(f.name)).cast("string").alias("value"),
                 (F.lit(isinstance(f.dataType, T.NumericType)) & F.col(quoted(f.name)).isNotNull()).alias("is_numeric"),
                 (F.coalesce(F.col(quoted(f.name)).cast("string"), F.lit("")) == "").alias("is_null"))
        for n, f in enumerate(df.schema.fields, 1)]))
    return row.select(cells.alias("c")).select("c.*")


def dropdown_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct non-null values, sorted."""
    name = resolve_column(df, column)
    return (df.filter(F.col(quoted(name)).isNotNull())
            .select(F.col(quoted(name)).cast("string").alias("value")).distinct().orderBy("value"))


