"""Cleaning policies: names, trimming, money text, negatives, missing values, dates, duplicates."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metricloom.functions.quantiles import column_quantiles
from metricloom.model import quoted
from metricloom.operators.profile import NON_NEGATIVE_NAMES

NEGATIVE_POLICIES = ("flag", "nullify", "abs", "drop_row")
MISSING_POLICIES = ("keep", "drop_row", "fill_mean", "fill_median", "fill_mode")
DATE_POLICIES = ("coerce_null", "drop_row")

# Date forms read from text, tried in this order.
DATE_FORMATS = ("yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy", "MM-dd-yyyy", "yyyy-MM-dd HH:mm:ss",
                "yyyy-MM-dd'T'HH:mm:ss")


@dataclass(frozen=True)
class CleaningPolicy:
    trim_whitespace: bool = True
    standardize_column_names: bool = True
    drop_duplicates: bool = False
    negatives: str = "flag"
    missing: str = "keep"
    invalid_dates: str = "coerce_null"
    coerce_currency: bool = True
    date_columns: tuple[str, ...] = ()

    def __post_init__(self):
        for value, allowed in ((self.negatives, NEGATIVE_POLICIES), (self.missing, MISSING_POLICIES),
                               (self.invalid_dates, DATE_POLICIES)):
            if value not in allowed:
                raise ValueError(f"policy {value!r} is not one of {allowed}")


def snake_case(name: str) -> str:
    """'Sale Price ($)' -> 'sale_price'."""
    text = re.sub(r"[^a-zA-Z0-9]+", "_", re.sub(r"\([^)]*\)", "", name)).strip("_").lower()
    return text or "col"


def clean_names(columns: list[str]) -> list[str]:
    """Snake-case names; a clash gets _1, _2 ..."""
    taken: list[str] = []
    for column in columns:
        base = name = snake_case(column)
        n = 1
        while name in taken:
            name, n = f"{base}_{n}", n + 1
        taken.append(name)
    return taken


def money_number(text: Column) -> Column:
    """'$1,200.00' -> 1200.0, '(5)' -> -5.0, '12%' -> 12.0; anything unreadable is null."""
    bare = F.regexp_replace(text, r"[$,€£¥%]", "")
    return F.trim(F.regexp_replace(bare, r"\((.*?)\)", "-$1")).try_cast("double")


def is_money_name(name: str) -> bool:
    return re.search(NON_NEGATIVE_NAMES, name) is not None


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def negative_columns(df: DataFrame) -> list[str]:
    """Numeric columns whose name says that they cannot be negative."""
    return [c for c in numeric_columns(df) if is_money_name(c)]


def trim_text(df: DataFrame) -> DataFrame:
    """Cut leading and trailing white space of every text column."""
    texts, blanks = set(text_columns(df)), F.lit(" \t\n\r\x0b\x0c")
    return df.select(*[F.btrim(F.col(quoted(c)), blanks).alias(c) if c in texts else F.col(quoted(c)) for c in df.columns])


def coerce_money(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Money and percent text to double in text columns whose name says so (or in ``columns``)."""
    chosen = set(columns if columns is not None else [c for c in text_columns(df) if is_money_name(c)])
    return df.select(*[money_number(F.col(quoted(c))).alias(c) if c in chosen else F.col(quoted(c))
                       for c in df.columns])


def handle_negatives(df: DataFrame, policy: str) -> DataFrame:
    """Apply a policy to negative values; ``drop_row`` keeps rows >= 0, so nulls drop too.

    As in a plain pass over the columns, a column without any negative value is left
    alone: ``drop_row`` then keeps its nulls.
    """
    columns = negative_columns(df)
    if policy == "flag" or not columns:
        return df
    if policy == "drop_row":
        counts = df.agg(*[F.count(F.when(F.col(quoted(c)) < 0, 1)).alias(f"n{i}") for i, c in enumerate(columns)])
        negatives = counts.select(F.struct(*counts.columns)).scalar()
        keep = F.lit(True)
        for i, c in enumerate(columns):
            value = F.col(quoted(c))
            keep = keep & (F.coalesce(value >= 0, F.lit(False)) | (negatives[f"n{i}"] == 0))
        return df.filter(keep)
    changed = {c: F.abs(F.col(quoted(c))) if policy == "abs" else F.when(F.col(quoted(c)) >= 0, F.col(quoted(c)))
               for c in columns}
    return df.select(*[changed.get(c, F.col(quoted(c))).alias(c) for c in df.columns])


def fill_modes(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row (c0, c1 ...) with the most frequent value of each column; ties go to the smallest."""
    cells = F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), F.col(quoted(c)).cast("string").alias("v"),
                 (F.col(quoted(c)).cast("double") if c in numeric_columns(df) else F.lit(None).cast("double")).alias("n"))
        for i, c in enumerate(columns)]))
    counts = (df.select(cells.alias("c")).select("c.*").filter(F.col("v").isNotNull())
              .groupBy("i", "v", "n").agg(F.count(F.lit(1)).alias("size")))
    best = counts.groupBy("i").agg(F.min(F.struct((-F.col("size")).alias("key"), "n", "v")).alias("m"))
    return best.agg(*[F.max(F.when(F.col("i") == i, F.col("m.v"))).cast(df.schema[c].dataType).alias(f"c{i}")
                      for i, c in enumerate(columns)])


def handle_missing(df: DataFrame, policy: str) -> DataFrame:
    """Keep, drop or fill nulls; means and medians fill numeric columns, modes fill every column."""
    if policy == "keep":
        return df
    if policy == "drop_row":
        return df.na.drop()
    columns = list(df.columns) if policy == "fill_mode" else numeric_columns(df)
    if not columns:
        return df
    if policy == "fill_mean":
        fills = df.agg(*[F.avg(F.col(quoted(c))).alias(f"c{i}") for i, c in enumerate(columns)])
    elif policy == "fill_median":
        medians = column_quantiles(df, columns, [0.5])
        fills = medians.agg(*[F.max(F.when(F.col("column_name") == c, F.col("quantile"))).alias(f"c{i}")
                              for i, c in enumerate(columns)])
    else:
        fills = fill_modes(df, columns)
    fill = fills.select(F.struct(*fills.columns)).scalar()
    filled = {}
    for i, c in enumerate(columns):
        target = df.schema[c].dataType
        # A mean of whole numbers is fractional: such a column becomes double.
        if policy != "fill_mode" and not isinstance(target, (T.DoubleType, T.FloatType)):
            target = T.DoubleType()
        filled[c] = F.coalesce(F.col(quoted(c)).cast(target), fill[f"c{i}"].cast(target)).alias(c)
    return df.select(*[filled.get(c, F.col(quoted(c))) for c in df.columns])


def parse_date(text: Column) -> Column:
    """Timestamp from any of the known date forms, null when none fits."""
    return F.coalesce(*[F.try_to_timestamp(F.trim(text), F.lit(f)) for f in DATE_FORMATS])


def handle_dates(df: DataFrame, columns: tuple[str, ...], policy: str) -> DataFrame:
    """Date text to timestamps; unreadable text becomes null or drops its row (nulls stay)."""
    for name in columns:
        text = F.col(quoted(name))
        if policy == "drop_row":
            df = df.filter(text.isNull() | parse_date(text).isNotNull())
        df = df.withColumn(name, parse_date(text))
    return df


def standardized(df: DataFrame, policy: CleaningPolicy) -> DataFrame:
    """The steps before any value is judged: names, trimming, money text."""
    if policy.standardize_column_names:
        df = df.toDF(*clean_names(df.columns))
    if policy.trim_whitespace:
        df = trim_text(df)
    if policy.coerce_currency:
        df = coerce_money(df)
    return df


def clean(df: DataFrame, policy: CleaningPolicy | None = None) -> DataFrame:
    """Apply the whole policy, in order: names, trim, money, negatives, missing, dates, duplicates."""
    policy = policy or CleaningPolicy()
    df = handle_negatives(standardized(df, policy), policy.negatives)
    df = handle_dates(df, policy.date_columns, policy.invalid_dates)
    df = handle_missing(df, policy.missing)
    return df.dropDuplicates() if policy.drop_duplicates else df
