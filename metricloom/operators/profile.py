"""Column profiles, types, roles, duplicate rows and concept tags."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metricloom.functions.quantiles import column_quantiles, spread_quantiles
from metricloom.model import quoted

# Text shapes that count as dates.
DATE_SHAPES = (
    r"^\d{4}-\d{2}-\d{2}$",
    r"^\d{4}/\d{2}/\d{2}$",
    r"^\d{2}/\d{2}/\d{4}$",
    r"^\d{2}-\d{2}-\d{4}$",
    r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}",
)
DATE_SHARE = 0.8

# Name patterns for roles and checks (used without regard to case).
ID_NAMES = r"(?i)(^id$|_id$|^id_|_uuid$|_code$|_key$|^sku$|^order_id$|^customer_id$|^product_id$|^transaction_id$)"
MEASURE_NAMES = (r"(?i)(price|cost|sales|revenue|profit|margin|amount|qty|quantity|units|total|discount|rate|fee"
                 r"|tax|salary|balance|count)")
NON_NEGATIVE_NAMES = r"(?i)(price|cost|sales|revenue|qty|quantity|units|count|fee|tax|salary)"

PROBS = {0.25: "q25", 0.5: "median", 0.75: "q75"}


def _is_time(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DayTimeIntervalType))


def _native_type(dtype: T.DataType) -> str | None:
    """Type known from the schema alone; None for text, which must be looked at."""
    if isinstance(dtype, T.NumericType):
        return "numeric"
    if isinstance(dtype, T.DateType):
        return "date"
    if _is_time(dtype):
        return "datetime"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    return None if isinstance(dtype, T.StringType) else "unknown"


def _date_like(text: Column) -> Column:
    trimmed = F.trim(text)
    hit = F.lit(False)
    for shape in DATE_SHAPES:
        hit = hit | trimmed.rlike(shape)
    return hit


def value_cells(df: DataFrame) -> DataFrame:
    """(position, whole, num, text, weight): each cell, pre-counted by column and value.

    Whole numbers, fractional numbers and everything else (as text) keep to a column of
    their own, so numbers are not turned into text row by row. Equal values collapse
    before the shuffle: a hot value costs one row per task.
    """
    cells = []
    for n, f in enumerate(df.schema.fields, 1):
        column = F.col(quoted(f.name))
        whole, num, text = F.lit(None).cast("long"), F.lit(None).cast("double"), F.lit(None).cast("string")
        if isinstance(f.dataType, T.IntegralType):
            whole = column.cast("long")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            num = column.cast("double") + F.lit(0.0)  # -0.0 and 0.0 are one value
        elif _native_type(f.dataType) != "unknown":
            text = column.cast("string")
        else:
            text = F.when(column.isNotNull(), F.to_json(F.struct(column)))
        cells.append(F.struct(F.lit(n).alias("position"), whole.alias("whole"), num.alias("num"), text.alias("text")))
    return (df.select(F.explode(F.array(*cells)).alias("c")).select("c.*")
            .groupBy("position", "whole", "num", "text").agg(F.count(F.lit(1)).alias("weight")))


def _named(df: DataFrame) -> Column:
    """Column name of a cell's position."""
    return F.element_at(F.array(*[F.lit(c) for c in df.columns]), F.col("position"))


def _natives(df: DataFrame) -> Column:
    """Type of a cell's column where the schema decides, null for text."""
    return F.element_at(F.array(*[F.lit(_native_type(f.dataType)).cast("string") for f in df.schema.fields]),
                        F.col("position"))


def _cell_text() -> Column:
    return F.coalesce(F.col("text"), F.col("whole").cast("string"), F.col("num").cast("string"))


def _counts() -> list[Column]:
    """Aggregates over pre-counted cells: rows, nulls, distinct values, date-shaped text."""
    weight, trimmed = F.col("weight"), F.trim("text")
    missing = F.col("whole").isNull() & F.col("num").isNull() & F.col("text").isNull()
    return [
        F.sum(weight).alias("row_count"),
        F.coalesce(F.sum(F.when(missing, weight)), F.lit(0)).alias("null_count"),
        F.count(F.lit(1)).alias("unique_count"),
        F.coalesce(F.sum(F.when((trimmed != "") & _date_like(F.col("text")), weight)), F.lit(0)).alias("shaped"),
        F.coalesce(F.sum(F.when(trimmed != "", weight)), F.lit(0)).alias("filled")]


def _moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, mean, std_dev) of numeric columns from one global aggregate."""
    aggregates = []
    for n, name in enumerate(columns):
        value = F.col(quoted(name)).cast("double")
        aggregates += [F.avg(value).alias(f"mean_{n}"), F.stddev_samp(value).alias(f"std_{n}")]
    rows = F.explode(F.array(*[
        F.struct(F.lit(name).alias("column_name"), F.col(f"mean_{n}").alias("mean"), F.col(f"std_{n}").alias("std_dev"))
        for n, name in enumerate(columns)]))
    return df.agg(*aggregates).select(rows.alias("r")).select("r.*")


def detected_type(native: Column, shaped: Column, filled: Column) -> Column:
    return F.coalesce(native, F.when((filled > 0) & (shaped / filled >= DATE_SHARE), "date").otherwise("categorical"))


def role_of(name: Column, kind: Column, rows: Column, unique: Column) -> Column:
    """Analytical role from type, name and uniqueness."""
    ratio = F.coalesce(F.try_divide(unique, rows), F.lit(0.0))
    id_name, measure_name = F.trim(name).rlike(ID_NAMES), F.trim(name).rlike(MEASURE_NAMES)
    return (F.when(kind.isin("date", "datetime"), "time_dimension")
            .when(kind == "boolean", "dimension")
            .when((kind == "numeric") & id_name, "id")
            .when((kind == "numeric") & (ratio == 1.0) & (rows > 10) & ~measure_name, "id")
            .when(kind == "numeric", "measure")
            .when((kind == "categorical") & id_name, "id")
            .when((kind == "categorical") & (ratio >= 0.95) & (rows > 20), "id")
            .when(kind == "categorical", "dimension").otherwise("unknown"))


def profile(df: DataFrame) -> DataFrame:
    """One row per column: type, role, nulls, unique values, samples, numeric and date statistics.

    Counts per (column, value) give uniques, extremes, date shapes and samples; two
    global aggregates give moments and quantile cuts.
    """
    numbers = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    cells = value_cells(df)
    value = F.coalesce(F.col("num"), F.col("whole").cast("double"))
    counts = cells.groupBy("position").agg(
        *_counts(), F.min(value).alias("min"), F.max(value).alias("max"),
        F.min("text").alias("first_text"), F.max("text").alias("last_text"))
    smallest = W.partitionBy("position").orderBy("whole", "num", "text")
    samples = (cells.withColumn("shown", _cell_text()).filter(F.col("shown").isNotNull())
               .withColumn("place", F.row_number().over(smallest)).filter(F.col("place") <= 5)
               .groupBy("position").agg(F.array_sort(F.collect_list(F.struct("place", "shown"))).alias("s"))
               .select("position", F.transform("s", lambda v: v["shown"]).alias("sample_values")))
    # From here on there is one row per column of the schema.
    rows = (counts.join(F.broadcast(samples), "position", "left")
            .withColumn("column_name", _named(df)).withColumn("native", _natives(df)))
    if numbers:
        quantiles = spread_quantiles(column_quantiles(df, numbers, PROBS), PROBS)
        rows = (rows.join(F.broadcast(_moments(df, numbers)), "column_name", "left")
                .join(F.broadcast(quantiles), "column_name", "left"))
    else:
        rows = rows.withColumns({c: F.lit(None).cast("double") for c in ("mean", "std_dev", *PROBS.values())})
    rows = rows.withColumn("detected_type", detected_type(F.col("native"), F.col("shaped"), F.col("filled")))
    is_date = F.col("detected_type").isin("date", "datetime")
    low, high = F.when(is_date, F.col("first_text")), F.when(is_date, F.col("last_text"))
    days = F.date_diff(F.substring(high, 1, 10).try_cast("date"), F.substring(low, 1, 10).try_cast("date"))
    four = [F.round(c, 4).alias(c) for c in ("min", "max", "mean", "median", "std_dev", "q25", "q75")]
    return rows.select(
        "column_name", "position", "detected_type",
        role_of(F.col("column_name"), F.col("detected_type"), F.col("row_count"), F.col("unique_count")).alias("role"),
        "row_count", "null_count", _percent("null_count", "row_count").alias("null_percentage"),
        "unique_count", _percent("unique_count", "row_count").alias("uniqueness_percentage"), "sample_values",
        *four, low.alias("min_date"), high.alias("max_date"), days.alias("duration_days"))


def _percent(part: str, whole: str) -> Column:
    return F.coalesce(F.round(F.try_divide(F.col(part) * 100.0, F.col(whole)), 2), F.lit(0.0))


def _distinct_values(df: DataFrame, positions: list[int]) -> DataFrame:
    """(position, unique_count) of columns; values travel as 128-bit hashes, a null counts as a value."""
    cells = []
    for n in positions:
        column = F.col(quoted(df.columns[n - 1]))
        if isinstance(df.schema.fields[n - 1].dataType, (T.DoubleType, T.FloatType)):
            column = column + F.lit(0.0)  # -0.0 and 0.0 are one value
        cells.append(F.struct(F.lit(n).alias("position"), F.xxhash64(column).alias("a"),
                              F.xxhash64(column, F.lit(n)).alias("b"), column.isNull().alias("missing")))
    return (df.select(F.explode(F.array(*cells)).alias("c")).select("c.*").distinct()
            .groupBy("position").agg(F.count(F.lit(1)).alias("unique_count")))


def type_roles(df: DataFrame) -> DataFrame:
    """(column_name, position, detected_type, role) without the statistics.

    Types come from the schema and, for text, from one global aggregate. Distinct values are counted only for columns
    whose role depends on them: dates, flags and columns named like an id or a measure do not.
    """
    fields = df.schema.fields
    natives = [_native_type(f.dataType) for f in fields]
    shapes = []
    for n, (f, native) in enumerate(zip(fields, natives), 1):
        if native is None:
            text = F.col(quoted(f.name))
            has = F.trim(text) != ""
            shapes += [F.count(F.when(has & _date_like(text), 1)).alias(f"shaped{n}"),
                       F.count(F.when(has, 1)).alias(f"filled{n}")]
    zero = F.lit(0).cast("long")
    columns = F.explode(F.array(*[F.struct(
        F.lit(f.name).alias("column_name"), F.lit(n).alias("position"), F.lit(native).cast("string").alias("native"),
        (F.col(f"shaped{n}") if native is None else zero).alias("shaped"),
        (F.col(f"filled{n}") if native is None else zero).alias("filled"), F.col("rows").alias("row_count"))
        for n, (f, native) in enumerate(zip(fields, natives), 1)]))
    rows = df.agg(F.count(F.lit(1)).alias("rows"), *shapes).filter("rows > 0").select(columns.alias("c")).select("c.*")

    def depends(name: str, native: str | None) -> bool:
        named = re.search(ID_NAMES, name.strip()) or (native == "numeric" and re.search(MEASURE_NAMES, name.strip()))
        return native in (None, "numeric") and not named

    open_ = [n for n, (f, native) in enumerate(zip(fields, natives), 1) if depends(f.name, native)]
    if open_:
        rows = rows.join(_distinct_values(df, open_), "position", "left")  # a row per column
    else:
        rows = rows.withColumn("unique_count", zero)
    kind = detected_type(F.col("native"), F.col("shaped"), F.col("filled"))
    typed = rows.withColumn("detected_type", kind)
    return typed.select("column_name", "position", "detected_type", role_of(
        F.col("column_name"), F.col("detected_type"), F.col("row_count"), F.coalesce("unique_count", zero)).alias("role"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row (row_count, distinct_rows, duplicate_rows, duplicate_percentage)."""
    copies = df.groupBy(*[F.col(quoted(c)) for c in df.columns]).agg(F.count(F.lit(1)).alias("_copies"))
    totals = copies.agg(F.coalesce(F.sum("_copies"), F.lit(0)).alias("row_count"),
                        F.count(F.lit(1)).alias("distinct_rows"))
    extra = F.col("row_count") - F.col("distinct_rows")
    return totals.select("row_count", "distinct_rows", extra.alias("duplicate_rows"),
                         F.coalesce(F.round(F.try_divide(extra * 100.0, F.col("row_count")), 2), F.lit(0.0))
                         .alias("duplicate_percentage"))


def dataset_summary(df: DataFrame) -> DataFrame:
    """One row (row_count, column_count, duplicate_rows, duplicate_percentage)."""
    return duplicate_rows(df).select("row_count", F.lit(len(df.columns)).alias("column_count"), "duplicate_rows",
                                     "duplicate_percentage")


# -- C20 --------------------------------------------------------------------------------------

# Words of a yes/no flag, and name hints for units.
FLAG_WORDS = ("true", "false", "1", "0", "yes", "no", "t", "f", "y", "n")
UNIT_HINTS = (
    (("price", "usd", "cost", "revenue", "fare"), "$", "currency"),
    (("delay", "duration", "minute"), "min", "duration"),
    (("distance", "km"), "km", "number"),
    (("mile",), "mi", "number"),
)
PERCENT_HINTS = ("factor", "rate", "pct", "percent")


def behaviour_roles(df: DataFrame) -> DataFrame:
    """Column roles judged by values alone, in both variants of the record explorer.

    ``role``: binary flag, date, discrete or continuous number, identifier, category.
    ``simple_role``: boolean, numeric (more than 15 values), identifier, categorical.
    """
    cells = value_cells(df).withColumn("shown", _cell_text()).withColumn("trimmed", F.trim("shown"))
    filled = F.col("shown").isNotNull() & (F.col("shown") != "")
    number = F.coalesce(F.col("num"), F.col("whole").cast("double"),
                        F.when(F.col("trimmed") == "", 0.0).otherwise(F.col("trimmed").try_cast("double")))
    date = (F.length("trimmed") >= 8) & F.col("trimmed").try_cast("timestamp").isNotNull()
    stats = cells.groupBy("position").agg(
        F.sum("weight").alias("rows"),
        F.coalesce(F.sum(F.when(filled, F.col("weight"))), F.lit(0)).alias("filled"),
        F.count(F.when(filled, 1)).alias("uniques"),
        F.coalesce(F.sum(F.when(filled & number.isNotNull(), F.col("weight"))), F.lit(0)).alias("numbers"),
        F.count(F.when(filled & ~F.lower("trimmed").isin(*FLAG_WORDS), 1)).alias("not_flag"),
        F.count(F.when(filled & ~date, 1)).alias("not_date"),
        F.count(F.when(filled & ~F.coalesce(number.isin(0.0, 1.0), F.lit(False)), 1)).alias("not_bit")).withColumn("column_name", _named(df))
    c, name = F.col, F.lower("column_name")
    binary = (c("uniques") <= 2) & (c("not_flag") == 0)
    numeric = (c("filled") > 0) & (c("numbers") / F.greatest(c("filled"), F.lit(1)) > 0.85)
    is_date = ~numeric & (c("filled") > 0) & (c("not_date") == 0)
    share = F.coalesce(F.try_divide(c("uniques"), c("filled")), F.lit(0.0))
    role = (F.when(binary, "binary_flag").when(is_date, "temporal_dimension")
            .when(numeric & (c("uniques") <= 12) & (c("uniques") < c("rows") * 0.05), "discrete_numeric_dimension")
            .when(numeric, "continuous_measure")
            .when((share > 0.85) & (c("uniques") > 30), "unique_identifier")
            .when(c("uniques") <= 5, "low_cardinality_category").otherwise("category"))
    all_numbers = c("numbers") == c("filled")
    simple = (F.when(c("filled") == 0, "identifier")
              .when(all_numbers & (c("uniques") <= 2) & (c("not_bit") == 0), "boolean")
              .when(all_numbers & (c("uniques") > 15), "numeric")
              .when((c("uniques") / c("rows") > 0.85) & (c("uniques") > 30), "identifier").otherwise("categorical"))
    unit, style = F.lit(""), F.lit("number")
    percent = binary
    for word in PERCENT_HINTS:
        percent = percent | name.contains(word)
    unit, style = F.when(percent, "%").otherwise(""), F.when(percent, "percentage").otherwise("number")
    for words, sign, form in reversed(UNIT_HINTS):
        hit = F.lit(False)
        for word in words:
            hit = hit | name.contains(word)
        unit, style = F.when(hit, sign).otherwise(unit), F.when(hit, form).otherwise(style)
    return stats.select("column_name", "position", role.alias("role"), simple.alias("simple_role"),
                        c("uniques").alias("unique_count"), (c("rows") - c("filled")).alias("null_count"),
                        unit.alias("unit"), style.alias("style"))
