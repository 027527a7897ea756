"""Text forms of numbers, labels and periods, all as JVM-side column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from metricloom.model import NumberFormat

# Calendar names in display order.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


def grouped_number(value: Column, decimals: int) -> Column:
    """1234.5 -> '1,234.50'."""
    return F.format_number(value.cast("double"), decimals)


def plain_number(value: Column, decimals: int) -> Column:
    """1234.5 -> '1234.50'."""
    return F.replace(grouped_number(value, decimals), F.lit(","), F.lit(""))


def metric_text(value: Column, fmt: NumberFormat) -> Column:
    """A metric value in its display format; 'N/A' for null."""
    number = grouped_number(value, fmt.decimals) if fmt.grouped else plain_number(value, fmt.decimals)
    return F.when(value.isNull(), F.lit("N/A")).otherwise(
        F.concat(F.lit(fmt.prefix), number, F.lit(fmt.suffix)))


def kpi_text(value: Column, style: str = "number", unit: str | None = None) -> Column:
    """A custom KPI value: currency, percentage, duration or number with a unit; '--' for null."""
    if style == "currency":
        text = F.concat(F.lit("$"), grouped_number(value, 2))
    elif style == "percentage":
        text = F.concat(grouped_number(value, 1), F.lit("%"))
    elif style == "duration":
        text = F.concat(grouped_number(value, 1), F.lit(f" {unit or 'min'}"))
    else:
        text = (F.when(value == F.floor(value), grouped_number(value, 0))
                .when(F.abs(value) < 1000, grouped_number(value, 2))
                .otherwise(grouped_number(value, 1)))
        if unit:
            text = F.concat(text, F.lit(f" {unit}"))
    return F.when(value.isNull(), F.lit("--")).otherwise(text)


def up_to_decimals(value: Column, decimals: int) -> Column:
    """Grouped number with trailing zeros of the fraction dropped."""
    text = grouped_number(value, decimals)
    return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def compact_text(value: Column, style: str = "number", unit: str = "") -> Column:
    """Card text: money as K / M from a thousand up, plain numbers as M from a million up."""
    size = F.abs(value)
    if style == "percentage" or unit == "%":
        text = F.concat(plain_number(value, 1), F.lit("%"))
    elif style == "currency" or unit == "$":
        text = (F.when(size >= 1_000_000, F.concat(F.lit("$"), plain_number(value / 1_000_000, 2), F.lit("M")))
                .when(size >= 1_000, F.concat(F.lit("$"), plain_number(value / 1_000, 1), F.lit("K")))
                .otherwise(F.concat(F.lit("$"), up_to_decimals(value, 2))))
    else:
        text = (F.when(size >= 1_000_000, F.concat(plain_number(value / 1_000_000, 2), F.lit("M")))
                .when((size >= 10_000) | (value == F.floor(value)), grouped_number(value, 0))
                .otherwise(plain_number(value, 2)))
        if unit:
            text = F.concat(text, F.lit(f" {unit}"))
    return F.when(value.isNull(), F.lit("--")).otherwise(text)


def hinted_text(value: Column, unit: str = "", scale: float = 1.0, prefix: bool = False) -> Column:
    """Value scaled by a unit hint: whole from 100 up, else one decimal at most."""
    scaled = value * F.lit(scale)
    # Half goes towards plus infinity, as a browser rounds.
    number = F.when(F.abs(scaled) >= 100, grouped_number(F.floor(scaled + 0.5), 0)).otherwise(
        up_to_decimals(F.floor(scaled * 10 + 0.5) / 10, 1))
    text = F.concat(F.lit(unit), number) if prefix else F.concat(number, F.lit(f" {unit}" if unit else ""))
    return F.when(value.isNull(), F.lit("--")).otherwise(text)


def spaced_words(name: Column) -> Column:
    """'DelayMinutes' -> 'Delay Minutes', 'USDPrice' -> 'USD Price'."""
    text = F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1 $2")
    return F.trim(F.regexp_replace(text, r"([A-Z]+)([A-Z][a-z])", "$1 $2"))


def name_tokens(name: Column) -> Column:
    """Lower-case words of a column name, split at case changes and non-alphanumerics."""
    words = F.split(F.lower(spaced_words(name)), r"[^a-z0-9]+")
    return F.filter(words, lambda w: w != "")


def month_name(number: Column) -> Column:
    """1 -> 'Jan'; anything outside 1..12 stays as text."""
    names = F.array(*[F.lit(m) for m in MONTHS])
    month = number.try_cast("int")
    return F.when(month.between(1, 12), F.element_at(names, month)).otherwise(number.cast("string"))


def calendar_rank(name: Column, names: tuple[str, ...]) -> Column:
    """Position in calendar order; unknown names first."""
    return F.array_position(F.array(*[F.lit(n) for n in names]), name)


def period_start(date: Column, granularity: str | Column) -> Column:
    """First day of the period a date falls in (weeks start on Monday); the granularity may be a column."""
    day = date.cast("date")
    if isinstance(granularity, str):
        return day if granularity == "day" else F.trunc(day, granularity)
    return F.when(granularity == "day", day).otherwise(F.call_function("trunc", day, granularity))


def _label(start: Column, granularity: str) -> Column:
    if granularity == "year":
        return F.date_format(start, "yyyy")
    if granularity == "quarter":
        return F.concat(F.lit("Q"), F.quarter(start).cast("string"), F.lit(" "), F.date_format(start, "yyyy"))
    if granularity == "month":
        return F.date_format(start, "yyyy-MM")
    return start.cast("string")


def period_label(start: Column, granularity: str | Column) -> Column:
    if isinstance(granularity, str):
        return _label(start, granularity)
    text = start.cast("string")
    for unit in ("year", "quarter", "month"):
        text = F.when(granularity == unit, _label(start, unit)).otherwise(text)
    return text
