"""KPI summaries, ranked breakdowns, custom KPIs, comparisons and what-if aggregates."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metricloom.functions.formats import (
    MONTHS, WEEKDAYS, calendar_rank, kpi_text, metric_text, month_name, period_start)
from metricloom.functions.metrics import computable_metrics, ratio, record_count
from metricloom.model import Filter, Metric, SemanticModel, quoted, resolve_column
from metricloom.operators.filters import _comparable, apply_filters, equality_filters


def long_metrics(wide: DataFrame, metrics: Iterable[Metric], keys: Iterable[str] = ()) -> DataFrame:
    """Metric columns to rows (keys..., metric_id, label, metric_type, unit, value, formatted_value)."""
    metrics, keys = list(metrics), list(keys)
    rows = F.explode(F.array(*[
        F.struct(F.lit(n).alias("metric_order"), F.lit(m.id).alias("metric_id"), F.lit(m.label).alias("label"),
                 F.lit(m.kind).alias("metric_type"), F.lit(m.unit).alias("unit"),
                 F.col(quoted(m.id)).alias("value"),
                 metric_text(F.col(quoted(m.id)), m.format).alias("formatted_value"))
        for n, m in enumerate(metrics, 1)]))
    return wide.select(*keys, rows.alias("m")).select(*keys, "m.*")


# -- C1 ---------------------------------------------------------------------------------------

def kpi_summary(df: DataFrame, model: SemanticModel, filters: Iterable[Filter] = (),
                metrics: Iterable[str] | None = None) -> DataFrame:
    """Every computable metric in one global aggregate, one row per metric."""
    known = computable_metrics(model)
    chosen = list(known.values()) if metrics is None else [known[m] for m in metrics if m in known]
    wide = apply_filters(df, filters).agg(*[m.column() for m in chosen])
    return long_metrics(wide, chosen)


# -- C2, C3, M1 -------------------------------------------------------------------------------

def grouped_metrics(df: DataFrame, dimension: str, metrics: Iterable[Metric],
                    filters: Iterable[Filter] = ()) -> DataFrame:
    """(dimension_value, _row_count, metrics...) with the null group kept."""
    dimension = resolve_column(df, dimension)
    return (apply_filters(df, filters)
            .groupBy(F.col(quoted(dimension)).alias("dimension_value"))
            .agg(F.count(F.lit(1)).alias("_row_count"), *[m.column() for m in metrics]))


def ordered(column: str, ascending: bool) -> list[Column]:
    """Sort keys with nulls last either way; ties go by the dimension."""
    key = F.col(quoted(column))
    return [key.asc_nulls_last() if ascending else key.desc_nulls_last(),
            F.col("dimension_value").asc_nulls_last()]


def breakdown(df: DataFrame, model: SemanticModel, dimension: str, metrics: Iterable[str] = (),
              filters: Iterable[Filter] = (), limit: int = 20, sort_by: str | None = None,
              ascending: bool = False, group_total: bool = False) -> DataFrame:
    """Top groups of a dimension by a metric (or by the dimension itself).

    ``group_total`` adds ``total_distinct_groups``, the number of non-null groups
    under the same filter.
    """
    if not 1 <= limit <= 1000:
        raise ValueError("limit must be between 1 and 1000")
    known = computable_metrics(model)
    chosen = [known[m] for m in dict.fromkeys(metrics) if m in known] or [record_count()]
    grouped = grouped_metrics(df, dimension, chosen, filters)
    key = chosen[0].id
    if sort_by in [m.id for m in chosen]:
        key = sort_by
    elif sort_by is not None and sort_by.lower() == dimension.lower():
        key = "dimension_value"
    top = grouped.orderBy(*ordered(key, ascending)).limit(limit)
    return with_group_total(top, grouped) if group_total else top


def with_group_total(top: DataFrame, grouped: DataFrame) -> DataFrame:
    """Add the number of non-null groups of ``grouped`` as a scalar subquery.

    The count looks at whole rows, so both branches need the same aggregate and
    Spark reuses its exchange instead of scanning the data twice.
    """
    whole_row = F.struct(*[F.col(quoted(c)) for c in grouped.columns])
    total = grouped.agg(F.count(F.when(F.col("dimension_value").isNotNull(), whole_row)).alias("n"))
    return top.withColumn("total_distinct_groups", total.scalar())


def group_count(df: DataFrame, dimension: str, filters: Iterable[Filter] = ()) -> DataFrame:
    """Number of distinct non-null values of a dimension."""
    name = resolve_column(df, dimension)
    return apply_filters(df, filters).agg(
        F.count_distinct(F.col(quoted(name))).alias("total_distinct_groups"))


# -- C4-C7 ------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Condition:
    """What counts as a hit for a rate; without a column it looks at the KPI's own column."""

    value: Any
    op: str = "eq"
    column: str | None = None


@dataclass(frozen=True)
class KpiSpec:
    """A user-defined KPI: sum, avg, count, min, max, rate or percent_of_total."""

    aggregation: str
    column: str = "*"
    dimension: str | None = None
    condition: Condition | None = None
    output_type: str = "auto"
    style: str | None = None
    unit: str | None = None
    limit: int = 15

    @property
    def text_style(self) -> str:
        if self.aggregation in ("rate", "percent_of_total") and self.style in (None, "number"):
            return "percentage"
        return self.style or "number"


# Text that counts as true when a rate has no condition.
TRUE_WORDS = ("1", "true", "True", "YES", "yes")


def _rate_hit(df: DataFrame, spec: KpiSpec) -> Column:
    condition = spec.condition
    name = resolve_column(df, condition.column if condition and condition.column else spec.column)
    column = F.col(quoted(name))
    if condition is None or condition.value is None:
        return column.cast("string").isin(*TRUE_WORDS)
    if condition.op in ("eq", "neq") and isinstance(condition.value, str):
        equal = F.lower(column.cast("string")) == condition.value.lower()
        return equal if condition.op == "eq" else ~equal
    left, right = _comparable(df, name, condition.value)
    return {"eq": left == right, "neq": left != right, "gt": left > right, "gte": left >= right,
            "lt": left < right, "lte": left <= right}[condition.op]


def custom_measure(df: DataFrame, spec: KpiSpec) -> Column:
    """The aggregate behind a custom KPI."""
    how = spec.aggregation
    if how == "rate":
        hits = F.count(F.when(_rate_hit(df, spec), 1))
        return F.round(ratio(hits * 100.0, F.count(F.lit(1))), 2)
    if how == "count":
        return F.count(F.lit(1) if spec.column == "*" else F.col(quoted(resolve_column(df, spec.column))))
    column = F.col(quoted(resolve_column(df, spec.column)))
    number = column.try_cast("double")
    if how == "avg":
        return F.round(F.avg(number), 2)
    if how == "sum":
        return F.round(F.sum(number), 2)
    if how == "percent_of_total":
        return F.sum(number)
    if how in ("min", "max"):
        return (F.min if how == "min" else F.max)(column)
    raise ValueError(f"unsupported aggregation {how!r}")


def custom_number(df: DataFrame, spec: KpiSpec, value: Column) -> Column:
    """The value of a KPI as a double; the least or greatest of a date is no number and shows as missing."""
    if spec.aggregation not in ("min", "max"):
        return value.cast("double")
    dtype = df.schema[resolve_column(df, spec.column)].dataType
    numeric = isinstance(dtype, (T.NumericType, T.StringType, T.BooleanType))
    return value.try_cast("double") if numeric else F.lit(None).cast("double")


def is_time_like(df: DataFrame, dimension: str) -> bool:
    """Date or time type, or a name that says so."""
    dtype = df.schema[dimension].dataType
    words = ("date", "year", "month", "day", "week", "time")
    return (isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType))
            or any(w in dimension.lower() for w in words))


def by_time(df: DataFrame, spec: KpiSpec) -> bool:
    """Whether the groups of a custom KPI are shown in the order of their dimension."""
    return is_time_like(df, resolve_column(df, spec.dimension)) and spec.output_type in ("auto", "line_chart")


def custom_kpi(df: DataFrame, spec: KpiSpec, filters: Iterable[Filter] = ()) -> DataFrame:
    """Scalar KPI: one row (metric_value, formatted_value). Grouped: one row per group.

    Grouped rows drop the null group; a time-like dimension on a line chart sorts by
    itself, anything else by value, nulls last. A null group value shows as 0.
    """
    df = apply_filters(df, filters)
    measure = custom_measure(df, spec)
    if spec.dimension is None:
        if spec.aggregation == "percent_of_total":
            total = df.agg(measure.alias("total"))
            value = F.round(ratio(F.col("total") * 100.0, F.col("total")), 2)
            rows = total.select(value.alias("metric_value"))
        else:
            rows = df.agg(custom_number(df, spec, measure).alias("metric_value"))
        return rows.withColumn("formatted_value",
                               kpi_text(F.col("metric_value"), spec.text_style, spec.unit))

    name = resolve_column(df, spec.dimension)
    dimension = F.col(quoted(name))
    grouped = (df.filter(dimension.isNotNull()).groupBy(dimension.alias("dimension_value"))
               .agg(measure.alias("metric_value")))
    if spec.aggregation == "percent_of_total":
        # The total is a one-row aggregate of the groups, not a window over all of them.
        total = grouped.agg(F.sum(F.when(F.col("dimension_value").isNotNull(), F.col("metric_value")))).scalar()
        grouped = grouped.withColumn("metric_value", F.round(ratio(F.col("metric_value") * 100.0, total), 2))
    else:
        grouped = grouped.withColumn("metric_value", custom_number(df, spec, F.col("metric_value")))
    keys = [F.col("dimension_value").asc()] if by_time(df, spec) else ordered("metric_value", ascending=False)
    value = F.coalesce(F.col("metric_value"), F.lit(0.0))
    return (grouped.orderBy(*keys).limit(spec.limit)
            .select(F.col("dimension_value").cast("string").alias("dimension_value"),
                    value.alias("metric_value"),
                    kpi_text(value, spec.text_style, spec.unit).alias("formatted_value")))


def kpi_sparkline(df: DataFrame, spec: KpiSpec, date_column: str, points: int = 8) -> DataFrame:
    """First months of a scalar KPI, oldest first: rows (period_start, metric_value)."""
    date = F.col(quoted(resolve_column(df, date_column)))
    rows = (df.filter(date.isNotNull()).groupBy(period_start(date, "month").alias("period"))
            .agg(custom_measure(df, spec).cast("double").alias("metric_value")))
    return (rows.orderBy("period").limit(points)
            .select(F.col("period").cast("string").alias("period_start"), "metric_value"))


# -- C9, D2 -----------------------------------------------------------------------------------

def grouping_rows(df: DataFrame, dimensions: Iterable[str], metrics: Iterable[Metric]) -> DataFrame:
    """One aggregate for many dimensions: rows (dim_order, dimension, dimension_value, _row_count, metrics...).

    Grouping sets read the data once; GROUPING tells a real null group from a
    dimension that is not part of the set.
    """
    dimensions = [resolve_column(df, d) for d in dimensions]
    if len(dimensions) == 1:
        return (grouped_metrics(df, dimensions[0], metrics)
                .select(F.lit(0).alias("dim_order"), F.lit(dimensions[0]).alias("dimension"),
                        F.col("dimension_value").cast("string").alias("dimension_value"),
                        "_row_count", *[quoted(m.id) for m in metrics]))
    keys = [F.col(quoted(d)) for d in dimensions]
    sets = df.groupingSets([[k] for k in keys], *keys).agg(
        F.count(F.lit(1)).alias("_row_count"),
        *[F.grouping(F.col(quoted(d))).alias(f"_out{n}") for n, d in enumerate(dimensions)],
        *[m.column() for m in metrics])
    order = F.coalesce(*[F.when(F.col(f"_out{n}") == 0, F.lit(n)) for n in range(len(dimensions))])
    value = F.coalesce(*[F.when(F.col(f"_out{n}") == 0, F.col(quoted(d)).cast("string"))
                         for n, d in enumerate(dimensions)])
    names = F.array(*[F.lit(d) for d in dimensions])
    return sets.select(order.alias("dim_order"), F.element_at(names, order + 1).alias("dimension"),
                       value.alias("dimension_value"), "_row_count", *[quoted(m.id) for m in metrics])


def top_per_dimension(rows: DataFrame, key: str, limit: int, ascending: bool = False) -> DataFrame:
    """Best rows of each dimension with their rank; Spark cuts to ``limit`` before the shuffle."""
    window = W.partitionBy("dim_order").orderBy(*ordered(key, ascending))
    return rows.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= limit)


def breakdown_dimensions(df: DataFrame, model: SemanticModel, most: int = 6) -> list[str]:
    """Employee name, category, product, model dimensions, then other text columns; the first ``most`` of them."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    names = {"employee_name", "employee_name_full", "full_name", "name"}
    employee = model.column("employee_name") or next((c for c in texts if c.lower() in names), None)
    wanted = [employee, model.column("category"), model.column("product"), *model.dimensions, *texts]
    return list(dict.fromkeys(d for d in wanted if d))[:most]


def multi_breakdown(df: DataFrame, model: SemanticModel, metric: str,
                    dimensions: Iterable[str] | None = None, top: int = 8) -> DataFrame:
    """One metric over several dimensions at once, ``top`` groups of each.

    ``share_percentage`` is of all groups of the dimension, ``share_of_shown`` of the rows returned.
    """
    if not 1 <= top <= 1000:
        raise ValueError("top must be between 1 and 1000")
    known = computable_metrics(model)
    chosen = known.get(metric) or record_count()
    dimensions = list(dimensions) if dimensions else breakdown_dimensions(df, model)
    rows = grouping_rows(df, dimensions, [chosen])
    value = F.coalesce(F.col(chosen.id), F.lit(0.0))
    totals = rows.groupBy("dim_order").agg(F.sum(value).alias("total"))  # a row per dimension
    best = top_per_dimension(rows, chosen.id, top).join(F.broadcast(totals), "dim_order")

    def share(total: Column) -> Column:
        return F.when(total > 0, F.round(value / total * 100.0, 1)).otherwise(0.0)

    return best.select("dimension", "rank", "dimension_value", F.round(value, 2).alias("value"),
                       metric_text(value, chosen.format).alias("formatted_value"),
                       F.lit(chosen.kind).alias("metric_type"), share(F.col("total")).alias("share_percentage"),
                       share(F.sum(value).over(W.partitionBy("dim_order"))).alias("share_of_shown"))


# -- C10, C14 ---------------------------------------------------------------------------------

def dimension_values(df: DataFrame, dimension: str, limit: int = 100) -> DataFrame:
    """Most frequent values with counts; a null value uses one of the places, then drops."""
    top = (grouped_metrics(df, dimension, []).orderBy(*ordered("_row_count", False)).limit(limit))
    return (top.filter(F.col("dimension_value").isNotNull())
            .select(F.col("dimension_value").cast("string").alias("dimension_value"),
                    F.col("_row_count").alias("row_count")))


def hero_stats(df: DataFrame, dimensions: Iterable[str], status: str | None = None) -> DataFrame:
    """Record count, distinct values of one or two dimensions (null counts) and the on-time share."""
    dimensions = [resolve_column(df, d) for d in dimensions]
    if len(dimensions) > 2:
        raise ValueError("at most two dimensions")
    columns = [F.count(F.lit(1)).alias("records")]
    for n, name in enumerate(dimensions, 1):
        column = F.col(quoted(name))
        nulls = F.max(F.when(column.isNull(), 1).otherwise(0))
        columns.append((F.count_distinct(column) + F.coalesce(nulls, F.lit(0))).alias(f"distinct_{n}"))
    if status:
        hit = F.col(quoted(resolve_column(df, status))) == "On Time"
        columns.append(F.round(F.avg(F.when(hit, 1.0).otherwise(0.0)) * 100, 1).alias("on_time_pct"))
    return df.agg(*columns)


# -- C12, C13 ---------------------------------------------------------------------------------

def compare(base: DataFrame, target: DataFrame, model: SemanticModel,
            target_model: SemanticModel | None = None, most: int = 5) -> DataFrame:
    """First metrics of the base data set on both data sets, with deltas."""
    chosen = list(computable_metrics(model).values())[:most]
    other = computable_metrics(target_model or model)
    left = long_metrics(base.agg(*[m.column() for m in chosen]), chosen)
    both = [other[m.id] for m in chosen if m.id in other]
    right = (long_metrics(target.agg(*[m.column() for m in both]), both)
             .select("metric_id", F.col("value").alias("target_value")))
    base_value, target_value = F.coalesce("value", F.lit(0.0)), F.coalesce("target_value", F.lit(0.0))
    delta = target_value - base_value
    pct = F.when(base_value > 0, F.try_divide(delta, base_value) * 100.0).otherwise(0.0)
    return left.join(right, "metric_id").select(
        "metric_id", "label", F.round(base_value, 2).alias("base_value"),
        F.round(target_value, 2).alias("target_value"), F.round(delta, 2).alias("delta_value"),
        F.round(pct, 1).alias("delta_percentage"), (delta >= 0).alias("is_positive_growth"))


# Largest change in percent of each what-if setting; the smallest is -90.
WHAT_IF_BOUNDS = {"price_change_pct": 200.0, "cost_change_pct": 200.0, "volume_change_pct": 300.0}


def what_if(df: DataFrame, model: SemanticModel, settings: Iterable[Mapping[str, float]],
            only: Mapping[str, Any] | None = None) -> DataFrame:
    """Revenue, profit and margin under price, cost and volume changes in percent.

    A setting scales the sums of the whole selection, so any number of settings needs
    one aggregate of two sums; the settings themselves are applied to its single row.
    """
    settings = [dict(s) for s in settings]
    for setting in settings:
        for key, most in WHAT_IF_BOUNDS.items():
            if not -90.0 <= float(setting.setdefault(key, 0.0)) <= most:
                raise ValueError(f"{key} must be between -90 and {most:g}")
    names = {c: model.mappings.get(c, d) for c, d in
             (("quantity", "Quantity"), ("sale_price", "Sale_Price"), ("cost_price", "Cost_Price"))}
    quantity, price, cost = (F.col(quoted(resolve_column(df, names[c])))
                             for c in ("quantity", "sale_price", "cost_price"))
    sums = apply_filters(df, equality_filters(model, only or {})).agg(
        F.coalesce(F.sum(quantity * price), F.lit(0.0)).cast("double").alias("base_revenue"),
        F.coalesce(F.sum(quantity * cost), F.lit(0.0)).cast("double").alias("base_cost"))
    grid = F.explode(F.array(*[
        F.struct(F.lit(n).alias("setting_no"),
                 *[F.lit(float(s[k])).alias(k) for k in WHAT_IF_BOUNDS])
        for n, s in enumerate(settings, 1)]))
    rows = sums.select("*", grid.alias("s")).select("base_revenue", "base_cost", "s.*")
    volume = 1 + F.col("volume_change_pct") / 100
    new_revenue = F.col("base_revenue") * volume * (1 + F.col("price_change_pct") / 100)
    new_cost = F.col("base_cost") * volume * (1 + F.col("cost_change_pct") / 100)

    def margin(revenue: Column, cost_: Column) -> Column:
        return F.when(revenue > 0, F.try_divide(revenue - cost_, revenue) * 100.0).otherwise(0.0)

    rows = (rows.withColumn("new_revenue", new_revenue).withColumn("new_cost", new_cost)
            .withColumn("base_profit", F.col("base_revenue") - F.col("base_cost"))
            .withColumn("new_profit", F.col("new_revenue") - F.col("new_cost"))
            .withColumn("base_margin", margin(F.col("base_revenue"), F.col("base_cost")))
            .withColumn("new_margin", margin(F.col("new_revenue"), F.col("new_cost"))))
    impacts = F.explode(F.array(*[
        F.struct(F.lit(i).alias("metric_id"), F.col(f"base_{c}").alias("base"), F.col(f"new_{c}").alias("new"))
        for i, c in (("total_revenue", "revenue"), ("total_profit", "profit"), ("profit_margin", "margin"))]))
    keys = ["setting_no", *WHAT_IF_BOUNDS]
    delta = F.col("i.new") - F.col("i.base")
    pct = F.when(F.col("i.base") > 0, F.try_divide(delta, F.col("i.base")) * 100.0).otherwise(0.0)
    return rows.select(*keys, impacts.alias("i")).select(
        *keys, "i.metric_id", F.round("i.base", 2).alias("baseline_value"),
        F.round("i.new", 2).alias("simulated_value"), F.round(delta, 2).alias("delta_value"),
        F.round(pct, 1).alias("delta_percentage"))


# -- C15, C16, D9, L9 -------------------------------------------------------------------------

# Text that counts as true in the lenient variant.
LENIENT_TRUE = ("true", "1", "yes", "t", "y")


def _number(column: Column, dtype: T.DataType) -> Column:
    """Value as a browser reads it: empty is 0, true is 1, other text that is no number is null."""
    if isinstance(dtype, T.BooleanType):
        return F.coalesce(column.cast("int").cast("double"), F.lit(0.0))
    text = F.trim(column.cast("string"))
    return F.when(text.isNull() | (text == ""), 0.0).otherwise(text.try_cast("double"))


def explorer_kpi(df: DataFrame, measure: str, column: str | None = None, how: str = "avg",
                 dimension: str | None = None, equals: tuple[str, Any] | None = None,
                 lenient: bool = False, limit: int | None = None) -> DataFrame:
    """KPI of the record explorer: measure is count, rate or value (sum, avg, min, max).

    The strict form skips text that is no number, counts a rate where the value equals 1,
    and drops empty groups. The lenient form reads non-numeric values as 0, takes any
    true word as a hit, names the empty group 'Unknown' and sorts by time a text column
    whose values are all dates. ``limit`` groups are returned (strict 15, lenient 30).
    Rows: (name, value, count), plus ``total_groups`` when grouped.
    """
    if equals:
        name, wanted = resolve_column(df, equals[0]), str(equals[1])
        text = F.col(quoted(name)).cast("string")
        df = df.filter(F.lower(text) == wanted.lower() if lenient else text == wanted)
    target = F.col(quoted(resolve_column(df, column))) if column else None
    rows = F.count(F.lit(1))
    if measure == "count":
        value = rows.cast("double")
    elif measure == "rate":
        hit = (F.lower(F.trim(target.cast("string"))).isin(*LENIENT_TRUE) if lenient
               else _number(target, df.schema[resolve_column(df, column)].dataType) == 1)
        value = ratio(F.count(F.when(hit, 1)) * 100.0, rows)
    else:
        number = _number(target, df.schema[resolve_column(df, column)].dataType)
        number = F.coalesce(number, F.lit(0.0)) if lenient else number
        value = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[how](number)
    if dimension is None:
        if lenient:
            value = F.coalesce(value, F.lit(0.0))
        elif measure == "count":
            value = F.when(rows > 0, value)
        return df.agg(value.alias("value"), rows.alias("count"))

    name = resolve_column(df, dimension)
    group, text = F.col(quoted(name)), F.col(quoted(name)).cast("string")
    if lenient:
        key = F.when(text.isNull() | (text == ""), F.lit("Unknown")).otherwise(text)
    else:
        df = df.filter(text.isNotNull() & (text != ""))
        key = month_name(group) if name == "Month" else text
    grouped = df.groupBy(key.alias("name")).agg(value.alias("value"), rows.alias("count"))
    if not lenient:
        grouped = grouped.filter(F.col("value").isNotNull())
    if lenient:
        # Dates of any form sort by time, the rest by value: one text that is no date decides for all groups.
        moment = F.col("name").try_cast("timestamp")
        dated = grouped.agg(F.coalesce(F.bool_and(moment.isNotNull() & (F.length("name") >= 8)), F.lit(False))).scalar()
        keys = [F.when(dated, moment).asc(), F.when(~dated, F.col("value")).desc_nulls_last(), F.col("name").asc()]
    elif not lenient and name in ("Month", "DayOfWeek", "Year"):
        names = {"Month": MONTHS, "DayOfWeek": WEEKDAYS}.get(name)
        keys = ([calendar_rank(F.col("name"), names)] if names else []) + [F.col("name").asc()]
    else:
        keys = [F.col("value").desc_nulls_last(), F.col("name").asc()]
    whole_row = F.struct("name", "value", "count")
    total = grouped.agg(F.count(F.when(F.col("name").isNotNull(), whole_row)).alias("n"))
    return (grouped.orderBy(*keys).limit(limit or (30 if lenient else 15))
            .withColumn("total_groups", total.scalar()))
