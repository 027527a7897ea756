"""All widgets of a dashboard from one shared aggregate."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from metricloom.functions.formats import kpi_text, metric_text, period_start
from metricloom.functions.metrics import computable_metrics, record_count
from metricloom.model import Filter, SemanticModel, quoted, resolve_column
from metricloom.operators.aggregate import (
    KpiSpec, by_time, custom_kpi, custom_measure, custom_number, is_time_like, kpi_summary)
from metricloom.operators.filters import apply_filters
from metricloom.operators.timeseries import choose_granularity, metric_trends

KINDS = ("kpi_card", "line_chart", "area_chart", "bar_chart", "pie_chart", "table")


@dataclass(frozen=True)
class Widget:
    """A dashboard tile. ``limit`` is top_n or page size; ``kpi`` makes it a custom KPI."""

    id: str
    kind: str
    metrics: tuple[str, ...] = ("total_revenue",)
    dimension: str | None = None
    granularity: str | None = None
    limit: int = 20
    kpi: KpiSpec | None = None

    def __post_init__(self):
        if not 1 <= self.limit <= 1000:
            raise ValueError("limit must be between 1 and 1000")
        if self.kind == "kpi_card" and len(self.metrics) > 1:
            raise ValueError("a card shows one metric")


def dashboard_data(df: DataFrame, model: SemanticModel, widgets: Iterable[Widget],
                   filters: Iterable[Filter] = (), context: DataFrame | None = None) -> DataFrame:
    """Rows (widget_id, position, key, metric_id, value, formatted_value) for all widgets.

    Cards, series, breakdowns and custom KPIs share one grouping-sets aggregate of the
    filtered data (the empty set for single values, one set per granularity and per
    dimension), so the number of scans does not grow with the number of widgets. An
    automatic granularity is a subquery on the date column. Only custom shares of a total
    are aggregates of their own, as each group needs the sum of the groups.
    A KPI card also yields ``<metric>`` rows keyed 'prior_value', 'growth_percentage',
    'spark_1'..'spark_8', 'trend', 'current_period' and 'prior_period', the last three as
    text. With ``context`` (the row of ``confidence_context``) a card also has 'headline'
    and 'confidence'. A widget that cannot be planned (an unknown column, a series without
    dates) yields one row keyed 'error' with the reason as text; the others are shown.
    """
    widgets = list(widgets)
    df = apply_filters(df, filters)
    plan = _Plan(df, model)
    apart, failed = [], []
    for w in widgets:
        try:
            if w.kpi is not None and w.kpi.aggregation == "percent_of_total":
                apart.append(_share(df, w))
            else:
                plan.add(w)
        except ValueError as reason:
            failed.append((w.id, 0, "error", None, None, str(reason)))
    parts = [*apart]
    if plan.shown:
        parts.append(plan.rows())
        cards = [(s.widget, s.metrics[0]) for s in plan.shown if s.kind == "trend" and s.metrics != ("count",)]
        if context is not None and cards:
            parts += _card_details(df, model, cards, context)
    if failed or not parts:
        parts.append(df.sparkSession.createDataFrame(
            failed, "widget_id string, position int, key string, metric_id string, value double, formatted_value string"))
    return reduce(DataFrame.unionByName, parts)


def _share(df: DataFrame, widget: Widget) -> DataFrame:
    """A custom KPI that is a share of the total."""
    rows = custom_kpi(df, widget.kpi)
    key, order = F.lit("value"), [F.lit(1)]
    if widget.kpi.dimension:
        key = F.col("dimension_value")
        order = [F.col("metric_value").desc_nulls_last(), key.asc()]
        if by_time(df, widget.kpi):
            order = [key.asc()]
    # At most `limit` rows, so ranking them in one partition is harmless.
    return rows.select(F.lit(widget.id).alias("widget_id"),
                       F.row_number().over(W.orderBy(*order)).alias("position"), key.alias("key"),
                       F.lit(widget.id).alias("metric_id"), F.col("metric_value").alias("value"), "formatted_value")


def _card_details(df: DataFrame, model: SemanticModel, cards: list[tuple[Widget, str]],
                  context: DataFrame) -> list[DataFrame]:
    """Headline and confidence of cards, one aggregate for each granularity in use."""
    parts = []
    for grain in dict.fromkeys(w.granularity for w, _ in cards):
        shown = [(w.id, m) for w, m in cards if w.granularity == grain]
        rows = metric_trends(df, model, dict.fromkeys(m for _, m in shown), context, grain)
        targets = F.explode(F.filter(F.array(*[
            F.struct(F.lit(i).alias("widget_id"), F.lit(m).alias("m")) for i, m in shown]),
            lambda t: t["m"] == F.col("metric_id")))
        cells = F.explode(F.array(
            F.struct(F.lit(15).alias("position"), F.lit("headline").alias("key"),
                     F.lit(None).cast("double").alias("value"), F.col("headline").alias("formatted_value")),
            F.struct(F.lit(16).alias("position"), F.lit("confidence").alias("key"),
                     F.col("confidence_score").alias("value"), F.col("confidence_label").alias("formatted_value"))))
        parts.append(rows.withColumn("t", targets).select("t.widget_id", "metric_id", cells.alias("c")).select(
            "widget_id", "c.position", "c.key", "metric_id", "c.value", "c.formatted_value"))
    return parts


@dataclass(frozen=True)
class _Shown:
    """A widget's use of a grouping set; ``name`` is the set's key, None for the whole data."""

    widget: Widget
    kind: str  # card, trend, series, groups; custom KPIs: single, custom
    name: str | None
    metrics: tuple[str, ...]
    in_order: bool = False  # groups by key rather than by value


class _Plan:
    """Grouping sets and measures that the widgets of a dashboard share."""

    def __init__(self, df: DataFrame, model: SemanticModel):
        self.df, self.model = df, model
        self.known = {**computable_metrics(model), "count": record_count()}
        self.date = resolve_column(df, model.date_column) if model.date_column else None
        self.keys: dict[str, Column] = {}
        self.shown: list[_Shown] = []
        self.customs: dict[str, tuple[KpiSpec, Column]] = {}

    def metrics(self, w: Widget) -> tuple[str, ...]:
        return tuple(m for m in dict.fromkeys(w.metrics) if m in self.known) or ("count",)

    def period(self, grain: str | None) -> str:
        name = f"_{grain or 'auto'}"
        if name not in self.keys:
            unit = choose_granularity(self.df, self.model, grain)
            self.keys[name] = period_start(F.col(quoted(self.date)), unit)
        return name

    def dimension(self, name: str) -> str:
        name = resolve_column(self.df, name)
        self.keys.setdefault(name, F.col(quoted(name)))
        return name

    def add(self, w: Widget) -> None:
        if w.kpi is not None:
            measure = custom_measure(self.df, w.kpi)
            name = self.dimension(w.kpi.dimension) if w.kpi.dimension else None
            self.customs[w.id] = (w.kpi, measure)
            self.shown.append(_Shown(w, "custom" if name else "single", name, (f"_kpi_{w.id}",),
                                     name is not None and by_time(self.df, w.kpi)))
        elif w.kind == "kpi_card":
            trend = self.period(w.granularity) if self.date else None
            self.shown.append(_Shown(w, "card", None, self.metrics(w)))
            if trend:
                self.shown.append(_Shown(w, "trend", trend, self.metrics(w)))
        elif w.kind in ("line_chart", "area_chart"):
            if self.date is None:
                raise ValueError(f"widget {w.id!r} needs a date column")
            self.shown.append(_Shown(w, "series", self.period(w.granularity), self.metrics(w)))
        else:
            if not (w.dimension or self.model.dimensions):
                raise ValueError(f"widget {w.id!r} needs a dimension")
            self.shown.append(_Shown(w, "groups", self.dimension(w.dimension or self.model.dimensions[0]),
                                     self.metrics(w)))

    def rows(self) -> DataFrame:
        keys, shown = self.keys, self.shown
        used = {m: self.known[m] for s in shown if s.widget.kpi is None for m in s.metrics}
        measures = [m.column() for m in used.values()]
        measures += [c.alias(f"_kpi_{i}") for i, (_, c) in self.customs.items()]
        base = self.df.withColumns({f"_k{n}": c for n, c in enumerate(keys.values())})
        slots = [F.col(f"_k{n}") for n in range(len(keys))]
        sets = [[s] for s in slots]
        if any(s.name is None for s in shown):
            sets.append([])
        grouped = base.groupingSets(sets, *slots).agg(F.grouping_id().alias("_gid"), *measures)
        ids = {name: sum(1 << (len(keys) - 1 - j) for j in range(len(keys)) if j != n) for n, name in enumerate(keys)}
        everything = (1 << len(keys)) - 1

        # Each aggregated row goes to every widget that shows its grouping set.
        targets = F.explode(F.filter(F.array(*[
            F.struct(F.lit(s.widget.id).alias("widget_id"), F.lit(s.kind).alias("part"), F.lit(n).alias("plan_no"),
                     F.lit(everything if s.name is None else ids[s.name]).cast("long").alias("gid"),
                     F.lit(s.widget.kpi.limit if s.widget.kpi else s.widget.limit).alias("most"),
                     F.lit(s.widget.id if s.widget.kpi else s.metrics[0]).alias("main"),
                     self._place(s).alias("place_value"), self._number(s).alias("main_value"))
            for n, s in enumerate(shown)]), lambda t: t["gid"] == F.col("_gid")))
        key = F.coalesce(*[F.when(F.col("_gid") == ids[name], F.col(f"_k{n}").cast("string"))
                           for n, name in enumerate(keys)]) if keys else F.lit(None).cast("string")
        part, value, age = F.col("t.part"), F.col("t.main_value"), F.col("age")
        timed, ranked = part.isin("trend", "series"), part.isin("groups", "custom")
        rows = (grouped.withColumn("key", key).withColumn("t", targets)
                .filter(~(timed | (part == "custom")) | F.col("key").isNotNull()))

        # A dimension may have very many groups: their rank is cut at a constant, which Spark
        # applies in every task before the shuffle. Periods are partitions of their own and all pass.
        best = W.partitionBy("t.plan_no", F.when(timed, F.col("key"))).orderBy(
            F.col("t.place_value").desc_nulls_last(), F.col("key").asc_nulls_last())
        most = max([s.widget.kpi.limit if s.widget.kpi else s.widget.limit
                    for s in shown if s.kind in ("groups", "custom")], default=1)
        rows = (rows.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= most)
                .filter(~ranked | (F.col("rank") <= F.col("t.most"))))
        # Left are the top groups and one row per period, for each widget.
        by_plan = W.partitionBy("t.plan_no")
        in_time = by_plan.orderBy(F.col("key").asc_nulls_last())
        rows = (rows.withColumn("place", F.row_number().over(in_time))
                .withColumn("age", F.row_number().over(by_plan.orderBy(F.col("key").desc_nulls_first())))
                .withColumn("prior", F.lag(F.coalesce(value, F.lit(0.0))).over(in_time))
                .withColumn("prior_key", F.lag("key").over(in_time))
                .withColumn("shown", F.least(F.lit(8), F.count(F.lit(1)).over(by_plan)).cast("int"))
                .filter((part != "trend") | (age <= 8)))

        def cell(position: Column, name: Column, metric: Column, number: Column, text: Column) -> Column:
            return F.struct(position.cast("int").alias("position"), name.alias("key"), metric.alias("metric_id"),
                            number.cast("double").alias("value"), text.cast("string").alias("formatted_value"))

        main, blank = F.col("t.main"), F.lit(None)
        position = F.when(ranked, F.col("rank")).otherwise(F.col("place"))
        name = F.when(part.isin("card", "single"), "value").otherwise(F.col("key"))
        wanted = {m: [s.widget.id for s in shown if s.widget.kpi is None and s.kind != "trend" and m in s.metrics]
                  for m in used}
        cells = [F.when((part != "trend") & F.col("t.widget_id").isin(wanted[m]),
                        cell(position, name, F.lit(m), F.col(quoted(m)), metric_text(F.col(quoted(m)), used[m].format)))
                 for m in used]
        for i, (spec, _) in self.customs.items():
            number = value if spec.dimension is None else F.coalesce(value, F.lit(0.0))
            cells.append(F.when(part.isin("single", "custom") & (F.col("t.widget_id") == i), cell(
                position, name, main, number, kpi_text(number, spec.text_style, spec.unit))))
        # A card's trend: the last values, and from the newest period its growth.
        spark_no = F.col("shown") - age + 1
        change = F.round(F.coalesce(value, F.lit(0.0)) - F.col("prior"), 2)
        growth = F.round(F.try_divide(change, F.col("prior")) * 100.0, 2)
        word = F.when(change > 0, "up").when(change < 0, "down").otherwise("flat")
        newest = (part == "trend") & (age == 1)
        cells += [
            F.when(part == "trend", cell(spark_no + 3, F.concat(F.lit("spark_"), spark_no.cast("string")), main, value,
                                         blank)),
            F.when(newest, cell(F.lit(2), F.lit("prior_value"), main, F.round("prior", 2), blank)),
            F.when(newest, cell(F.lit(3), F.lit("growth_percentage"), main, growth, blank)),
            F.when(newest, cell(F.lit(12), F.lit("trend"), main, blank, word)),
            F.when(newest, cell(F.lit(13), F.lit("current_period"), main, blank, F.col("key"))),
            F.when(newest, cell(F.lit(14), F.lit("prior_period"), main, blank,
                                F.coalesce(F.col("prior_key"), F.lit(""))))]
        return rows.select(F.col("t.widget_id").alias("widget_id"), F.explode(F.array_compact(F.array(*cells))).alias("c")
                           ).select("widget_id", "c.position", "c.key", "c.metric_id", "c.value", "c.formatted_value")

    def _number(self, s: _Shown) -> Column:
        column = F.col(quoted(s.metrics[0]))
        return custom_number(self.df, s.widget.kpi, column) if s.widget.kpi else column.cast("double")

    def _place(self, s: _Shown) -> Column:
        """What groups are ranked by, greatest first: their value, or a numeric key from below; other keys go as text."""
        if not s.in_order:
            return self._number(s)
        numeric = isinstance(self.df.schema[s.name].dataType, NumericType)
        return -F.col(f"_k{list(self.keys).index(s.name)}").cast("double") if numeric else F.lit(None).cast("double")


# -- P2 ---------------------------------------------------------------------------------------

def suggest_charts(df: DataFrame, dimensions: Iterable[str], with_table: bool = False,
                   chosen: str = "auto") -> DataFrame:
    """(dimension, distinct_count, chart, reason): line for time-like, pie for 2-5 values, else bar.

    ``with_table`` shows more than twenty values as a table and a single one as a pie. A
    ``chosen`` kind of chart is taken as it is; a word that names none counts as "auto".
    """
    dimensions = [resolve_column(df, d) for d in dimensions]
    cells = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(quoted(d)).cast("string").alias("v"))
                                for d in dimensions]))
    counts = (df.select(cells.alias("c")).select("c.*").distinct()
              .groupBy("dimension").agg(F.count("v").alias("distinct_count")))
    timed = [d for d in dimensions if is_time_like(df, d)]
    count = F.col("distinct_count")
    chart = F.when(F.col("dimension").isin(*timed) if timed else F.lit(False), "line_chart").when(
        count.between(1 if with_table else 2, 5), "pie_chart")
    if with_table:
        chart = chart.when(count > 20, "table")
    chart = chart.otherwise("bar_chart")
    # The sentences of the reasons.
    name = F.concat(F.lit("dimension '"), "dimension", F.lit("'"))
    reason = (F.when(chart == "line_chart", F.concat(
                  F.lit("Line chart ("), name, F.lit(" represents chronological progression)")))
              .when(chart == "pie_chart", F.concat(
                  F.lit("Donut/Pie chart ("), name, F.lit(" has low cardinality: "), count.cast("string"),
                  F.lit(" segments)")))
              .otherwise(F.concat(F.when(chart == "table", "Table").otherwise("Comparative Bar chart"), F.lit(" ("), name,
                                  F.lit(" has "), count.cast("string"), F.lit(" distinct categories)"))))
    if chosen in KINDS:
        chart, reason = F.lit(chosen), F.lit(f"User selected {chosen.replace('_', ' ')}")
    return counts.select("dimension", "distinct_count", chart.alias("chart"), reason.alias("reason"))


# -- P3 ---------------------------------------------------------------------------------------

# Order of the HR scorecard.
HR_ORDER = ("total_employees", "active_employees", "active_departments", "workforce_locations", "average_age",
            "average_salary", "turnover_rate", "average_tenure", "avg_performance_rating", "hires_over_time",
            "hire_rate")


def scorecard(df: DataFrame, model: SemanticModel, filters: Iterable[Filter] = (), most: int = 6) -> DataFrame:
    """First six KPIs with labels and formatted values; HR data uses a fixed order."""
    known = computable_metrics(model)
    names = [m for m in HR_ORDER if m in known] if model.domain == "human_resources" else list(known)
    return kpi_summary(df, model, filters, names[:most]).select(
        F.col("metric_order").alias("position"), "metric_id", "label", "formatted_value")
