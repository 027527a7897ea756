"""Time series: period aggregates, growth, sparklines, headline drivers and confidence."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from metricloom.functions.formats import period_label, period_start, plain_number
from metricloom.functions.metrics import computable_metrics, pick_metrics
from metricloom.model import Filter, Metric, SemanticModel, quoted, resolve_column
from metricloom.operators.filters import apply_filters

GRANULARITIES = ("day", "week", "month", "quarter", "year")


def _date_column(df: DataFrame, model: SemanticModel) -> str:
    if not model.date_column:
        raise ValueError("no date column in the semantic model")
    return resolve_column(df, model.date_column)


# -- F2 ---------------------------------------------------------------------------------------

def granularity_from_span(days: Column) -> Column:
    return (F.when(days > 730, "quarter").when(days > 90, "month").when(days > 28, "week")
            .when(days.isNotNull(), "day").otherwise("month"))


def auto_granularity(df: DataFrame, model: SemanticModel) -> DataFrame:
    """One row (min_date, max_date, span_days, granularity) from the span of the date column."""
    day = F.col(quoted(_date_column(df, model))).cast("date")
    span = df.agg(F.min(day).alias("low"), F.max(day).alias("high"))
    days = F.date_diff("high", "low")
    return span.select(F.col("low").cast("string").alias("min_date"),
                       F.col("high").cast("string").alias("max_date"),
                       days.alias("span_days"), granularity_from_span(days).alias("granularity"))


def choose_granularity(df: DataFrame, model: SemanticModel, granularity: str | Column | None) -> str | Column:
    """The given granularity, else the automatic one as a scalar subquery: nothing runs while a plan is built."""
    if granularity is None:
        return auto_granularity(df, model).select("granularity").scalar()
    if not isinstance(granularity, Column) and granularity not in GRANULARITIES:
        raise ValueError(f"granularity must be one of {GRANULARITIES}")
    return granularity


# -- F1, F3 -----------------------------------------------------------------------------------

def period_metrics(df: DataFrame, model: SemanticModel, metrics: Iterable[Metric], granularity: str | Column,
                   by: Iterable[str] = ()) -> DataFrame:
    """Unordered (period date, by..., metrics...) with null dates left out."""
    date = F.col(quoted(_date_column(df, model)))
    keys = [F.col(quoted(resolve_column(df, c))).alias(c) for c in by]
    # Null dates go by a condition on the groups: rows are read unfiltered, and so shared with other readers of them.
    return (df.groupBy(period_start(date, granularity).alias("period"), *keys)
            .agg(*[m.column() for m in metrics], F.count(date).alias("_dated"))
            .filter(F.col("_dated") > 0).drop("_dated"))


def timeseries(df: DataFrame, model: SemanticModel, metrics: Iterable[str] = (),
               granularity: str | Column | None = None, filters: Iterable[Filter] = ()) -> DataFrame:
    """(period_start, period_label, metric columns), oldest first. Gaps are not filled."""
    df = apply_filters(df, filters)
    granularity = choose_granularity(df, model, granularity)
    chosen = pick_metrics(model, metrics, default=2)
    rows = period_metrics(df, model, chosen, granularity).orderBy("period")
    return rows.select(F.col("period").cast("string").alias("period_start"),
                       period_label(F.col("period"), granularity).alias("period_label"),
                       *[quoted(m.id) for m in chosen])


def series_rows(series: DataFrame, metrics: Iterable[str]) -> DataFrame:
    """A wide series as rows (metric_id, period_start, value)."""
    cells = F.explode(F.array(*[F.struct(F.lit(m).alias("metric_id"), F.col(quoted(m)).alias("value"))
                                for m in metrics]))
    return series.select("period_start", cells.alias("c")).select("c.metric_id", "period_start", "c.value")


def metric_names(series: DataFrame) -> list[str]:
    return [c for c in series.columns if c not in ("period_start", "period_label")]


# -- F4, F5, D7 -------------------------------------------------------------------------------

# The note for a single period.
NO_HISTORY = "Insufficient history for trend comparison — at least 2 periods of data are required."


def growth(series: DataFrame) -> DataFrame:
    """Latest present period against the one before it, a row per metric.

    Works on the aggregated series, so its windows hold one row per period.
    """
    value = F.coalesce(F.col("value"), F.lit(0.0))
    by_metric = W.partitionBy("metric_id")
    oldest_first = by_metric.orderBy("period_start")
    rows = (series_rows(series, metric_names(series)).withColumn("value", value)
            .withColumn("prior_period", F.lag("period_start").over(oldest_first))
            .withColumn("prior_value", F.lag("value").over(oldest_first))
            .withColumn("age", F.row_number().over(by_metric.orderBy(F.col("period_start").desc())))
            .filter(F.col("age") == 1))
    single = F.col("prior_period").isNull()
    change = F.round(F.col("value") - F.col("prior_value"), 2)
    pct = F.round(F.try_divide(change, F.col("prior_value")) * 100.0, 2)
    return rows.select(
        "metric_id", F.col("period_start").alias("current_period"),
        F.coalesce("prior_period", F.lit("")).alias("prior_period"),
        F.round("value", 2).alias("current_value"),
        F.round(F.coalesce("prior_value", F.lit(0.0)), 2).alias("prior_value"),
        F.coalesce(change, F.lit(0.0)).alias("absolute_change"),
        F.when(~single, pct).alias("growth_percentage"),
        F.when(change > 0, "up").when(change < 0, "down").otherwise("flat").alias("trend"),
        (~single).alias("has_periods"), F.when(single, NO_HISTORY).alias("note"))


# -- D8 ---------------------------------------------------------------------------------------

def sparkline(series: DataFrame, points: int = 8) -> DataFrame:
    """Last points of each metric as an array, oldest first."""
    newest = W.partitionBy("metric_id").orderBy(F.col("period_start").desc())
    rows = (series_rows(series, metric_names(series))
            .withColumn("age", F.row_number().over(newest)).filter(F.col("age") <= points))
    ordered = F.array_sort(F.collect_list(F.struct("period_start", "value")))
    return rows.groupBy("metric_id").agg(F.transform(ordered, lambda p: p["value"]).alias("sparkline"))


# -- F7 ---------------------------------------------------------------------------------------

def _daily_amounts(df: DataFrame, model: SemanticModel, metrics: Iterable[Metric], segment: str) -> DataFrame:
    """(day, segment, rows, a column for each metric) of metrics that are plain sums.

    The condition on the groups, which holds for all that have a day, names every column: readers that need only some
    then ask for the same aggregate, and Spark runs it once.
    """
    day = F.col(quoted(_date_column(df, model))).cast("date")
    name = F.col(quoted(resolve_column(df, segment)))
    sums = [F.sum(m.row()).cast("double").alias(m.id) for m in metrics]
    used = reduce(Column.__or__, [F.col(quoted(m.id)).isNotNull() for m in metrics], F.col("rows") >= 0)
    return (df.groupBy(day.alias("day"), name.cast("string").alias("segment"))
            .agg(F.count(F.lit(1)).alias("rows"), F.count(day).alias("_dated"), *sums)
            .filter((F.col("_dated") > 0) & used).drop("_dated"))


def _segment_sides(daily: DataFrame, metrics: list[str]) -> DataFrame:
    """(metric_id, segment, curr_val, prior_val, pct_delta) from daily sums.

    The quartiles come from the counts per day, of which there are only as many as
    calendar days, so `percentile` is safe here.
    """
    numbered = daily.withColumn("day_no", F.unix_date("day"))
    bounds = (numbered.groupBy("day_no").agg(F.sum("rows").alias("rows"))
              .agg(F.percentile("day_no", [0.25, 0.75], F.col("rows")).alias("q")))
    marked = numbered.crossJoin(F.broadcast(bounds))  # a single row
    # Rows without a segment add to neither side, and the last filter drops them.
    named = F.col("segment").isNotNull()
    current = named & (F.col("day_no") >= F.col("q")[1])
    prior = named & (F.col("day_no") < F.col("q")[1]) & (F.col("day_no") >= F.col("q")[0])

    def side(test: Column, metric: str) -> Column:
        return F.coalesce(F.sum(F.when(test, F.col(quoted(metric)))), F.lit(0.0))

    sums = marked.groupBy("segment").agg(*[
        F.struct(F.lit(m).alias("metric_id"), side(current, m).alias("curr_val"), side(prior, m).alias("prior_val"))
        .alias(f"s{i}") for i, m in enumerate(metrics)])
    rows = sums.select("segment", F.explode(F.array(*[f"s{i}" for i in range(len(metrics))])).alias("s")).select(
        "s.metric_id", "segment", "s.curr_val", "s.prior_val")
    change = F.col("curr_val") - F.col("prior_val")
    pct = F.round(F.try_divide(change, F.col("prior_val")) * 100.0, 1)
    return rows.filter((F.col("curr_val") != 0) | (F.col("prior_val") != 0)).withColumn("pct_delta", pct)


def segment_windows(df: DataFrame, model: SemanticModel, metric: Metric, segment: str) -> DataFrame:
    """(segment, curr_val, prior_val, pct_delta): dates from Q3 on against dates in [Q1, Q3).

    Rows are summed by (day, segment) first.
    """
    return _segment_sides(_daily_amounts(df, model, [metric], segment), [metric.id]).drop("metric_id")


def _drivers(daily: DataFrame, metrics: list[str]) -> DataFrame:
    """(metric_id, driver): which segments changed most, as a sentence."""
    move = F.abs(F.col("curr_val") - F.col("prior_val"))
    largest = W.partitionBy("metric_id").orderBy(move.desc(), F.col("segment").asc())
    top = _segment_sides(daily, metrics).withColumn("place", F.row_number().over(largest)).filter("place <= 3")
    listed = top.groupBy("metric_id").agg(F.array_sort(F.collect_list(F.struct("place", "segment", "pct_delta")))
                                          .alias("top"))  # three segments a metric
    first = F.get("top", F.lit(0))
    others = F.filter(F.slice("top", 2, 2), lambda s: s["pct_delta"].isNotNull() & (F.abs(s["pct_delta"]) >= 1.0))
    second = F.get(others, F.lit(0))
    # The sentence of a driver.
    clause = F.when(second.isNotNull(), F.concat(
        F.lit("; "), second["segment"],
        F.when(second["pct_delta"] >= 0, F.lit(" up ")).otherwise(F.lit(" down ")),
        plain_number(F.abs(second["pct_delta"]), 1), F.lit("%"))).otherwise(F.lit(""))
    driver = F.when(first["pct_delta"].isNotNull(), F.concat(
        F.lit("Driven by a "), F.when(first["pct_delta"] >= 0, F.lit("lift")).otherwise(F.lit("decline")),
        F.lit(" of "), plain_number(F.abs(first["pct_delta"]), 1), F.lit("% in "), first["segment"],
        clause, F.lit(".")))
    return listed.select("metric_id", driver.alias("driver"))


def headlines(df: DataFrame, model: SemanticModel, metric_ids: Iterable[str], granularity: str | None = None,
              filters: Iterable[Filter] = ()) -> DataFrame:
    """The columns of ``growth`` and a headline, a row per metric: which segment drove the latest change.

    Metrics that are plain sums share one aggregate by day and segment: their series, the
    segment windows and an automatic granularity all come from it. The others share one
    series; their headline, as that of a model without a segment column, only tells a
    flat or missing trend. Without any dated row there is no row.
    """
    df, unit = apply_filters(df, filters), None
    known = computable_metrics(model)
    wanted = [known[m] for m in dict.fromkeys(metric_ids)]
    segment = model.segment_column("category", "product", "department")
    sums = [m for m in wanted if segment is not None and m.row is not None]
    others = [m.id for m in wanted if m not in sums]
    parts = []
    if sums:
        ids = [m.id for m in sums]
        daily = _daily_amounts(df, model, sums, segment)
        if granularity is None:
            span = daily.agg(F.date_diff(F.max("day"), F.min("day")).alias("days"))
            unit = span.select(granularity_from_span(F.col("days"))).scalar()
        else:
            unit = choose_granularity(df, model, granularity)
        start = period_start(F.col("day"), unit).cast("string")
        series = (daily.withColumn("period_start", start).groupBy("period_start")
                  .agg(*[F.sum(quoted(m)).alias(m) for m in ids]))
        # A handful of rows on either side: one for each metric.
        parts.append(growth(series).join(F.broadcast(_drivers(daily, ids)), "metric_id", "left"))
    if others:
        series = timeseries(df, model, others, choose_granularity(df, model, granularity) if unit is None else unit)
        parts.append(growth(series).withColumn("driver", F.lit(None).cast("string")))
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    name = F.lit(None).cast("string")
    for m in wanted:
        name = F.when(F.col("metric_id") == m.id, m.label).otherwise(name)
    # The sentence of a flat trend.
    flat = F.concat(name, F.lit(" remained essentially flat versus the prior period."))
    is_flat = F.col("growth_percentage").isNull() | (F.abs("growth_percentage") < 0.5)
    text = F.when(F.col("note").isNotNull(), F.col("note")).when(is_flat, flat).otherwise(F.col("driver"))
    return rows.withColumn("headline", text).drop("driver")


def headline(df: DataFrame, model: SemanticModel, metric_id: str, granularity: str | None = None,
             filters: Iterable[Filter] = ()) -> DataFrame:
    """One row (metric_id, growth_percentage, headline): which segment drove the latest change."""
    return headlines(df, model, [metric_id], granularity, filters).select("metric_id", "growth_percentage", "headline")


def metric_trends(df: DataFrame, model: SemanticModel, metric_ids: Iterable[str], context: DataFrame,
                  granularity: str | None = None, filters: Iterable[Filter] = ()) -> DataFrame:
    """Growth, headline, confidence_score and confidence_label of several metrics, a row per metric.

    ``context`` is the single row of ``confidence_context``; the trend depth is each metric's own.
    """
    rows = headlines(df, model, metric_ids, granularity, filters)
    scored = confidence(rows.crossJoin(F.broadcast(context)))  # a single row
    return scored.select(*rows.columns, "confidence_score", "confidence_label")


# -- F6 ---------------------------------------------------------------------------------------

def confidence(context: DataFrame) -> DataFrame:
    """Adds confidence scores to rows with row_count, avg_null_percentage, warnings, criticals, has_periods.

    Weights: sample size 30 %, completeness 35 %, warnings 20 %, trend depth 15 %.
    """
    rows, nulls = F.coalesce("row_count", F.lit(0)), F.coalesce("avg_null_percentage", F.lit(0.0))
    warnings, criticals = F.coalesce("warnings", F.lit(0)), F.coalesce("criticals", F.lit(0))
    size = (F.when(rows >= 10_000, 100.0).when(rows >= 1_000, 85.0).when(rows >= 200, 70.0)
            .when(rows >= 50, 50.0).when(rows > 0, 30.0).otherwise(0.0))
    complete = (F.when(nulls <= 1, 100.0).when(nulls <= 5, 90.0).when(nulls <= 15, 70.0)
                .when(nulls <= 30, 50.0).otherwise(25.0))
    quality = F.greatest(F.lit(0.0), F.lit(100.0) - warnings * 12.0 - criticals * 25.0)
    depth = F.when(F.coalesce("has_periods", F.lit(True)), 100.0).otherwise(25.0)
    scored = (context.withColumn("size_score", size).withColumn("completeness_score", complete)
              .withColumn("quality_score", quality).withColumn("depth_score", depth))
    weighted = (F.col("size_score") * 0.30 + F.col("completeness_score") * 0.35
                + F.col("quality_score") * 0.20 + F.col("depth_score") * 0.15)
    score = F.round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), weighted)), 1)
    # The bounds and labels of the score.
    return (scored.withColumn("confidence_score", score)
            .withColumn("confidence_label",
                        F.when(F.col("confidence_score") >= 80, "High confidence")
                        .when(F.col("confidence_score") >= 60, "Moderate confidence")
                        .when(F.col("confidence_score") >= 40, "Limited confidence")
                        .otherwise("Low confidence")))


def confidence_factors(context: DataFrame) -> DataFrame:
    """The four factors behind a confidence score: the columns of ``context`` and (factor, label, score, detail)."""
    scored = confidence(context)
    rows, nulls = F.coalesce("row_count", F.lit(0)), F.coalesce("avg_null_percentage", F.lit(0.0))
    warnings = F.coalesce("warnings", F.lit(0))
    # Names and details of the factors.
    factors = (
        ("Sample size", "size_score", F.when(rows == 0, "No data").otherwise(
            F.concat(F.format_number(rows, 0), F.lit(" rows")))),
        ("Data completeness", "completeness_score", F.when(nulls == 0, "Complete").otherwise(
            F.concat(F.lit("Avg "), plain_number(nulls, 1), F.lit("% nulls")))),
        ("Data quality", "quality_score", F.when(warnings == 0, "No warnings").otherwise(
            F.concat(warnings.cast("string"), F.lit(" warning(s)")))),
        ("Trend depth", "depth_score", F.when(F.coalesce("has_periods", F.lit(True)), "Multi-period history")
         .otherwise("Single period only")))
    cells = F.explode(F.array(*[
        F.struct(F.lit(n).alias("factor"), F.lit(label).alias("label"), F.col(score).alias("score"),
                 detail.alias("detail")) for n, (label, score, detail) in enumerate(factors, 1)]))
    return scored.select(*context.columns, cells.alias("f")).select(*context.columns, "f.*")
