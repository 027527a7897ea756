"""Anomalous periods of a metric and the segments behind them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from metricloom.functions.formats import plain_number
from metricloom.functions.metrics import computable_metrics
from metricloom.model import Filter, SemanticModel
from metricloom.operators.filters import apply_filters
from metricloom.operators.timeseries import choose_granularity, period_metrics, series_rows, timeseries


def _flagged(series: DataFrame, metrics: list[str]) -> DataFrame:
    """Raw anomalies of an aggregated series; windows hold one row per period."""
    by_metric = W.partitionBy("metric_id")
    in_time = by_metric.orderBy("period_start")
    spread = F.stddev_pop("value").over(by_metric)
    rows = (series_rows(series, metrics)
            .withColumn("value", F.coalesce("value", F.lit(0.0)))
            .withColumn("prior_value", F.lag("value").over(in_time))
            .withColumn("prior_period", F.lag("period_start").over(in_time))
            .withColumn("mean", F.avg("value").over(by_metric))
            .withColumn("spread", F.when(spread > 0, spread).otherwise(1.0))
            .withColumn("largest", F.max(F.abs("value")).over(by_metric))
            .filter(F.col("prior_period").isNotNull() & (F.col("largest") > 0)))
    delta = F.col("value") - F.col("prior_value")
    pct = F.when(F.col("prior_value") > 0, F.try_divide(delta, F.col("prior_value")) * 100.0).otherwise(0.0)
    rows = (rows.withColumn("delta", delta).withColumn("pct", pct)
            .withColumn("z", F.abs(F.col("value") - F.col("mean")) / F.col("spread")))
    return rows.filter((F.abs("pct") >= 30.0) | (F.col("z") >= 1.8))


def anomalies(df: DataFrame, model: SemanticModel, metrics: Iterable[str] | None = None,
              granularity: str | None = None, filters: Iterable[Filter] = ()) -> DataFrame:
    """Periods that moved by 30 % or more, or lie 1.8 standard deviations off the mean."""
    wanted = [m for m in (metrics or ("total_revenue", "units_sold")) if m in computable_metrics(model)]
    df = apply_filters(df, filters)
    series = timeseries(df, model, wanted, choose_granularity(df, model, granularity))
    return _report(_flagged(series, wanted))


def _report(rows: DataFrame, *extra) -> DataFrame:
    return rows.select(
        "metric_id", F.col("period_start").alias("period"), "prior_period",
        F.round("value", 2).alias("actual_value"), F.round("mean", 2).alias("expected_value"),
        F.round("pct", 1).alias("deviation_percentage"), F.round("z", 2).alias("z_score"),
        F.when((F.abs("pct") >= 50.0) | (F.col("z") >= 2.5), "critical").otherwise("warning").alias("severity"),
        F.when(F.col("delta") > 0, "spike").otherwise("drop").alias("anomaly_type"), *extra)


def _causes(df: DataFrame, model: SemanticModel, metric: str, granularity: str | Column,
            dimension: str) -> tuple[DataFrame, DataFrame]:
    chosen = computable_metrics(model)[metric]
    segments = (period_metrics(df, model, [chosen], granularity, [dimension])
                .select(F.col("period").cast("string").alias("side_period"),
                        F.col(dimension).cast("string").alias("segment"), F.col(metric).alias("amount"))
                # The join below implies this filter; stated here, both readers share one aggregate.
                .filter(F.col("side_period").isNotNull()))
    if chosen.row is not None:
        # A sum over all rows is the sum over the segments: the data is read once for both.
        series = segments.groupBy(F.col("side_period").alias("period_start")).agg(F.sum("amount").alias(metric))
    else:
        series = timeseries(df, model, [metric], granularity)
    flagged = _flagged(series, [metric])
    # Each anomaly looks at two periods; an equi-join on the period brings their segments.
    sides = F.explode(F.array(
        F.struct(F.col("period_start").alias("side_period"), F.lit(1).alias("is_current")),
        F.struct(F.col("prior_period").alias("side_period"), F.lit(0).alias("is_current"))))
    looked_at = flagged.select("period_start", "delta", "pct", sides.alias("s")).select(
        "period_start", "delta", "pct", "s.*")
    # `looked_at` has two rows per anomalous period, far fewer than calendar days.
    both = segments.join(F.broadcast(looked_at), "side_period").groupBy("period_start", "delta", "pct", "segment").agg(
        F.coalesce(F.sum(F.when(F.col("is_current") == 1, F.col("amount"))), F.lit(0.0)).alias("current"),
        F.coalesce(F.sum(F.when(F.col("is_current") == 0, F.col("amount"))), F.lit(0.0)).alias("prior"))
    change = F.col("current") - F.col("prior")
    whole = F.when(F.col("delta") != 0, F.abs("delta")).otherwise(1.0)
    share = F.round(F.abs(change) / whole * 100.0, 1)
    return flagged, (both.withColumn("change", change).withColumn("share", share)
                     .filter(F.col("share") >= 10.0))


def root_causes(df: DataFrame, model: SemanticModel, metric: str, granularity: str | None = None,
                dimension: str | None = None, filters: Iterable[Filter] = ()) -> DataFrame:
    """Segments that explain at least 10 % of each anomaly's change, for all anomalies in one job."""
    df = apply_filters(df, filters)
    granularity = choose_granularity(df, model, granularity)
    dimension = dimension or model.segment_column("category", "product")
    _, causes = _causes(df, model, metric, granularity, dimension)
    return causes.select(
        F.lit(metric).alias("metric_id"), F.col("period_start").alias("period"),
        F.lit(dimension).alias("dimension"), F.col("segment").alias("value"),
        F.round("prior", 2).alias("prior_value"), F.round("current", 2).alias("current_value"),
        F.round("change", 2).alias("delta"),
        F.least(F.lit(100.0), F.col("share")).alias("contribution_percentage"))


def explained_anomalies(df: DataFrame, model: SemanticModel, metric: str, granularity: str | None = None,
                        dimension: str | None = None, filters: Iterable[Filter] = ()) -> DataFrame:
    """Anomalies with a sentence naming the largest contributor, or saying the change was even."""
    df = apply_filters(df, filters)
    granularity = choose_granularity(df, model, granularity)
    dimension = dimension or model.segment_column("category", "product")
    flagged, causes = _causes(df, model, metric, granularity, dimension)
    # Contributions are capped at 100 before ranking; ties go by segment name.
    capped = F.least(F.lit(100.0), F.col("share"))
    main = causes.groupBy("period_start").agg(
        F.min(F.struct((-capped).alias("key"), F.col("segment"))).alias("main"))
    rows = flagged.join(main, "period_start", "left")
    size = plain_number(F.abs("pct"), 1)
    label = metric.replace("_", " ").title()
    # The sentences of the explanation.
    text = F.when(F.col("main").isNotNull(), F.concat(
        F.lit("Metric "), F.when(F.col("delta") > 0, "increase").otherwise("drop"), F.lit(" of "), size,
        F.lit("% in "), F.substring("period_start", 1, 7), F.lit(" was primarily driven by '"),
        F.col("main.segment"), F.lit(f"' in {dimension} ("), plain_number(-F.col("main.key"), 1),
        F.lit("% contribution)."))).otherwise(F.concat(
            F.lit(f"{label} "), F.when(F.col("delta") > 0, "increased").otherwise("decreased"),
            F.lit(" by "), size, F.lit("% evenly across segments.")))
    return _report(rows, text.alias("explanation"))
