"""The four shapes an analytical question takes: trend, list, rank and single value."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricloom.functions.formats import period_label
from metricloom.functions.metrics import computable_metrics, record_count
from metricloom.model import Metric, SemanticModel
from metricloom.operators.aggregate import grouped_metrics, ordered
from metricloom.operators.filters import apply_filters, value_filters
from metricloom.operators.timeseries import period_metrics


def _metric(model: SemanticModel, metric: str) -> Metric:
    return computable_metrics(model).get(metric) or record_count()


def trend(df: DataFrame, model: SemanticModel, metric: str, values: Iterable[tuple[str, Any]] = ()) -> DataFrame:
    """A metric by month, oldest first: (month, metric)."""
    chosen = _metric(model, metric)
    rows = period_metrics(apply_filters(df, value_filters(values)), model, [chosen], "month").orderBy("period")
    return rows.select(period_label(F.col("period"), "month").alias("month"), chosen.id)


def listing(df: DataFrame, dimension: str, values: Iterable[tuple[str, Any]] = (), most: int = 15) -> DataFrame:
    """Values of a dimension with their row counts, most frequent first."""
    rows = grouped_metrics(apply_filters(df, value_filters(values)), dimension, [])
    return rows.orderBy(*ordered("_row_count", False)).limit(most).select(
        "dimension_value", F.col("_row_count").alias("row_count"))


def ranking(df: DataFrame, model: SemanticModel, metric: str, dimension: str,
            values: Iterable[tuple[str, Any]] = (), top: int = 5) -> DataFrame:
    """Best ``top`` groups of a dimension by a metric."""
    chosen = _metric(model, metric)
    rows = grouped_metrics(apply_filters(df, value_filters(values)), dimension, [chosen])
    return rows.orderBy(*ordered(chosen.id, False)).limit(top).select("dimension_value", chosen.id)


def scalar(df: DataFrame, model: SemanticModel, metric: str, values: Iterable[tuple[str, Any]] = ()) -> DataFrame:
    """A metric over the whole selection."""
    return apply_filters(df, value_filters(values)).agg(_metric(model, metric).column())
