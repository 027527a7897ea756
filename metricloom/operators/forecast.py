"""Linear-trend forecasts with confidence bands, for one series or one per segment."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from metricloom.functions.formats import period_label, plain_number
from metricloom.functions.metrics import computable_metrics
from metricloom.model import Filter, SemanticModel
from metricloom.operators.filters import apply_filters
from metricloom.operators.timeseries import choose_granularity, period_metrics

_STEP_MONTHS = {"month": 1, "quarter": 3, "year": 12}
_STEP_DAYS = {"day": 1, "week": 7}


def _ahead(start: Column, steps: Column, granularity: str | Column) -> Column:
    """The start of the period some steps after another's."""
    def moved(unit: str) -> Column:
        if unit in _STEP_DAYS:
            return F.date_add(start, (steps * _STEP_DAYS[unit]).cast("int"))
        return F.add_months(start, (steps * _STEP_MONTHS[unit]).cast("int"))

    if isinstance(granularity, str):
        return moved(granularity)
    return F.coalesce(*[F.when(granularity == unit, moved(unit)) for unit in (*_STEP_DAYS, *_STEP_MONTHS)])


def trend(series: DataFrame, metric: str, by: Iterable[str] = ()) -> DataFrame:
    """Least-squares line per series over the period index 0..n-1.

    Columns: by..., n, slope, intercept, std_err, last_period, last_value.
    ``series`` has (period, by..., metric), one row per period.
    """
    by = list(by)
    index = F.row_number().over(W.partitionBy(*by).orderBy("period")) - 1
    points = (series.withColumn("t", index.cast("double"))
              .withColumn("y", F.coalesce(F.col(metric), F.lit(0.0))))
    # Residual sum of squares in closed form, from centred sums of one aggregate.
    fit = points.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope("y", "t").alias("raw_slope"),
        F.regr_intercept("y", "t").alias("raw_intercept"), F.avg("y").alias("mean"),
        F.regr_syy("y", "t").alias("syy"), F.regr_sxy("y", "t").alias("sxy"), F.regr_sxx("y", "t").alias("sxx"),
        F.max_by("y", "period").alias("last_value"), F.max("period").alias("last_period"))
    fit = (fit.withColumn("slope", F.when(F.col("n") >= 2, F.col("raw_slope")).otherwise(0.0))
           .withColumn("intercept", F.when(F.col("n") >= 2, F.col("raw_intercept")).otherwise(F.col("last_value"))))
    left = F.when(F.col("n") >= 2, F.col("syy") - F.try_divide(F.col("sxy") * F.col("sxy"), F.col("sxx"))).otherwise(0.0)
    variance = F.greatest(left, F.lit(0.0)) / F.greatest(F.lit(1), F.col("n") - 2)
    # An exact fit leaves only float noise, which counts as zero residual.
    noise = F.greatest(F.col("mean") * F.col("mean") * 1e-18, F.col("syy") * 1e-12)
    tenth = F.col("mean") * 0.1
    std_err = (F.when(F.col("n") < 2, F.col("intercept") * 0.15)
               .when(variance > noise, F.sqrt(variance))
               .when(tenth != 0, tenth).otherwise(10.0))
    return fit.filter("n > 0").select(*by, "n", "slope", "intercept", std_err.alias("std_err"), "last_period", "last_value")


def forecast(df: DataFrame, model: SemanticModel, metric: str, horizon: int = 3,
             by: Iterable[str] = (), granularity: str | None = None,
             filters: Iterable[Filter] = ()) -> DataFrame:
    """Predictions with 80 % and 95 % bands, ``horizon`` periods ahead, a series per ``by`` group.

    Labels advance by the granularity of the history.
    """
    if not 1 <= horizon <= 24:
        raise ValueError("horizon must be between 1 and 24")
    by = list(by)
    df = apply_filters(df, filters)
    granularity = choose_granularity(df, model, granularity)
    series = period_metrics(df, model, [computable_metrics(model)[metric]], granularity, by)
    lines = trend(series, metric, by)
    steps = lines.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    raw = F.col("intercept") + F.col("slope") * (F.col("n") - 1 + F.col("step"))
    predicted = F.greatest(F.lit(0.0), raw)
    band = F.col("std_err") * F.sqrt(1 + F.col("step") / F.greatest(F.lit(1), F.col("n")))
    period = _ahead(F.col("last_period"), F.col("step"), granularity)
    base = F.when(F.col("last_value") > 0, F.col("last_value")).otherwise(1.0)
    final = F.greatest(F.lit(0.0), F.col("intercept") + F.col("slope") * (F.col("n") - 1 + horizon))
    change = F.round((final - base) / base * 100.0, 1)
    return steps.select(
        *by, "step", period.cast("string").alias("period_start"),
        period_label(period, granularity).alias("period_label"), F.col("n").alias("history_periods"),
        F.round(predicted, 2).alias("predicted_value"),
        F.round(F.greatest(F.lit(0.0), predicted - 1.28 * band), 2).alias("lower_80"),
        F.round(predicted + 1.28 * band, 2).alias("upper_80"),
        F.round(F.greatest(F.lit(0.0), predicted - 1.96 * band), 2).alias("lower_95"),
        F.round(predicted + 1.96 * band, 2).alias("upper_95"),
        change.alias("growth_projected_pct"),
        F.when(change > 0, "upward").when(change < 0, "downward").otherwise("stable").alias("direction"))


def forecast_summary(rows: DataFrame, horizon: int) -> DataFrame:
    """One sentence per series from the last forecast step."""
    keys = [c for c in rows.columns[:rows.columns.index("step")]]
    last = rows.filter(F.col("step") == horizon)
    text = F.concat(F.lit("Forecast projects a "), F.col("direction"), F.lit(" trajectory with an estimated "),
                    plain_number(F.abs("growth_projected_pct"), 1),
                    F.lit(f"% shift over the next {horizon} periods reaching ~$"),
                    F.format_number("predicted_value", 2), F.lit("."))
    return last.select(*keys, text.alias("summary"))
