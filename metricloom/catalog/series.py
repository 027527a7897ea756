"""Time series, growth, forecasts and anomalies."""

from __future__ import annotations

from pyspark.sql import functions as F

from metricloom.catalog.base import SALES_METRICS, over, query, rounded
from metricloom.model import Filter
from metricloom.operators import timeseries as ts
from metricloom.operators.anomaly import anomalies, explained_anomalies, root_causes
from metricloom.operators.forecast import forecast, forecast_summary
from metricloom.operators.quality import confidence_context, quality_warnings
from metricloom.operators.profile import duplicate_rows, profile
from metricloom.sources import views as V

M = SALES_METRICS
_AMOUNTS = ["order_date", "quantity", "sale_price"]


def _start(grain: str, column: str = "order_date") -> str:
    return f"strftime(date_trunc('{grain}', {column}), '%Y-%m-%d')"


_LABELS = {
    "day": "period_start", "week": "period_start", "month": "substr(period_start, 1, 7)",
    "quarter": "'Q' || ((CAST(substr(period_start, 6, 2) AS INTEGER) - 1) // 3 + 1) || ' ' || substr(period_start, 1, 4)",
    "year": "substr(period_start, 1, 4)",
}


def _series_query(grain: str) -> None:
    @query(f"timeseries_{grain}", over("sales", body=f"""
        WITH t AS (SELECT {_start(grain)} AS period_start, round({M['total_revenue']}, 2) AS total_revenue,
                          {M['total_orders']} AS total_orders
                   FROM sales WHERE order_date IS NOT NULL AND region <> 'AFRICA' GROUP BY 1)
        SELECT period_start, {_LABELS[grain]} AS period_label, total_revenue, total_orders FROM t"""))
    def _(spark, sf):
        df = V.sales(spark, sf, ["order_id", "region", *_AMOUNTS])
        rows = ts.timeseries(df, V.SALES_MODEL, ["total_revenue", "total_orders"], grain,
                             [Filter("region", "neq", "AFRICA")])
        return rounded(rows, total_revenue=2)


for _grain in ts.GRANULARITIES:
    _series_query(_grain)


@query("timeseries_auto_events", over("subscriptions", body=f"""
    WITH t AS (SELECT {_start('week', 'event_time')} AS period_start, round(sum(mrr), 2) AS total_mrr,
                      round(100.0 * avg(CASE WHEN churn = 'true' THEN 1.0 ELSE 0.0 END), 4) AS churn_rate
               FROM subscriptions WHERE event_time IS NOT NULL GROUP BY 1)
    SELECT period_start, period_start AS period_label, total_mrr, churn_rate FROM t"""))
def _(spark, sf):
    rows = ts.timeseries(V.subscriptions(spark, sf), V.SUBSCRIPTIONS_MODEL, ["total_mrr", "churn_rate"])
    return rounded(rows, total_mrr=2, churn_rate=4)


@query("timeseries_hires", over("workforce", body=f"""
    WITH t AS (SELECT {_start('year', 'hire_date')} AS period_start, CAST(count(*) AS DOUBLE) AS hires_over_time
               FROM workforce WHERE hire_date IS NOT NULL GROUP BY 1)
    SELECT period_start, substr(period_start, 1, 4) AS period_label, hires_over_time FROM t"""))
def _(spark, sf):
    return ts.timeseries(V.workforce(spark, sf), V.WORKFORCE_MODEL, ["hires_over_time"], "year")


_SPAN = """SELECT strftime(min({c}), '%Y-%m-%d') AS min_date, strftime(max({c}), '%Y-%m-%d') AS max_date,
    date_diff('day', min({c}), max({c})) AS d FROM {v} WHERE {c} IS NOT NULL"""
_GRAIN = """CASE WHEN d > 730 THEN 'quarter' WHEN d > 90 THEN 'month' WHEN d > 28 THEN 'week'
    WHEN d IS NOT NULL THEN 'day' ELSE 'month' END"""


@query("auto_granularity", over("sales", "subscriptions", body=f"""
    WITH s AS ({_SPAN.format(c='order_date', v='sales')} UNION ALL {_SPAN.format(c='event_time', v='subscriptions')})
    SELECT min_date, max_date, CAST(d AS INTEGER) AS span_days, {_GRAIN} AS granularity FROM s"""))
def _(spark, sf):
    return ts.auto_granularity(V.sales(spark, sf, ["order_date"]), V.SALES_MODEL).unionByName(
        ts.auto_granularity(V.subscriptions(spark, sf), V.SUBSCRIPTIONS_MODEL))


_TWO_MONTHLY = f"""
    WITH m AS (SELECT {_start('month')} AS p, {M['total_revenue']} AS total_revenue, {M['units_sold']} AS units_sold
               FROM sales WHERE order_date IS NOT NULL GROUP BY 1),
    l AS (SELECT 'total_revenue' AS metric_id, p, total_revenue AS v FROM m
          UNION ALL SELECT 'units_sold', p, units_sold FROM m),
    w AS (SELECT metric_id, p, v, lag(p) OVER (PARTITION BY metric_id ORDER BY p) AS pp,
                 lag(v) OVER (PARTITION BY metric_id ORDER BY p) AS pv,
                 row_number() OVER (PARTITION BY metric_id ORDER BY p DESC) AS age FROM l)"""


@query("growth_latest", over("sales", body=_TWO_MONTHLY + """
    SELECT metric_id, p AS current_period, pp AS prior_period, round(v, 2) AS current_value,
           round(pv, 2) AS prior_value, round(v - pv, 2) AS absolute_change,
           round(round(v - pv, 2) / nullif(pv, 0) * 100.0, 2) AS growth_percentage,
           CASE WHEN round(v - pv, 2) > 0 THEN 'up' WHEN round(v - pv, 2) < 0 THEN 'down' ELSE 'flat' END AS trend
    FROM w WHERE age = 1"""))
def _(spark, sf):
    series = ts.timeseries(V.sales(spark, sf, _AMOUNTS), V.SALES_MODEL, ["total_revenue", "units_sold"], "month")
    return ts.growth(series).drop("has_periods", "note")


@query("growth_single_period", over("sales", body=f"""
    WITH y AS (SELECT {_start('year')} AS p, {M['units_sold']} AS v FROM sales
               WHERE order_date BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31' GROUP BY 1)
    SELECT 'units_sold' AS metric_id, p AS current_period, '' AS prior_period, round(v, 2) AS current_value,
           0.0::DOUBLE AS prior_value, 0.0::DOUBLE AS absolute_change, CAST(NULL AS DOUBLE) AS growth_percentage,
           'flat' AS trend, '{ts.NO_HISTORY}' AS note FROM y"""))
def _(spark, sf):
    series = ts.timeseries(V.sales(spark, sf, ["order_date", "quantity"]), V.SALES_MODEL, ["units_sold"], "year",
                           [Filter("order_date", "between", ["1996-01-01", "1996-12-31"])])
    return ts.growth(series).drop("has_periods")


@query("sparkline_last8", over("sales", body=_TWO_MONTHLY + """
    SELECT metric_id, string_agg(format('{:.2f}', v), ' ' ORDER BY p) AS sparkline FROM w WHERE age <= 8
    GROUP BY metric_id"""))
def _(spark, sf):
    series = ts.timeseries(V.sales(spark, sf, _AMOUNTS), V.SALES_MODEL, ["total_revenue", "units_sold"], "month")
    text = F.transform("sparkline", lambda v: F.replace(F.format_number(v, 2), F.lit(","), F.lit("")))
    return ts.sparkline(series).select("metric_id", F.array_join(text, " ").alias("sparkline"))


# -- headline and confidence ------------------------------------------------------------------

_WINDOWS = f"""
    WITH b AS (SELECT quantile_cont(epoch(order_date) / 86400, 0.75) AS q3,
                      quantile_cont(epoch(order_date) / 86400, 0.25) AS q1
               FROM sales WHERE order_date IS NOT NULL),
    s AS (SELECT category AS segment,
                 coalesce(sum(CASE WHEN epoch(order_date) / 86400 >= q3 THEN quantity * sale_price END), 0) AS c,
                 coalesce(sum(CASE WHEN epoch(order_date) / 86400 < q3 AND epoch(order_date) / 86400 >= q1
                                   THEN quantity * sale_price END), 0) AS p
          FROM sales CROSS JOIN b WHERE order_date IS NOT NULL AND category IS NOT NULL GROUP BY category)"""


@query("segment_windows", over("sales", body=_WINDOWS + """
    SELECT segment, round(c, 2) AS curr_val, round(p, 2) AS prior_val,
           round((c - p) / nullif(p, 0) * 100.0, 1) AS pct_delta FROM s WHERE c <> 0 OR p <> 0"""))
def _(spark, sf):
    from metricloom.functions.metrics import computable_metrics
    rows = ts.segment_windows(V.sales(spark, sf, [*_AMOUNTS, "category"]), V.SALES_MODEL,
                              computable_metrics(V.SALES_MODEL)["total_revenue"], "category")
    return rounded(rows, curr_val=2, prior_val=2)


@query("headline_driver", over("sales", body=_WINDOWS + f""",
    r AS (SELECT segment, round((c - p) / nullif(p, 0) * 100.0, 1) AS pct,
                 row_number() OVER (ORDER BY abs(c - p) DESC, segment) AS k FROM s WHERE c <> 0 OR p <> 0),
    one AS (SELECT segment, pct FROM r WHERE k = 1),
    two AS (SELECT segment, pct FROM r WHERE k IN (2, 3) AND abs(pct) >= 1.0 ORDER BY k LIMIT 1),
    y AS (SELECT {_start('year')} AS p, {M['total_revenue']} AS v FROM sales GROUP BY 1),
    g AS (SELECT v, lag(v) OVER (ORDER BY p) AS pv, row_number() OVER (ORDER BY p DESC) AS age FROM y)
    SELECT 'total_revenue' AS metric_id, round(round(v - pv, 2) / pv * 100, 2) AS growth_percentage,
           CASE WHEN abs(round(round(v - pv, 2) / pv * 100, 2)) < 0.5
                THEN 'Total Revenue remained essentially flat versus the prior period.'
                ELSE 'Driven by a ' || CASE WHEN one.pct >= 0 THEN 'lift' ELSE 'decline' END || ' of '
                     || format('{{:.1f}}', abs(one.pct)) || '% in ' || one.segment
                     || coalesce((SELECT '; ' || segment || CASE WHEN pct >= 0 THEN ' up ' ELSE ' down ' END
                                         || format('{{:.1f}}', abs(pct)) || '%' FROM two), '') || '.' END AS headline
    FROM g CROSS JOIN one WHERE age = 1"""))
def _(spark, sf):
    return ts.headline(V.sales(spark, sf, [*_AMOUNTS, "category"]), V.SALES_MODEL, "total_revenue", "year")


@query("confidence_score", over("workforce", body="""
    WITH p AS (
        SELECT count(*) AS n,
               (100.0 * (count(*) - count(employee_id)) / count(*) + 100.0 * (count(*) - count(department)) / count(*)
              + 100.0 * (count(*) - count(salary)) / count(*) + 100.0 * (count(*) - count(city)) / count(*)
              + 100.0 * (count(*) - count(hire_date)) / count(*) + 100.0 * (count(*) - count(status)) / count(*)) / 6 AS nulls,
               CAST(min(salary) < 0 AS INTEGER)
                 + CAST(round(100.0 * (count(*) - count(hire_date)) / count(*), 2) >= 5 AS INTEGER) AS warnings,
               CAST(round(100.0 * (count(*) - count(hire_date)) / count(*), 2) > 50 AS INTEGER) AS criticals
        FROM workforce),
    s AS (SELECT n, warnings, criticals,
                 CASE WHEN n >= 10000 THEN 100.0 WHEN n >= 1000 THEN 85.0 WHEN n >= 200 THEN 70.0
                      WHEN n >= 50 THEN 50.0 WHEN n > 0 THEN 30.0 ELSE 0.0 END AS a,
                 CASE WHEN nulls <= 1 THEN 100.0 WHEN nulls <= 5 THEN 90.0 WHEN nulls <= 15 THEN 70.0
                      WHEN nulls <= 30 THEN 50.0 ELSE 25.0 END AS b,
                 greatest(0.0, 100.0 - 12.0 * warnings - 25.0 * criticals) AS c FROM p),
    t AS (SELECT *, round(a * 0.30 + b * 0.35 + c * 0.20 + 100.0 * 0.15, 1) AS score FROM s)
    SELECT n AS row_count, warnings, criticals, CAST(a AS DOUBLE) AS size_score, CAST(b AS DOUBLE) AS completeness_score,
           CAST(c AS DOUBLE) AS quality_score, CAST(score AS DOUBLE) AS confidence_score,
           CASE WHEN score >= 80 THEN 'High confidence' WHEN score >= 60 THEN 'Moderate confidence'
                WHEN score >= 40 THEN 'Limited confidence' ELSE 'Low confidence' END AS confidence_label FROM t"""))
def _(spark, sf):
    df = V.workforce(spark, sf)
    columns = profile(df)
    context = confidence_context(columns, quality_warnings(columns, duplicate_rows(df)))
    return ts.confidence(context.withColumn("has_periods", F.lit(True))).select(
        "row_count", "warnings", "criticals", "size_score", "completeness_score", "quality_score",
        "confidence_score", "confidence_label")


_DEPTH = """
    WITH v AS (SELECT order_id, order_date, quantity, sale_price, cost_price, category FROM sales),
    p AS (SELECT count(*) AS n,
                 (100.0 * (count(*) - count(order_id)) + 100.0 * (count(*) - count(order_date))
                + 100.0 * (count(*) - count(quantity)) + 100.0 * (count(*) - count(sale_price))
                + 100.0 * (count(*) - count(cost_price)) + 100.0 * (count(*) - count(category))) / count(*) / 6 AS nulls,
                 CAST((SELECT count(*) FROM (SELECT DISTINCT * FROM v)) < count(*) AS INTEGER) AS warnings FROM v),
    c AS (SELECT n, nulls, warnings, CASE WHEN n >= 10000 THEN 100.0 WHEN n >= 1000 THEN 85.0 WHEN n >= 200 THEN 70.0
                         WHEN n >= 50 THEN 50.0 WHEN n > 0 THEN 30.0 ELSE 0.0 END AS a,
                 CASE WHEN nulls <= 1 THEN 100.0 WHEN nulls <= 5 THEN 90.0 WHEN nulls <= 15 THEN 70.0
                      WHEN nulls <= 30 THEN 50.0 ELSE 25.0 END AS b, 100.0 - 12.0 * warnings AS q FROM p),"""
_DEPTH_COLUMNS = ["order_id", *_AMOUNTS, "cost_price", "category"]


@query("metric_trends", over("sales", body=_DEPTH + _WINDOWS.strip().removeprefix("WITH ") + f""",
    r AS (SELECT segment, round((c - p) / nullif(p, 0) * 100.0, 1) AS pct,
                 row_number() OVER (ORDER BY abs(c - p) DESC, segment) AS k FROM s WHERE c <> 0 OR p <> 0),
    one AS (SELECT segment, pct FROM r WHERE k = 1),
    two AS (SELECT segment, pct FROM r WHERE k IN (2, 3) AND abs(pct) >= 1.0 ORDER BY k LIMIT 1),
    y AS (SELECT {_start('quarter')} AS p, {M['total_revenue']} AS v, {M['profit_margin']} AS w FROM sales GROUP BY 1),
    l AS (SELECT 'total_revenue' AS metric_id, 'Total Revenue' AS label, p, v FROM y
          UNION ALL SELECT 'profit_margin', 'Profit Margin', p, w FROM y),
    g AS (SELECT *, lag(v) OVER (PARTITION BY metric_id ORDER BY p) AS pv,
                 lag(p) OVER (PARTITION BY metric_id ORDER BY p) AS pp,
                 row_number() OVER (PARTITION BY metric_id ORDER BY p DESC) AS age FROM l),
    h AS (SELECT *, round(v - pv, 2) AS d, round(round(v - pv, 2) / pv * 100, 2) AS pct FROM g WHERE age = 1),
    t AS (SELECT round(a * 0.30 + b * 0.35 + q * 0.20 + 15.0, 1) AS score FROM c)
    SELECT metric_id, p AS current_period, pp AS prior_period, round(v, 2) AS current_value,
           round(pv, 2) AS prior_value, d AS absolute_change, h.pct AS growth_percentage,
           CASE WHEN d > 0 THEN 'up' WHEN d < 0 THEN 'down' ELSE 'flat' END AS trend, true AS has_periods,
           CAST(NULL AS VARCHAR) AS note,
           CASE WHEN abs(h.pct) < 0.5 THEN label || ' remained essentially flat versus the prior period.'
                WHEN metric_id = 'total_revenue'
                THEN 'Driven by a ' || CASE WHEN one.pct >= 0 THEN 'lift' ELSE 'decline' END || ' of '
                     || format('{{:.1f}}', abs(one.pct)) || '% in ' || one.segment
                     || coalesce((SELECT '; ' || two.segment || CASE WHEN two.pct >= 0 THEN ' up ' ELSE ' down ' END
                                         || format('{{:.1f}}', abs(two.pct)) || '%' FROM two), '') || '.'
                END AS headline,
           CAST(score AS DOUBLE) AS confidence_score,
           CASE WHEN score >= 80 THEN 'High confidence' WHEN score >= 60 THEN 'Moderate confidence'
                WHEN score >= 40 THEN 'Limited confidence' ELSE 'Low confidence' END AS confidence_label
    FROM h CROSS JOIN one CROSS JOIN t"""))
def _(spark, sf):
    """Growth, headline and confidence of a sum and a ratio, by the automatic granularity."""
    df = V.sales(spark, sf, _DEPTH_COLUMNS)
    columns = profile(df)
    context = confidence_context(columns, quality_warnings(columns, duplicate_rows(df)))
    return ts.metric_trends(df, V.SALES_MODEL, ["total_revenue", "profit_margin"], context)


@query("confidence_factors", over("sales", body=_DEPTH.strip().rstrip(",") + """
    SELECT 1 AS factor, 'Sample size' AS label, CAST(a AS DOUBLE) AS score, format('{:,}', n) || ' rows' AS detail FROM c
    UNION ALL SELECT 2, 'Data completeness', CAST(b AS DOUBLE),
        CASE WHEN nulls = 0 THEN 'Complete' ELSE 'Avg ' || format('{:.1f}', nulls) || '% nulls' END FROM c
    UNION ALL SELECT 3, 'Data quality', CAST(q AS DOUBLE),
        CASE WHEN warnings = 0 THEN 'No warnings' ELSE warnings || ' warning(s)' END FROM c
    UNION ALL SELECT 4, 'Trend depth', 25.0::DOUBLE, 'Single period only' FROM c"""))
def _(spark, sf):
    df = V.sales(spark, sf, _DEPTH_COLUMNS)
    columns = profile(df)
    context = confidence_context(columns, quality_warnings(columns, duplicate_rows(df)))
    return ts.confidence_factors(context.withColumn("has_periods", F.lit(False))).select(
        "factor", "label", "score", "detail")


# -- forecasts --------------------------------------------------------------------------------

def _forecast_sql(grain: str, months: int, horizon: int, by: str | None, group_by: str | None = None) -> str:
    key, part = (f"{by}, ", f"PARTITION BY {by} ") if by else ("", "")
    join = lambda a: f"ON {a}.{by} IS NOT DISTINCT FROM f.{by}" if by else "ON TRUE"
    first, own, fit = (f"{group_by or by} AS {by}, ", f"f.{by}, ", f"GROUP BY f.{by}") if by else ("", "", "")
    group = f"GROUP BY {by}" if by else ""
    label = {"month": "strftime(d, '%Y-%m')", "quarter": "'Q' || quarter(d) || ' ' || year(d)"}[grain]
    return over("sales", body=f"""
        WITH h AS (SELECT {first}date_trunc('{grain}', order_date) AS p, {M['total_revenue']} AS y FROM sales
                   WHERE order_date IS NOT NULL GROUP BY ALL),
        x AS (SELECT *, row_number() OVER ({part}ORDER BY p) - 1 AS t FROM h),
        f AS (SELECT {key}count(*) AS n, regr_slope(y, t) AS b, regr_intercept(y, t) AS a, max(p) AS last_p,
                     arg_max(y, p) AS last_y FROM x {group}),
        e AS (SELECT {own}sqrt(sum((y - a - b * t) * (y - a - b * t)) / any_value(greatest(1, n - 2))) AS se
              FROM x JOIN f {join("x")} {fit}),
        s AS (SELECT f.*, se, step, greatest(0.0, a + b * (n - 1 + step)) AS yhat, se * sqrt(1 + step / n) AS w,
                     greatest(0.0, a + b * (n - 1 + {horizon})) AS final,
                     CAST(last_p AS DATE) + to_months(CAST({months} * step AS INTEGER)) AS d
              FROM f JOIN e {join("e")} CROSS JOIN (SELECT unnest(range(1, {horizon} + 1)) AS step))
        SELECT {key}CAST(step AS INTEGER) AS step, strftime(d, '%Y-%m-%d') AS period_start, {label} AS period_label,
               n AS history_periods, round(yhat, 2) AS predicted_value,
               round(greatest(0.0, yhat - 1.28 * w), 2) AS lower_80, round(yhat + 1.28 * w, 2) AS upper_80,
               round(greatest(0.0, yhat - 1.96 * w), 2) AS lower_95, round(yhat + 1.96 * w, 2) AS upper_95,
               round((final - last_y) / last_y * 100.0, 1) AS growth_projected_pct,
               CASE WHEN round((final - last_y) / last_y * 100.0, 1) > 0 THEN 'upward'
                    WHEN round((final - last_y) / last_y * 100.0, 1) < 0 THEN 'downward' ELSE 'stable' END AS direction
        FROM s""")


@query("forecast_total", _forecast_sql("quarter", 3, 4, None))
def _(spark, sf):
    return forecast(V.sales(spark, sf, _AMOUNTS), V.SALES_MODEL, "total_revenue", 4)


@query("forecast_by_region", _forecast_sql("month", 1, 3, "region"))
def _(spark, sf):
    df = V.sales(spark, sf, ["region", *_AMOUNTS])
    return forecast(df, V.SALES_MODEL, "total_revenue", 3, ["region"], "month")


@query("forecast_by_product", _forecast_sql("quarter", 3, 6, "product"))
def forecast_products(spark, sf):
    df = V.sales(spark, sf, ["product", *_AMOUNTS])
    return forecast(df, V.SALES_MODEL, "total_revenue", 6, ["product"], "quarter")


@query("forecast_null_segment", _forecast_sql("quarter", 3, 2, "region", "CASE WHEN region <> 'ASIA' THEN region END"))
def _(spark, sf):
    df = V.sales(spark, sf, ["region", *_AMOUNTS]).withColumn("region", F.when(F.col("region") != "ASIA",
                                                                               F.col("region")))
    return forecast(df, V.SALES_MODEL, "total_revenue", 2, ["region"], "quarter")


@query("forecast_sentence", "SELECT region, 'Forecast projects a ' || direction || ' trajectory with an estimated ' "
       "|| format('{:.1f}', abs(growth_projected_pct)) || '% shift over the next 3 periods reaching ~$' "
       "|| format('{:,.2f}', predicted_value) || '.' AS summary FROM ("
       + _forecast_sql("month", 1, 3, "region") + ") WHERE step = 3")
def _(spark, sf):
    df = V.sales(spark, sf, ["region", *_AMOUNTS])
    return forecast_summary(forecast(df, V.SALES_MODEL, "total_revenue", 3, ["region"], "month"), 3)


# -- anomalies --------------------------------------------------------------------------------

def _flagged_sql(grain: str, metrics: tuple[str, ...]) -> str:
    rows = " UNION ALL ".join(f"SELECT '{m}' AS metric_id, p, {m} AS v FROM h" for m in metrics)
    return f"""
    WITH h AS (SELECT {_start(grain)} AS p, {", ".join(f"{M[m]} AS {m}" for m in metrics)} FROM sales
               WHERE order_date IS NOT NULL GROUP BY 1),
    l AS ({rows}),
    w AS (SELECT *, lag(p) OVER m AS pp, lag(v) OVER m AS pv, avg(v) OVER (PARTITION BY metric_id) AS mean,
                 stddev_pop(v) OVER (PARTITION BY metric_id) AS sd FROM l
          WINDOW m AS (PARTITION BY metric_id ORDER BY p)),
    z AS (SELECT *, v - pv AS d, CASE WHEN pv > 0 THEN (v - pv) / pv * 100.0 ELSE 0.0 END AS pct,
                 abs(v - mean) / CASE WHEN sd > 0 THEN sd ELSE 1.0 END AS z FROM w WHERE pp IS NOT NULL),
    a AS (SELECT * FROM z WHERE abs(pct) >= 30 OR z >= 1.8)"""


_REPORT = """metric_id, p AS period, pp AS prior_period, round(v, 2) AS actual_value, round(mean, 2) AS expected_value,
    round(pct, 1) AS deviation_percentage, round(z, 2) AS z_score,
    CASE WHEN abs(pct) >= 50 OR z >= 2.5 THEN 'critical' ELSE 'warning' END AS severity,
    CASE WHEN d > 0 THEN 'spike' ELSE 'drop' END AS anomaly_type"""


@query("anomalies", over("sales", body=_flagged_sql("quarter", ("total_revenue", "units_sold"))
                         + f" SELECT {_REPORT} FROM a"))
def _(spark, sf):
    return anomalies(V.sales(spark, sf, _AMOUNTS), V.SALES_MODEL)


@query("anomalies_weekly", over("sales", body=_flagged_sql("week", ("total_revenue",)) + f" SELECT {_REPORT} FROM a"))
def _(spark, sf):
    return anomalies(V.sales(spark, sf, _AMOUNTS), V.SALES_MODEL, ["total_revenue"], "week")


_CAUSES = _flagged_sql("week", ("total_revenue",)) + f""",
    g AS (SELECT {_start('week')} AS p, region AS s, {M['total_revenue']} AS v FROM sales
          WHERE order_date IS NOT NULL GROUP BY 1, 2),
    k AS (SELECT a.p, a.d, g.s, 0.0 AS pr, g.v AS cu FROM a JOIN g ON g.p = a.p
          UNION ALL SELECT a.p, a.d, g.s, g.v, 0.0 FROM a JOIN g ON g.p = a.pp),
    c AS (SELECT p, s, sum(pr) AS pr, sum(cu) AS cu,
                 round(abs(sum(cu) - sum(pr)) / any_value(CASE WHEN d <> 0 THEN abs(d) ELSE 1.0 END) * 100.0, 1) AS share
          FROM k GROUP BY p, s)"""


@query("anomaly_root_causes", over("sales", body=_CAUSES + """
    SELECT 'total_revenue' AS metric_id, p AS period, 'region' AS dimension, s AS value, round(pr, 2) AS prior_value,
           round(cu, 2) AS current_value, round(cu - pr, 2) AS delta, least(100.0, share) AS contribution_percentage
    FROM c WHERE share >= 10"""))
def causes(spark, sf):
    df = V.sales(spark, sf, ["region", *_AMOUNTS])
    return root_causes(df, V.SALES_MODEL, "total_revenue", "week", "region")


@query("anomaly_explanations", over("sales", body=_CAUSES + f""",
    t AS (SELECT p, s, least(100.0, share) AS share, row_number() OVER (
              PARTITION BY p ORDER BY least(100.0, share) DESC, s) AS k FROM c WHERE share >= 10),
    n AS (SELECT a.*, t.s AS seg, t.share FROM a LEFT JOIN t ON a.p = t.p AND t.k = 1)
    SELECT {_REPORT},
           CASE WHEN seg IS NOT NULL THEN 'Metric ' || CASE WHEN d > 0 THEN 'increase' ELSE 'drop' END || ' of '
                || format('{{:.1f}}', abs(pct)) || '% in ' || substr(p, 1, 7) || ' was primarily driven by ''' || seg
                || ''' in region (' || format('{{:.1f}}', share) || '% contribution).'
                ELSE 'Total Revenue ' || CASE WHEN d > 0 THEN 'increased' ELSE 'decreased' END || ' by '
                || format('{{:.1f}}', abs(pct)) || '% evenly across segments.' END AS explanation FROM n"""))
def _(spark, sf):
    df = V.sales(spark, sf, ["region", *_AMOUNTS])
    return explained_anomalies(df, V.SALES_MODEL, "total_revenue", "week", "region")
