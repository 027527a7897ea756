"""KPI summaries, filters, custom KPIs, formulas, comparisons and what-if."""

from __future__ import annotations

from pyspark.sql import functions as F

from metricloom.catalog.base import SALES_FORMATS, SALES_METRICS, metric_rows, over, query, rounded
from metricloom.functions.formats import compact_text, hinted_text, kpi_text, name_tokens, spaced_words
from metricloom.functions.formulas import formula_metric
from metricloom.model import Filter, SemanticModel
from metricloom.operators.aggregate import (
    Condition, KpiSpec, compare, custom_kpi, hero_stats, kpi_sparkline, kpi_summary, what_if)
from metricloom.operators.filters import apply_filters, equality_filters, value_filters
from metricloom.plans.dashboard import scorecard
from metricloom.sources import views as V
from metricloom.sources.files import schema_rows


def _summary(df):
    return rounded(df.select("metric_id", "value", "formatted_value"), value=2)


@query("kpi_summary_sales", metric_rows("sales", SALES_METRICS, SALES_FORMATS))
def _(spark, sf):
    columns = ["order_id", "quantity", "sale_price", "cost_price", "discount", "product"]
    return _summary(kpi_summary(V.sales(spark, sf, columns), V.SALES_MODEL))


@query("kpi_summary_filtered", metric_rows(
    "sales", SALES_METRICS, SALES_FORMATS,
    "WHERE region IN ('ASIA', 'EUROPE') AND order_date >= DATE '1997-01-01' AND quantity > 10"))
def _(spark, sf):
    wanted = [Filter("Region", "in", ["ASIA", "EUROPE"]), Filter("order_date", "gte", "1997-01-01"),
              Filter("quantity", "gt", 10)]
    return _summary(kpi_summary(V.sales(spark, sf), V.SALES_MODEL, wanted))


_HR = {
    "total_orders": ("count(*)", "{:,.0f}"),
    "total_employees": ("count(*)", "{:,.0f}"),
    "hires_over_time": ("count(*)", "{:,.0f}"),
    "hire_rate": ("100.0 * count(hire_date) / nullif(count(*), 0)", "{:.2f}%"),
    "active_employees": ("sum(CASE WHEN status = 'active' THEN 1 ELSE 0 END)", "{:,.0f}"),
    "turnover_rate": ("100.0 * avg(CASE WHEN status = 'inactive' THEN 1.0 ELSE 0.0 END)", "{:.2f}%"),
    "active_departments": ("count(DISTINCT department)", "{:,.0f}"),
    "workforce_locations": ("count(DISTINCT city)", "{:,.0f}"),
    "average_salary": ("avg(salary)", "${:,.2f}"),
}
_SAAS = {
    "total_orders": ("count(*)", "{:,.0f}"), "total_users": ("count(*)", "{:,.0f}"), "total_mrr": ("sum(mrr)", "${:,.2f}"),
    "active_plans": ("count(DISTINCT plan)", "{:,.0f}"),
    "churn_rate": ("100.0 * avg(CASE WHEN churn = 'true' THEN 1.0 ELSE 0.0 END)", "{:.2f}%"),
}
_LOGISTICS = {
    "total_orders": ("count(*)", "{:,.0f}"), "total_shipments": ("count(DISTINCT shipment_id)", "{:,.0f}"),
    "active_carriers": ("count(DISTINCT carrier)", "{:,.0f}"), "average_weight": ("avg(weight)", "{:,.2f}"),
}
_HEALTH = {
    "total_orders": ("count(*)", "{:,.0f}"), "total_patients": ("count(DISTINCT patient_id)", "{:,.0f}"),
    "active_diagnoses": ("count(DISTINCT diagnosis)", "{:,.0f}"),
}


def _domain_sql(view: str, metrics: dict) -> str:
    return metric_rows(view, {m: f"CAST({e} AS DOUBLE)" for m, (e, _) in metrics.items()},
                       {m: f for m, (_, f) in metrics.items()})


@query("kpi_summary_workforce", _domain_sql("workforce", _HR))
def _(spark, sf):
    return _summary(kpi_summary(V.workforce(spark, sf), V.WORKFORCE_MODEL))


@query("kpi_summary_subscriptions", _domain_sql("subscriptions", _SAAS))
def _(spark, sf):
    return _summary(kpi_summary(V.subscriptions(spark, sf), V.SUBSCRIPTIONS_MODEL))


@query("kpi_summary_shipments", _domain_sql("shipments", _LOGISTICS))
def _(spark, sf):
    return _summary(kpi_summary(V.shipments(spark, sf), V.SHIPMENTS_MODEL))


@query("kpi_summary_encounters", _domain_sql("encounters", _HEALTH))
def _(spark, sf):
    return _summary(kpi_summary(V.encounters(spark, sf), V.ENCOUNTERS_MODEL))


# -- filters ----------------------------------------------------------------------------------

_FILTERS = {
    "eq": ([Filter("region", "eq", "ASIA")], "region = 'ASIA'"),
    "neq": ([Filter("status", "neq", "F")], "status <> 'F'"),
    "in": ([Filter("category", "in", ["PROMO", "SMALL"]), Filter("brand", "in", [])], "category IN ('PROMO', 'SMALL')"),
    "not_in": ([Filter("segment", "not_in", ["BUILDING", "MACHINERY"])], "segment NOT IN ('BUILDING', 'MACHINERY')"),
    "gt": ([Filter("quantity", "gt", 25)], "quantity > 25"),
    "gte": ([Filter("quantity", "gte", 25)], "quantity >= 25"),
    "lt": ([Filter("sale_price", "lt", 1500.5)], "sale_price < 1500.5"),
    "lte": ([Filter("order_date", "lte", "1996-06-30")], "order_date <= TIMESTAMP '1996-06-30'"),
    "like": ([Filter("product", "like", "RED")], "product ILIKE '%RED%'"),
    "between": ([Filter("order_date", "between", ["1997-01-01", "1997-12-31"]), Filter("quantity", "between", [5])],
                "order_date BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-12-31'"),
    "all_of": ([Filter("region", "eq", "EUROPE"), Filter("quantity", "between", [10, 20]),
                Filter("product", "like", "gear")],
               "region = 'EUROPE' AND quantity BETWEEN 10 AND 20 AND product ILIKE '%gear%'"),
}


def _filter_query(op: str) -> None:
    filters, where = _FILTERS[op]

    @query(f"filter_{op}", over("sales", body=f"""
        SELECT category, count(*) AS row_count, sum(quantity) AS units, round(sum(revenue), 2) AS revenue
        FROM sales WHERE {where} GROUP BY category"""))
    def _(spark, sf):
        names = {"category", "quantity", "revenue", *[f.column for f in filters]}
        rows = apply_filters(V.sales(spark, sf, sorted(names)), filters)
        return rows.groupBy("category").agg(
            F.count(F.lit(1)).alias("row_count"), F.sum("quantity").alias("units"),
            F.round(F.sum("revenue"), 2).alias("revenue"))


for _op in _FILTERS:
    _filter_query(_op)


@query("filter_equality_map", over("sales", body="""
    SELECT count(*) AS row_count, round(sum(revenue), 2) AS revenue FROM sales
    WHERE region = 'ASIA' AND category = 'PROMO'"""))
def _(spark, sf):
    filters = equality_filters(V.SALES_MODEL, {"region": "ASIA", "category": "PROMO"})
    rows = apply_filters(V.sales(spark, sf, ["region", "category", "revenue"]), filters)
    return rows.agg(F.count(F.lit(1)).alias("row_count"), F.round(F.sum("revenue"), 2).alias("revenue"))


@query("filter_value_pairs", over("sales", body="""
    SELECT count(*) AS row_count, round(sum(revenue), 2) AS revenue FROM sales
    WHERE region IN ('ASIA', 'AFRICA') AND status IN ('O')"""))
def _(spark, sf):
    filters = value_filters([("region", "ASIA"), ("status", "O"), ("region", "AFRICA")])
    rows = apply_filters(V.sales(spark, sf, ["region", "status", "revenue"]), filters)
    return rows.agg(F.count(F.lit(1)).alias("row_count"), F.round(F.sum("revenue"), 2).alias("revenue"))


@query("filter_value_pairs_many", over("sales", body="""
    SELECT count(*) AS row_count, round(sum(revenue), 2) AS revenue FROM sales
    WHERE country IN ('CHINA', 'FRANCE', 'INDIA', 'JAPAN', 'KENYA', 'PERU', 'BRAZIL') AND status IN ('O')"""))
def _(spark, sf):
    wanted = ("CHINA", "FRANCE", "INDIA", "JAPAN", "KENYA", "PERU", "BRAZIL")
    filters = value_filters([*(("country", c) for c in wanted), ("status", "O")])
    rows = apply_filters(V.sales(spark, sf, ["country", "status", "revenue"]), filters)
    return rows.agg(F.count(F.lit(1)).alias("row_count"), F.round(F.sum("revenue"), 2).alias("revenue"))


# -- custom KPIs ------------------------------------------------------------------------------

def _kpi_sql(measure: str, dimension: str | None, order: str = "metric_value DESC NULLS LAST, dimension_value",
             view: str = "sales", text: str = "format('{:,.1f}', metric_value)") -> str:
    if dimension is None:
        return over(view, body=f"""
            WITH g AS (SELECT CAST({measure} AS DOUBLE) AS metric_value FROM {view})
            SELECT metric_value, {text} AS formatted_value FROM g""")
    return over(view, body=f"""
        WITH g AS (SELECT {dimension} AS dimension_value, CAST({measure} AS DOUBLE) AS metric_value FROM {view}
                   WHERE {dimension} IS NOT NULL GROUP BY {dimension} ORDER BY {order} LIMIT 15)
        SELECT CAST(dimension_value AS VARCHAR) AS dimension_value, metric_value, {text} AS formatted_value FROM g""")


_PERCENT_TEXT = "format('{:,.1f}%', metric_value)"
_WHOLE_TEXT = "format('{:,.0f}', metric_value)"
_NUMBER_TEXT = """CASE WHEN metric_value = floor(metric_value) THEN format('{:,.0f}', metric_value)
    WHEN abs(metric_value) < 1000 THEN format('{:,.2f}', metric_value) ELSE format('{:,.1f}', metric_value) END"""


@query("custom_kpi_sum", _kpi_sql("round(sum(revenue), 2)", "product", text="format('${:,.2f}', metric_value)"))
def _(spark, sf):
    return custom_kpi(V.sales(spark, sf, ["product", "revenue"]),
                      KpiSpec("sum", "Revenue", "product", style="currency"))


@query("custom_kpi_avg", _kpi_sql("round(avg(quantity), 2)", None, text="format('{:,.2f} pcs', metric_value)"))
def _(spark, sf):
    return custom_kpi(V.sales(spark, sf, ["quantity"]), KpiSpec("avg", "quantity", unit="pcs"))


@query("custom_kpi_count", _kpi_sql("count(*)", "brand", text=_WHOLE_TEXT))
def _(spark, sf):
    return custom_kpi(V.sales(spark, sf, ["brand"]), KpiSpec("count", "*", "brand"))


@query("custom_kpi_min", _kpi_sql("min(sale_price)", "segment", text="format('${:,.2f}', metric_value)"))
def _(spark, sf):
    return custom_kpi(V.sales(spark, sf, ["segment", "sale_price"]),
                      KpiSpec("min", "Sale Price", "segment", style="currency"))


@query("custom_kpi_max", _kpi_sql("max(quantity)", "region", text="format('{:,.1f} h', metric_value)"))
def _(spark, sf):
    return custom_kpi(V.sales(spark, sf, ["region", "quantity"]),
                      KpiSpec("max", "quantity", "region", style="duration", unit="h"))


@query("custom_kpi_rate", _kpi_sql(
    "round(count(CASE WHEN lower(status) = 'f' THEN 1 END) * 100.0 / nullif(count(*), 0), 2)", "country",
    text=_PERCENT_TEXT))
def _(spark, sf):
    return custom_kpi(V.sales(spark, sf, ["country", "status"]),
                      KpiSpec("rate", "status", "country", Condition("F")))


@query("custom_kpi_rate_truthy", _kpi_sql(
    "round(count(CASE WHEN churn IN ('1', 'true', 'True', 'YES', 'yes') THEN 1 END) * 100.0 / nullif(count(*), 0), 2)",
    None, view="subscriptions", text=_PERCENT_TEXT))
def _(spark, sf):
    return custom_kpi(V.subscriptions(spark, sf), KpiSpec("rate", "churn"))


@query("custom_kpi_rate_condition", _kpi_sql(
    "round(count(CASE WHEN quantity >= 40 THEN 1 END) * 100.0 / nullif(count(*), 0), 2)", "region", text=_PERCENT_TEXT))
def _(spark, sf):
    return custom_kpi(V.sales(spark, sf, ["region", "status", "quantity"]),
                      KpiSpec("rate", "status", "region", Condition(40, "gte", "quantity")))


@query("custom_kpi_rate_flag", """
    SELECT round(100.0 * count(CASE WHEN o_orderstatus = 'F' THEN 1 END) / nullif(count(*), 0), 2) AS as_number,
           round(100.0 * count(CASE WHEN o_orderstatus = 'F' THEN 1 END) / nullif(count(*), 0), 2) AS as_flag
    FROM orders""")
def _(spark, sf):
    rows = V.table(spark, sf, "orders").select((F.col("o_orderstatus") == "F").alias("flag"),
                                               (F.col("o_orderstatus") == "F").cast("int").alias("number"))
    number = custom_kpi(rows, KpiSpec("rate", "number", condition=Condition(True))).select(
        F.col("metric_value").alias("as_number"))
    flag = custom_kpi(rows, KpiSpec("rate", "flag", condition=Condition(1))).select(
        F.col("metric_value").alias("as_flag"))
    return number.crossJoin(flag)  # one row each


@query("custom_kpi_max_date", """
    SELECT CAST(NULL AS DOUBLE) AS metric_value FROM (SELECT max(o_orderdate) FROM orders)""")
def _(spark, sf):
    return custom_kpi(V.table(spark, sf, "orders"), KpiSpec("max", "o_orderdate")).select("metric_value")


@query("custom_kpi_percent_of_total", _kpi_sql(
    "round(sum(revenue) * 100.0 / nullif(sum(sum(revenue)) OVER (), 0), 2)", "category", text=_PERCENT_TEXT))
def _(spark, sf):
    return custom_kpi(V.sales(spark, sf, ["category", "revenue"]),
                      KpiSpec("percent_of_total", "revenue", "category"))


@query("custom_kpi_by_date", _kpi_sql("round(sum(quantity), 2)", "order_date", "dimension_value ASC",
                                      text=_NUMBER_TEXT).replace(
    "CAST(dimension_value AS VARCHAR)", "strftime(dimension_value, '%Y-%m-%d %H:%M:%S')"))
def _(spark, sf):
    return custom_kpi(V.sales(spark, sf, ["order_date", "quantity"]), KpiSpec("sum", "quantity", "order_date"))


@query("custom_kpi_sparkline", over("sales", body="""
    SELECT strftime(date_trunc('month', order_date), '%Y-%m-%d') AS period_start,
           round(sum(revenue), 2) AS metric_value
    FROM sales WHERE order_date IS NOT NULL GROUP BY 1 ORDER BY 1 LIMIT 8"""))
def _(spark, sf):
    return kpi_sparkline(V.sales(spark, sf, ["order_date", "revenue"]), KpiSpec("sum", "revenue"), "order_date")


@query("formula_metric", over("sales", body="""
    SELECT 'net_margin' AS metric_id,
           round((sum(revenue) - sum(discount)) / nullif(sum(revenue), 0) * 100, 4) AS value,
           format('{:.2f}%', (sum(revenue) - sum(discount)) / nullif(sum(revenue), 0) * 100) AS formatted_value
    FROM sales
    UNION ALL
    SELECT 'avg_line', round(sum(revenue * quantity) / nullif(count(*), 0), 4),
           format('{:,.2f}', sum(revenue * quantity) / nullif(count(*), 0)) FROM sales"""))
def _(spark, sf):
    df = V.sales(spark, sf, ["revenue", "discount", "quantity"])
    model = V.SALES_MODEL.with_metric(formula_metric(
        "Net Margin", "Net margin", "(revenue - discount) / revenue * 100", df, "percentage"))
    model = model.with_metric(formula_metric(
        "avg line", "Average line", "SUM(Revenue * quantity) / COUNT(*)", df, "number"))
    rows = kpi_summary(df, model, metrics=["net_margin", "avg_line"])
    return rounded(rows.select("metric_id", "value", "formatted_value"), value=4)


# -- headline counts, comparison, what-if -----------------------------------------------------

@query("hero_stats", over("sales", body="""
    SELECT count(*) AS records, count(DISTINCT product) AS distinct_1, count(DISTINCT category) AS distinct_2,
           round(avg(CASE WHEN status = 'On Time' THEN 1.0 ELSE 0.0 END) * 100, 1) AS on_time_pct
    FROM (SELECT product, category, CASE WHEN status = 'F' THEN 'On Time' ELSE status END AS status FROM sales)"""))
def _(spark, sf):
    df = V.sales(spark, sf, ["product", "category", "status"]).replace({"F": "On Time"}, subset=["status"])
    return hero_stats(df, ["product", "category"], "status")


_FIRST5 = ("total_revenue", "total_cost", "total_profit", "profit_margin", "units_sold")


@query("benchmark_periods", over("sales", body=f"""
    WITH v AS (
        {" UNION ALL ".join(f'''SELECT '{m}' AS metric_id,
            (SELECT {SALES_METRICS[m]} FROM sales WHERE order_date < TIMESTAMP '1998-01-01') AS b,
            (SELECT {SALES_METRICS[m]} FROM sales WHERE order_date >= TIMESTAMP '1998-01-01') AS t''' for m in _FIRST5)})
    SELECT metric_id, round(b, 2) AS base_value, round(t, 2) AS target_value, round(t - b, 2) AS delta_value,
           round(CASE WHEN b > 0 THEN (t - b) / b * 100.0 ELSE 0.0 END, 1) AS delta_percentage,
           CAST(t - b >= 0 AS INTEGER) AS is_positive_growth FROM v"""))
def _(spark, sf):
    df = V.sales(spark, sf, ["order_date", "quantity", "sale_price", "cost_price"])
    rows = compare(apply_filters(df, [Filter("order_date", "lt", "1998-01-01")]),
                   apply_filters(df, [Filter("order_date", "gte", "1998-01-01")]), V.SALES_MODEL)
    return rows.drop("label").withColumn("is_positive_growth", F.col("is_positive_growth").cast("int"))


@query("what_if_grid", over("sales", body="""
    WITH s AS (SELECT sum(quantity * sale_price) AS r0, sum(quantity * cost_price) AS c0 FROM sales
               WHERE region = 'EUROPE'),
    p AS (SELECT * FROM (VALUES (1, 10.0, -5.0, 20.0), (2, 0.0, 0.0, 0.0), (3, -15.0, 10.0, 5.0))
          AS t(setting_no, price, cost, volume)),
    v AS (SELECT setting_no, r0, c0, r0 * (1 + volume / 100) * (1 + price / 100) AS r1,
                 c0 * (1 + volume / 100) * (1 + cost / 100) AS c1 FROM s CROSS JOIN p),
    m AS (SELECT setting_no, 'total_revenue' AS metric_id, r0 AS b, r1 AS n FROM v
          UNION ALL SELECT setting_no, 'total_profit', r0 - c0, r1 - c1 FROM v
          UNION ALL SELECT setting_no, 'profit_margin', (r0 - c0) / r0 * 100, (r1 - c1) / r1 * 100 FROM v)
    SELECT setting_no, metric_id, round(b, 2) AS baseline_value, round(n, 2) AS simulated_value,
           round(n - b, 2) AS delta_value,
           round(CASE WHEN b > 0 THEN (n - b) / b * 100 ELSE 0.0 END, 1) AS delta_percentage FROM m"""))
def _(spark, sf):
    settings = [{"price_change_pct": 10, "cost_change_pct": -5, "volume_change_pct": 20}, {},
                {"price_change_pct": -15, "cost_change_pct": 10, "volume_change_pct": 5}]
    df = V.sales(spark, sf, ["region", "quantity", "sale_price", "cost_price"])
    return what_if(df, V.SALES_MODEL, settings, {"region": "EUROPE"}).drop(
        "price_change_pct", "cost_change_pct", "volume_change_pct")


# -- texts and scorecards ---------------------------------------------------------------------

@query("number_formats", """
    WITH t AS (SELECT o_orderkey AS order_key, o_totalprice AS v FROM orders)
    SELECT order_key,
           CASE WHEN abs(v) >= 1000000 THEN '$' || format('{:.2f}', v / 1000000) || 'M'
                WHEN abs(v) >= 1000 THEN '$' || format('{:.1f}', v / 1000) || 'K'
                ELSE '$' || regexp_replace(regexp_replace(format('{:,.2f}', v), '(\\.\\d*?)0+$', '\\1'), '\\.$', '') END
               AS money,
           CASE WHEN v = floor(v) THEN format('{:,.0f}', v) WHEN abs(v) < 1000 THEN format('{:,.2f}', v)
                ELSE format('{:,.1f}', v) END || ' EUR' AS number,
           format('{:,.2f}', v / 1000) || ' min' AS span,
           CASE WHEN abs(v / 1000) >= 100 THEN format('{:,.0f}', floor(v / 1000 + 0.5))
                ELSE regexp_replace(format('{:,.1f}', floor(v / 100 + 0.5) / 10), '\\.0$', '') END || ' k' AS hinted
    FROM t""".replace("\\\\", "\\").replace("format('{:,.2f}', v / 1000) || ' min' AS span",
                                            "format('{:,.1f}', round(v)) || ' min' AS span"))
def _(spark, sf):
    v = F.col("o_totalprice")
    return V.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("order_key"), compact_text(v, "currency").alias("money"),
        kpi_text(v, "number", "EUR").alias("number"), kpi_text(F.round(v), "duration").alias("span"),
        hinted_text(v, "k", 0.001).alias("hinted"))


def _score_sql(view: str, metrics: list[tuple[str, str, str, str]]) -> str:
    rows = " UNION ALL ".join(
        f"SELECT {n} AS position, '{m}' AS metric_id, '{label}' AS label, format('{fmt}', CAST({e} AS DOUBLE)) "
        f"AS formatted_value FROM {view}" for n, (m, label, e, fmt) in enumerate(metrics, 1))
    return over(view, body=rows)


@query("scorecard_sales", _score_sql("sales", [
    (m, label, SALES_METRICS[m], SALES_FORMATS[m]) for m, label in (
        ("total_revenue", "Total Revenue"), ("total_cost", "Total Cost"), ("total_profit", "Total Profit"),
        ("profit_margin", "Profit Margin"), ("units_sold", "Total Units Sold"), ("total_orders", "Total Orders"))]))
def _(spark, sf):
    return scorecard(V.sales(spark, sf, ["order_id", "quantity", "sale_price", "cost_price"]), V.SALES_MODEL)


@query("scorecard_workforce", _score_sql("workforce", [
    (m, label, *_HR[m]) for m, label in (
        ("total_employees", "Total Headcount"), ("active_employees", "Active Employees"),
        ("active_departments", "Active Departments"), ("workforce_locations", "Workforce Locations"),
        ("average_salary", "Average Salary"), ("turnover_rate", "Turnover Rate"))]))
def _(spark, sf):
    return scorecard(V.workforce(spark, sf), V.WORKFORCE_MODEL)


# -- measures and fallbacks without a table of their own ---------------------------------------

@query("kpi_summary_staff_averages", """
    WITH m AS (SELECT avg(p_size) AS age, avg(p_retailprice / 100) AS rating, avg(p_size / 4.0) AS tenure FROM part)
    SELECT 'avg_performance_rating' AS metric_id, round(rating, 4) AS value FROM m
    UNION ALL SELECT 'average_age', round(age, 4) FROM m UNION ALL SELECT 'average_tenure', round(tenure, 4) FROM m""")
def _(spark, sf):
    rows = V.table(spark, sf, "part").select(
        F.col("p_partkey").alias("employee_id"), F.col("p_size").alias("age"),
        (F.col("p_retailprice") / 100).alias("rating"), (F.col("p_size") / 4.0).alias("tenure"))
    model = SemanticModel(mappings={"employee_id": "employee_id", "age": "age", "performance_rating": "rating",
                                    "tenure": "tenure"}, domain="human_resources")
    wanted = ["avg_performance_rating", "average_age", "average_tenure"]
    return rounded(kpi_summary(rows, model, metrics=wanted).select("metric_id", "value"), value=4)


@query("kpi_summary_fallback", """
    SELECT 'total_records' AS metric_id, CAST(count(*) AS DOUBLE) AS value FROM part
    UNION ALL SELECT 'distinct_p_brand', CAST(count(DISTINCT p_brand) AS DOUBLE) FROM part
    UNION ALL SELECT 'avg_p_size', round(avg(p_size), 4) FROM part""")
def _(spark, sf):
    model = SemanticModel(dimensions=("p_brand",), measures=("p_size",))
    wanted = ["total_records", "distinct_p_brand", "avg_p_size"]
    rows = kpi_summary(V.table(spark, sf, "part"), model, metrics=wanted)
    return rounded(rows.select("metric_id", "value"), value=4)


@query("name_words", """
    WITH t AS (SELECT p_partkey AS key, 'Order' || replace(initcap_name, ' ', '') || 'USDPrice' AS name FROM (
        SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '),
               lambda x: upper(x[1]) || lower(x[2:])), ' ') AS initcap_name FROM part))
    SELECT key, trim(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'),
                                    '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')) AS spaced,
           array_to_string(list_filter(string_split_regex(lower(trim(regexp_replace(regexp_replace(
               name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'))),
               '[^a-z0-9]+'), lambda w: w <> ''), '|') AS tokens FROM t""")
def _(spark, sf):
    name = F.concat(F.lit("Order"), F.replace(F.initcap("p_name"), F.lit(" "), F.lit("")), F.lit("USDPrice"))
    return V.table(spark, sf, "part").select(
        F.col("p_partkey").alias("key"), spaced_words(name).alias("spaced"),
        F.array_join(name_tokens(name), "|").alias("tokens"))


@query("schema_columns", " UNION ALL ".join(
    f"SELECT {n} AS position, '{c}' AS column_name, count({c}) AS filled FROM customer"
    for n, c in enumerate(("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"), 1)))
def _(spark, sf):
    table = V.table(spark, sf, "customer")
    counts = table.agg(*[F.count(c).alias(c) for c in table.columns]).unpivot(
        [], table.columns, "column_name", "filled")
    return schema_rows(table).select("position", "column_name").join(counts, "column_name")
