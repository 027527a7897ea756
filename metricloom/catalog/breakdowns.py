"""Ranked breakdowns, insights, geography, dashboards and question-shaped queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from metricloom.catalog.base import SALES_FORMATS, SALES_METRICS, over, query, rounded
from metricloom.model import Filter, SemanticModel
from metricloom.operators.aggregate import KpiSpec, breakdown, dimension_values, group_count, multi_breakdown
from metricloom.operators.cleaning import clean
from metricloom.operators.explore import dropdown_values
from metricloom.operators.filters import toggle_filter
from metricloom.operators.geo import CITIES, REGIONS, centroids, geo_breakdown
from metricloom.operators.insights import insights, lowest_margin, pareto
from metricloom.operators.sqlview import safe_sql
from metricloom.plans import questions
from metricloom.plans.dashboard import Widget, dashboard_data, suggest_charts
from metricloom.sources import views as V

M = SALES_METRICS


@query("breakdown_category", over("sales", body=f"""
    SELECT category AS dimension_value, count(*) AS _row_count, round({M['total_revenue']}, 2) AS total_revenue,
           round({M['total_profit']}, 2) AS total_profit, round({M['profit_margin']}, 4) AS profit_margin
    FROM sales WHERE region = 'ASIA' GROUP BY category
    ORDER BY total_revenue DESC NULLS LAST, dimension_value LIMIT 10"""))
def flagship(spark, sf):
    """Revenue, profit and margin by category for one region."""
    df = V.sales(spark, sf, ["region", "category", "quantity", "sale_price", "cost_price"])
    rows = breakdown(df, V.SALES_MODEL, "category", ["total_revenue", "total_profit", "profit_margin"],
                     [Filter("region", "eq", "ASIA")], limit=10)
    return rounded(rows, total_revenue=2, total_profit=2, profit_margin=4)


@query("breakdown_sorted_ascending", over("sales", body=f"""
    SELECT product AS dimension_value, count(*) AS _row_count, round({M['units_sold']}, 2) AS units_sold,
           {M['total_orders']} AS total_orders
    FROM sales GROUP BY product ORDER BY {M['total_orders']} ASC NULLS LAST, dimension_value LIMIT 7"""))
def _(spark, sf):
    rows = breakdown(V.sales(spark, sf, ["product", "quantity", "order_id"]), V.SALES_MODEL, "Product",
                     ["units_sold", "total_orders", "no_such_metric"], limit=7, sort_by="total_orders", ascending=True)
    return rounded(rows, units_sold=2)


@query("breakdown_by_dimension_order", over("sales", body=f"""
    SELECT brand AS dimension_value, count(*) AS _row_count, round({M['total_revenue']}, 2) AS total_revenue
    FROM sales GROUP BY brand ORDER BY brand LIMIT 5"""))
def _(spark, sf):
    rows = breakdown(V.sales(spark, sf, ["brand", "quantity", "sale_price"]), V.SALES_MODEL, "brand",
                     ["total_revenue"], limit=5, sort_by="brand", ascending=True)
    return rounded(rows, total_revenue=2)


_DIRTY_MODEL = SemanticModel(mappings={"sale_price": "unit_price"}, dimensions=("segment", "state"))


@query("breakdown_null_group", over("clean", body="""
    SELECT segment AS dimension_value, count(*) AS _row_count, CAST(count(*) AS DOUBLE) AS count,
           (SELECT count(DISTINCT segment) FROM clean) AS total_distinct_groups
    FROM clean GROUP BY segment ORDER BY count DESC NULLS LAST, dimension_value NULLS LAST LIMIT 20"""))
def _(spark, sf):
    return breakdown(clean(V.dirty(spark, sf)), _DIRTY_MODEL, "segment", ["not_there"], group_total=True)


@query("breakdown_group_count", over("sales", body="""
    SELECT count(DISTINCT product) AS total_distinct_groups FROM sales WHERE quantity > 45"""))
def _(spark, sf):
    return group_count(V.sales(spark, sf, ["product", "quantity"]), "product", [Filter("quantity", "gt", 45)])


@query("breakdown_with_group_total", over("sales", body=f"""
    SELECT country AS dimension_value, count(*) AS _row_count, round({M['total_revenue']}, 2) AS total_revenue,
           (SELECT count(DISTINCT country) FROM sales) AS total_distinct_groups
    FROM sales GROUP BY country ORDER BY {M['total_revenue']} DESC, dimension_value LIMIT 6"""))
def _(spark, sf):
    rows = breakdown(V.sales(spark, sf, ["country", "quantity", "sale_price"]), V.SALES_MODEL, "country",
                     ["total_revenue"], limit=6, group_total=True)
    return rounded(rows, total_revenue=2)


_DIMS = ("category", "product", "brand", "segment", "country", "region")


@query("multi_breakdown", over("sales", body="WITH " + ", ".join(
    f"g_{d} AS (SELECT '{d}' AS dimension, {d} AS dimension_value, {M['total_revenue']} AS v, "
    f"row_number() OVER (ORDER BY {M['total_revenue']} DESC NULLS LAST, {d}) AS rank, "
    f"sum({M['total_revenue']}) OVER () AS total "
    f"FROM sales GROUP BY {d})" for d in _DIMS) + ", t AS (" + " UNION ALL ".join(
        f"SELECT * FROM g_{d} WHERE rank <= 8" for d in _DIMS) + """)
    SELECT dimension, rank, dimension_value, round(v, 2) AS value, format('${:,.2f}', v) AS formatted_value,
           'currency' AS metric_type,
           round(v / total * 100.0, 1) AS share_percentage,
           round(v / sum(v) OVER (PARTITION BY dimension) * 100.0, 1) AS share_of_shown FROM t"""))
def _(spark, sf):
    return multi_breakdown(V.sales(spark, sf), V.SALES_MODEL, "total_revenue")


@query("dimension_values", over("clean", body="""
    WITH t AS (SELECT segment AS dimension_value, count(*) AS row_count FROM clean GROUP BY segment
               ORDER BY row_count DESC, dimension_value LIMIT 100)
    SELECT * FROM t WHERE dimension_value IS NOT NULL"""))
def _(spark, sf):
    return dimension_values(clean(V.dirty(spark, sf)), "segment")


@query("dropdown_values", over("sales", body="SELECT DISTINCT product AS value FROM sales WHERE product IS NOT NULL"))
def _(spark, sf):
    return dropdown_values(V.sales(spark, sf, ["product"]), "product")


# -- insights ---------------------------------------------------------------------------------

_PARETO = f"""
    WITH g AS (SELECT product AS name, {M['total_revenue']} AS v,
                      row_number() OVER (ORDER BY {M['total_revenue']} DESC NULLS LAST, product) AS rank
               FROM sales GROUP BY product),
    n AS (SELECT count(*) AS groups, CAST(greatest(1, count(*) // 5) AS INTEGER) AS top_count,
                 sum(v) AS total_revenue FROM g)"""


@query("insight_pareto", over("sales", body=_PARETO + """
    SELECT 'product' AS dimension, groups, top_count,
           (SELECT string_agg(name, ', ' ORDER BY rank) FROM g WHERE rank <= least(top_count, 20)) AS top_names,
           round((SELECT sum(v) FROM g WHERE rank <= top_count), 2) AS top_revenue,
           round(total_revenue, 2) AS total_revenue,
           round((SELECT sum(v) FROM g WHERE rank <= top_count) / total_revenue * 100.0, 1) AS concentration_pct
    FROM n"""))
def _(spark, sf):
    rows = pareto(V.sales(spark, sf, ["product", "quantity", "sale_price"]), V.SALES_MODEL, ["product"])
    return rounded(rows.drop("best_name", "best_revenue", "best_share"), top_revenue=2, total_revenue=2)


@query("insight_top_driver", over("sales", body=f"""
    WITH g AS (SELECT category AS name, {M['total_revenue']} AS v FROM sales GROUP BY category)
    SELECT 'category' AS dimension, (SELECT name FROM g ORDER BY v DESC LIMIT 1) AS best_name,
           round(max(v), 2) AS best_revenue, round(max(v) / sum(v) * 100.0, 1) AS best_share FROM g"""))
def _(spark, sf):
    rows = pareto(V.sales(spark, sf), V.SALES_MODEL)
    return rounded(rows.select("dimension", "best_name", "best_revenue", "best_share"), best_revenue=2)


@query("insight_margin_risk", over("sales", body=f"""
    WITH g AS (
        SELECT 1 AS o, 'category' AS dimension, category AS dimension_value, {M['profit_margin']} AS m,
               {M['total_profit']} AS p, {M['total_revenue']} AS r FROM sales GROUP BY category
        UNION ALL
        SELECT 2, 'product', product, {M['profit_margin']}, {M['total_profit']}, {M['total_revenue']}
        FROM sales GROUP BY product)
    SELECT dimension, dimension_value, round(m, 4) AS profit_margin, round(p, 2) AS total_profit,
           round(r, 2) AS total_revenue
    FROM g WHERE m < 60 ORDER BY o, m, dimension_value LIMIT 1"""))
def _(spark, sf):
    df = V.sales(spark, sf, ["category", "product", "quantity", "sale_price", "cost_price"])
    rows = lowest_margin(df, V.SALES_MODEL, ["category", "product"], threshold=60.0)
    return rounded(rows, profit_margin=4, total_profit=2, total_revenue=2)


@query("insights_worded", over("sales", body=f"""
    WITH g AS (SELECT category AS name, {M['total_revenue']} AS v, row_number() OVER (
                   ORDER BY {M['total_revenue']} DESC, category) AS rank FROM sales GROUP BY category),
    n AS (SELECT count(*) AS groups, greatest(1, CAST(floor(count(*) * 0.2) AS INTEGER)) AS k, sum(v) AS total FROM g),
    s AS (SELECT groups, k, total, (SELECT sum(v) FROM g WHERE rank <= k) AS top,
                 (SELECT string_agg(name, ', ' ORDER BY rank) FROM g WHERE rank <= k) AS names,
                 (SELECT name FROM g WHERE rank = 1) AS best, (SELECT v FROM g WHERE rank = 1) AS best_v FROM n)
    SELECT 1 AS insight_order, 'concentration' AS type,
           'Revenue Concentration: Top ' || k || ' categorys Generate ' || format('{{:.1f}}', round(top / total * 100, 1))
               || '% of Sales' AS title,
           'The top ' || k || ' of ' || groups || ' categorys (' || names || ') account for $'
               || format('{{:,.2f}}', top) || ' out of $' || format('{{:,.2f}}', total) || ' total revenue.' AS description,
           'total_revenue' AS metric, 'category' AS dimension,
           CASE WHEN round(top / total * 100, 1) > 70 THEN 85.0 ELSE 65.0 END::DOUBLE AS impact_score FROM s
    UNION ALL
    SELECT 2, 'growth_driver',
           'Dominant Segment: ''' || best || ''' Captures ' || format('{{:.1f}}', round(best_v / total * 100, 1))
               || '% Market Share in category',
           '''' || best || ''' is the single largest performance driver in category with $'
               || format('{{:,.2f}}', best_v) || ' in total revenue.',
           'total_revenue', 'category', 80.0::DOUBLE FROM s"""))
def _(spark, sf):
    df = V.sales(spark, sf, ["category", "product", "region", "quantity", "sale_price", "cost_price"])
    model = SemanticModel(mappings=dict(V.SALES_MODEL.mappings), dimensions=("product", "category", "region"))
    return insights(df, model)


@query("insight_baseline", over("sales", body="""
    SELECT 4 AS insight_order, 'summary' AS type, 'Automated Analytics Active' AS title,
           'Dataset successfully normalized into columnar format. Real-time deterministic aggregations are enabled.'
               AS description, 'record_count' AS metric, 'category' AS dimension, 50.0::DOUBLE AS impact_score
    WHERE NOT EXISTS (SELECT 1 FROM sales WHERE revenue * 0 <> 0)"""))
def _(spark, sf):
    """Sales of quantity none: no group stands out and no margin is low, so the basic insight alone is left."""
    df = V.sales(spark, sf, ["category", "product", "quantity", "sale_price", "cost_price"])
    model = SemanticModel(mappings=dict(V.SALES_MODEL.mappings), dimensions=("product", "category"))
    return insights(df.withColumn("quantity", F.col("quantity") * 0), model)


# -- geography --------------------------------------------------------------------------------

_PLACES = ", ".join(f"('{p}', {lat}, {lng}, '{code}')" for p, lat, lng, code in (*CITIES, *REGIONS))


@query("geo_breakdown", over("sales", body=f"""
    WITH places AS (SELECT * FROM (VALUES {_PLACES}) AS t(place, lat, lng, code)),
    g AS (SELECT region AS name, count(*) AS n, {M['total_revenue']} AS v FROM sales
          GROUP BY region)
    SELECT name AS region_name, coalesce(code, upper(substr(name, 1, 3))) AS region_code,
           CAST(coalesce(lat, 20.0) AS DOUBLE) AS latitude, CAST(coalesce(lng, 0.0) AS DOUBLE) AS longitude,
           'total_revenue' AS metric_id, round(v, 2) AS metric_value, format('${{:,.2f}}', v) AS formatted_value,
           round(v / (SELECT sum(v) FROM g) * 100, 1) AS share_percentage,
           round(v / sum(v) OVER () * 100, 1) AS share_of_shown, n AS order_count
    FROM (SELECT * FROM g ORDER BY v DESC, name LIMIT 3) AS g LEFT JOIN places ON lower(trim(name)) = place"""))
def _(spark, sf):
    df = V.sales(spark, sf, ["region", "quantity", "sale_price"])
    return rounded(geo_breakdown(df, V.SALES_MODEL, limit=3), metric_value=2)


_COORDINATES = "n_nationkey * 2.5 - 30 + c_custkey % 10 / 10.0 AS latitude, n_regionkey * 40.0 - 80 AS longitude"


@query("geo_centroids", f"""
    WITH c AS (SELECT n_name AS place, {_COORDINATES} FROM customer JOIN nation ON c_nationkey = n_nationkey)
    SELECT place, round(avg(latitude), 6) AS data_lat, round(avg(longitude), 6) AS data_lng FROM c GROUP BY place""")
def _(spark, sf):
    customer, nation = V.table(spark, sf, "customer"), V.table(spark, sf, "nation")
    df = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("n_name").alias("place"), (F.col("n_nationkey") * 2.5 - 30 + F.col("c_custkey") % 10 / 10.0).alias("lat"),
        (F.col("n_regionkey") * 40.0 - 80).alias("lng"))
    return rounded(centroids(df, "place", "lat", "lng"), data_lat=6, data_lng=6)


@query("geo_data_coordinates", """
    WITH c AS (SELECT n_name AS country, c_acctbal AS amount, n_nationkey * 2.5 - 30 AS lat,
                      n_regionkey * 40.0 - 80 AS lng FROM customer JOIN nation ON c_nationkey = n_nationkey),
    g AS (SELECT country, sum(amount) AS v, count(*) AS n, avg(lat) AS lat, avg(lng) AS lng FROM c GROUP BY country)
    SELECT country AS region_name, upper(substr(country, 1, 3)) AS region_code, round(lat, 4) AS latitude,
           round(lng, 4) AS longitude, 'total_revenue' AS metric_id, round(v, 2) AS metric_value,
           format('${:,.2f}', v) AS formatted_value,
           round(v / sum(v) OVER () * 100, 1) AS share_percentage,
           round(v / sum(v) OVER () * 100, 1) AS share_of_shown, n AS order_count FROM g""")
def _(spark, sf):
    customer, nation = V.table(spark, sf, "customer"), V.table(spark, sf, "nation")
    df = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("n_name").alias("country"), F.col("c_acctbal").alias("amount"),
        (F.col("n_nationkey") * 2.5 - 30).alias("lat"), (F.col("n_regionkey") * 40.0 - 80).alias("lng"))
    model = SemanticModel(mappings={"revenue": "amount", "country": "country"}, dimensions=("country",))
    return rounded(geo_breakdown(df, model), metric_value=2, latitude=4, longitude=4)


# -- dashboards and charts --------------------------------------------------------------------

def _top(widget: str, dimension: str, metrics: list[str], limit: int, where: str) -> str:
    order = f"{M[metrics[0]]} DESC NULLS LAST, {dimension}"
    base = (f"SELECT {dimension} AS key, row_number() OVER (ORDER BY {order}) AS position, "
            + ", ".join(f"{M[m]} AS {m}" for m in metrics)
            + f" FROM sales {where} GROUP BY {dimension} ORDER BY position LIMIT {limit}")
    return " UNION ALL ".join(
        f"SELECT '{widget}' AS widget_id, position, key, '{m}' AS metric_id, {m} AS value, "
        f"format('{SALES_FORMATS[m]}', {m}) AS formatted_value FROM ({base})" for m in metrics)


_WHERE = "WHERE segment = 'BUILDING'"
_DASHBOARD = f"""
    WITH q AS (SELECT strftime(date_trunc('quarter', order_date), '%Y-%m-%d') AS p, {M['total_revenue']} AS v,
                      row_number() OVER (ORDER BY date_trunc('quarter', order_date) DESC) AS age
               FROM sales {_WHERE} GROUP BY date_trunc('quarter', order_date)),
    last8 AS (SELECT p, v, age, row_number() OVER (ORDER BY p) AS i FROM q WHERE age <= 8),
    yearly AS (SELECT strftime(date_trunc('year', order_date), '%Y-%m-%d') AS p, {M['units_sold']} AS v,
                      row_number() OVER (ORDER BY date_trunc('year', order_date)) AS i
               FROM sales {_WHERE} GROUP BY date_trunc('year', order_date)),
    a AS (
    SELECT 'card' AS widget_id, 1 AS position, 'value' AS key, 'total_revenue' AS metric_id,
           {M['total_revenue']} AS value, format('${{:,.2f}}', {M['total_revenue']}) AS formatted_value FROM sales {_WHERE}
    UNION ALL SELECT 'card', 2, 'prior_value', 'total_revenue', (SELECT v FROM q WHERE age = 2), NULL
    UNION ALL SELECT 'card', 3, 'growth_percentage', 'total_revenue',
        (SELECT round(round(c.v - b.v, 2) / b.v * 100, 2) FROM q c, q b WHERE c.age = 1 AND b.age = 2), NULL
    UNION ALL SELECT 'card', 12, 'trend', 'total_revenue', NULL,
        (SELECT CASE WHEN round(c.v - b.v, 2) > 0 THEN 'up' WHEN round(c.v - b.v, 2) < 0 THEN 'down' ELSE 'flat' END
         FROM q c, q b WHERE c.age = 1 AND b.age = 2)
    UNION ALL SELECT 'card', 13, 'current_period', 'total_revenue', NULL, (SELECT p FROM q WHERE age = 1)
    UNION ALL SELECT 'card', 14, 'prior_period', 'total_revenue', NULL, (SELECT p FROM q WHERE age = 2)
    UNION ALL SELECT 'single', 1, 'value', 'single', round(sum(quantity), 2), format('{{:,.0f}}', sum(quantity))
        FROM sales {_WHERE}
    UNION ALL SELECT 'broken', 0, 'error', NULL, NULL, 'column ''no_such'' does not exist'
    UNION ALL SELECT 'card', i + 3, 'spark_' || i, 'total_revenue', v, NULL FROM last8
    UNION ALL SELECT 'line', i, p, 'units_sold', v, format('{{:,.0f}} units', v) FROM yearly
    UNION ALL {_top('bar', 'category', ['total_profit'], 4, _WHERE)}
    UNION ALL {_top('table', 'product', ['total_orders', 'profit_margin'], 6, _WHERE)}
    UNION ALL SELECT 'custom', row_number() OVER (ORDER BY v DESC, region), region, 'custom', v,
        CASE WHEN v = floor(v) THEN format('{{:,.0f}}', v) WHEN abs(v) < 1000 THEN format('{{:,.2f}}', v)
             ELSE format('{{:,.1f}}', v) END
        FROM (SELECT region, round(avg(quantity), 2) AS v FROM sales {_WHERE} AND region IS NOT NULL GROUP BY region))
    SELECT widget_id, CAST(position AS INTEGER) AS position, key, metric_id, round(value, 2) AS value, formatted_value
    FROM a"""


@query("dashboard_data", over("sales", body=_DASHBOARD))
def dashboard(spark, sf):
    """A cross-filtered dashboard: card, line, bar, table, two custom KPIs and a widget that cannot be shown."""
    widgets = [
        Widget("card", "kpi_card", ("total_revenue",)),
        Widget("line", "line_chart", ("units_sold",), granularity="year"),
        Widget("bar", "bar_chart", ("total_profit",), "category", limit=4),
        Widget("table", "table", ("total_orders", "profit_margin"), "product", limit=6),
        Widget("custom", "bar_chart", kpi=KpiSpec("avg", "quantity", "region")),
        Widget("single", "kpi_card", kpi=KpiSpec("sum", "quantity")),
        Widget("broken", "bar_chart", dimension="no_such"),
    ]
    # A second pick on the same column replaces the first.
    picks = toggle_filter(toggle_filter([], "segment", "MACHINERY"), "segment", "BUILDING")
    df = V.sales(spark, sf, ["order_id", "order_date", "quantity", "sale_price", "cost_price", "product", "category",
                             "segment", "region"])
    rows = rounded(dashboard_data(df, V.SALES_MODEL, widgets, picks), value=2)
    return rows.withColumn("formatted_value", F.regexp_replace("formatted_value", "; columns are .*", ""))


@query("chart_suggestion", over("sales", body="""
    WITH c AS (SELECT 'order_date' AS dimension, count(DISTINCT order_date) AS distinct_count FROM sales
               UNION ALL SELECT 'category', count(DISTINCT category) FROM sales
               UNION ALL SELECT 'product', count(DISTINCT product) FROM sales
               UNION ALL SELECT 'region', count(DISTINCT region) FROM sales)
    SELECT dimension, distinct_count, CASE WHEN dimension = 'order_date' THEN 'line_chart'
           WHEN distinct_count BETWEEN 2 AND 5 THEN 'pie_chart' WHEN distinct_count > 20 THEN 'table'
           ELSE 'bar_chart' END AS chart FROM c"""))
def _(spark, sf):
    dims = ["order_date", "category", "product", "region"]
    return suggest_charts(V.sales(spark, sf, dims), dims, with_table=True).drop("reason")


@query("chart_reasons", over("sales", body="""
    WITH c AS (SELECT 'order_date' AS dimension, count(DISTINCT order_date) AS n FROM sales
               UNION ALL SELECT 'category', count(DISTINCT category) FROM sales
               UNION ALL SELECT 'region', count(DISTINCT region) FROM sales
               UNION ALL SELECT 'status', count(DISTINCT status) FROM sales)
    SELECT 'auto' AS asked, dimension, n AS distinct_count,
           CASE WHEN dimension = 'order_date' THEN 'line_chart' WHEN n BETWEEN 2 AND 5 THEN 'pie_chart'
                ELSE 'bar_chart' END AS chart,
           CASE WHEN dimension = 'order_date'
                THEN format('Line chart (dimension ''{}'' represents chronological progression)', dimension)
                WHEN n BETWEEN 2 AND 5
                THEN format('Donut/Pie chart (dimension ''{}'' has low cardinality: {} segments)', dimension, n)
                ELSE format('Comparative Bar chart (dimension ''{}'' has {} distinct categories)', dimension, n)
                END AS reason FROM c
    UNION ALL SELECT 'area_chart', dimension, n, 'area_chart', 'User selected area chart' FROM c"""))
def _(spark, sf):
    dims = ["order_date", "category", "region", "status"]
    df = V.sales(spark, sf, dims)
    parts = [suggest_charts(df, dims, chosen=c).withColumn("asked", F.lit(c)) for c in ("auto", "area_chart")]
    return parts[0].unionByName(parts[1])


# -- SQL and questions ------------------------------------------------------------------------

@query("safe_sql", over("sales", body="""
    SELECT region, count(*) AS n, round(sum(revenue), 2) AS revenue FROM sales
    WHERE quantity >= 20 GROUP BY region"""))
def _(spark, sf):
    return safe_sql(V.sales(spark, sf, ["region", "quantity", "revenue"]), """
        WITH big AS (SELECT * FROM data WHERE quantity >= :least)
        SELECT region, COUNT(*) AS n, ROUND(SUM(revenue), 2) AS revenue FROM big GROUP BY region ORDER BY revenue DESC
        """, {"least": 20})


@query("self_join_sql", over("sales", body="""
    WITH t AS (SELECT order_id, count(*) AS lines, sum(revenue) AS total FROM sales GROUP BY order_id)
    SELECT s.category, count(*) AS n, round(sum(s.revenue / t.total), 4) AS order_share
    FROM sales s JOIN t ON s.order_id = t.order_id WHERE t.lines > 3 GROUP BY s.category"""))
def _(spark, sf):
    return safe_sql(V.sales(spark, sf, ["order_id", "category", "revenue"]), """
        SELECT s.category, COUNT(*) AS n, ROUND(SUM(s.revenue / t.total), 4) AS order_share
        FROM data s JOIN (SELECT order_id, COUNT(*) AS lines, SUM(revenue) AS total FROM data GROUP BY order_id) t
          ON s.order_id = t.order_id
        WHERE t.lines > 3 GROUP BY s.category""")


@query("ask_trend", over("sales", body=f"""
    SELECT strftime(order_date, '%Y-%m') AS month, round({M['total_revenue']}, 2) AS total_revenue
    FROM sales WHERE order_date IS NOT NULL AND region IN ('AMERICA') GROUP BY 1"""))
def _(spark, sf):
    df = V.sales(spark, sf, ["order_date", "region", "quantity", "sale_price"])
    return rounded(questions.trend(df, V.SALES_MODEL, "total_revenue", [("region", "AMERICA")]), total_revenue=2)


@query("ask_list", over("sales", body="""
    SELECT product AS dimension_value, count(*) AS row_count FROM sales GROUP BY product
    ORDER BY row_count DESC, dimension_value LIMIT 15"""))
def _(spark, sf):
    return questions.listing(V.sales(spark, sf, ["product"]), "product")


@query("ask_rank", over("sales", body=f"""
    SELECT product AS dimension_value, round({M['total_profit']}, 2) AS total_profit FROM sales
    WHERE region IN ('ASIA', 'EUROPE') AND status IN ('F') GROUP BY product
    ORDER BY {M['total_profit']} DESC NULLS LAST, dimension_value LIMIT 5"""))
def _(spark, sf):
    df = V.sales(spark, sf, ["product", "region", "status", "quantity", "sale_price", "cost_price"])
    rows = questions.ranking(df, V.SALES_MODEL, "total_profit", "product",
                             [("region", "ASIA"), ("region", "EUROPE"), ("status", "F")])
    return rounded(rows, total_profit=2)


@query("ask_scalar", over("sales", body=f"""
    SELECT round({M['average_order_value']}, 2) AS average_order_value FROM sales WHERE category IN ('PROMO')"""))
def _(spark, sf):
    df = V.sales(spark, sf, ["category", "order_id", "quantity", "sale_price"])
    return rounded(questions.scalar(df, V.SALES_MODEL, "average_order_value", [("category", "PROMO")]),
                   average_order_value=2)
