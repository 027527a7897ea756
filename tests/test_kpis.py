"""Metrics, breakdowns, filters, custom KPIs and formulas on hand-computed inputs."""

import datetime as dt

import pytest

from metricloom.functions.formulas import check_formula, formula_metric
from metricloom.functions.metrics import computable_metrics
from metricloom.model import Filter, SemanticModel, resolve_column
from metricloom.operators import aggregate as A
from metricloom.operators.filters import apply_filters, equality_filters, search, toggle_filter, value_filters
from metricloom.operators.geo import coordinate_columns, geo_breakdown, geo_column
from metricloom.operators.insights import insights, pareto
from metricloom.operators.sqlview import check_sql, safe_sql
from metricloom.plans.dashboard import Widget, dashboard_data, scorecard, suggest_charts

SALES = ("Order_ID long, Order_Date date, Product string, Category string, Quantity long, Sale_Price double, "
         "Cost_Price double, City string, Country string")
MAPPINGS = {"order_id": "Order_ID", "date": "Order_Date", "product": "Product", "category": "Category",
            "quantity": "Quantity", "sale_price": "Sale_Price", "cost_price": "Cost_Price", "city": "City",
            "country": "Country"}
MODEL = SemanticModel(mappings=MAPPINGS, dimensions=("Product", "Category", "City", "Country"),
                      measures=("Quantity", "Sale_Price", "Cost_Price"), identifiers=("Order_ID",), domain="sales")


def day(text):
    return dt.date.fromisoformat(text)


@pytest.fixture(scope="module")
def sales(spark):
    return spark.createDataFrame([
        (1001, day("2024-01-15"), "Laptop", "Electronics", 2, 1200.0, 800.0, "Chicago", "USA"),
        (1002, day("2024-01-16"), "Mouse", "Electronics", 5, 25.0, 10.0, "New York", "USA"),
        (1003, day("2024-01-17"), "Desk", "Furniture", 1, 450.0, 200.0, "Dallas", "USA")], SALES)


@pytest.fixture(scope="module")
def flights(spark):
    rows = [("AA100", "American", "JFK-LAX", 15.0, True, 150, "Jan"), ("AA101", "American", "JFK-LAX", 0.0, False, 170, "Jan"),
            ("DL200", "Delta", "ATL-ORD", 45.0, True, 190, "Jan"), ("DL201", "Delta", "ATL-ORD", 30.0, True, 180, "Feb"),
            ("UA300", "United", "SFO-DEN", 0.0, False, 120, "Feb"), ("UA301", "United", "SFO-DEN", 10.0, True, 140, "Feb")]
    return spark.createDataFrame(rows, "FlightNumber string, Airline string, Route string, DelayMinutes double, "
                                       "IsDelayed boolean, Passengers long, Month string")


def test_kpi_summary(sales):
    rows = {r["metric_id"]: r for r in A.kpi_summary(sales, MODEL).collect()}
    assert rows["total_revenue"]["value"] == 2975.0 and rows["total_revenue"]["formatted_value"] == "$2,975.00"
    assert rows["total_cost"]["value"] == 1850.0 and rows["total_profit"]["value"] == 1125.0
    assert rows["profit_margin"]["formatted_value"] == "37.82%"
    assert rows["units_sold"]["formatted_value"] == "8 units" and rows["total_orders"]["value"] == 3
    assert round(rows["average_order_value"]["value"], 2) == 991.67


def test_kpi_summary_of_nothing(sales):
    rows = {r["metric_id"]: r for r in A.kpi_summary(sales, MODEL, [Filter("City", "eq", "Oslo")]).collect()}
    assert rows["profit_margin"]["value"] is None and rows["profit_margin"]["formatted_value"] == "N/A"
    assert rows["total_orders"]["value"] == 0


def test_breakdown_and_filter(sales):
    rows = A.breakdown(sales, MODEL, "Category", ["total_revenue", "total_profit"], group_total=True).collect()
    assert [(r["dimension_value"], r["total_revenue"], r["total_profit"], r["total_distinct_groups"]) for r in rows] == [
        ("Electronics", 2525.0, 875.0, 2), ("Furniture", 450.0, 250.0, 2)]
    rows = A.breakdown(sales, MODEL, "category", ["total_revenue"], [Filter("city", "in", ["Chicago", "New York"])]).collect()
    assert [(r["dimension_value"], r["total_revenue"]) for r in rows] == [("Electronics", 2525.0)]


def test_breakdown_nulls_last_both_ways(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", None), (None, 2.0)], "g string, v double")
    model = SemanticModel(mappings={"revenue": "v"}, dimensions=("g",))
    for ascending, order in ((True, ["a", None, "b"]), (False, [None, "a", "b"])):
        rows = A.breakdown(df, model, "g", ["total_revenue"], ascending=ascending).collect()
        assert [r["dimension_value"] for r in rows] == order
    with pytest.raises(ValueError):
        A.breakdown(df, model, "g", limit=0)


def test_filters_ignore_malformed_lists(sales):
    for ignored in (Filter("City", "in", []), Filter("City", "in", "Dallas"), Filter("Quantity", "between", [1])):
        assert apply_filters(sales, [ignored]).count() == 3
    assert apply_filters(sales, [Filter("Quantity", "gt", 1.5)]).count() == 2
    assert apply_filters(sales, [Filter("Order_Date", "between", ["2024-01-16", "2024-01-17"])]).count() == 2
    assert apply_filters(sales, [Filter("Quantity", "eq", "not a number")]).count() == 0
    assert apply_filters(sales, [Filter("Product", "like", "%k")]).count() == 1  # the user's % is a wildcard
    assert apply_filters(sales, [Filter("Product", "like", "\\")]).count() == 0
    with pytest.raises(ValueError):
        Filter("City", "resembles", "x")


def test_filter_reaches_the_scan(spark, sf, capsys):
    df = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_quantity", "l_returnflag", "l_tax")
    apply_filters(df, [Filter("l_quantity", "gt", 10), Filter("l_returnflag", "eq", "A")]).explain("formatted")
    text = capsys.readouterr().out
    assert "GreaterThan(l_quantity,10.0)" in text and "EqualTo(l_returnflag,A)" in text


def test_equality_and_value_filters(sales):
    assert apply_filters(sales, equality_filters(MODEL, {"City": "Dallas", "Order_ID": 1003})).count() == 1
    with pytest.raises(ValueError):
        equality_filters(MODEL, {"Quantity": 1})
    filters = value_filters([("City", c) for c in "abcdefg"] + [("Product", "Desk")])
    assert [len(f.value) for f in filters] == [7, 1]


def test_toggle_filter():
    one = toggle_filter([], "City", "Dallas")
    assert toggle_filter(one, "city", "Chicago") == [Filter("City", "eq", "Chicago")]
    assert toggle_filter(one, "City", "Dallas") == []
    assert len(toggle_filter(one, "Country", "USA")) == 2


def test_resolve_column(sales):
    assert resolve_column(sales, "sale price") == "Sale_Price" == resolve_column(sales, "SALEPRICE")
    with pytest.raises(ValueError):
        resolve_column(sales, "nope")


def test_custom_kpi(flights):
    assert A.custom_kpi(flights, A.KpiSpec("avg", "delay minutes", unit="min")).collect()[0].asDict() == {
        "metric_value": 16.67, "formatted_value": "16.67 min"}
    rows = A.custom_kpi(flights, A.KpiSpec("rate", "IsDelayed", "Airline", A.Condition(True))).collect()
    assert [(r["dimension_value"], r["metric_value"], r["formatted_value"]) for r in rows] == [
        ("Delta", 100.0, "100.0%"), ("American", 50.0, "50.0%"), ("United", 50.0, "50.0%")]
    assert A.custom_kpi(flights, A.KpiSpec("rate", "IsDelayed")).first()["metric_value"] == 66.67
    assert A.custom_kpi(flights, A.KpiSpec("percent_of_total", "Passengers")).first()["metric_value"] == 100.0
    with pytest.raises(ValueError):
        A.custom_kpi(flights, A.KpiSpec("sum", "Absent"))


def test_chart_suggestions(flights):
    rows = {r["dimension"]: r["chart"] for r in suggest_charts(flights, ["Airline", "Month", "FlightNumber"]).collect()}
    assert rows == {"Airline": "pie_chart", "Month": "line_chart", "FlightNumber": "bar_chart"}


def test_explorer_kpi(spark, flights):
    rows = A.explorer_kpi(flights, "value", "DelayMinutes", "avg", "Month").collect()
    assert [(r["name"], r["value"], r["count"]) for r in rows] == [("Jan", 20.0, 3), ("Feb", 40 / 3, 3)]
    odd = spark.createDataFrame([("1", "a"), ("x", "a"), (None, None), ("yes", "")], "v string, g string")
    # Strict: text that is no number is skipped, empty counts as 0. Lenient: both count as 0.
    assert A.explorer_kpi(odd, "value", "v").first()["value"] == 0.5
    assert A.explorer_kpi(odd, "value", "v", lenient=True).first()["value"] == 0.25
    groups = A.explorer_kpi(odd, "rate", "v", dimension="g", lenient=True).collect()
    assert {(r["name"], r["value"], r["total_groups"]) for r in groups} == {("a", 50.0, 2), ("Unknown", 50.0, 2)}
    assert A.explorer_kpi(odd, "count", dimension="g").first()["count"] == 2
    assert A.explorer_kpi(odd.limit(0), "count").first()["value"] is None


def test_formula_rules(sales):
    tree, used, calls = check_formula("(Sale_Price - cost_price) / Sale_Price * 100", sales.columns)
    assert used == ["Sale_Price", "Cost_Price"] and not calls
    for formula, message in (("Unknown_Col * 2", "does not exist"), ("Quantity; DROP TABLE users", "Forbidden keyword"),
                             ("", "empty"), ("MEDIAN(Quantity)", "not one of")):
        with pytest.raises(ValueError, match=message):
            formula_metric("x", "X", formula, sales)
    # Without a function each column is summed on its own.
    model = MODEL.with_metric(formula_metric("Rev", "Rev", "Sale_Price * Quantity", sales))
    assert A.kpi_summary(sales, model, metrics=["rev"]).first()["value"] == 1675.0 * 8
    model = model.with_metric(formula_metric("rev", "Rev", "SUM(Sale_Price * Quantity) / (COUNT(*) - 3)", sales))
    assert A.kpi_summary(sales, model, metrics=["rev"]).first()["value"] is None  # zero denominator
    assert len(model.custom_metrics) == 1
    odd = sales.withColumnsRenamed({"Sale_Price": "Sale Price", "Quantity": "class"})
    metric = formula_metric("t", "T", "ROUND(SUM(`Sale Price` * class) - 0.5, 1)", odd)
    assert odd.agg(metric.column()).first()["t"] == 2974.5
    with pytest.raises(ValueError):
        formula_metric("t", "T", "SUM((SELECT 1))", odd)


def test_what_if_and_compare(spark):
    rows = [(1000 + n, day(f"2024-0{n}-01"), "Laptop", "Electronics", n + 1, 1000.0, 600.0, "New York", "USA") for n in (1, 2, 3)]
    df = spark.createDataFrame(rows, SALES)
    setting = {"price_change_pct": 10, "cost_change_pct": -5, "volume_change_pct": 20}
    got = {r["metric_id"]: (r["baseline_value"], r["simulated_value"], r["delta_percentage"])
           for r in A.what_if(df, MODEL, [setting]).collect()}
    assert got == {"total_revenue": (9000.0, 11880.0, 32.0), "total_profit": (3600.0, 5724.0, 59.0),
                   "profit_margin": (40.0, 48.18, 20.5)}
    with pytest.raises(ValueError):
        A.what_if(df, MODEL, [{"price_change_pct": 201}])
    double = df.union(df)
    first = A.compare(df, double, MODEL).orderBy("metric_id").collect()
    assert len(first) == 5 and {r["delta_percentage"] for r in first if r["metric_id"] != "profit_margin"} == {100.0}


def test_domain_metrics(spark):
    hr = spark.createDataFrame([
        ("E101", "Ada Stone", "Engineering", day("2018-05-12"), 125000, 31, "San Francisco"),
        ("E102", "Sam Lee", "Engineering", day("2017-03-01"), 165000, 42, "San Francisco"),
        ("E103", "Jordan Cole", "Sales", day("2019-11-20"), 95000, 29, "New York"),
        ("E104", "Alex Morgan", "Customer Support", day("2021-08-15"), 65000, 36, "Austin"),
        ("E105", "Riley Chen", "Marketing", day("2020-02-10"), 105000, 27, "New York")],
        "Employee_ID string, Employee_Name string, Department string, Hire_Date date, Salary long, Age long, City string")
    model = SemanticModel(mappings={"employee_id": "Employee_ID", "employee_name": "Employee_Name", "city": "City",
                                    "department": "Department", "hire_date": "Hire_Date", "salary": "Salary", "age": "Age"},
                          dimensions=("Department", "City"), domain="human_resources")
    values = {r["metric_id"]: r["value"] for r in A.kpi_summary(hr, model).collect()}
    assert values["total_employees"] == 5 and values["active_departments"] == 4 and values["workforce_locations"] == 3
    assert values["average_salary"] == 111000 and values["average_age"] == 33 and values["hire_rate"] == 100
    assert [r["metric_id"] for r in scorecard(hr, model).orderBy("position").collect()][:3] == [
        "total_employees", "active_departments", "workforce_locations"]
    first = A.multi_breakdown(hr, model, "total_employees").filter("dimension = 'Employee_Name'").collect()
    assert {r["value"] for r in first} == {1.0} and {r["share_percentage"] for r in first} == {20.0}
    generic = computable_metrics(SemanticModel(dimensions=("A b",), measures=("M",)))
    assert list(generic) == ["total_orders", "total_records", "distinct_a_b", "avg_m"]


def test_insights(spark):
    df = spark.createDataFrame([
        (1001, day("2024-01-15"), "Laptop", "Electronics", 1, 1000.0, 700.0, "Chicago", "USA"),
        (1002, day("2024-02-15"), "Laptop", "Electronics", 5, 1000.0, 700.0, "Chicago", "USA"),
        (1003, day("2024-02-16"), "Mouse", "Electronics", 2, 50.0, 20.0, "Dallas", "USA")], SALES)
    top = pareto(df, MODEL).first()
    assert (top["dimension"], top["top_names"], top["concentration_pct"]) == ("Product", "Laptop", 98.4)
    rows = insights(df, MODEL).collect()
    assert [(r["type"], r["impact_score"]) for r in rows] == [("concentration", 85.0), ("growth_driver", 80.0)]
    low = df.withColumn("Cost_Price", df["Sale_Price"] * 0.9)
    assert "risk" in [r["type"] for r in insights(low, MODEL).collect()]
    assert [r["type"] for r in insights(df.limit(0), MODEL).collect()] == ["summary"]


def test_geo(spark):
    df = spark.createDataFrame([(1001, "Laptop", "North America", 2, 1200.0), (1002, "Mouse", "Europe", 5, 25.0),
                                (1003, "Desk", "Europe", 1, 450.0)],
                               "Order_ID long, Product string, Region string, Quantity long, Sale_Price double")
    model = SemanticModel(mappings={"quantity": "Quantity", "sale_price": "Sale_Price"}, dimensions=("Product", "Region"))
    rows = geo_breakdown(df, model).collect()
    assert [(r["region_name"], r["region_code"], r["latitude"], r["metric_value"], r["share_percentage"]) for r in rows] == [
        ("North America", "NA", 40.0, 2400.0, 80.7), ("Europe", "EU", 50.0, 575.0, 19.3)]
    assert geo_column(["x", "Home_City", "Country"], SemanticModel(dimensions=("Region",))) == "Region"
    assert geo_column(["x", "Country", "Home_City"], SemanticModel()) == "Home_City"
    assert coordinate_columns(["a", "Lat", "LONGITUDE"]) == ("Lat", "LONGITUDE")


def test_search(spark):
    df = spark.createDataFrame([(1, "Alpha", "x"), (21, "beta", "X"), (3, None, "gamma")], "k long, a string, b string")
    assert {r["k"] for r in search(df, "A").collect()} == {1, 21, 3}
    assert {r["k"] for r in search(df, "1").collect()} == {1, 21}
    assert search(df, " ", {"b": "x"}).count() == 1 and search(df, "", {"b": "x"}, ignore_case=True).count() == 2
    with pytest.raises(ValueError):
        search(df, "a", {"k": 1, "a": 2, "b": 3})


def test_safe_sql(spark):
    df = spark.createDataFrame([(1, 100), (2, 200)], "id long, val long")
    assert safe_sql(df, "SELECT SUM(val) AS s, COUNT(*) AS n FROM data").first().asDict() == {"s": 300, "n": 2}
    assert safe_sql(df, "select count(*) n from data where 'drop table' <> ''").first()["n"] == 2
    for sql in ("DROP TABLE data", "SELECT 1; SELECT 2 FROM data", "SELECT * FROM other", "SELECT nothing FROM data",
                "WITH x AS (SELECT 1) INSERT INTO t SELECT * FROM x", "SELECT * FROM data, other", "SELECT 1",
                "SELECT reflect('java.lang.System', 'getProperty', 'user.home') FROM data",
                "WITH x AS (TABLE secret) SELECT * FROM x", "WITH secret AS (SELECT * FROM secret) SELECT * FROM secret",
                "SELECT * FROM data a JOIN data b ON a.id = b.id, secret s",
                "SELECT (SELECT max(val) FROM secret) FROM data", "SELECT id FROM data UNION TABLE secret"):
        with pytest.raises(ValueError):
            safe_sql(df, sql)
    check_sql(spark, "SELECT EXTRACT(YEAR FROM d) FROM data WHERE a IS DISTINCT FROM b;")


def test_safe_sql_refuses_what_it_does_not_know(spark, tmp_path):
    df = spark.createDataFrame([(1, 100), (2, 200)], "id long, val long")
    df.write.parquet(str(tmp_path / "files"))
    df.createOrReplaceGlobalTempView("hidden")
    for sql in ("SELECT * FROM data, IDENTIFIER('global_temp.' || 'hidden')",
                f"SELECT * FROM data, IDENTIFIER('parquet.`{tmp_path}/files`')", f"SELECT * FROM data, parquet.`{tmp_path}/files`",
                "SELECT IDENTIFIER('ref' || 'lect')('java.lang.System', 'getProperty', 'user.home') FROM data",
                "SELECT IDENTIFIER(reflect('java.lang.System', 'getProperty', 'user.home')) FROM data",
                "SELECT try_reflect('java.lang.System', 'getProperty', 'user.home') FROM data",
                "EXECUTE IMMEDIATE 'SELECT * FROM global_temp.hidden'", "FROM data |> SELECT IDENTIFIER('i' || 'd')",
                "SELECT * FROM data, range(3)", "SELECT * FROM data, LATERAL (SELECT * FROM global_temp.hidden)",
                "SELECT id FROM data WHERE id IN (SELECT id FROM IDENTIFIER('global_temp.hidden'))",
                "SELECT TRANSFORM(id) USING 'cat' AS (x string) FROM data", "FROM data INSERT INTO t SELECT id",
                "SELECT transform(array(1), x -> reflect('java.lang.System', 'getProperty', 'a')) FROM data"):
        with pytest.raises(ValueError):
            safe_sql(df, sql).collect()


def test_safe_sql_takes_queries_of_all_shapes(spark):
    df = spark.createDataFrame([(1, 100), (2, 200)], "id long, val long")
    for sql, wanted in (
            ("SELECT max(val) OVER (PARTITION BY id % 2 ORDER BY id) AS x FROM data ORDER BY id", [100, 200]),
            ("SELECT id AS x FROM data WHERE id IN (SELECT max(id) FROM data)", [2]),
            ("WITH a AS (SELECT id FROM data), b AS (SELECT * FROM a) SELECT sum(b.id) AS x FROM b JOIN a USING (id)", [3]),
            ("SELECT count(*) AS x FROM data GROUP BY ROLLUP (id) HAVING count(*) > 1", [2]),
            ("SELECT v AS x FROM data LATERAL VIEW explode(array(id, val)) AS v ORDER BY 1 LIMIT 2 OFFSET 1", [2, 100]),
            ("SELECT d.id AS x FROM data d LEFT ANTI JOIN (VALUES (1)) AS t(id) ON d.id = t.id", [2]),
            ("SELECT id AS x FROM data EXCEPT SELECT 1 UNION ALL SELECT DISTINCT 7 FROM data", [2, 7]),
            ("SELECT aggregate(transform(array(id, val), v -> v + 1), 0L, (a, b) -> a + b) AS x FROM data ORDER BY x", [103, 204]),
            ("SELECT CASE WHEN val BETWEEN :low AND 150 THEN date_format(DATE'2024-01-01', 'yyyy') ELSE 'b' END AS x "
             "FROM data ORDER BY id", ["2024", "b"]),
            ("SELECT x FROM data PIVOT (sum(val) AS s FOR id IN (1 AS x))", [100]),
            ("SELECT s.x FROM data, LATERAL (SELECT data.id * 2 AS x) AS s ORDER BY x", [2, 4])):
        assert [r["x"] for r in safe_sql(df, sql, {"low": 1} if ":low" in sql else None).collect()] == wanted, sql


def test_safe_sql_leaves_views_and_names_alone(spark):
    df = spark.createDataFrame([(1, 100), (2, 200)], "copy long, load long")
    spark.createDataFrame([(7,)], "x long").createOrReplaceTempView("data")
    assert safe_sql(df, "SELECT sum(load) AS s FROM data WHERE copy > 1").first()["s"] == 200
    assert safe_sql(df, "WITH x AS (SELECT copy FROM data) SELECT count(*) AS n FROM x, data").first()["n"] == 4
    assert spark.table("data").first()["x"] == 7


def test_rates_and_extremes_of_any_type(spark):
    df = spark.createDataFrame([(1, True, day("2024-01-01")), (0, False, day("2024-03-01")), (1, True, None)],
                               "n int, b boolean, d date")
    for condition in (A.Condition(True, column="n"), A.Condition(1, column="b"), A.Condition(True, column="b")):
        assert A.custom_kpi(df, A.KpiSpec("rate", "n", condition=condition)).first()["metric_value"] == 66.67
    assert apply_filters(df, [Filter("n", "eq", True)]).count() == 2
    assert apply_filters(df, [Filter("b", "in", [0])]).count() == 1
    assert A.custom_kpi(df, A.KpiSpec("max", "d")).first()["metric_value"] is None


def test_pareto_counts_all_groups(spark):
    df = spark.range(1000).selectExpr("'p' || id AS Product", "1L AS Quantity", "1.0D AS Sale_Price")
    model = SemanticModel(mappings={"quantity": "Quantity", "sale_price": "Sale_Price", "product": "Product"})
    top = pareto(df, model, ["Product"]).first()
    assert (top["groups"], top["total_revenue"], top["top_revenue"], top["best_share"]) == (1000, 1000.0, 200.0, 0.1)
    assert len(top["top_names"].split(", ")) == 20


def test_dashboard_matches_single_operators(sales):
    widgets = [Widget("k", "kpi_card", ("profit_margin",)), Widget("b", "bar_chart", ("units_sold",), "Category", limit=1),
               Widget("l", "line_chart", ("units_sold",), granularity="month"),
               Widget("x", "pie_chart", kpi=A.KpiSpec("max", "Quantity", "City"))]
    rows = {(r["widget_id"], r["key"]): r["value"] for r in dashboard_data(sales, MODEL, widgets).collect()}
    assert round(rows["k", "value"], 2) == 37.82 and rows["b", "Electronics"] == 7.0 and ("b", "Furniture") not in rows
    assert rows["l", "2024-01-01"] == 8.0 and rows["x", "New York"] == 5.0
    assert rows["k", "spark_1"] is not None and rows["k", "growth_percentage"] is not None


def test_dashboard_explains_cards_and_survives_a_broken_tile(spark, sales):
    widgets = [Widget("k", "kpi_card", ("total_revenue",)), Widget("m", "kpi_card", ("profit_margin",), granularity="month"),
               Widget("s", "pie_chart", kpi=A.KpiSpec("percent_of_total", "Quantity", "Category")),
               Widget("t", "bar_chart", kpi=A.KpiSpec("sum", "Quantity", "Order_Date")),
               Widget("x", "bar_chart", dimension="nothing"), Widget("y", "bar_chart", kpi=A.KpiSpec("odd", "Quantity"))]
    context = spark.createDataFrame([(5, 0.0, 1, 0)], "row_count long, avg_null_percentage double, warnings long, criticals long")
    rows = dashboard_data(sales, MODEL, widgets, context=context).collect()
    cells = {(r["widget_id"], r["key"]): r for r in rows}
    assert cells["x", "error"]["formatted_value"].startswith("column 'nothing' does not exist")
    assert cells["y", "error"]["formatted_value"] == "unsupported aggregation 'odd'"
    assert ("k", "headline") in cells and cells["k", "trend"]["formatted_value"] in ("up", "down", "flat")
    # 30 % of 30, 35 % of 100, 20 % of 88, 15 % of 100, or of 25 for the single month.
    assert cells["k", "confidence"]["value"] == 76.6 and cells["m", "confidence"]["value"] == 65.4
    assert cells["m", "confidence"]["formatted_value"] == "Moderate confidence"
    assert cells["m", "headline"]["formatted_value"].startswith("Insufficient history")
    assert abs(sum(r["value"] for r in rows if r["widget_id"] == "s") - 100) < 0.1
    days = sorted((r["position"], r["key"]) for r in rows if r["widget_id"] == "t")
    assert [k for _, k in days] == sorted(k for _, k in days)


def test_numeric_time_keys_of_tiles_stay_in_numeric_order(spark):
    df = spark.createDataFrame([(m, 1.0) for m in range(1, 13)], "month int, v double")
    tile = Widget("t", "bar_chart", kpi=A.KpiSpec("sum", "v", "month", limit=11))
    rows = dashboard_data(df, SemanticModel(), [tile]).orderBy("position").collect()
    assert [r["key"] for r in rows] == [str(m) for m in range(1, 12)]


def test_plans_are_built_without_a_job(spark, sales):
    from metricloom.operators import anomaly, forecast, timeseries
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("building", "plans")
    try:
        frames = [timeseries.timeseries(sales, MODEL), timeseries.headline(sales, MODEL, "total_revenue"),
                  forecast.forecast(sales, MODEL, "total_revenue"), anomaly.anomalies(sales, MODEL),
                  anomaly.explained_anomalies(sales, MODEL, "total_revenue"),
                  dashboard_data(sales, MODEL, [Widget("k", "kpi_card"), Widget("l", "line_chart")])]
        assert not tracker.getJobIdsForGroup("building")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert all(f.count() >= 0 for f in frames)


def test_series_by_the_automatic_unit_equals_the_named_one(spark):
    from metricloom.operators.forecast import forecast
    from metricloom.operators.timeseries import timeseries
    model = SemanticModel(mappings={"date": "d", "revenue": "v"}, domain="sales")
    for days, unit in ((20, "day"), (60, "week"), (400, "month"), (1000, "quarter")):
        df = spark.range(days + 1).selectExpr("date_add(date'2023-01-05', int(id)) AS d", "double(id) AS v")
        for run in (lambda g: timeseries(df, model, ["total_revenue"], g),
                    lambda g: forecast(df, model, "total_revenue", 2, granularity=g)):
            assert run(None).collect() == run(unit).collect()
