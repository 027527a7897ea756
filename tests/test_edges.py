"""Empty frames, all-null columns and a key that holds a third of all rows."""

import pytest
from pyspark.sql import functions as F

from metricloom.functions import quantiles
from metricloom.functions.quantiles import column_quantiles
from metricloom.model import SemanticModel
from metricloom.operators import aggregate as A
from metricloom.operators import cleaning as cl
from metricloom.operators import insights
from metricloom.operators import quality as q
from metricloom.operators import timeseries as ts
from metricloom.operators.explore import page
from metricloom.operators.anomaly import anomalies, root_causes
from metricloom.operators.forecast import forecast
from metricloom.operators.geo import geo_breakdown
from metricloom.operators.insights import lowest_margin, pareto
from metricloom.operators.profile import behaviour_roles, duplicate_rows, profile, type_roles
from metricloom.plans.dashboard import Widget, dashboard_data

SHAPE = "day date, city string, qty long, price double, cost double, oid long"
MODEL = SemanticModel(mappings={"date": "day", "city": "city", "category": "city", "quantity": "qty", "sale_price": "price",
                                "cost_price": "cost", "order_id": "oid"}, dimensions=("city",), domain="sales")
WIDGETS = [Widget("k", "kpi_card"), Widget("b", "bar_chart", dimension="city"), Widget("l", "line_chart")]


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SHAPE)


@pytest.fixture(scope="module")
def nulls(spark):
    return spark.createDataFrame([(None, None, None, None, None, None)] * 3, SHAPE)


def test_empty_frame(empty):
    assert A.kpi_summary(empty, MODEL).filter("metric_id = 'total_orders'").first()["value"] == 0
    assert A.what_if(empty, MODEL, [{}]).filter("delta_percentage <> 0").count() == 0
    assert A.compare(empty, empty, MODEL).first()["delta_percentage"] == 0
    for rows in (A.breakdown(empty, MODEL, "city", ["total_revenue"], group_total=True),
                 A.custom_kpi(empty, A.KpiSpec("percent_of_total", "qty", "city")),
                 A.multi_breakdown(empty, MODEL, "total_revenue"), ts.timeseries(empty, MODEL),
                 ts.growth(ts.timeseries(empty, MODEL)), ts.headline(empty, MODEL, "total_revenue"),
                 forecast(empty, MODEL, "total_revenue"), anomalies(empty, MODEL), root_causes(empty, MODEL, "units_sold"),
                 geo_breakdown(empty, MODEL), pareto(empty, MODEL), lowest_margin(empty, MODEL), profile(empty),
                 type_roles(empty), behaviour_roles(empty), q.missing_report(empty), q.outliers(empty, ["qty"]),
                 cl.clean(empty, cl.CleaningPolicy(missing="fill_median", negatives="drop_row"))):
        assert rows.count() == 0
    assert duplicate_rows(empty).first()["duplicate_percentage"] == 0
    assert q.cleaning_report(empty).first()["quality_score"] == 0.0
    assert dashboard_data(empty, MODEL, WIDGETS).filter("key = 'value'").count() <= 1


def test_all_null_frame(nulls):
    assert A.kpi_summary(nulls, MODEL).filter("metric_id = 'profit_margin'").first()["value"] is None
    row = A.breakdown(nulls, MODEL, "city", ["total_revenue"], group_total=True).first()
    assert (row["dimension_value"], row["_row_count"], row["total_distinct_groups"]) == (None, 3, 0)
    assert A.custom_kpi(nulls, A.KpiSpec("count", "*", "city")).count() == 0
    assert ts.timeseries(nulls, MODEL, granularity="month").count() == 0
    assert {r["null_percentage"] for r in profile(nulls).collect()} == {100.0}
    assert q.missing_report(nulls).filter("issue_type = 'high_nulls'").count() == 6
    assert cl.handle_missing(nulls, "fill_mode").filter("city is null").count() == 3
    assert q.outliers(nulls, ["price"]).count() == 0


def test_hot_key(spark):
    # A third of the rows share one city, one order and one price.
    df = spark.range(30000).select(
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 60).cast("int")).alias("day"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("c"), (F.col("id") % 997).cast("string"))).alias("city"),
        F.lit(1).cast("long").alias("qty"), F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.col("id") * 1.0).alias("price"),
        F.lit(1.0).alias("cost"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("oid"))
    top = A.breakdown(df, MODEL, "city", ["units_sold", "total_orders"], limit=1, group_total=True).first()
    assert (top["dimension_value"], top["units_sold"], top["total_orders"], top["total_distinct_groups"]) == (
        "hot", 10000.0, 1.0, 998)
    assert A.multi_breakdown(df, MODEL, "units_sold", ["city"]).first()["value"] == 10000.0
    row = profile(df).filter("column_name = 'price'").first()
    assert row["unique_count"] == 20000 and row["q25"] == 5.0
    assert duplicate_rows(df).first()["duplicate_rows"] == 10000 - 20
    causes = root_causes(df, MODEL, "units_sold", "month", "city")
    assert all(r["value"] == "hot" for r in causes.collect())


def test_infinite_values_have_quantiles(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (float("inf"),), (float("inf"),)], "v double")
    rows = {r["prob"]: r["quantile"] for r in column_quantiles(df, ["v"], [0.25, 1.0]).collect()}
    assert rows == {0.25: 1.75, 1.0: float("inf")}


def test_infinite_and_huge_values_are_searched(spark):
    """Columns of more values than a task orders, with infinities and ranges beyond the largest double."""
    n, inf = quantiles.FEW_ROWS * 2, float("inf")
    value = F.col("id").cast("double")
    df = spark.range(n).select(
        F.when(F.col("id") == 7, inf).otherwise(value).alias("one"),
        F.when(F.col("id") % 3 == 0, -inf).when(F.col("id") % 3 == 1, inf).otherwise(value).alias("many"),
        ((value - n / 2) * (1.7e308 / (n / 2))).alias("huge"), (value * 5e-324).alias("tiny"))
    items = quantiles._columns(df, df.columns, [0.5])
    assert all(i.is_open() for i in items)
    assert all(not i.is_open() for i in quantiles._searched(df, items))
    probs = [0.0, 0.1, 0.5, 0.9, 1.0]
    got = {(r[0], r[1]): r[2] for r in column_quantiles(df, df.columns, probs).collect()}
    data = df.toPandas()
    for name in df.columns:
        ordered = sorted(data[name])
        for p in probs:
            low, part = int(p * (n - 1)), p * (n - 1) % 1
            a, b = ordered[low], ordered[min(low + 1, n - 1)]
            wanted = a if part == 0 or a == b else a * (1 - part) + b * part
            assert got[name, p] == wanted or abs(got[name, p] - wanted) <= max(1e-12 * abs(wanted), 1e-323), (name, p)


def test_pareto_of_many_groups_is_exact(spark, monkeypatch):
    monkeypatch.setattr(insights, "FEW", 100)
    df = spark.range(30_000).selectExpr("concat('c', id) AS city", "CAST(pmod(hash(id), 5000) AS DOUBLE) AS revenue")
    model = SemanticModel(mappings={"revenue": "revenue"}, dimensions=("city",))
    row = insights.pareto(df, model).first()
    values = sorted((r["revenue"] for r in df.collect()), reverse=True)
    assert (row["groups"], row["top_count"]) == (30_000, 6000)
    assert abs(row["top_revenue"] - sum(values[:6000])) < 1e-3 and row["best_revenue"] == values[0]


def test_pages_of_any_key_hold_each_row_once(spark):
    df = spark.range(30_000).selectExpr("id", "'k' || lpad(id % 700, 5, '0') AS t", "id % 3 AS few",
                                        "date_add(DATE'2000-01-01', CAST(id % 9000 AS INT)) AS d")
    for key in ("t", "few", "d"):
        wanted = [r[0] for r in df.orderBy(key).select(key).collect()]
        seen = []
        for number in (1, 2, 350, 351, 750):
            rows = page(df, key, number).collect()
            assert [r[key] for r in rows] == wanted[(number - 1) * 40:number * 40]
            seen += [r["id"] for r in rows]
        assert len(seen) == len(set(seen)) == 200


def test_null_segment_keeps_its_forecast(spark):
    df = spark.createDataFrame([(f"2024-0{m}-01", s, m * (2 if s else 1)) for m in (1, 2, 3) for s in ("a", None)],
                               "day string, seg string, v int").selectExpr("CAST(day AS DATE) AS d", "seg", "v AS revenue")
    model = SemanticModel(mappings={"date": "d", "revenue": "revenue"}, dimensions=("seg",), time_dimensions=("d",))
    rows = forecast(df, model, "total_revenue", 1, ["seg"], "month").collect()
    assert {r["seg"]: r["predicted_value"] for r in rows} == {"a": 8.0, None: 4.0}
