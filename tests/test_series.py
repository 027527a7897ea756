"""Series, growth, headline, confidence, forecast and anomalies on hand-computed inputs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from metricloom.model import SemanticModel
from metricloom.operators import timeseries as ts
from metricloom.operators.anomaly import anomalies, explained_anomalies, root_causes
from metricloom.operators.forecast import forecast, forecast_summary
from metricloom.sources.views import SALES_MODEL

SHAPE = "Order_ID long, Order_Date date, Product string, Category string, Quantity long, Sale_Price double"
MODEL = SemanticModel(mappings={"order_id": "Order_ID", "date": "Order_Date", "product": "Product", "category": "Category",
                                "quantity": "Quantity", "sale_price": "Sale_Price"}, dimensions=("Product", "Category"))


def frame(spark, rows):
    return spark.createDataFrame([(n, dt.date.fromisoformat(d), p, c, q, v) for n, (d, p, c, q, v) in enumerate(rows)], SHAPE)


def test_growth(spark):
    df = frame(spark, [("2024-01-15", "Laptop", "E", 1, 1000.0), ("2024-02-15", "Laptop", "E", 2, 1000.0)])
    series = ts.timeseries(df, MODEL, ["total_revenue", "units_sold"], "month")
    assert [tuple(r) for r in series.collect()] == [
        ("2024-01-01", "2024-01", 1000.0, 1.0), ("2024-02-01", "2024-02", 2000.0, 2.0)]
    row = ts.growth(series).filter("metric_id = 'total_revenue'").first()
    assert (row["absolute_change"], row["growth_percentage"], row["trend"]) == (1000.0, 100.0, "up")
    assert ts.auto_granularity(df, MODEL).first()["granularity"] == "week"  # 31 days
    assert ts.timeseries(df, MODEL, ["nope"], "year").columns[2:] == ["total_revenue", "units_sold"]
    with pytest.raises(ValueError):
        ts.timeseries(df, MODEL, granularity="hour")


def test_single_period(spark):
    df = frame(spark, [("2024-01-15", "a", "Electronics", 1, 1000.0), ("2024-01-20", "b", "Furniture", 1, 500.0)])
    row = ts.growth(ts.timeseries(df, MODEL, ["total_revenue"], "month")).first()
    assert row["growth_percentage"] is None and row["trend"] == "flat" and "Insufficient history" in row["note"]
    assert "Insufficient history" in ts.headline(df, MODEL, "total_revenue", "month").first()["headline"]


def test_headline(spark):
    days = [("01-15", "E"), ("01-20", "E"), ("01-22", "F"), ("02-10", "E"), ("02-12", "E"), ("02-15", "F"),
            ("03-05", "E"), ("03-07", "E"), ("03-09", "E"), ("03-12", "F")]
    df = frame(spark, [(f"2024-{d}", "p", "Electronics" if c == "E" else "Furniture", 1, 1000.0 if c == "E" else 500.0)
                       for d, c in days])
    row = ts.headline(df, MODEL, "total_revenue", "month").first()
    assert row["growth_percentage"] == 40.0 and row["headline"] == "Driven by a decline of 33.3% in Electronics."
    flat = frame(spark, [("2024-01-15", "p", "E", 1, 10.0), ("2024-02-15", "p", "E", 1, 10.0)])
    assert "essentially flat" in ts.headline(flat, MODEL, "total_revenue", "month").first()["headline"]
    assert ts.headline(df, MODEL, "average_unit_price", "month").first()["headline"] is None


def test_confidence(spark):
    context = spark.createDataFrame([(12000, 0.5, 0, 0, True), (30, 45.0, 5, 1, False), (0, 0.0, 0, 0, True)],
                                    "row_count long, avg_null_percentage double, warnings long, criticals long, has_periods boolean")
    rows = [(r["confidence_score"], r["confidence_label"]) for r in ts.confidence(context).collect()]
    assert rows == [(100.0, "High confidence"), (24.5, "Low confidence"), (70.0, "Moderate confidence")]


def test_forecast(spark):
    df = frame(spark, [(f"2024-0{m}-01", "Laptop", "E", m + 1, 1000.0) for m in (1, 2, 3)])
    rows = forecast(df, MODEL, "total_revenue", 3, granularity="month").orderBy("step").collect()
    assert [r["predicted_value"] for r in rows] == [5000.0, 6000.0, 7000.0]
    assert [r["period_label"] for r in rows] == ["2024-04", "2024-05", "2024-06"]
    assert (rows[0]["lower_80"], rows[0]["upper_80"]) == (4556.59, 5443.41)
    assert (rows[0]["lower_95"], rows[0]["upper_95"]) == (4321.04, 5678.96)
    assert rows[0]["growth_projected_pct"] == 75.0
    text = forecast_summary(forecast(df, MODEL, "total_revenue", 3, granularity="month"), 3).first()["summary"]
    assert text == ("Forecast projects a upward trajectory with an estimated 75.0% shift over the next 3 periods "
                    "reaching ~$7,000.00.")
    single = forecast(df.limit(1), MODEL, "units_sold", 1, granularity="month").first()
    assert single["predicted_value"] == 2.0 and single["upper_80"] == round(2 + 1.28 * 0.3 * 2 ** 0.5, 2)
    with pytest.raises(ValueError):
        forecast(df, MODEL, "total_revenue", 25)


def test_forecast_by_segment_equals_single(spark):
    df = frame(spark, [(f"2024-0{m}-0{d}", p, "E", m * d, 10.0) for m in (1, 2, 3, 4) for d, p in ((1, "a"), (2, "b"))])
    both = {(r["Product"], r["step"]): r["predicted_value"]
            for r in forecast(df, MODEL, "units_sold", 2, ["Product"], "month").collect()}
    for name in "ab":
        for r in forecast(df.filter(f"Product = '{name}'"), MODEL, "units_sold", 2, granularity="month").collect():
            assert both[name, r["step"]] == r["predicted_value"]


def test_anomalies(spark):
    df = frame(spark, [("2024-01-15", "Laptop", "Electronics", 1, 1000.0), ("2024-02-15", "Laptop", "Electronics", 5, 1000.0),
                       ("2024-02-16", "Mouse", "Electronics", 2, 50.0)])
    rows = {r["metric_id"]: r for r in anomalies(df, MODEL).collect()}
    revenue = rows["total_revenue"]
    assert (revenue["period"], revenue["deviation_percentage"], revenue["z_score"]) == ("2024-02-12", 410.0, 1.0)
    assert (revenue["severity"], revenue["anomaly_type"]) == ("critical", "spike")
    assert rows["units_sold"]["deviation_percentage"] == 600.0
    cause = root_causes(df, MODEL, "total_revenue").first()
    assert (cause["value"], cause["delta"], cause["contribution_percentage"]) == ("Electronics", 4100.0, 100.0)
    text = explained_anomalies(df, MODEL, "total_revenue").first()["explanation"]
    assert text == ("Metric increase of 410.0% in 2024-02 was primarily driven by 'Electronics' in Category "
                    "(100.0% contribution).")


def test_anomalies_need_values_and_two_periods(spark):
    one = frame(spark, [("2024-01-15", "a", "E", 1, 10.0)])
    assert anomalies(one, MODEL, granularity="month").count() == 0
    zero = frame(spark, [("2024-01-15", "a", "E", 0, 10.0), ("2024-02-15", "a", "E", 0, 10.0)])
    assert anomalies(zero, MODEL, granularity="month").count() == 0


def test_segment_missing_in_one_period(spark):
    df = frame(spark, [("2024-01-01", "a", "Old", 10, 1.0), ("2024-02-01", "a", "New", 4, 1.0)])
    rows = {r["value"]: (r["prior_value"], r["current_value"])
            for r in root_causes(df, MODEL, "units_sold", "month").collect()}
    assert rows == {"Old": (10.0, 0.0), "New": (0.0, 4.0)}


def test_headlines_read_a_table_once(spark, tmp_path):
    # Null dates and null segments among the rows: they must stay out, though nothing is filtered before the aggregate.
    days = F.when(F.col("id") % 7 != 0, F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 200).cast("int")))
    spark.range(600).select(
        F.col("id").alias("order_id"), days.cast("timestamp_ntz").alias("order_date"), F.lit(2.0).alias("quantity"),
        (F.col("id") % 5 + 1).cast("double").alias("sale_price"), F.lit(0.5).alias("cost_price"),
        F.when(F.col("id") % 3 != 0, F.concat(F.lit("c"), (F.col("id") % 4).cast("string"))).alias("category")
    ).write.parquet(str(tmp_path / "flat"))
    flat = spark.read.parquet(str(tmp_path / "flat"))
    ids = ["total_revenue", "profit_margin"]
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = ts.headlines(flat, SALES_MODEL, ids)
        assert rows._jdf.queryExecution().executedPlan().toString().count("FileScan") <= 2
        found = {r["metric_id"]: r.asDict() for r in rows.collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    series = ts.timeseries(flat.filter("order_date IS NOT NULL"), SALES_MODEL, ids, "month")
    wanted = {r["metric_id"]: r.asDict() for r in ts.growth(series).collect()}
    assert {m: {k: r[k] for k in wanted[m]} for m, r in found.items()} == wanted and len(found) == 2
    assert found["total_revenue"]["headline"].startswith("Driven by a ") and "None" not in found["total_revenue"]["headline"]
