"""Sources, profile, quantiles, concepts, cleaning and quality on hand-computed inputs."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from metricloom.functions import quantiles as quantile_module
from metricloom.operators import explore
from metricloom.functions.formats import compact_text, hinted_text, kpi_text, month_name, name_tokens, spaced_words
from metricloom.functions.quantiles import column_quantiles
from metricloom.operators import cleaning as cl
from metricloom.operators import quality as q
from metricloom.operators.concepts import CONCEPTS, build_model, concept_candidates, tag_concepts
from metricloom.operators.explore import cursor_after, inspect_record, numbered_pages, page, page_after
from metricloom.operators.profile import behaviour_roles, duplicate_rows, profile, type_roles
from metricloom.sources import files


@pytest.fixture
def dirty(spark):
    return spark.createDataFrame([(101, "New York", "$1,200.00", 2), (102, None, "-50.00", 1), (103, None, "$250.50", 3),
                                  (101, "New York", "$1,200.00", 2)],
                                 "Order_ID long, City string, Sale_Price string, Quantity long")


def test_csv_round_trip(spark, tmp_path):
    source = tmp_path / "in.csv"
    source.write_text("Order ID,When,Name,Price,Flag,Odd\n1,2024-01-15,\"a, b\",1.5,true,7,extra\n"
                      "2,2024-01-16,N/A,-,false,x\n3,2024-01-17,c,2,true\n")
    df = files.read_csv(spark, str(source))
    assert [t for _, t in df.dtypes] == ["bigint", "date", "string", "double", "boolean", "string"]
    rows = df.orderBy("Order ID").collect()
    assert rows[0]["Name"] == "a, b" and rows[1]["Name"] is None and rows[1]["Price"] is None and rows[2]["Odd"] is None
    files.write_clean_parquet(df.toDF(*cl.clean_names(df.columns)), str(tmp_path / "clean"))
    again = files.read_parquet(spark, str(tmp_path / "clean"))
    assert again.count() == 3 and again.columns[0] == "order_id"
    files.write_csv(again, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 3
    assert files.schema_rows(again).filter("is_text").count() == 2


def test_types_fit_every_value(spark, tmp_path):
    df = spark.range(20_000).selectExpr("CASE WHEN id < 15000 THEN CAST(id AS STRING) ELSE 'x' || id END AS v")
    assert files.typed(df).filter("v IS NULL").count() == 0
    source = tmp_path / "in.csv"
    source.write_text('a,b\n1,"two\nlines"\n2,x\n')
    assert [tuple(r) for r in files.read_csv(spark, str(source), multi_line=True).orderBy("a").collect()] == [
        (1, "two\nlines"), (2, "x")]


def test_explorer_csv(spark, tmp_path):
    source = tmp_path / "in.csv"
    source.write_text("a,b,c\n1,true,\"x, y\"\n2,false,\n3,true\n4,1,z,9\n")
    df = files.read_explorer_csv(spark, str(source))
    assert [tuple(r) for r in df.orderBy("a").collect()] == [(1.0, 1.0, "x, y"), (2.0, 0.0, None)]
    assert df.select("a").count() == 2


def test_profile(spark):
    rows = [(101, "2024-01-10", "Laptop", "Electronics", 2, 1200.0), (102, "2024-01-11", "Mouse", "Electronics", 5, 25.0),
            (103, "2024-01-12", "Chair", "Furniture", 1, 150.0), (104, "2024-01-13", "Desk", "Furniture", 2, 300.0)]
    df = spark.createDataFrame(rows, "Order_ID long, Order_Date string, Product string, Category string, Quantity long, "
                                     "Sale_Price double")
    got = {r["column_name"]: r for r in profile(df).collect()}
    assert [got[c]["role"] for c in ("Order_ID", "Order_Date", "Category", "Quantity")] == [
        "id", "time_dimension", "dimension", "measure"]
    assert (got["Quantity"]["min"], got["Quantity"]["max"], got["Quantity"]["mean"]) == (1.0, 5.0, 2.5)
    assert (got["Sale_Price"]["min"], got["Sale_Price"]["max"], got["Sale_Price"]["median"]) == (25.0, 1200.0, 225.0)
    assert got["Sale_Price"]["q25"] == 118.75 and got["Order_Date"]["duration_days"] == 3
    assert got["Quantity"]["sample_values"] == ["1", "2", "5"] and got["Quantity"]["unique_count"] == 3
    assert round(got["Quantity"]["std_dev"], 4) == round(float(np.std([2, 5, 1, 2], ddof=1)), 4)


def test_profile_of_odd_frames(spark):
    df = spark.createDataFrame([(None, [1], True), (None, None, True)], "n double, xs array<int>, b boolean")
    got = {r["column_name"]: r for r in profile(df).collect()}
    assert got["n"]["null_percentage"] == 100.0 and got["n"]["unique_count"] == 1 and got["n"]["min"] is None
    assert got["xs"]["detected_type"] == "unknown" and got["xs"]["null_count"] == 1
    assert got["b"]["detected_type"] == "boolean" and got["b"]["role"] == "dimension"
    big = spark.createDataFrame([(2 ** 60,), (2 ** 60 + 1,)], "k long")
    assert profile(big).first()["unique_count"] == 2
    assert profile(spark.createDataFrame([(1.0,)], "v double")).first()["std_dev"] is None


def test_warnings(spark):
    df = spark.createDataFrame([(101, "New York", 100.0, "ACTIVE"), (102, None, -50.0, "ACTIVE"), (103, None, 200.0, "ACTIVE"),
                                (101, "New York", 100.0, "ACTIVE")], "Order_ID long, City string, Sale_Price double, Status string")
    rows = {(r["column_name"], r["warning_type"]): (r["severity"], r["metric_value"])
            for r in q.quality_warnings(profile(df), duplicate_rows(df)).collect()}
    assert rows == {(None, "duplicate_rows"): ("critical", 1.0), ("City", "missing_values"): ("warning", 50.0),
                    ("Sale_Price", "negative_values"): ("warning", -50.0), ("Status", "constant_column"): ("info", 1.0)}


def test_cleaning_report(dirty):
    row = q.cleaning_report(dirty).first()
    assert row["quality_score"] == 73.8 or row["quality_score"] == 73.7  # 73.75 sits on a half
    assert (row["negative_measures"], row["missing_values"], row["total_rows"], row["dropped_rows"]) == (1, 2, 4, 0)
    clean = cl.clean(dirty)
    assert dict(clean.dtypes)["sale_price"] == "double" and clean.orderBy("order_id").first()["sale_price"] == 1200.0


def test_negative_policies(spark):
    df = spark.createDataFrame([(1, "Mouse", -25.0), (2, "Keyboard", -50.0), (1, "Mouse", -25.0), (3, "Desk", None)],
                               "ID long, Product string, Price double")
    policy = cl.CleaningPolicy(negatives="abs", drop_duplicates=True)
    assert sorted(r["price"] for r in cl.clean(df.na.drop(), policy).collect()) == [25.0, 50.0]
    assert cl.clean(df, cl.CleaningPolicy(negatives="drop_row")).count() == 0  # nulls drop with the negatives
    assert cl.clean(df.filter("ID = 3"), cl.CleaningPolicy(negatives="drop_row")).count() == 1  # no negative, no drop
    assert cl.clean(df, cl.CleaningPolicy(negatives="nullify")).filter("price is null").count() == 4
    with pytest.raises(ValueError):
        cl.CleaningPolicy(negatives="other")


def test_names_and_money(spark):
    assert cl.clean_names(["Order ID #", "Sale Price ($)", "(x)", "order id", "ORDER-ID"]) == [
        "order_id", "sale_price", "col", "order_id_1", "order_id_2"]
    texts = ["$1,200.00", "(50)", " 12% ", "€3", "abc", None, "1e3"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(cl.money_number(F.col("t")).alias("v"))
    assert [r["v"] for r in df.collect()] == [1200.0, -50.0, 12.0, 3.0, None, None, 1000.0]


def test_fill_and_dates(spark):
    df = spark.createDataFrame([(1.0, "a", "2024-01-02"), (None, "b", "03/04/2024"), (4.0, "b", "x"), (7.0, None, None)],
                               "v double, g string, d string")
    assert sorted(r["v"] for r in cl.handle_missing(df, "fill_mean").collect()) == [1.0, 4.0, 4.0, 7.0]
    assert cl.handle_missing(df, "fill_median").filter("v = 4").count() == 2
    assert cl.handle_missing(df, "fill_mode").filter("g = 'b'").count() == 3
    assert cl.handle_missing(df, "fill_mode").filter("v = 1").count() == 2  # tie goes to the smallest
    assert cl.handle_missing(df, "drop_row").count() == 2
    kept = cl.handle_dates(df, ("d",), "coerce_null").collect()
    assert [r["d"] for r in kept] == [dt.datetime(2024, 1, 2), dt.datetime(2024, 3, 4), None, None]
    assert cl.handle_dates(df, ("d",), "drop_row").count() == 3


def test_outliers(spark):
    df = spark.createDataFrame([(n, 10.0 + n) for n in range(1, 21)] + [(21, 5000.0), (22, 6000.0)], "ID long, price double")
    row = q.outliers(df, ["price"]).first()
    assert row["outlier_count"] == 2 and row["sample_outliers"] == [5000.0, 6000.0]
    assert q.outliers(df.limit(9), ["price"]).count() == 0
    assert q.outliers(df.withColumn("price", F.lit(1.0)), ["price"]).count() == 0


def test_quantiles_against_numpy(spark, monkeypatch):
    monkeypatch.setattr(quantile_module, "FEW_ROWS", 20)
    monkeypatch.setattr(quantile_module, "CELLS", 7)
    rng = random.Random(5)
    rows = [(float(rng.randint(-3, 3)), rng.lognormvariate(0, 4), float(n % 3 == 0), rng.gauss(0, 1) if n % 5 else None)
            for n in range(3000)]
    rows.append((float("nan"), 1e12, 0.0, -1e9))
    df = spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(5)
    probs = [0.0, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = {(r["column_name"], r["prob"]): r["quantile"] for r in column_quantiles(df, ["a", "b", "c", "d"], probs).collect()}
    for i, name in enumerate("abcd"):
        values = [r[i] for r in rows if r[i] is not None and r[i] == r[i]]
        for p in probs:
            assert got[name, p] == pytest.approx(float(np.quantile(values, p)), rel=1e-9, abs=1e-12), (name, p)
    assert column_quantiles(df.filter("a > 99"), ["a"], probs).count() == 0


def test_concepts_by_brute_force(spark, sf):
    from metricloom.sources import views as V

    frames = {"sales": V.sales(spark, sf), "hr": V.workforce(spark, sf)}
    parts = [type_roles(df).withColumn("dataset_id", F.lit(n)) for n, df in frames.items()]
    profiles = parts[0].unionByName(parts[1]).cache()
    pairs = concept_candidates(profiles).collect()
    got = {(r["dataset_id"], r["concept"]): r["column_name"] for r in tag_concepts(profiles).collect()}
    want = {}
    for data in frames:
        free = {r["column_name"]: r["position"] for r in profiles.filter(F.col("dataset_id") == data).collect()}
        for concept, _ in CONCEPTS:
            fits = [(-p["confidence"], p["position"], p["column_name"]) for p in pairs
                    if p["dataset_id"] == data and p["concept"] == concept and p["column_name"] in free]
            if fits:
                want[data, concept] = min(fits)[2]
                del free[min(fits)[2]]
    assert got == want and got["hr", "hire_date"] == "hire_date"


def test_model_from_short_headers(spark):
    df = spark.createDataFrame([(2001, dt.date(2024, 2, 1), "Keyboard", 10, 45.0, 20.0, "North"),
                                (2002, dt.date(2024, 2, 2), "Monitor", 2, 300.0, 180.0, "South")],
                               "order_id long, date date, item string, qty long, sp double, cp double, region string")
    model = build_model(type_roles(df))
    assert {c: model.mappings[c] for c in ("order_id", "date", "product", "quantity", "sale_price", "cost_price", "region")} == {
        "order_id": "order_id", "date": "date", "product": "item", "quantity": "qty", "sale_price": "sp",
        "cost_price": "cp", "region": "region"}
    assert model.domain == "sales" and model.dataset_type == "ecommerce_sales"
    assert build_model(type_roles(df), {"region": None}).mappings.get("region") is None


def test_behaviour_roles(spark):
    rows = [(n % 2, f"id{n}", n * 1.5, "2024-01-01", n % 3) for n in range(100)]
    df = spark.createDataFrame(rows, "flag int, key string, price_usd double, day string, kind int")
    got = {r["column_name"]: (r["role"], r["simple_role"], r["unit"]) for r in behaviour_roles(df).collect()}
    assert got == {"flag": ("binary_flag", "boolean", "%"), "key": ("unique_identifier", "identifier", ""),
                   "price_usd": ("continuous_measure", "numeric", "$"), "day": ("temporal_dimension", "categorical", ""),
                   "kind": ("discrete_numeric_dimension", "categorical", "")}


def test_paging(spark):
    df = spark.range(0, 101).withColumnRenamed("id", "k").repartition(4)
    assert [r["k"] for r in page(df, "k", 2, 10).collect()] == list(range(10, 20))
    assert [r["k"] for r in page(df, "k", 10, 10).collect()] == list(range(90, 100))
    assert [r["k"] for r in page(df, "k", 99, 10).collect()] == [100]
    assert page(df.limit(0), "k", 3).count() == 0
    assert [r["k"] for r in page_after(df, "k", 97).collect()] == [98, 99, 100]
    cells = inspect_record(df.withColumn("n", F.lit(None).cast("string")), "k", 5).collect()
    assert [(c["field"], c["value"], c["is_numeric"], c["is_null"]) for c in cells] == [
        ("k", "5", True, False), ("n", None, False, True)]


@pytest.mark.parametrize("size", [2, 7, 1000])
def test_walk_gives_every_row_once(spark, size):
    rows = [(1, "a")] * 9 + [(1, "b")] * 3 + [(None, "c")] * 4 + [(None, "d")] + [(k, "e") for k in (-5, 2, 2, 3)]
    df = spark.createDataFrame(rows, "k long, v string").repartition(3)
    seen, cursor = [], None
    while True:
        part = page_after(df, "k", size=size, cursor=cursor)
        cursor = cursor_after(part, "k", cursor)
        if cursor is None:
            break
        seen += [tuple(r) for r in part.collect()]
    assert sorted(seen, key=str) == sorted(rows, key=str)
    assert [r[0] for r in seen] == sorted((r[0] for r in rows), key=lambda k: (k is None, k or 0))
    assert [r["k"] for r in page_after(df, "k", 2).collect()] == [3] + [None] * 5
    assert page_after(df.limit(0), "k").count() == 0


@pytest.mark.parametrize("dtype", ["long", "string", "double", "date"])
def test_all_pages_at_once_are_those_of_a_walk(spark, monkeypatch, dtype):
    monkeypatch.setattr(explore, "RANGE", 6)
    monkeypatch.setattr(explore, "PICKED", 2)
    key = F.when(F.col("id") % 9 != 0, F.col("id") % 23)
    key = F.date_add(F.lit("2024-01-01").cast("date"), key.cast("int")) if dtype == "date" else key.cast(dtype)
    df = spark.range(200).select(key.alias("k"), (F.col("id") % 4).alias("v")).repartition(5)
    seen, cursor = [], None
    while True:
        part = page_after(df, "k", size=30, cursor=cursor)
        cursor = cursor_after(part, "k", cursor)
        if cursor is None:
            break
        seen.append(sorted(map(tuple, part.collect()), key=str))
    found = numbered_pages(df, "k", 30).collect()
    pages = [sorted(((r["k"], r["v"]) for r in found if r["page"] == n), key=str) for n in range(7)]
    assert pages == seen and len(found) == 200
    assert numbered_pages(df.limit(0), "k").count() == 0


def test_page_walk_takes_no_job_for_each_page(spark, tmp_path):
    from metricloom.catalog import CATALOG

    orders = spark.range(40_000).select(
        F.col("id").alias("o_orderkey"), (F.col("id") % 700).alias("o_custkey"), F.lit("O").alias("o_orderstatus"),
        F.lit(1.0).alias("o_totalprice"), F.lit("2024-01-01").cast("timestamp_ntz").alias("o_orderdate"),
        F.lit("1-URGENT").alias("o_orderpriority"))
    jobs = []
    for rows in (8_000, 40_000):
        orders.limit(rows).write.parquet(f"{tmp_path}/{rows}/orders.parquet")
        group = f"walk-{rows}"
        spark.sparkContext.setJobGroup(group, group)
        found = CATALOG["record_page_walk"].run(spark, f"{tmp_path}/{rows}").collect()
        assert sorted((r["page"], r["records"], r["orders"]) for r in found) == [(n, 4000, 4000) for n in range(rows // 4000)]
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)))
    assert jobs[1] <= jobs[0] + 3


def test_deep_page(spark, monkeypatch):
    monkeypatch.setattr(explore, "PASSED", 10)
    monkeypatch.setattr(quantile_module, "FEW_ROWS", 20)
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"), (F.col("id") % 10).alias("tens"))
    assert [r["k"] for r in page(df, "k", 40, 10).collect()] == list(range(390, 400))
    assert [r["k"] for r in page(df, "k", 99, 10).collect()] == list(range(980, 990))
    assert [r["tens"] for r in page(df, "tens", 11, 50).collect()] == [5] * 50
    holes = df.withColumn("k", F.when(F.col("k") < 500, F.col("k")))
    assert [r["k"] for r in page(holes, "k", 50, 10).collect()] == list(range(490, 500))
    assert [r["k"] for r in page(holes, "k", 60, 10).collect()] == [None] * 10


def test_texts(spark):
    def show(column):
        return spark.range(1).select(column.alias("t")).first()["t"]

    v = lambda x: F.lit(x).cast("double")
    assert [show(kpi_text(v(x))) for x in (None, 1234.0, 12.345, 1234.56)] == ["--", "1,234", "12.35", "1,234.6"]
    assert show(kpi_text(v(1234.56), "currency")) == "$1,234.56" and show(kpi_text(v(5), "duration")) == "5.0 min"
    assert [show(compact_text(v(x), "currency")) for x in (2_500_000, 1500, 12.5, 12)] == ["$2.50M", "$1.5K", "$12.5", "$12"]
    assert [show(compact_text(v(x))) for x in (3e6, 12345.6, 7, 1.239)] == ["3.00M", "12,346", "7", "1.24"]
    assert show(hinted_text(v(0.834), "%", 100)) == "83.4 %" and show(hinted_text(v(1234.5), "$", prefix=True)) == "$1,235"
    assert show(spaced_words(F.lit("DelayMinutesUSDPrice"))) == "Delay Minutes USD Price"
    assert show(name_tokens(F.lit("Sale_PriceUSD"))) == ["sale", "price", "usd"]
    assert [show(month_name(F.lit(x))) for x in ("2", "13", "May")] == ["Feb", "13", "May"]
