"""Flat business tables over the normalised star schema.

Every view hangs dimension tables onto a fact table by left joins on the
dimension's primary key. Such a join neither drops nor repeats fact rows, so a
dimension none of whose columns is asked for is not joined at all.

Join strategy is left to Spark: it broadcasts a side only when its size is known to
be under the broadcast threshold, and adaptive execution splits skewed partitions.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metricloom.model import SemanticModel


# Declared schemas: a read then starts no job to look at file footers.
SCHEMAS = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp_ntz",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# -- sales ------------------------------------------------------------------------------------

_SALES = {
    "order_id": "l_orderkey", "order_date": "o_orderdate", "quantity": "l_quantity", "revenue": "l_extendedprice",
    "sale_price": "try_divide(l_extendedprice, l_quantity)", "cost_price": "p_retailprice",
    "discount": "l_extendedprice * l_discount", "product": "p_name", "category": "p_type", "brand": "p_brand",
    "segment": "c_mktsegment", "country": "n_name", "region": "r_name", "status": "o_orderstatus",
}
_FROM_ORDERS = {"order_date", "status", "segment", "country", "region"}
_FROM_PART = {"cost_price", "product", "category", "brand"}
_FROM_CUSTOMER = {"segment", "country", "region"}
_FROM_NATION = {"country", "region"}

SALES_MODEL = SemanticModel(
    mappings={"order_id": "order_id", "date": "order_date", "quantity": "quantity", "revenue": "revenue",
              "sale_price": "sale_price", "cost_price": "cost_price", "discount": "discount",
              "product": "product", "category": "category", "country": "country", "region": "region",
              "status": "status"},
    dimensions=("product", "category", "brand", "segment", "country", "region", "status"),
    measures=("quantity", "revenue", "sale_price", "cost_price", "discount"),
    time_dimensions=("order_date",), identifiers=("order_id",), domain="sales", dataset_type="ecommerce_sales")


def sales(spark: SparkSession, sf_dir: str, columns: Iterable[str] | None = None) -> DataFrame:
    """One row per order line; only the tables behind ``columns`` are joined."""
    columns = list(columns) if columns is not None else list(_SALES)
    wanted = set(columns)
    rows = table(spark, sf_dir, "lineitem")
    if wanted & _FROM_ORDERS:
        orders = table(spark, sf_dir, "orders")
        rows = rows.join(orders, rows["l_orderkey"] == orders["o_orderkey"], "left")
    if wanted & _FROM_PART:
        part = table(spark, sf_dir, "part")
        rows = rows.join(part, rows["l_partkey"] == part["p_partkey"], "left")
    if wanted & _FROM_CUSTOMER:
        customer = table(spark, sf_dir, "customer")
        rows = rows.join(customer, rows["o_custkey"] == customer["c_custkey"], "left")
    if wanted & _FROM_NATION:
        nation = table(spark, sf_dir, "nation")
        rows = rows.join(nation, rows["c_nationkey"] == nation["n_nationkey"], "left")
    if "region" in wanted:
        region = table(spark, sf_dir, "region")
        rows = rows.join(region, rows["n_regionkey"] == region["r_regionkey"], "left")
    return rows.select(*[F.expr(_SALES[c]).alias(c) for c in columns])


# -- other domains ----------------------------------------------------------------------------

WORKFORCE_MODEL = SemanticModel(
    mappings={"employee_id": "employee_id", "department": "department", "salary": "salary", "city": "city",
              "hire_date": "hire_date", "status": "status"},
    dimensions=("department", "city", "status"), measures=("salary",), time_dimensions=("hire_date",),
    identifiers=("employee_id",), domain="human_resources", dataset_type="hr_workforce")


def workforce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer, read as an employee hired on the day of the first order."""
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    first = (table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("hire_date")))
    rows = (customer.join(nation, customer["c_nationkey"] == nation["n_nationkey"], "left")
            .join(first, customer["c_custkey"] == first["o_custkey"], "left"))
    return rows.select(
        F.col("c_custkey").alias("employee_id"), F.col("c_mktsegment").alias("department"),
        F.col("c_acctbal").alias("salary"), F.col("n_name").alias("city"), "hire_date",
        F.when(F.col("c_acctbal") < 0, "inactive").otherwise("active").alias("status"))


SUBSCRIPTIONS_MODEL = SemanticModel(
    mappings={"user_id": "user_id", "subscription_plan": "plan", "mrr": "mrr", "churn": "churn", "date": "event_time"},
    dimensions=("plan", "churn"), measures=("mrr",), time_dimensions=("event_time",), identifiers=("user_id",),
    domain="saas_subscription", dataset_type="saas_analytics")


def subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "user_id", F.col("event_type").alias("plan"), F.col("value").alias("mrr"),
        F.when(F.col("event_type") == "error", "true").otherwise("false").alias("churn"),
        F.col("ts").alias("event_time"))


SHIPMENTS_MODEL = SemanticModel(
    mappings={"shipment_id": "shipment_id", "carrier": "carrier", "weight": "weight"},
    dimensions=("carrier",), measures=("weight",), identifiers=("shipment_id",),
    domain="logistics_supply_chain", dataset_type="logistics_analytics")


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, supplier = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")
    part = table(spark, sf_dir, "part")
    rows = (line.join(supplier, line["l_suppkey"] == supplier["s_suppkey"], "left")
            .join(part, line["l_partkey"] == part["p_partkey"], "left"))
    return rows.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("shipment_id"),
                       F.col("s_name").alias("carrier"), F.col("p_size").alias("weight"))


ENCOUNTERS_MODEL = SemanticModel(
    mappings={"patient_id": "patient_id", "diagnosis": "diagnosis"}, dimensions=("diagnosis",),
    identifiers=("patient_id",), domain="healthcare", dataset_type="patient_records")


def encounters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("patient_id"),
                                                 F.col("event_type").alias("diagnosis"))


# -- input of the cleaning operators ----------------------------------------------------------

def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with the defects the cleaning operators repair.

    Padded names, balances as money text with '(x)' for negatives and gaps, dates as
    text in two forms with unreadable ones, and every tenth row twice.
    """
    customer = table(spark, sf_dir, "customer")
    key, balance = F.col("c_custkey"), F.col("c_acctbal")
    money = F.format_number(F.abs(balance), 2)
    text = F.when(key % 7 == 0, None).when(balance < 0, F.concat(F.lit("("), money, F.lit(")"))).otherwise(
        F.concat(F.lit("$"), money))
    day = (key % 28 + 1).cast("int")
    joined = F.when(key % 11 == 0, F.lit("not a date")).when(
        key % 2 == 0, F.concat(F.lit("2024-03-"), F.lpad(day.cast("string"), 2, "0"))).otherwise(
        F.concat(F.lit("03/"), F.lpad(day.cast("string"), 2, "0"), F.lit("/2024")))
    rows = customer.select(
        key.alias("Cust ID"), F.concat(F.lit("  "), F.col("c_name"), F.lit(" ")).alias("Cust Name"),
        text.alias("Sales Total ($)"), balance.alias("Unit Price"),
        F.when(key % 3 != 0, F.col("c_mktsegment")).alias("Segment"), joined.alias("Joined"),
        F.lit("open").alias("State"), F.when(key % 10 == 0, 2).otherwise(1).alias("copies"))
    return (rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
            .drop("copies", "copy"))
