"""The record explorer: search, paging, inspection and its own KPI rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from metricloom.catalog.base import over, query, rounded
from metricloom.operators.aggregate import explorer_kpi
from metricloom.operators.explore import cursor_after, inspect_record, numbered_pages, page, page_after, page_count
from metricloom.operators.filters import search, text_equals
from metricloom.sources import views as V


@query("universal_search", """
    SELECT doc_id, lang, source, n_chars FROM documents
    WHERE contains(lower(CAST(doc_id AS VARCHAR)), 'the') OR contains(lower(text), 'the')
       OR contains(lower(lang), 'the') OR contains(lower(source), 'the') OR contains(CAST(n_chars AS VARCHAR), 'the')""")
def search_documents(spark, sf):
    return search(V.table(spark, sf, "documents"), "THE").drop("text")


@query("universal_search_filtered", """
    SELECT o_orderkey AS order_key, o_totalprice AS price FROM orders
    WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'
      AND (contains(CAST(o_orderkey AS VARCHAR), '77') OR contains(CAST(o_custkey AS VARCHAR), '77'))""")
def _(spark, sf):
    df = V.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    hits = search(df, "77", {"o_orderstatus": "F", "o_orderpriority": "1-URGENT"})
    prices = V.table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"))
    return hits.join(prices, "o_orderkey").select(F.col("o_orderkey").alias("order_key"), "price")


@query("text_equality_any_case", """
    SELECT o_orderpriority AS priority, count(*) AS n FROM orders WHERE lower(o_orderpriority) = '2-high' GROUP BY 1""")
def _(spark, sf):
    rows = text_equals(V.table(spark, sf, "orders"), "o_orderpriority", "2-HIGH", ignore_case=True)
    return rows.groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count(F.lit(1)).alias("n"))


@query("record_page", """
    SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 2) AS o_totalprice FROM orders
    ORDER BY o_orderkey LIMIT 40 OFFSET 240""")
def _(spark, sf):
    df = V.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    return page(df, "o_orderkey", 7)


@query("record_page_last", """
    SELECT c_custkey, c_name FROM customer ORDER BY c_custkey
    LIMIT 15 OFFSET (SELECT (CAST(ceil(count(*) / 15.0) AS BIGINT) - 1) * 15 FROM customer)""")
def _(spark, sf):
    return page(V.table(spark, sf, "customer").select("c_custkey", "c_name"), "c_custkey", 10_000_000, 15)


@query("record_page_text", """
    SELECT c_name, c_custkey FROM customer ORDER BY c_name, c_custkey
    LIMIT 40 OFFSET (SELECT CAST(floor(count(*) / 80) AS BIGINT) * 40 FROM customer)""")
def _(spark, sf):
    df = V.table(spark, sf, "customer").select("c_name", "c_custkey")
    return page(df, "c_name", df.count() // 80 + 1)


@query("record_page_date", """
    SELECT CAST(CAST(d AS DATE) AS VARCHAR) AS day FROM (SELECT o_orderdate AS d FROM orders ORDER BY d
    LIMIT 40 OFFSET (SELECT CAST(least(12000, (ceil(count(*) / 40) - 1) * 40) AS BIGINT) FROM orders))""")
def _(spark, sf):
    rows = V.table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("day"))
    return page(rows, "day", 301).select(F.col("day").cast("string").alias("day"))


@query("record_page_after", """
    SELECT c_custkey, c_name FROM customer WHERE c_custkey > 99 ORDER BY c_custkey LIMIT 40""")
def _(spark, sf):
    return page_after(V.table(spark, sf, "customer").select("c_custkey", "c_name"), "c_custkey", 99)


@query("record_page_walk", """
    SELECT page, count(*) AS records, count(DISTINCT o_orderkey || '-' || o_custkey) AS orders,
           min(o_custkey) AS first_key, max(o_custkey) AS last_key
    FROM (SELECT *, (row_number() OVER (ORDER BY o_custkey) - 1) // 4000 AS page FROM orders) GROUP BY page""")
def _(spark, sf):
    """All orders, page after page by a key that many of them share, and what the walk finds behind the last: nothing."""
    rows = V.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    pages = numbered_pages(rows, "o_custkey", size=4000)
    end = cursor_after(pages.drop("page"), "o_custkey")
    behind = page_after(rows, "o_custkey", size=4000, cursor=end).withColumn("page", F.lit(-1).cast("long"))
    every = pages.unionByName(behind)
    return every.groupBy("page").agg(
        F.count(F.lit(1)).alias("records"), F.countDistinct("o_orderkey", "o_custkey").alias("orders"),
        F.min("o_custkey").alias("first_key"), F.max("o_custkey").alias("last_key"))


@query("record_page_count", """
    SELECT count(*) AS records, CAST(greatest(1, ceil(count(*) / 40.0)) AS BIGINT) AS pages FROM orders
    WHERE o_orderstatus = 'O'""")
def _(spark, sf):
    return page_count(text_equals(V.table(spark, sf, "orders"), "o_orderstatus", "O"))


@query("record_inspector", """
    WITH r AS (SELECT * FROM customer WHERE c_custkey = 42)
    SELECT 1 AS position, 'c_custkey' AS field, CAST(c_custkey AS VARCHAR) AS value, 1 AS is_numeric, 0 AS is_null FROM r
    UNION ALL SELECT 2, 'c_name', c_name, 0, 0 FROM r
    UNION ALL SELECT 3, 'c_nationkey', CAST(c_nationkey AS VARCHAR), 1, 0 FROM r
    UNION ALL SELECT 4, 'c_acctbal', CAST(c_acctbal AS VARCHAR), 1, 0 FROM r
    UNION ALL SELECT 5, 'c_mktsegment', c_mktsegment, 0, 0 FROM r""")
def _(spark, sf):
    rows = inspect_record(V.table(spark, sf, "customer"), "c_custkey", 42)
    return rows.withColumns({c: F.col(c).cast("int") for c in ("is_numeric", "is_null")})


# -- explorer KPIs ----------------------------------------------------------------------------

@query("explorer_kpi_single", """
    SELECT round(avg(o_totalprice), 2) AS value, count(*) AS count FROM orders WHERE o_orderstatus = 'F'""")
def _(spark, sf):
    df = V.table(spark, sf, "orders").select("o_orderstatus", "o_totalprice")
    return rounded(explorer_kpi(df, "value", "o_totalprice", "avg", equals=("o_orderstatus", "F")), value=2)


@query("explorer_kpi_groups", over("sales", body="""
    WITH g AS (SELECT product AS name, sum(revenue) AS v, count(*) AS n FROM sales
               WHERE product IS NOT NULL AND product <> '' GROUP BY product)
    SELECT name, round(v, 2) AS value, n AS count, (SELECT count(*) FROM g) AS total_groups FROM g
    ORDER BY v DESC, name LIMIT 15"""))
def _(spark, sf):
    rows = explorer_kpi(V.sales(spark, sf, ["product", "revenue"]), "value", "revenue", "sum", "product")
    return rounded(rows, value=2)


@query("explorer_kpi_rate", over("sales", body="""
    WITH g AS (SELECT brand AS name, count(*) FILTER (WHERE quantity = 1) * 100.0 / count(*) AS v, count(*) AS n
               FROM sales GROUP BY brand)
    SELECT name, round(v, 4) AS value, n AS count, (SELECT count(*) FROM g) AS total_groups FROM g
    ORDER BY v DESC, name LIMIT 15"""))
def _(spark, sf):
    rows = explorer_kpi(V.sales(spark, sf, ["brand", "quantity"]), "rate", "quantity", dimension="brand")
    return rounded(rows, value=4)


@query("explorer_kpi_months", """
    WITH g AS (SELECT month(o_orderdate) AS m, max(o_totalprice) AS v, count(*) AS n FROM orders GROUP BY 1)
    SELECT ['Jan', 'Feb', 'Mar', 'Apr', 'May', 'Jun', 'Jul', 'Aug', 'Sep', 'Oct', 'Nov', 'Dec'][m] AS name,
           round(v, 2) AS value, n AS count, (SELECT count(*) FROM g) AS total_groups FROM g ORDER BY m LIMIT 15""")
def _(spark, sf):
    df = V.table(spark, sf, "orders").select(F.month("o_orderdate").alias("Month"), "o_totalprice")
    return rounded(explorer_kpi(df, "value", "o_totalprice", "max", "Month"), value=2)


@query("explorer_kpi_lenient", over("clean", body="""
    WITH g AS (SELECT coalesce(segment, 'Unknown') AS name, avg(coalesce(sales_total, 0)) AS v, count(*) AS n
               FROM clean GROUP BY 1)
    SELECT name, round(v, 2) AS value, n AS count, (SELECT count(*) FROM g) AS total_groups FROM g
    ORDER BY v DESC, name LIMIT 30"""))
def _(spark, sf):
    from metricloom.operators.cleaning import clean
    rows = explorer_kpi(clean(V.dirty(spark, sf)), "value", "sales_total", "avg", "segment", lenient=True)
    return rounded(rows, value=2)


@query("explorer_kpi_lenient_rate", over("subscriptions", body="""
    WITH g AS (SELECT CAST(user_id AS VARCHAR) AS name,
                      count(*) FILTER (WHERE churn = 'true') * 100.0 / count(*) AS v, count(*) AS n
               FROM subscriptions WHERE lower(plan) <> '' GROUP BY 1)
    SELECT name, round(v, 4) AS value, n AS count, (SELECT count(*) FROM g) AS total_groups FROM g
    ORDER BY v DESC, name LIMIT 30"""))
def _(spark, sf):
    rows = explorer_kpi(V.subscriptions(spark, sf), "rate", "churn", dimension="user_id", lenient=True)
    return rounded(rows, value=4)
