"""Registration of queries, and the views as SQL text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


CATALOG: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register ``run(spark, sf_dir)`` under a name, with its SQL twin if there is one."""

    def register(run):
        if name in CATALOG:
            raise ValueError(f"query {name} is registered twice")
        CATALOG[name] = Query(run, sql)
        return run

    return register


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    """Round the named columns, so that float sums compare across engines."""
    return df.withColumns({c: F.round(c, d) for c, d in digits.items()})


def r2(name: str) -> Column:
    return F.round(name, 2).alias(name)


VIEWS = {
    "sales": """
        SELECT l_orderkey AS order_id, o_orderdate AS order_date, l_quantity AS quantity,
               l_extendedprice AS revenue, l_extendedprice / nullif(l_quantity, 0) AS sale_price,
               p_retailprice AS cost_price, l_extendedprice * l_discount AS discount, p_name AS product,
               p_type AS category, p_brand AS brand, c_mktsegment AS segment, n_name AS country,
               r_name AS region, o_orderstatus AS status
        FROM lineitem
        LEFT JOIN orders ON l_orderkey = o_orderkey
        LEFT JOIN part ON l_partkey = p_partkey
        LEFT JOIN customer ON o_custkey = c_custkey
        LEFT JOIN nation ON c_nationkey = n_nationkey
        LEFT JOIN region ON n_regionkey = r_regionkey""",
    "workforce": """
        SELECT c_custkey AS employee_id, c_mktsegment AS department, c_acctbal AS salary, n_name AS city,
               hire_date, CASE WHEN c_acctbal < 0 THEN 'inactive' ELSE 'active' END AS status
        FROM customer
        LEFT JOIN nation ON c_nationkey = n_nationkey
        LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS hire_date FROM orders GROUP BY o_custkey)
               ON c_custkey = o_custkey""",
    "subscriptions": """
        SELECT user_id, event_type AS plan, value AS mrr,
               CASE WHEN event_type = 'error' THEN 'true' ELSE 'false' END AS churn, ts AS event_time
        FROM events""",
    "shipments": """
        SELECT l_orderkey || '-' || l_linenumber AS shipment_id, s_name AS carrier, p_size AS weight
        FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN part ON l_partkey = p_partkey""",
    "encounters": "SELECT user_id AS patient_id, event_type AS diagnosis FROM events",
    "dirty": """
        SELECT c_custkey AS "Cust ID", '  ' || c_name || ' ' AS "Cust Name",
               CASE WHEN c_custkey % 7 = 0 THEN NULL
                    WHEN c_acctbal < 0 THEN '(' || format('{:,.2f}', abs(c_acctbal)) || ')'
                    ELSE '$' || format('{:,.2f}', c_acctbal) END AS "Sales Total ($)",
               c_acctbal AS "Unit Price",
               CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS "Segment",
               CASE WHEN c_custkey % 11 = 0 THEN 'not a date'
                    WHEN c_custkey % 2 = 0 THEN '2024-03-' || lpad(CAST(c_custkey % 28 + 1 AS VARCHAR), 2, '0')
                    ELSE '03/' || lpad(CAST(c_custkey % 28 + 1 AS VARCHAR), 2, '0') || '/2024' END AS "Joined",
               'open' AS "State"
        FROM customer CROSS JOIN (SELECT unnest([1, 2]) AS copy)
        WHERE copy = 1 OR c_custkey % 10 = 0""",
    # The dirty view with clean names, trimmed text and numbers read from money text.
    "clean": r"""
        SELECT "Cust ID" AS cust_id, trim("Cust Name") AS cust_name,
               TRY_CAST(regexp_replace(regexp_replace("Sales Total ($)", '[$,€£¥%]', '', 'g'),
                                       '\((.*?)\)', '-\1', 'g') AS DOUBLE) AS sales_total,
               "Unit Price" AS unit_price, trim("Segment") AS segment, trim("Joined") AS joined,
               trim("State") AS state
        FROM dirty""",
}
_NEEDS = {"clean": ("dirty",)}


def over(*views: str, body: str) -> str:
    """SQL with the named views as leading CTEs; ``body`` may bring CTEs of its own."""
    names: list[str] = []
    for view in views:
        names += [n for n in (*_NEEDS.get(view, ()), view) if n not in names]
    ctes = ", ".join(f"{n} AS ({VIEWS[n]})" for n in names)
    body = body.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes}, {body[5:]}"
    return f"WITH {ctes} {body}"


# Metric formulas of the sales view, as SQL aggregates.
SALES_METRICS = {
    "total_revenue": "sum(quantity * sale_price)",
    "total_cost": "sum(quantity * cost_price)",
    "total_profit": "sum((sale_price - cost_price) * quantity)",
    "profit_margin": "100.0 * sum((sale_price - cost_price) * quantity) / nullif(sum(sale_price * quantity), 0)",
    "units_sold": "sum(quantity)",
    "total_orders": "CAST(count(DISTINCT order_id) AS DOUBLE)",
    "average_order_value": "sum(quantity * sale_price) / nullif(count(DISTINCT order_id), 0)",
    "average_unit_price": "avg(sale_price)",
    "total_discount": "sum(discount)",
    "max_order_value": "max(quantity * sale_price)",
    "avg_profit_per_order": "sum((sale_price - cost_price) * quantity) / nullif(count(DISTINCT order_id), 0)",
    "units_per_order": "sum(quantity) / nullif(count(DISTINCT order_id), 0)",
    "discount_rate": "100.0 * sum(discount) / nullif(sum(quantity * sale_price) + sum(discount), 0)",
    "active_products": "CAST(count(DISTINCT product) AS DOUBLE)",
}
SALES_FORMATS = {
    "total_revenue": "${:,.2f}", "total_cost": "${:,.2f}", "total_profit": "${:,.2f}", "profit_margin": "{:.2f}%",
    "units_sold": "{:,.0f} units", "total_orders": "{:,.0f}", "average_order_value": "${:,.2f}",
    "average_unit_price": "${:,.2f}", "total_discount": "${:,.2f}", "max_order_value": "${:,.2f}",
    "avg_profit_per_order": "${:,.2f}", "units_per_order": "{:.1f} items", "discount_rate": "{:.2f}%",
    "active_products": "{:,.0f}",
}


def metric_rows(view: str, metrics: dict[str, str], formats: dict[str, str] | None = None, where: str = "") -> str:
    """One aggregate of a view as rows (metric_id, value[, formatted_value])."""
    columns = ", ".join(f"{sql} AS {name}" for name, sql in metrics.items())
    rows = " UNION ALL ".join(
        f"SELECT '{name}' AS metric_id, round(CAST({name} AS DOUBLE), 2) AS value"
        + (f", coalesce(format('{formats[name]}', {name}), 'N/A') AS formatted_value" if formats else "")
        + " FROM totals" for name in metrics)
    return over(view, body=f"WITH totals AS (SELECT {columns} FROM {view} {where}) {rows}")
