"""Profiles, roles, cleaning and data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from metricloom.catalog.base import over, query, rounded
from metricloom.functions.quantiles import column_quantiles
from metricloom.operators import cleaning as cl
from metricloom.operators import quality as q
from metricloom.operators.concepts import tag_concepts
from metricloom.operators.concepts import CONCEPTS, DATE_CONCEPTS, NUMERIC_CONCEPTS
from metricloom.operators.profile import dataset_summary, DATE_SHAPES, behaviour_roles, duplicate_rows, profile, type_roles
from metricloom.sources import views as V
from metricloom.sources.files import blank_to_null, explorer_typed, typed

_LINEITEM_NUMBERS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                     "l_discount", "l_tax")


@query("profile_numeric", " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, round(CAST(min({c}) AS DOUBLE), 4) AS min, round(CAST(max({c}) AS DOUBLE), 4) AS max,
        round(avg({c}), 4) AS mean, round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 4) AS median,
        round(stddev_samp({c}), 4) AS std_dev, round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 4) AS q25,
        round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 4) AS q75 FROM lineitem""" for c in _LINEITEM_NUMBERS))
def profile_lineitem(spark, sf):
    rows = profile(V.table(spark, sf, "lineitem")).filter(F.col("detected_type") == "numeric")
    return rows.select("column_name", "min", "max", "mean", "median", "std_dev", "q25", "q75")


_MONEY = ("o_totalprice", "negative_price")


@query("profile_decimal", " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, 'numeric' AS detected_type, round(CAST(min({v}) AS DOUBLE), 4) AS min,
        round(CAST(max({v}) AS DOUBLE), 4) AS max, round(avg(CAST({v} AS DOUBLE)), 4) AS mean FROM orders"""
    for c, v in zip(_MONEY, ("CAST(o_totalprice AS DECIMAL(12, 2))", "CAST(-o_totalprice AS DECIMAL(12, 2))"))))
def _(spark, sf):
    rows = V.table(spark, sf, "orders").select(
        F.col("o_totalprice").cast("decimal(12,2)").alias("o_totalprice"),
        (-F.col("o_totalprice")).cast("decimal(12,2)").alias("negative_price"))
    return profile(rows).select("column_name", "detected_type", "min", "max", "mean")


@query("warnings_decimal", """
    SELECT 'negative_price' AS column_name, 'negative_values' AS warning_type,
           round(CAST(min(CAST(-o_totalprice AS DECIMAL(12, 2))) AS DOUBLE), 4) AS metric_value FROM orders""")
def _(spark, sf):
    rows = V.table(spark, sf, "orders").select((-F.col("o_totalprice")).cast("decimal(12,2)").alias("negative_price"))
    found = q.quality_warnings(profile(rows), duplicate_rows(rows))
    return found.filter("warning_type = 'negative_values'").select("column_name", "warning_type", "metric_value")


@query("csv_typed", """
    SELECT o_orderkey AS key, round(o_totalprice, 2) AS price, CAST(o_orderdate AS DATE) AS day,
           CASE WHEN o_orderkey > (SELECT 0.9 * max(o_orderkey) FROM orders) THEN 'x' ELSE '' END
             || CAST(o_orderkey AS VARCHAR) AS code FROM orders""")
def _(spark, sf):
    orders = V.table(spark, sf, "orders")
    late = F.col("o_orderkey") > orders.agg(F.max("o_orderkey") * 0.9).scalar()
    text = orders.select(
        F.col("o_orderkey").cast("string").alias("key"), F.round("o_totalprice", 2).cast("string").alias("price"),
        F.col("o_orderdate").cast("date").cast("string").alias("day"),
        F.concat(F.when(late, "x").otherwise(""), F.col("o_orderkey").cast("string")).alias("code"))
    return typed(blank_to_null(text))


_DIRTY = ("Cust ID", "Cust Name", "Sales Total ($)", "Unit Price", "Segment", "Joined", "State")


@query("profile_counts", over("dirty", body=" UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, {n} AS position, count(*) AS row_count, count(*) - count("{c}") AS null_count,
        round(100.0 * (count(*) - count("{c}")) / count(*), 2) AS null_percentage,
        count(DISTINCT "{c}") + CAST(count("{c}") < count(*) AS INTEGER) AS unique_count,
        round(100.0 * (count(DISTINCT "{c}") + CAST(count("{c}") < count(*) AS INTEGER)) / count(*), 2)
            AS uniqueness_percentage FROM dirty""" for n, c in enumerate(_DIRTY, 1))))
def _(spark, sf):
    return profile(V.dirty(spark, sf)).select(
        "column_name", "position", "row_count", "null_count", "null_percentage", "unique_count", "uniqueness_percentage")


@query("profile_samples", """
    WITH v AS (SELECT DISTINCT 'o_orderstatus' AS column_name, o_orderstatus AS v, o_orderstatus AS k FROM orders
               UNION ALL SELECT DISTINCT 'o_orderpriority', o_orderpriority, o_orderpriority FROM orders
               UNION ALL SELECT DISTINCT 'o_orderkey', CAST(o_orderkey AS VARCHAR), lpad(CAST(o_orderkey AS VARCHAR), 20, '0')
                         FROM orders
               UNION ALL SELECT DISTINCT 'o_custkey', CAST(o_custkey AS VARCHAR), lpad(CAST(o_custkey AS VARCHAR), 20, '0')
                         FROM orders),
    r AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY k) AS n FROM v)
    SELECT column_name, string_agg(v, '|' ORDER BY n) AS samples FROM r WHERE n <= 5 GROUP BY column_name""")
def _(spark, sf):
    df = V.table(spark, sf, "orders").select("o_orderstatus", "o_orderpriority", "o_orderkey", "o_custkey")
    return profile(df).select("column_name", F.array_join("sample_values", "|").alias("samples"))


@query("profile_dates", """
    SELECT 'o_orderdate' AS column_name, 'datetime' AS detected_type, 'time_dimension' AS role,
           strftime(min(o_orderdate), '%Y-%m-%d') AS min_date, strftime(max(o_orderdate), '%Y-%m-%d') AS max_date,
           CAST(date_diff('day', min(o_orderdate), max(o_orderdate)) AS INTEGER) AS duration_days FROM orders""")
def _(spark, sf):
    rows = profile(V.table(spark, sf, "orders")).filter(F.col("role") == "time_dimension")
    return rows.select("column_name", "detected_type", "role", F.substring("min_date", 1, 10).alias("min_date"),
                       F.substring("max_date", 1, 10).alias("max_date"), "duration_days")


@query("duplicate_rows", over("dirty", body="""
    SELECT (SELECT count(*) FROM dirty) AS row_count, count(*) AS distinct_rows,
           (SELECT count(*) FROM dirty) - count(*) AS duplicate_rows,
           round(100.0 * ((SELECT count(*) FROM dirty) - count(*)) / (SELECT count(*) FROM dirty), 2)
               AS duplicate_percentage FROM (SELECT DISTINCT * FROM dirty)"""))
def _(spark, sf):
    return duplicate_rows(V.dirty(spark, sf))


_ID = ("(^id$|_id$|^id_|_uuid$|_code$|_key$|^sku$|^order_id$|^customer_id$|^product_id$|^transaction_id$)")
_MEASURE = ("(price|cost|sales|revenue|profit|margin|amount|qty|quantity|units|total|discount|rate|fee|tax|salary"
            "|balance|count)")


def _roles_sql(view: str, columns: list[tuple[str, str]]) -> str:
    parts = []
    for n, (name, native) in enumerate(columns, 1):
        column = f'"{name}"'
        shapes = " OR ".join(f"regexp_matches(trim({column}), '{s}')" for s in DATE_SHAPES)
        kind = f"'{native}'" if native != "text" else (
            f"CASE WHEN avg(CASE WHEN {shapes} THEN 1.0 ELSE 0.0 END) "
            f"FILTER (WHERE trim({column}) <> '') >= 0.8 THEN 'date' ELSE 'categorical' END")
        parts.append(f"""SELECT '{name}' AS column_name, {n} AS position, {kind} AS detected_type, count(*) AS n,
            count(DISTINCT {column}) + CAST(count({column}) < count(*) AS INTEGER) AS u FROM {view}""")
    return f"""
    WITH c AS ({" UNION ALL ".join(parts)})
    SELECT column_name, position, detected_type,
           CASE WHEN detected_type IN ('date', 'datetime') THEN 'time_dimension'
                WHEN detected_type = 'boolean' THEN 'dimension'
                WHEN regexp_matches(column_name, '{_ID}', 'i') THEN 'id'
                WHEN detected_type = 'numeric' AND u = n AND n > 10
                     AND NOT regexp_matches(column_name, '{_MEASURE}', 'i') THEN 'id'
                WHEN detected_type = 'numeric' THEN 'measure'
                WHEN u / n >= 0.95 AND n > 20 THEN 'id' ELSE 'dimension' END AS role FROM c"""


_SALES_TYPES = [("order_id", "numeric"), ("order_date", "datetime"), ("quantity", "numeric"), ("revenue", "numeric"),
                ("sale_price", "numeric"), ("cost_price", "numeric"), ("discount", "numeric"), ("product", "text"),
                ("category", "text"), ("brand", "text"), ("segment", "text"), ("country", "text"), ("region", "text"),
                ("status", "text")]


@query("type_roles_sales", over("sales", body=_roles_sql("sales", _SALES_TYPES)))
def _(spark, sf):
    return type_roles(V.sales(spark, sf))


@query("type_roles_dirty", over("dirty", body=_roles_sql("dirty", [
    ("Cust ID", "numeric"), ("Cust Name", "text"), ("Sales Total ($)", "text"), ("Unit Price", "numeric"),
    ("Segment", "text"), ("Joined", "text"), ("State", "text")])))
def _(spark, sf):
    return type_roles(V.dirty(spark, sf))


def _behaviour_sql(view: str, columns: list[str]) -> str:
    parts = []
    for n, name in enumerate(columns, 1):
        v = f'CAST("{name}" AS VARCHAR)'
        filled = f"coalesce({v}, '') <> ''"
        parts.append(f"""SELECT '{name}' AS column_name, {n} AS position, count(*) AS n,
            count(*) FILTER (WHERE {filled}) AS f, count(DISTINCT {v}) FILTER (WHERE {filled}) AS u,
            count(*) FILTER (WHERE {filled} AND TRY_CAST({v} AS DOUBLE) IS NOT NULL) AS numbers,
            count(*) FILTER (WHERE {filled} AND lower({v}) NOT IN
                ('true', 'false', '1', '0', 'yes', 'no', 't', 'f', 'y', 'n')) AS not_flag,
            count(*) FILTER (WHERE {filled} AND (length({v}) < 8 OR TRY_CAST({v} AS TIMESTAMP) IS NULL)) AS not_date,
            count(*) FILTER (WHERE {filled} AND coalesce(TRY_CAST({v} AS DOUBLE), -1) NOT IN (0, 1)) AS not_bit
            FROM {view}""")
    return f"""
    WITH c AS ({" UNION ALL ".join(parts)}),
    d AS (SELECT *, u <= 2 AND not_flag = 0 AS binary_flag, f > 0 AND numbers > 0.85 * f AS is_number,
                 lower(column_name) AS k FROM c)
    SELECT column_name, position,
           CASE WHEN binary_flag THEN 'binary_flag'
                WHEN NOT is_number AND f > 0 AND not_date = 0 THEN 'temporal_dimension'
                WHEN is_number AND u <= 12 AND u < n * 0.05 THEN 'discrete_numeric_dimension'
                WHEN is_number THEN 'continuous_measure'
                WHEN u > 0.85 * f AND u > 30 THEN 'unique_identifier'
                WHEN u <= 5 THEN 'low_cardinality_category' ELSE 'category' END AS role,
           CASE WHEN f = 0 THEN 'identifier' WHEN numbers = f AND u <= 2 AND not_bit = 0 THEN 'boolean'
                WHEN numbers = f AND u > 15 THEN 'numeric' WHEN u > 0.85 * n AND u > 30 THEN 'identifier'
                ELSE 'categorical' END AS simple_role,
           u AS unique_count, n - f AS null_count,
           CASE WHEN regexp_matches(k, 'price|usd|cost|revenue|fare') THEN '$'
                WHEN regexp_matches(k, 'delay|duration|minute') THEN 'min' WHEN regexp_matches(k, 'distance|km') THEN 'km'
                WHEN regexp_matches(k, 'mile') THEN 'mi'
                WHEN binary_flag OR regexp_matches(k, 'factor|rate|pct|percent') THEN '%' ELSE '' END AS unit FROM d"""


@query("behaviour_roles_lineitem", _behaviour_sql("lineitem", [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    "l_returnflag", "l_linestatus", "l_shipdate"]))
def _(spark, sf):
    return behaviour_roles(V.table(spark, sf, "lineitem")).drop("style")


@query("behaviour_roles_dirty", over("dirty", body=_behaviour_sql("dirty", list(_DIRTY))))
def _(spark, sf):
    return behaviour_roles(V.dirty(spark, sf)).drop("style")


_TAGGED = {
    "sales": _SALES_TYPES,
    "workforce": [("employee_id", "numeric"), ("department", "text"), ("salary", "numeric"), ("city", "text"),
                  ("hire_date", "datetime"), ("status", "text")],
    "subscriptions": [("user_id", "numeric"), ("plan", "text"), ("mrr", "numeric"), ("churn", "text"),
                      ("event_time", "datetime")],
    "shipments": [("shipment_id", "text"), ("carrier", "text"), ("weight", "numeric")],
    "encounters": [("patient_id", "numeric"), ("diagnosis", "text")],
    "clean": [("cust_id", "numeric"), ("cust_name", "text"), ("sales_total", "numeric"), ("unit_price", "numeric"),
              ("segment", "text"), ("joined", "text"), ("state", "text")],
}


def _concepts_sql() -> str:
    """Concepts take their best free column in turn: a recursive CTE over each data set's concepts."""
    roles = " UNION ALL ".join(f"SELECT '{v}' AS dataset_id, * FROM ({_roles_sql(v, c)})" for v, c in _TAGGED.items())
    patterns = ", ".join(
        f"({n}, '{concept}', {m}, '{pattern}', {base}, "
        f"'{'numeric' if concept in NUMERIC_CONCEPTS else 'date' if concept in DATE_CONCEPTS else 'any'}')"
        for n, (concept, found) in enumerate(CONCEPTS) for m, (pattern, base) in enumerate(found))
    has = lambda *names: f"list_has_any(concepts, {list(names)})"
    sales, goods = has("sale_price", "quantity", "revenue"), has("product", "category")
    staff = has("department", "employee_id", "job_title", "hire_date", "salary")
    return over(*_TAGGED, body=f"""
    WITH roles AS ({roles}),
    patterns(priority, concept, pattern_no, pattern, base, needs) AS (VALUES {patterns}),
    fits AS (SELECT dataset_id, position, column_name, priority, concept, pattern_no,
                    least(1.0, base + CASE WHEN role = 'measure' AND needs = 'numeric' THEN 0.02
                                           WHEN role = 'dimension' AND needs <> 'numeric' THEN 0.02
                                           WHEN role = 'time_dimension' AND needs = 'date' THEN 0.02 ELSE 0 END) AS conf
             FROM roles JOIN patterns ON regexp_matches(lower(trim(column_name)), pattern)
              AND (needs = 'any' OR (needs = 'numeric' AND detected_type = 'numeric')
                   OR (needs = 'date' AND (detected_type IN ('date', 'datetime') OR role = 'time_dimension')))),
    options AS (SELECT dataset_id, position, column_name, priority, concept,
                       CAST(round(arg_min(conf, pattern_no), 2) AS DOUBLE) AS conf FROM fits GROUP BY ALL),
    turns AS (SELECT dataset_id, concept, row_number() OVER (PARTITION BY dataset_id ORDER BY priority) AS turn,
                     list({{'name': column_name, 'conf': conf}} ORDER BY conf DESC, position) AS choice
              FROM options GROUP BY dataset_id, priority, concept),
    picks AS (SELECT DISTINCT dataset_id, CAST(0 AS BIGINT) AS turn, '' AS concept, '' AS name,
                     CAST(NULL AS DOUBLE) AS conf, CAST([] AS VARCHAR[]) AS taken FROM turns
              UNION ALL
              SELECT dataset_id, turn, concept, best.name, best.conf,
                     CASE WHEN best IS NULL THEN taken ELSE list_append(taken, best.name) END
              FROM (SELECT t.dataset_id, t.turn, t.concept, p.taken,
                           [c FOR c IN t.choice IF NOT list_contains(p.taken, c.name)][1] AS best
                    FROM picks p JOIN turns t ON t.dataset_id = p.dataset_id AND t.turn = p.turn + 1)),
    kept AS (SELECT dataset_id, concept, name, conf FROM picks WHERE turn > 0 AND name IS NOT NULL),
    kinds AS (SELECT dataset_id, list(concept) AS concepts FROM kept GROUP BY dataset_id),
    named AS (SELECT dataset_id, concepts,
                     CASE WHEN {staff} AND NOT {sales} THEN 'human_resources'
                          WHEN {has("user_id", "subscription_plan", "mrr", "churn")} AND NOT {goods}
                          THEN 'saas_subscription'
                          WHEN {has("shipment_id", "carrier", "weight")} AND NOT {sales} THEN 'logistics_supply_chain'
                          WHEN {has("patient_id", "diagnosis")} THEN 'healthcare'
                          WHEN {sales} AND {goods} THEN 'sales' WHEN {sales} THEN 'financial_transactions'
                          WHEN {goods} THEN 'inventory' ELSE 'generic_analytics' END AS domain FROM kinds)
    SELECT dataset_id, concept, name AS column_name, conf AS confidence, domain,
           CASE domain WHEN 'human_resources' THEN 'hr_workforce' WHEN 'saas_subscription' THEN 'saas_analytics'
                WHEN 'logistics_supply_chain' THEN 'logistics_analytics' WHEN 'healthcare' THEN 'patient_records'
                WHEN 'sales' THEN CASE WHEN {has("order_id")} THEN 'ecommerce_sales' ELSE 'retail_sales' END
                WHEN 'financial_transactions' THEN 'financial_sales' WHEN 'inventory' THEN 'product_inventory'
                ELSE 'tabular_data' END AS dataset_type
    FROM kept JOIN named USING (dataset_id)""").replace("WITH ", "WITH RECURSIVE ", 1)


@query("concept_tags", _concepts_sql())
def _(spark, sf):
    """Concepts of six data sets in one job."""
    views = {"sales": V.sales(spark, sf), "workforce": V.workforce(spark, sf),
             "subscriptions": V.subscriptions(spark, sf), "shipments": V.shipments(spark, sf),
             "encounters": V.encounters(spark, sf), "clean": cl.clean(V.dirty(spark, sf))}
    rows = None
    for name, df in views.items():
        part = type_roles(df).withColumn("dataset_id", F.lit(name))
        rows = part if rows is None else rows.unionByName(part)
    return tag_concepts(rows)


# -- cleaning ---------------------------------------------------------------------------------

def _clean_sql(body: str) -> str:
    return over("clean", body=body)


_ROW = "cust_id, cust_name, round({total}, 2) AS sales_total, round({price}, 2) AS unit_price, segment, joined, state"
_PLAIN = _ROW.format(total="sales_total", price="unit_price")


def _cleaned(spark, sf, **policy):
    rows = cl.clean(V.dirty(spark, sf), cl.CleaningPolicy(**policy))
    return rounded(rows, sales_total=2, unit_price=2)


@query("clean_trim", over("dirty", body="""
    SELECT "Cust ID" AS cust_id, trim("Cust Name") AS cust_name, trim("Sales Total ($)") AS sales_total,
           "Unit Price" AS unit_price, trim("Segment") AS segment, trim("Joined") AS joined, trim("State") AS state
    FROM dirty"""))
def _(spark, sf):
    return cl.clean(V.dirty(spark, sf), cl.CleaningPolicy(coerce_currency=False))


@query("clean_currency", _clean_sql(f"SELECT {_PLAIN} FROM clean"))
def _(spark, sf):
    return _cleaned(spark, sf)


@query("clean_negative_abs", _clean_sql(
    f"SELECT {_ROW.format(total='abs(sales_total)', price='abs(unit_price)')} FROM clean"))
def _(spark, sf):
    return _cleaned(spark, sf, negatives="abs")


@query("clean_negative_nullify", _clean_sql("SELECT " + _ROW.format(
    total="CASE WHEN sales_total >= 0 THEN sales_total END", price="CASE WHEN unit_price >= 0 THEN unit_price END")
    + " FROM clean"))
def _(spark, sf):
    return _cleaned(spark, sf, negatives="nullify")


@query("clean_negative_drop", _clean_sql(f"SELECT {_PLAIN} FROM clean WHERE sales_total >= 0 AND unit_price >= 0"))
def _(spark, sf):
    return _cleaned(spark, sf, negatives="drop_row")


@query("clean_dedupe", _clean_sql(f"SELECT DISTINCT {_PLAIN} FROM clean"))
def _(spark, sf):
    return _cleaned(spark, sf, drop_duplicates=True)


@query("clean_drop_missing", _clean_sql(f"""
    SELECT {_PLAIN} FROM clean WHERE sales_total IS NOT NULL AND segment IS NOT NULL AND unit_price IS NOT NULL
      AND cust_id IS NOT NULL AND cust_name IS NOT NULL AND joined IS NOT NULL AND state IS NOT NULL"""))
def _(spark, sf):
    return _cleaned(spark, sf, missing="drop_row")


def _fill_sql(function: str) -> str:
    return _clean_sql("SELECT CAST(cust_id AS DOUBLE) AS cust_id, " + _ROW.format(
        total=f"coalesce(sales_total, (SELECT {function} FROM clean))", price="unit_price").removeprefix("cust_id, ")
        + " FROM clean")


@query("clean_fill_mean", _fill_sql("avg(sales_total)"))
def _(spark, sf):
    return _cleaned(spark, sf, missing="fill_mean")


@query("clean_fill_median", _fill_sql("quantile_cont(sales_total, 0.5)"))
def _(spark, sf):
    return _cleaned(spark, sf, missing="fill_median")


@query("clean_fill_mode", _clean_sql("""
    WITH a AS (SELECT sales_total AS v FROM clean WHERE sales_total IS NOT NULL GROUP BY sales_total
               ORDER BY count(*) DESC, sales_total LIMIT 1),
    b AS (SELECT segment AS v FROM clean WHERE segment IS NOT NULL GROUP BY segment ORDER BY count(*) DESC, segment LIMIT 1)
    SELECT cust_id, cust_name, round(coalesce(sales_total, (SELECT v FROM a)), 2) AS sales_total,
           round(unit_price, 2) AS unit_price, coalesce(segment, (SELECT v FROM b)) AS segment, joined, state
    FROM clean"""))
def _(spark, sf):
    return _cleaned(spark, sf, missing="fill_mode")


_PARSED = """CASE WHEN joined LIKE '%/%' THEN strftime(TRY_STRPTIME(joined, '%m/%d/%Y'), '%Y-%m-%d')
    ELSE strftime(TRY_STRPTIME(joined, '%Y-%m-%d'), '%Y-%m-%d') END"""


@query("clean_invalid_dates", _clean_sql(f"""
    SELECT 'coerce_null' AS policy, {_PARSED} AS joined, count(*) AS n FROM clean GROUP BY 2
    UNION ALL SELECT 'drop_row', {_PARSED}, count(*) FROM clean WHERE {_PARSED} IS NOT NULL GROUP BY 2"""))
def _(spark, sf):
    rows = None
    for policy in cl.DATE_POLICIES:
        part = cl.clean(V.dirty(spark, sf), cl.CleaningPolicy(date_columns=("joined",), invalid_dates=policy))
        part = (part.groupBy(F.date_format("joined", "yyyy-MM-dd").alias("joined")).agg(F.count(F.lit(1)).alias("n"))
                .select(F.lit(policy).alias("policy"), "joined", "n"))
        rows = part if rows is None else rows.unionByName(part)
    return rows


# -- quality reports --------------------------------------------------------------------------

@query("missing_report", over("dirty", body="""
    WITH c AS (SELECT count(*) AS n, count(*) - count("Sales Total ($)") AS a, count(*) - count("Segment") AS b FROM dirty),
    r AS (SELECT 'Sales Total ($)' AS column_name, a AS k, n FROM c UNION ALL SELECT 'Segment', b, n FROM c)
    SELECT column_name, CASE WHEN round(100.0 * k / n, 2) > 50 THEN 'high_nulls' ELSE 'missing_values' END AS issue_type,
           k AS affected_rows, round(100.0 * k / n, 2) AS affected_percentage FROM r WHERE k > 0"""))
def _(spark, sf):
    return q.missing_report(V.dirty(spark, sf)).drop("description")


_ISSUES = """
    WITH c AS (SELECT count(*) AS n, count(*) FILTER (WHERE sales_total < 0) AS neg_total,
                      count(*) FILTER (WHERE unit_price < 0) AS neg_price, count(*) - count(sales_total) AS no_total,
                      count(*) - count(segment) AS no_segment,
                      count(*) FILTER (WHERE joined = 'not a date') AS bad_date FROM clean),
    r AS (SELECT 'sales_total' AS column_name, 'negative_measure' AS issue_type, neg_total AS k, n FROM c
          UNION ALL SELECT 'unit_price', 'negative_measure', neg_price, n FROM c
          UNION ALL SELECT 'sales_total', 'missing_values', no_total, n FROM c
          UNION ALL SELECT 'segment', 'missing_values', no_segment, n FROM c
          UNION ALL SELECT 'joined', 'invalid_date', bad_date, n FROM c),
    i AS (SELECT column_name, issue_type, k AS affected_rows, round(100.0 * k / n, 2) AS affected_percentage
          FROM r WHERE k > 0)"""


@query("column_issues", over("clean", body=_ISSUES + " SELECT * FROM i"))
def _(spark, sf):
    return q.column_issues(V.dirty(spark, sf), cl.CleaningPolicy(date_columns=("joined",))).drop("description")


@query("quality_score", over("clean", body=_ISSUES + """,
    p AS (SELECT sum(CASE issue_type WHEN 'missing_values' THEN least(affected_percentage * 0.15, 8.0)
                     ELSE least(affected_percentage * 0.25, 10.0) END) AS lost, count(*) AS issue_count FROM i),
    d AS (SELECT (SELECT count(*) FROM dirty) AS n, (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty)) AS u)
    SELECT n AS total_rows, n - u AS duplicate_rows, issue_count,
           greatest(0.0, round(100.0 - least(100.0 * (n - u) / n * 0.5, 20.0) - lost, 1)) AS quality_score
    FROM d CROSS JOIN p"""))
def score(spark, sf):
    return q.quality_score(V.dirty(spark, sf), cl.CleaningPolicy(date_columns=("joined",)))


@query("cleaning_report", over("clean", body="""
    WITH d AS (SELECT (SELECT count(*) FROM dirty) AS n, (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty)) AS u,
                      (SELECT count(*) FROM (SELECT DISTINCT * FROM clean)) AS c),
    s AS (SELECT count(*) FILTER (WHERE sales_total < 0) + count(*) FILTER (WHERE unit_price < 0) AS neg,
                 2 * count(*) - count(sales_total) - count(segment) AS missing FROM clean)
    SELECT n AS total_rows, c AS clean_rows, n - c AS dropped_rows, n - u AS duplicate_rows,
           neg AS negative_measures, missing AS missing_values FROM d CROSS JOIN s"""))
def _(spark, sf):
    return q.cleaning_report(V.dirty(spark, sf), cl.CleaningPolicy(drop_duplicates=True)).drop(
        "quality_score", "malformed_numerics", "invalid_dates")


def _actions_sql(*more: str) -> str:
    """The first two actions, and selects of (place, sentence) behind them."""
    rows = " UNION ALL ".join(f"SELECT * FROM ({m})" for m in more)
    return over("clean", body=f"""
    WITH k AS (SELECT * REPLACE ({{}}) FROM clean), a AS (
        SELECT 1 AS place, 'Standardized 7 column names to snake_case.' AS action
        UNION ALL SELECT 2, 'Coerced formatted strings in measure column ''sales_total'' to numeric Float64.'
        UNION ALL {rows})
    SELECT CAST(row_number() OVER (ORDER BY place) AS INTEGER) AS position, action FROM a""")


_ACTIONS = {
    "abs": ("Converted ", " to absolute values.", "abs({0})"),
    "nullify": ("Nullified ", ".", "CASE WHEN {0} >= 0 THEN {0} END"),
}


def _actions_query(policy: str) -> None:
    before, behind, change = _ACTIONS[policy]
    counted = [f"SELECT {n} AS place, '{before}' || count(*) || ' negative values in ''{c}''{behind}' AS action "
               f"FROM clean WHERE {c} < 0 HAVING count(*) > 0" for n, c in ((3, "sales_total"), (4, "unit_price"))]
    changed = ", ".join(f"{change.format(c)} AS {c}" for c in ("sales_total", "unit_price"))

    @query(f"cleaning_actions_{policy}", _actions_sql(*counted, """
        SELECT 5 AS place, 'Removed ' || (count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM k)))
               || ' exact duplicate records.' AS action FROM k
        HAVING count(*) > (SELECT count(*) FROM (SELECT DISTINCT * FROM k))""").replace("{}", changed))
    def _(spark, sf):
        return q.cleaning_actions(V.dirty(spark, sf), cl.CleaningPolicy(negatives=policy, drop_duplicates=True))


for _policy in _ACTIONS:
    _actions_query(_policy)


@query("dataset_summary", over("dirty", body="""
    SELECT count(*) AS row_count, 7 AS column_count,
           count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty)) AS duplicate_rows,
           round(100.0 * (count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty))) / count(*), 2)
               AS duplicate_percentage FROM dirty"""))
def _(spark, sf):
    return dataset_summary(V.dirty(spark, sf))


def _outlier_sql(column: str, table: str) -> str:
    return f"""
    SELECT '{column}' AS column_name, 'IQR' AS method, round(lo, 4) AS lower_bound, round(hi, 4) AS upper_bound,
           count(*) FILTER (WHERE x < lo OR x > hi) AS outlier_count,
           round(100.0 * count(*) FILTER (WHERE x < lo OR x > hi) / count(*), 2) AS outlier_percentage
    FROM (SELECT CAST({column} AS DOUBLE) AS x FROM {table} WHERE {column} IS NOT NULL)
    CROSS JOIN (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM (
        SELECT quantile_cont(CAST({column} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({column} AS DOUBLE), 0.75) AS q3
        FROM {table}))
    GROUP BY lo, hi HAVING count(*) FILTER (WHERE x < lo OR x > hi) > 0 AND count(*) >= 10"""


@query("iqr_outliers", _outlier_sql("value", "events"))
def outlier_events(spark, sf):
    return q.outliers(V.table(spark, sf, "events"), ["value"]).drop("sample_outliers")


@query("iqr_outliers_many", " UNION ALL ".join(
    f"SELECT * FROM ({_outlier_sql(c, 'lineitem')})" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")))
def _(spark, sf):
    columns = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    return q.outliers(V.table(spark, sf, "lineitem"), columns).drop("sample_outliers")


@query("iqr_outlier_samples", """
    WITH b AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events),
    o AS (SELECT round(value, 4) AS value FROM events CROSS JOIN b
          WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) ORDER BY value LIMIT 5)
    SELECT 'value' AS column_name, string_agg(format('{:.2f}', value), '|' ORDER BY value) AS samples FROM o""")
def _(spark, sf):
    text = F.transform("sample_outliers", lambda v: F.format_number(v, 2))
    rows = q.outliers(V.table(spark, sf, "events"), ["value"])
    return rows.select("column_name", F.array_join(text, "|").alias("samples"))


@query("quality_warnings", over("dirty", body="""
    WITH c AS (SELECT count(*) AS n, count(*) - count("Sales Total ($)") AS a, count(*) - count("Segment") AS b,
                      min("Unit Price") AS low, count(DISTINCT "Segment") + 1 AS segments,
                      count(DISTINCT "Sales Total ($)") + 1 AS totals, count(DISTINCT "Cust Name") AS names
               FROM dirty),
    d AS (SELECT n, n - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty)) AS copies FROM c),
    r AS (SELECT CAST(NULL AS VARCHAR) AS column_name, 'duplicate_rows' AS warning_type,
                 CASE WHEN round(100.0 * copies / n, 2) > 20 THEN 'critical' ELSE 'warning' END AS severity,
                 CAST(copies AS DOUBLE) AS metric_value FROM d WHERE copies > 0
          UNION ALL SELECT 'Sales Total ($)', 'missing_values', 'warning', round(100.0 * a / n, 2) FROM c
          UNION ALL SELECT 'Segment', 'missing_values', 'warning', round(100.0 * b / n, 2) FROM c
          UNION ALL SELECT 'Unit Price', 'negative_values', 'warning', round(low, 4) FROM c WHERE low < 0
          UNION ALL SELECT 'State', 'constant_column', 'info', 1.0 FROM c
          UNION ALL SELECT 'Sales Total ($)', 'high_cardinality', 'info', totals FROM c
                    WHERE totals > 500 AND round(100.0 * totals / n, 2) > 70 AND totals / n < 0.95
          UNION ALL SELECT 'Cust Name', 'high_cardinality', 'info', names FROM c
                    WHERE names > 500 AND round(100.0 * names / n, 2) > 70 AND names / n < 0.95)
    SELECT * FROM r"""))
def _(spark, sf):
    df = V.dirty(spark, sf)
    return q.quality_warnings(profile(df), duplicate_rows(df)).drop("message")


@query("quantiles_infinite", """
    WITH v AS (SELECT CASE WHEN l_discount > 0 THEN CAST(l_extendedprice AS DOUBLE) / CAST(l_discount AS DOUBLE)
                           WHEN l_linenumber = 1 THEN CAST('-Infinity' AS DOUBLE)
                           ELSE CAST('Infinity' AS DOUBLE) END AS price FROM lineitem)
    SELECT 'price' AS column_name, 0.2 AS prob, round(quantile_cont(price, 0.2), 4) AS quantile FROM v
    UNION ALL SELECT 'price', 0.5, round(quantile_cont(price, 0.5), 4) FROM v
    UNION ALL SELECT 'price', 0.75, round(quantile_cont(price, 0.75), 4) FROM v""")
def _(spark, sf):
    """Quotients by a discount that can be none, so that the column holds infinities of both signs."""
    lines = V.table(spark, sf, "lineitem").select(F.when(
        F.col("l_discount") > 0, F.try_divide(F.col("l_extendedprice").cast("double"), F.col("l_discount").cast("double")))
        .when(F.col("l_linenumber") == 1, F.lit(float("-inf"))).otherwise(F.lit(float("inf"))).alias("price"))
    return column_quantiles(lines, ["price"], [0.2, 0.5, 0.75]).select(
        "column_name", "prob", F.round("quantile", 4).alias("quantile"))


@query("explorer_csv_typed", """
    SELECT c_custkey AS number, CAST(c_custkey % 2 = 0 AS DOUBLE) AS flag,
           CASE WHEN c_custkey % 5 > 0 THEN CAST(c_custkey % 3 = 0 AS DOUBLE) ELSE c_acctbal END AS both,
           nullif(CASE WHEN c_custkey % 7 = 0 THEN 'n/a' ELSE CAST(c_acctbal AS VARCHAR) END, '') AS mixed,
           CASE WHEN c_custkey % 4 > 0 THEN c_name END AS name FROM (
        SELECT CAST(c_custkey AS DOUBLE) AS c_custkey, CAST(c_acctbal AS DOUBLE) AS c_acctbal, c_name FROM customer)""")
def _(spark, sf):
    """Customers as cells of text with blanks, true and false, read back by the explorer's rules."""
    key, balance = F.col("c_custkey"), F.col("c_acctbal").cast("double")
    flag = lambda condition: F.when(condition, " TRUE ").otherwise("false")
    cells = V.table(spark, sf, "customer").select(
        F.concat(F.lit(" "), key.cast("string")).alias("number"), flag(key % 2 == 0).alias("flag"),
        F.when(key % 5 > 0, flag(key % 3 == 0)).otherwise(balance.cast("string")).alias("both"),
        F.when(key % 7 == 0, "n/a").otherwise(balance.cast("string")).alias("mixed"),
        F.when(key % 4 > 0, F.col("c_name")).otherwise("  ").alias("name"))
    return explorer_typed(cells)
