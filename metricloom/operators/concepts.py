"""Business concepts: which column is the price, the order id, the hire date, and so on."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricloom.model import SemanticModel

# Fixed values, in the order in which concepts choose their column: concept, then
# (name pattern, confidence), best pattern first. Patterns meet the lower-case name.
CONCEPTS = (
    ("employee_id", ((r"^(employee_?id|emp_?id|staff_?id|worker_?id|badge_?num|person_?id)$", 0.98),)),
    ("employee_name", ((r"^(employee_?name|emp_?name|staff_?name|worker_?name|full_?name|person_?name)$", 0.98),
                       (r"^(name|employee)$", 0.85))),
    ("department", ((r"^(department|dept|business_?unit|division|team|group|org_?unit)$", 0.98),)),
    ("job_title", ((r"^(job_?title|title|role|position|designation|job_?role|occupation)$", 0.98),)),
    ("hire_date", ((r"^(hire_?date|start_?date|join_?date|onboarding_?date|employment_?date)$", 0.98),)),
    ("salary", ((r"^(salary|annual_?salary|monthly_?salary|compensation|base_?pay|wage|hourly_?rate)$", 0.98),)),
    ("salary_band", ((r"^(salary_?band|pay_?band|comp_?band|grade)$", 0.98),)),
    ("order_id", ((r"^(order_?id|invoice_?id|invoice_?num|invoice_?number|transaction_?id|tx_?id|order_?number"
                   r"|order_?num)$", 0.98),
                  (r"^(id|order|invoice|txn_?id)$", 0.80))),
    ("user_id", ((r"^(user_?id|account_?id|subscriber_?id|member_?id)$", 0.98),)),
    ("shipment_id", ((r"^(shipment_?id|tracking_?number|tracking_?id|parcel_?id|package_?id)$", 0.98),)),
    ("patient_id", ((r"^(patient_?id|mrn|medical_?record_?number|subject_?id)$", 0.98),)),
    ("date", ((r"^(order_?date|trans_?date|transaction_?date|sale_?date|purchase_?date|invoice_?date)$", 0.98),
              (r"^(date|created_?at|timestamp|event_?date|time|datetime)$", 0.90),
              (r"(date|time|timestamp)", 0.75))),
    ("quantity", ((r"^(quantity|qty|units_?sold|units|order_?qty|order_?quantity)$", 0.98),
                  (r"^(volume|items_?count|count|num_?items|pieces)$", 0.85),
                  (r"(quantity|qty|units)", 0.75))),
    ("sale_price", ((r"^(sale_?price|selling_?price|sp|unit_?price|retail_?price|item_?price|product_?price)$", 0.98),
                    (r"^(price|rate|unit_?rate)$", 0.88),
                    (r"(sale_?price|unit_?price|price)", 0.75))),
    ("cost_price", ((r"^(cost_?price|unit_?cost|cp|cogs|base_?cost|purchase_?cost|item_?cost|unit_?cogs)$", 0.98),
                    (r"^(cost|expense|base_?price)$", 0.85),
                    (r"(cost_?price|unit_?cost|cogs|cost)", 0.75))),
    ("revenue", ((r"^(total_?revenue|revenue|total_?sales|gross_?sales|total_?amount|line_?total|subtotal)$", 0.98),
                 (r"^(sales|amount|turnover)$", 0.85))),
    ("profit", ((r"^(total_?profit|profit|net_?profit|gross_?profit|earnings|net_?income)$", 0.98),
                (r"^(margin)$", 0.80))),
    ("product", ((r"^(product_?name|product_?title|item_?name|product|item|item_?desc|article)$", 0.98),
                 (r"^(description|title|goods)$", 0.80))),
    ("category", ((r"^(product_?category|category|item_?category|sub_?category|dept|department|segment"
                   r"|product_?type|line)$", 0.98),
                  (r"^(type|group|class|family)$", 0.75))),
    ("customer", ((r"^(customer_?name|client_?name|customer|client|buyer|account_?name)$", 0.98),)),
    ("city", ((r"^(city|town|municipality)$", 0.98),)),
    ("state", ((r"^(state|province|prefecture|canton)$", 0.98),)),
    ("country", ((r"^(country|nation|country_?code|country_?name)$", 0.98),)),
    ("region", ((r"^(region|territory|zone|area|continent|division|geo_?region)$", 0.98),)),
    ("discount", ((r"^(discount|discount_?amount|discount_?rate|discount_?pct|promo_?discount)$", 0.98),)),
    ("age", ((r"^(age|employee_?age|years_?old)$", 0.98),)),
    ("tenure", ((r"^(tenure|years_?of_?service|experience|years_?at_?company)$", 0.98),)),
    ("status", ((r"^(status|employment_?status|active_?status|is_?active|attrition|attrition_?status)$", 0.98),)),
    ("education", ((r"^(education|education_?level|degree|qualification)$", 0.98),)),
    ("performance_rating", ((r"^(performance_?rating|rating|score|review_?score|performance_?score)$", 0.98),)),
    ("gender", ((r"^(gender|sex)$", 0.98),)),
    ("work_mode", ((r"^(work_?mode|workmode|remote_?status|employment_?type)$", 0.98),)),
    ("marital_status", ((r"^(marital_?status|marital|relationship_?status)$", 0.98),)),
    ("subscription_plan", ((r"^(plan|tier|subscription_?plan|subscription_?tier|package)$", 0.98),)),
    ("mrr", ((r"^(mrr|monthly_?recurring_?revenue|arr|annual_?recurring_?revenue)$", 0.98),)),
    ("churn", ((r"^(churn|is_?churned|churn_?status|cancelled)$", 0.98),)),
    ("carrier", ((r"^(carrier|shipping_?carrier|courier|logistics_?partner|delivery_?method)$", 0.98),)),
    ("weight", ((r"^(weight|package_?weight|gross_?weight|kg|lbs)$", 0.98),)),
    ("diagnosis", ((r"^(diagnosis|disease|condition|icd_?code|medical_?condition)$", 0.98),)),
    ("product_id", ((r"^(product_?id|sku|sku_?id|item_?id|item_?code|product_?code|asin)$", 0.98),)),
    ("customer_id", ((r"^(customer_?id|client_?id|cust_?id|account_?id|user_?id|account_?number)$", 0.98),)),
)

# Concepts that need a numeric or a date column, and the bonus for a fitting role.
NUMERIC_CONCEPTS = ("quantity", "sale_price", "cost_price", "revenue", "profit", "discount", "salary", "age",
                    "tenure", "mrr", "weight", "performance_rating")
DATE_CONCEPTS = ("date", "hire_date")
ROLE_BONUS = 0.02


def _patterns(spark) -> DataFrame:
    rows = [(n, concept, m, pattern, confidence,
             "numeric" if concept in NUMERIC_CONCEPTS else "date" if concept in DATE_CONCEPTS else "any")
            for n, (concept, patterns) in enumerate(CONCEPTS)
            for m, (pattern, confidence) in enumerate(patterns)]
    return spark.createDataFrame(
        rows, "priority int, concept string, pattern_no int, pattern string, base double, needs string")


def concept_candidates(profiles: DataFrame) -> DataFrame:
    """(dataset_id, position, column_name, priority, concept, confidence) for every fitting pair.

    The pattern table is fixed and broadcast; the other side has one row per column.
    """
    needs, kind, role = F.col("needs"), F.col("detected_type"), F.col("role")
    fits = ((needs == "any") | ((needs == "numeric") & (kind == "numeric"))
            | ((needs == "date") & (kind.isin("date", "datetime") | (role == "time_dimension"))))
    pairs = profiles.join(F.broadcast(_patterns(profiles.sparkSession)), F.expr(
        "lower(trim(column_name)) rlike pattern") & fits)
    bonus = (F.when((role == "measure") & (needs == "numeric"), ROLE_BONUS)
             .when((role == "dimension") & (needs != "numeric"), ROLE_BONUS)
             .when((role == "time_dimension") & (needs == "date"), ROLE_BONUS).otherwise(0.0))
    first = F.min_by(F.least(F.lit(1.0), F.col("base") + bonus), "pattern_no")
    return (pairs.groupBy("dataset_id", "position", "column_name", "priority", "concept")
            .agg(F.round(first, 2).alias("confidence")))


def tag_concepts(profiles: DataFrame) -> DataFrame:
    """Concepts of many data sets at once: (dataset_id, concept, column_name, confidence, domain, dataset_type).

    ``profiles`` has dataset_id, position, column_name, detected_type, role. Concepts
    choose in fixed order, each the best column still free. A group is one data set's
    schema; the choice folds over its candidates inside the JVM.
    """
    candidate = F.struct("priority", (-F.col("confidence")).alias("key"), "position", "concept",
                         "column_name", "confidence")
    groups = concept_candidates(profiles).groupBy("dataset_id").agg(
        F.array_sort(F.collect_list(candidate)).alias("candidates"))
    # Candidates come sorted by concept, then best first: take one if concept and column are free.
    pick = F.aggregate(
        "candidates", F.filter("candidates", lambda c: F.lit(False)),
        lambda taken, c: F.when(
            F.exists(taken, lambda t: (t["concept"] == c["concept"]) | (t["column_name"] == c["column_name"])),
            taken).otherwise(F.concat(taken, F.array(c))))
    picked = groups.withColumn("taken", pick)
    concepts = F.transform("taken", lambda t: t["concept"])
    domain, dataset_type = domain_of(concepts)
    return (picked.select("dataset_id", domain.alias("domain"), dataset_type.alias("dataset_type"),
                          F.explode("taken").alias("t"))
            .select("dataset_id", "t.concept", "t.column_name", "t.confidence", "domain", "dataset_type"))


def domain_of(concepts: Column) -> tuple[Column, Column]:
    """Business domain and data set type from the array of mapped concepts."""

    def any_of(*names: str) -> Column:
        return F.arrays_overlap(concepts, F.array(*[F.lit(n) for n in names]))

    sales = any_of("sale_price", "quantity", "revenue")
    goods = any_of("product", "category")
    rules = (
        (any_of("department", "employee_id", "job_title", "hire_date", "salary") & ~sales,
         "human_resources", F.lit("hr_workforce")),
        (any_of("user_id", "subscription_plan", "mrr", "churn") & ~goods,
         "saas_subscription", F.lit("saas_analytics")),
        (any_of("shipment_id", "carrier", "weight") & ~sales, "logistics_supply_chain", F.lit("logistics_analytics")),
        (any_of("patient_id", "diagnosis"), "healthcare", F.lit("patient_records")),
        (sales & goods, "sales", F.when(any_of("order_id"), "ecommerce_sales").otherwise("retail_sales")),
        (sales, "financial_transactions", F.lit("financial_sales")),
        (goods, "inventory", F.lit("product_inventory")),
    )
    domain, kind = F.lit("generic_analytics"), F.lit("tabular_data")
    for test, name, type_ in reversed(rules):
        domain, kind = F.when(test, name).otherwise(domain), F.when(test, type_).otherwise(kind)
    return domain, kind


def build_model(profile_rows: DataFrame, overrides: Mapping[str, str | None] | None = None) -> SemanticModel:
    """Semantic model of one data set from its profile (collects one row per column).

    ``overrides`` sets or, with None, removes single mappings.
    """
    rows = profile_rows.select(F.lit("data").alias("dataset_id"), "position", "column_name", "detected_type", "role")
    columns = rows.orderBy("position").collect()
    local = profile_rows.sparkSession.createDataFrame(columns, rows.schema)
    tags = tag_concepts(local).collect()
    mappings = {t["concept"]: t["column_name"] for t in tags}
    for concept, name in (overrides or {}).items():
        if name is None:
            mappings.pop(concept, None)
        else:
            mappings[concept] = name
    by_role = {r: tuple(c["column_name"] for c in columns if c["role"] == r)
               for r in ("dimension", "measure", "time_dimension", "id")}
    return SemanticModel(
        mappings=mappings, dimensions=by_role["dimension"], measures=by_role["measure"],
        time_dimensions=by_role["time_dimension"], identifiers=by_role["id"],
        domain=tags[0]["domain"] if tags else "generic_analytics",
        dataset_type=tags[0]["dataset_type"] if tags else "tabular_data",
        confidence={t["concept"]: t["confidence"] for t in tags},
        unmapped=tuple(c["column_name"] for c in columns if c["column_name"] not in set(mappings.values())))
