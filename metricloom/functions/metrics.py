"""The standard metrics: which exist for a given semantic model, and how each is aggregated."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from metricloom.model import Metric, NumberFormat, SemanticModel, quoted

MONEY = NumberFormat("$", 2)
PERCENT = NumberFormat("", 2, "%", grouped=False)
WHOLE = NumberFormat("", 0)
PLAIN = NumberFormat("", 2)

# Status words that count an employee as present or as gone.
ACTIVE_WORDS = ("active", "employed", "current", "true", "1", "yes")
LEFT_WORDS = ("inactive", "terminated", "exited", "left", "separated", "false", "0", "no")
# Churn marks (compared as written, lower case only).
CHURN_WORDS = ("true", "1", "yes", "churned")


class _Inputs:
    """Looks concepts up in the model and combines them into per-row amounts."""

    def __init__(self, model: SemanticModel):
        self._model = model

    def has(self, *concepts: str) -> bool:
        return all(c in self._model.mappings for c in concepts)

    def col(self, concept: str) -> Column:
        return F.col(quoted(self._model.mappings[concept]))

    def revenue(self) -> Callable[[], Column] | None:
        if self.has("quantity", "sale_price"):
            return lambda: self.col("quantity") * self.col("sale_price")
        return (lambda: self.col("revenue")) if self.has("revenue") else None

    def cost(self) -> Callable[[], Column] | None:
        if self.has("quantity", "cost_price"):
            return lambda: self.col("quantity") * self.col("cost_price")
        return (lambda: self.col("cost_price")) if self.has("cost_price") else None

    def profit(self) -> Callable[[], Column] | None:
        if self.has("quantity", "sale_price", "cost_price"):
            return lambda: (self.col("sale_price") - self.col("cost_price")) * self.col("quantity")
        if self.has("revenue", "cost_price"):
            return lambda: self.col("revenue") - self.col("cost_price")
        return None


def ratio(top: Column, bottom: Column) -> Column:
    """Null when the denominator is zero or null."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def _sum_metric(id_, label, kind, unit, fmt, row) -> Metric:
    return Metric(id_, label, kind, unit, fmt, lambda: F.sum(row()), row)


def _metric(id_, label, kind, unit, fmt, agg) -> Metric:
    return Metric(id_, label, kind, unit, fmt, agg)


def _rows(id_, label, unit) -> Metric:
    return Metric(id_, label, "count", unit, WHOLE, lambda: F.count(F.lit(1)), lambda: F.lit(1))


def _text_in(column: Column, words: tuple[str, ...]) -> Column:
    return F.coalesce(column.isin(*words), F.lit(False))


def record_count() -> Metric:
    """What a breakdown shows when none of the asked metrics exists."""
    return _rows("count", "Record Count", "")


# Fixed values in what follows: ids, labels, units and formats of the metrics.

def _sales(i: _Inputs) -> list[Metric]:
    out: list[Metric] = []
    revenue, cost, profit = i.revenue(), i.cost(), i.profit()
    if revenue:
        out.append(_sum_metric("total_revenue", "Total Revenue", "currency", "$", MONEY, revenue))
    if cost:
        out.append(_sum_metric("total_cost", "Total Cost", "currency", "$", MONEY, cost))
    if profit:
        out.append(_sum_metric("total_profit", "Total Profit", "currency", "$", MONEY, profit))
    if i.has("quantity", "sale_price", "cost_price"):
        out.append(_metric("profit_margin", "Profit Margin", "percentage", "%", PERCENT,
                           lambda: ratio(F.sum(profit()), F.sum(revenue())) * 100.0))
    if i.has("quantity"):
        out.append(_sum_metric("units_sold", "Total Units Sold", "quantity", "units",
                               NumberFormat("", 0, " units"), lambda: i.col("quantity")))
    orders: Callable[[], Column] | None = None
    if i.has("order_id"):
        orders = lambda: F.count_distinct(i.col("order_id"))
        out.append(_metric("total_orders", "Total Orders", "count", "orders", WHOLE, orders))
    else:
        out.append(_rows("total_orders", "Total Transactions", "txs"))
    if orders and i.has("quantity", "sale_price"):
        out.append(_metric("average_order_value", "Average Order Value (AOV)", "currency", "$", MONEY,
                           lambda: ratio(F.sum(revenue()), orders())))
    if i.has("sale_price"):
        out.append(_metric("average_unit_price", "Average Unit Price", "currency", "$", MONEY,
                           lambda: F.avg(i.col("sale_price"))))
    if i.has("discount"):
        out.append(_sum_metric("total_discount", "Total Discount", "currency", "$", MONEY,
                               lambda: i.col("discount")))
    if revenue:
        out.append(_metric("max_order_value", "Peak Transaction Value", "currency", "$", MONEY,
                           lambda: F.max(revenue())))
    if orders and profit:
        out.append(_metric("avg_profit_per_order", "Avg Profit / Order", "currency", "$", MONEY,
                           lambda: ratio(F.sum(profit()), orders())))
    if orders and i.has("quantity"):
        out.append(_metric("units_per_order", "Basket Size (Units/Order)", "ratio", "items",
                           NumberFormat("", 1, " items", grouped=False),
                           lambda: ratio(F.sum(i.col("quantity")), orders())))
    if i.has("discount") and revenue:
        out.append(_metric("discount_rate", "Discount Rate", "percentage", "%", PERCENT,
                           lambda: ratio(F.sum(i.col("discount")),
                                         F.sum(revenue()) + F.sum(i.col("discount"))) * 100.0))
    if i.has("product"):
        out.append(_metric("active_products", "Active Products", "count", "SKUs", WHOLE,
                           lambda: F.count_distinct(i.col("product"))))
    return out


def _workforce(i: _Inputs, model: SemanticModel) -> list[Metric]:
    if not (model.domain == "human_resources" or i.has("department") or i.has("employee_id")):
        return []
    years = NumberFormat("", 1, " yrs", grouped=False)
    out = [_rows("total_employees", "Total Headcount", "Employees")]
    if i.has("hire_date"):
        out.append(_rows("hires_over_time", "Hires (per period)", "Hires"))
        out.append(_metric("hire_rate", "Hire Rate", "percentage", "%", PERCENT,
                           lambda: ratio(F.count(i.col("hire_date")), F.count(F.lit(1))) * 100.0))
    if i.has("status"):
        status = lambda: F.lower(i.col("status").cast("string"))
        out.append(_sum_metric("active_employees", "Active Employees", "count", "Active", WHOLE,
                               lambda: F.when(_text_in(status(), ACTIVE_WORDS), 1).otherwise(0)))
        out.append(_metric("turnover_rate", "Turnover Rate", "percentage", "%", PERCENT,
                           lambda: F.avg(F.when(_text_in(status(), LEFT_WORDS), 1.0).otherwise(0.0)) * 100.0))
    if i.has("performance_rating"):
        out.append(_metric("avg_performance_rating", "Average Performance", "ratio", "",
                           NumberFormat("", 2, grouped=False), lambda: F.avg(i.col("performance_rating"))))
    if i.has("department"):
        out.append(_metric("active_departments", "Active Departments", "count", "Depts", WHOLE,
                           lambda: F.count_distinct(i.col("department"))))
    place = "city" if i.has("city") else "state" if i.has("state") else None
    if place:
        out.append(_metric("workforce_locations", "Workforce Locations", "count", "Cities", WHOLE,
                           lambda: F.count_distinct(i.col(place))))
    if i.has("salary"):
        out.append(_metric("average_salary", "Average Salary", "currency", "$", MONEY,
                           lambda: F.avg(i.col("salary"))))
    if i.has("age"):
        out.append(_metric("average_age", "Average Employee Age", "ratio", "yrs", years,
                           lambda: F.avg(i.col("age"))))
    if i.has("tenure"):
        out.append(_metric("average_tenure", "Average Tenure", "ratio", "yrs", years,
                           lambda: F.avg(i.col("tenure"))))
    return out


def _subscriptions(i: _Inputs, model: SemanticModel) -> list[Metric]:
    if not (model.domain == "saas_subscription" or i.has("user_id", "subscription_plan")):
        return []
    out = [_rows("total_users", "Total Subscribers", "Users")]
    if i.has("mrr"):
        out.append(_sum_metric("total_mrr", "Total MRR", "currency", "$", MONEY, lambda: i.col("mrr")))
    if i.has("subscription_plan"):
        out.append(_metric("active_plans", "Active Plans", "count", "Plans", WHOLE,
                           lambda: F.count_distinct(i.col("subscription_plan"))))
    if i.has("churn"):
        out.append(_metric("churn_rate", "Churn Rate", "percentage", "%", PERCENT,
                           lambda: F.avg(F.when(_text_in(i.col("churn").cast("string"), CHURN_WORDS), 1.0)
                                         .otherwise(0.0)) * 100.0))
    return out


def _logistics(i: _Inputs, model: SemanticModel) -> list[Metric]:
    if not (model.domain == "logistics_supply_chain" or i.has("shipment_id") or i.has("carrier")):
        return []
    if i.has("shipment_id"):
        out = [_metric("total_shipments", "Total Shipments", "count", "Shipments", WHOLE,
                       lambda: F.count_distinct(i.col("shipment_id")))]
    else:
        out = [_rows("total_shipments", "Total Shipments", "Shipments")]
    if i.has("carrier"):
        out.append(_metric("active_carriers", "Active Carriers", "count", "Carriers", WHOLE,
                           lambda: F.count_distinct(i.col("carrier"))))
    if i.has("weight"):
        out.append(_metric("average_weight", "Average Shipment Weight", "ratio", "units", PLAIN,
                           lambda: F.avg(i.col("weight"))))
    return out


def _healthcare(i: _Inputs, model: SemanticModel) -> list[Metric]:
    if not (model.domain == "healthcare" or i.has("patient_id") or i.has("diagnosis")):
        return []
    if i.has("patient_id"):
        out = [_metric("total_patients", "Total Patients", "count", "Patients", WHOLE,
                       lambda: F.count_distinct(i.col("patient_id")))]
    else:
        out = [_rows("total_patients", "Total Patients", "Patients")]
    if i.has("diagnosis"):
        out.append(_metric("active_diagnoses", "Diagnoses Recorded", "count", "Diagnoses", WHOLE,
                           lambda: F.count_distinct(i.col("diagnosis"))))
    return out


def _fallback(model: SemanticModel, found: list[Metric]) -> list[Metric]:
    """A dataset with fewer than three metrics still gets counts and averages."""
    if len(found) >= 3:
        return []
    out = [_rows("total_records", "Total Volume / Records", "Records")]
    for name in model.dimensions[:2]:
        out.append(_metric(f"distinct_{name.lower().replace(' ', '_')}", f"Unique {name} Count", "count",
                           "Groups", WHOLE, lambda n=name: F.count_distinct(F.col(quoted(n)))))
    for name in model.measures[:2]:
        out.append(_metric(f"avg_{name.lower().replace(' ', '_')}",
                           f"Average {name.replace('_', ' ').title()}", "ratio", "", PLAIN,
                           lambda n=name: F.avg(F.col(quoted(n)))))
    return out


def computable_metrics(model: SemanticModel) -> dict[str, Metric]:
    """Every metric the model's columns allow, in display order, keyed by id."""
    inputs = _Inputs(model)
    found = _sales(inputs)
    for domain in (_workforce, _subscriptions, _logistics, _healthcare):
        found += domain(inputs, model)
    found += _fallback(model, found)
    out: dict[str, Metric] = {}
    for metric in found:
        out.setdefault(metric.id, metric)
    for metric in model.custom_metrics:
        out[metric.id] = metric
    return out


def pick_metrics(model: SemanticModel, ids, default: int) -> list[Metric]:
    """The asked metrics that exist; when none does, the first ``default`` computable ones."""
    known = computable_metrics(model)
    asked = [known[i] for i in dict.fromkeys(ids or ()) if i in known]
    return asked or list(known.values())[:default]
