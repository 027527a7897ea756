"""Revenue concentration, dominant segment and margin risk."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from metricloom.functions.formats import grouped_number, plain_number
from metricloom.functions.metrics import computable_metrics
from metricloom.model import SemanticModel
from metricloom.operators.aggregate import grouping_rows, top_per_dimension

_SHAPE = ("insight_order int, type string, title string, description string, metric string, "
          "dimension string, impact_score double")


def candidate_dimensions(model: SemanticModel) -> list[str]:
    wanted = [model.column("category"), model.column("product"), *model.dimensions]
    return list(dict.fromkeys(d for d in wanted if d))


#: The top fifth, how near to it an approximate percentile is asked for, and how exact that is (both as shares). With
#: FEW groups or less all are put in order.
TOP, AROUND, EXACT, FEW = 0.8, 1e-4, 100_000, 10_000


def pareto(df: DataFrame, model: SemanticModel, dimensions: list[str] | None = None, names: int = 20) -> DataFrame:
    """Share of revenue of the top fifth of groups, on the first dimension with two groups.

    All groups count. Two approximate percentiles, of bounded state, enclose the revenue at which the top fifth begins;
    only the few groups between them are put in order, so the share is exact and no task orders all groups. It is one
    plan: all its parts read the same grouped rows. Only the first ``names`` of the top fifth are listed. Columns:
    dimension, groups, top_count, top_names, top_revenue, total_revenue, concentration_pct, best_name, best_revenue,
    best_share.
    """
    dimensions = dimensions or candidate_dimensions(model)
    revenue = computable_metrics(model)["total_revenue"]
    rows = grouping_rows(df, dimensions, [revenue]).withColumn("value", F.coalesce("total_revenue", F.lit(0.0)))
    near = F.percentile_approx("value", [TOP - AROUND, TOP + 2 * AROUND], EXACT)
    few = F.col("groups") <= FEW
    shape = (rows.groupBy("dim_order", "dimension").agg(
        F.count(F.lit(1)).alias("groups"), F.sum("value").alias("total"), near.alias("near"))
        .filter((F.col("total") > 0) & (F.col("groups") >= 2)).orderBy("dim_order").limit(1)
        .select("dim_order", "dimension", "groups", "total",
                F.greatest(F.lit(1), F.expr("groups div 5")).alias("top_count"),
                F.when(few, F.lit(float("-inf"))).otherwise(F.col("near")[0]).alias("low"),
                F.when(few, F.lit(float("inf"))).otherwise(F.col("near")[1]).alias("high")))
    own = rows.join(F.broadcast(shape.drop("dimension", "total")), "dim_order")
    # One row for all groups above, one for each revenue between.
    between = F.when(F.col("value") <= F.col("high"), F.col("value"))
    steps = own.filter(F.col("value") >= F.col("low")).groupBy(between.alias("step")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("sum"), F.first("top_count").alias("top_count"))
    before = F.sum("n").over(W.orderBy(F.desc_nulls_first("step")).rowsBetween(W.unboundedPreceding, -1))
    left = F.greatest(F.col("top_count") - F.coalesce(before, F.lit(0)), F.lit(0))
    # Groups that tie where the top fifth ends fill it up.
    taken = F.when(left >= F.col("n"), F.col("sum")).otherwise(F.col("step") * left)
    top_revenue = steps.select(taken.alias("taken")).agg(F.sum("taken"))
    name = F.coalesce("dimension_value", F.lit("None"))
    listed = top_per_dimension(own, "total_revenue", names).filter(F.col("rank") <= F.col("top_count")).agg(
        F.array_sort(F.collect_list(F.struct("rank", name.alias("name"), "value"))).alias("listed"))
    found = shape.withColumns({"top_revenue": top_revenue.scalar(), "listed": listed.scalar()})
    return found.select(
        "dimension", F.col("groups").cast("long").alias("groups"), F.col("top_count").cast("int").alias("top_count"),
        F.array_join(F.transform("listed", lambda n: n["name"]), ", ").alias("top_names"),
        "top_revenue", F.col("total").alias("total_revenue"),
        F.round(F.col("top_revenue") / F.col("total") * 100.0, 1).alias("concentration_pct"),
        F.col("listed")[0]["name"].alias("best_name"), F.col("listed")[0]["value"].alias("best_revenue"),
        F.round(F.col("listed")[0]["value"] / F.col("total") * 100.0, 1).alias("best_share"))


def lowest_margin(df: DataFrame, model: SemanticModel, dimensions: list[str] | None = None,
                  threshold: float = 20.0) -> DataFrame:
    """Group with the lowest margin below the threshold, on the first dimension that has one."""
    dimensions = dimensions or candidate_dimensions(model)
    known = computable_metrics(model)
    metrics = [known[m] for m in ("profit_margin", "total_profit", "total_revenue")]
    rows = top_per_dimension(grouping_rows(df, dimensions, metrics), "profit_margin", 1, ascending=True)
    return (rows.filter(F.col("profit_margin") < threshold).orderBy("dim_order").limit(1)
            .select("dimension", F.coalesce("dimension_value", F.lit("None")).alias("dimension_value"),
                    "profit_margin", "total_profit", "total_revenue"))


# Wording of the insights. {names} stand for columns of the figures.
WORDS = {
    "concentration": (
        "Revenue Concentration: Top {count} {dimension}s Generate {share}% of Sales",
        "The top {count} of {groups} {dimension}s ({names}) account for ${top} out of ${total} total revenue."),
    "growth_driver": (
        "Dominant Segment: '{best}' Captures {best_share}% Market Share in {dimension}",
        "'{best}' is the single largest performance driver in {dimension} with ${best_revenue} in total revenue."),
    "risk": (
        "Margin Compression Alert: '{name}' Operating at {margin}% Margin in {dimension}",
        "'{name}' exhibits low profitability with a margin of {margin}% (${profit} profit from ${revenue} revenue)."),
    "summary": (
        "Automated Analytics Active",
        "Dataset successfully normalized into columnar format. Real-time deterministic aggregations are enabled."),
}


def _text(template: str, figures: dict[str, Column]) -> Column:
    """A sentence with the figures put in."""
    parts = [figures[p[1:-1]] if p.startswith("{") else F.lit(p)
             for p in re.split(r"(\{\w+\})", template) if p]
    return F.concat(*parts)


def _insight(order: int, kind: str, metric: str, dimension: Column, impact: Column,
             figures: dict[str, Column]) -> Column:
    title, description = (_text(w, figures) for w in WORDS[kind])
    return F.struct(
        F.lit(order).alias("insight_order"), F.lit(kind).alias("type"), title.alias("title"),
        description.alias("description"), F.lit(metric).alias("metric"), dimension.alias("dimension"),
        impact.cast("double").alias("impact_score"))


def insights(df: DataFrame, model: SemanticModel) -> DataFrame:
    """Worded insights, most basic one only when nothing else fires."""
    spark, known = df.sparkSession, computable_metrics(model)
    dimensions = candidate_dimensions(model)
    found = spark.createDataFrame([], _SHAPE)
    if "total_revenue" in known and dimensions:
        c = F.col
        figures = {
            "dimension": c("dimension"), "count": c("top_count").cast("string"), "groups": c("groups").cast("string"),
            "share": plain_number(c("concentration_pct"), 1), "names": c("top_names"),
            "top": grouped_number(c("top_revenue"), 2), "total": grouped_number(c("total_revenue"), 2),
            "best": c("best_name"), "best_share": plain_number(c("best_share"), 1),
            "best_revenue": grouped_number(c("best_revenue"), 2)}
        impact = F.when(c("concentration_pct") > 70, 85.0).otherwise(65.0)
        pair = F.array(_insight(1, "concentration", "total_revenue", c("dimension"), impact, figures),
                       _insight(2, "growth_driver", "total_revenue", c("dimension"), F.lit(80.0), figures))
        found = found.unionByName(pareto(df, model, dimensions).select(F.explode(pair).alias("i")).select("i.*"))
    if {"profit_margin", "total_profit", "total_revenue"} <= known.keys() and dimensions:
        c = F.col
        figures = {
            "dimension": c("dimension"), "name": c("dimension_value"), "margin": plain_number(c("profit_margin"), 1),
            "profit": grouped_number(c("total_profit"), 2), "revenue": grouped_number(c("total_revenue"), 2)}
        risk = _insight(3, "risk", "profit_margin", c("dimension"), F.lit(75.0), figures)
        found = found.unionByName(lowest_margin(df, model, dimensions).select(risk.alias("i")).select("i.*"))
    first_dimension = F.lit(dimensions[0] if dimensions else None).cast("string")
    baseline = spark.range(1).select(
        _insight(4, "summary", "record_count", first_dimension, F.lit(50.0), {}).alias("i")).select("i.*")
    # At most four rows: the baseline stays only when it is the only one.
    first = F.min("insight_order").over(W.partitionBy())
    shown = found.unionByName(baseline).withColumn("first", first)
    return (shown.filter((F.col("insight_order") < 4) | (F.col("first") == 4)).drop("first")
            .orderBy("insight_order"))
