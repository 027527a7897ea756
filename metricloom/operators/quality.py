"""Data-quality reports: missing values, negatives, outliers, score, warnings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from metricloom.functions.quantiles import column_quantiles
from metricloom.model import quoted
from metricloom.operators.cleaning import (
    CleaningPolicy, clean, clean_names, coerce_money, handle_negatives, is_money_name, negative_columns,
    parse_date, text_columns, trim_text)
from metricloom.operators.profile import NON_NEGATIVE_NAMES, duplicate_rows

_ISSUE = ("column_name", "issue_type", "affected_rows", "affected_percentage", "description")


def _issue_rows(counts: DataFrame, items: list[tuple[str, str, str]], total: str) -> DataFrame:
    """One-row counters to issue rows; items are (counter, column name, issue kind)."""
    cells = F.explode(F.array(*[
        F.struct(F.lit(name).alias("column_name"), F.lit(kind).alias("kind"), F.col(counter).alias("affected_rows"))
        for counter, name, kind in items]))
    rows = counts.select(F.col(total).alias("total"), cells.alias("i")).select("total", "i.*")
    pct = F.round(F.try_divide(F.col("affected_rows") * 100.0, F.col("total")), 2)
    rows = rows.filter(F.col("affected_rows") > 0).withColumn("affected_percentage", pct)
    kind = F.when((F.col("kind") == "missing_values") & (F.col("affected_percentage") > 50), "high_nulls").otherwise(
        F.col("kind"))
    rows = rows.withColumn("issue_type", kind)
    count, share = F.col("affected_rows").cast("string"), F.col("affected_percentage").cast("string")
    # The sentences of the issues.
    text = (F.when(F.col("kind") == "negative_measure", F.concat(
                F.lit("Measure '"), "column_name", F.lit("' contains "), count, F.lit(" negative values ("),
                share, F.lit("%).")))
            .when(F.col("kind") == "missing_values", F.concat(
                F.lit("Column '"), "column_name", F.lit("' has "), count, F.lit(" missing values ("),
                share, F.lit("%).")))
            .when(F.col("kind") == "invalid_date", F.concat(
                F.lit("Column '"), "column_name", F.lit("' has "), count, F.lit(" unreadable dates ("),
                share, F.lit("%).")))
            .otherwise(F.concat(F.lit("Column '"), "column_name", F.lit("' has "), count,
                                F.lit(" unreadable numbers ("), share, F.lit("%)."))))
    return rows.withColumn("description", text).select(*_ISSUE)


def missing_report(df: DataFrame) -> DataFrame:
    """Columns with nulls: one aggregate, one row per affected column."""
    counts = df.agg(F.count(F.lit(1)).alias("total"), *[
        F.count(F.when(F.col(quoted(c)).isNull(), 1)).alias(f"n{i}") for i, c in enumerate(df.columns)])
    return _issue_rows(counts, [(f"n{i}", c, "missing_values") for i, c in enumerate(df.columns)], "total")


def column_issues(raw: DataFrame, policy: CleaningPolicy | None = None) -> DataFrame:
    """Issues found while cleaning: negatives, missing values, unreadable numbers and dates.

    Percentages are of the raw row count. One aggregate counts everything: negatives on
    the coerced values, nulls after the negative policy.
    """
    policy = policy or CleaningPolicy()
    named = raw.toDF(*clean_names(raw.columns)) if policy.standardize_column_names else raw
    if policy.trim_whitespace:
        named = trim_text(named)
    money = [c for c in text_columns(named) if is_money_name(c)] if policy.coerce_currency else []
    before = coerce_money(named, money)
    negatives = negative_columns(before)
    names = list(named.columns)
    # Both forms side by side in one projection, so a single scan serves all counters.
    both = named.select(*[F.col(quoted(c)).alias(f"raw{i}") for i, c in enumerate(names)],
                        *[F.col(quoted(c)).alias(c) for c in names])
    after = coerce_money(both, money)
    counters, items = [F.count(F.lit(1)).alias("total")], []
    for i, c in enumerate(names):
        if c in negatives:
            counters.append(F.count(F.when(F.col(quoted(c)) < 0, 1)).alias(f"neg{i}"))
            items.append((f"neg{i}", c, "negative_measure"))
    if policy.negatives == "drop_row" and negatives:
        kept = handle_negatives(before, "drop_row")
        counts = after.agg(*counters)
        nulls = kept.agg(*[F.count(F.when(F.col(quoted(c)).isNull(), 1)).alias(f"null{i}")
                           for i, c in enumerate(names)])
        counts = counts.crossJoin(F.broadcast(nulls))  # two single rows
        items += [(f"null{i}", c, "missing_values") for i, c in enumerate(names)]
        return _issue_rows(counts, items, "total")
    for i, c in enumerate(names):
        value, text = F.col(quoted(c)), F.col(f"raw{i}")
        gone = value.isNull()
        if policy.negatives == "nullify" and c in negatives:
            gone = gone | (value < 0)
        counters.append(F.count(F.when(gone, 1)).alias(f"null{i}"))
        items.append((f"null{i}", c, "missing_values"))
        if c in money:
            counters.append(F.count(F.when(text.isNotNull() & (text != "") & value.isNull(), 1)).alias(f"bad{i}"))
            items.append((f"bad{i}", c, "malformed_numeric"))
        if c in policy.date_columns:
            counters.append(F.count(F.when(text.isNotNull() & parse_date(text).isNull(), 1)).alias(f"date{i}"))
            items.append((f"date{i}", c, "invalid_date"))
    return _issue_rows(after.agg(*counters), items, "total")


# Points lost per percent of affected rows, and the most one issue can cost.
PENALTIES = (
    ("high_nulls", 0.3, 15.0),
    ("missing_values", 0.15, 8.0),
    ("negative_measure", 0.25, 10.0),
    ("invalid_date", 0.25, 10.0),
    ("malformed_numeric", 0.2, 8.0),
)


def _issue_totals(raw: DataFrame, policy: CleaningPolicy) -> DataFrame:
    """One row: points lost, number of issues, and how many values each group of issues affects."""
    kind, rows = F.col("issue_type"), F.col("affected_rows")
    penalty = F.lit(0.0)
    for name, rate, most in PENALTIES:
        penalty = F.when(kind == name, F.least(F.col("affected_percentage") * rate, F.lit(most))).otherwise(penalty)

    def affected(*names: str) -> Column:
        return F.coalesce(F.sum(F.when(kind.isin(*names), rows)), F.lit(0))

    return column_issues(raw, policy).agg(
        F.coalesce(F.sum(penalty), F.lit(0.0)).alias("lost"), F.count(F.lit(1)).alias("issue_count"),
        affected("negative_measure").alias("negative_measures"),
        affected("missing_values", "high_nulls").alias("missing_values"),
        affected("malformed_numeric").alias("malformed_numerics"), affected("invalid_date").alias("invalid_dates"))


def _scored(raw: DataFrame, policy: CleaningPolicy) -> DataFrame:
    copies = duplicate_rows(raw).withColumnRenamed("row_count", "total_rows")
    copy_pct = F.coalesce(F.try_divide(F.col("duplicate_rows") * 100.0, F.col("total_rows")), F.lit(0.0))
    score = F.lit(100.0) - F.least(copy_pct * 0.5, F.lit(20.0)) - F.col("lost")
    both = copies.crossJoin(F.broadcast(_issue_totals(raw, policy)))  # two single rows
    return both.withColumn(
        "quality_score", F.when(F.col("total_rows") == 0, 0.0).otherwise(F.greatest(F.round(score, 1), F.lit(0.0))))


def quality_score(raw: DataFrame, policy: CleaningPolicy | None = None) -> DataFrame:
    """One row (total_rows, duplicate_rows, issue_count, quality_score)."""
    return _scored(raw, policy or CleaningPolicy()).select(
        "total_rows", "duplicate_rows", "issue_count", "quality_score")


def cleaning_report(raw: DataFrame, policy: CleaningPolicy | None = None) -> DataFrame:
    """One row: score, row counts before and after, and how many values each kind of issue affects."""
    policy = policy or CleaningPolicy()
    after = clean(raw, policy).agg(F.count(F.lit(1)).alias("clean_rows"))
    rows = _scored(raw, policy).crossJoin(F.broadcast(after))  # two single rows
    return rows.select("quality_score", "total_rows", "clean_rows",
                       (F.col("total_rows") - F.col("clean_rows")).alias("dropped_rows"), "duplicate_rows",
                       "negative_measures", "missing_values", "malformed_numerics", "invalid_dates")


def cleaning_actions(raw: DataFrame, policy: CleaningPolicy | None = None) -> DataFrame:
    """Rows (position, action): what cleaning by a policy does to a table, in the order in which it is done.

    Counts come from one aggregate over the renamed, coerced table; removed copies from the
    row counts before and after. Actions that change nothing are not listed.
    """
    policy = policy or CleaningPolicy()
    names = clean_names(raw.columns) if policy.standardize_column_names else list(raw.columns)
    named = raw.toDF(*names)
    money = [c for c in text_columns(named) if is_money_name(c)] if policy.coerce_currency else []
    coerced = coerce_money(trim_text(named) if policy.trim_whitespace else named, money)
    negatives = negative_columns(coerced) if policy.negatives != "flag" else []
    # The sentences of the actions.
    sentence = {"abs": ("Converted ", " negative values in '{}' to absolute values."),
                "nullify": ("Nullified ", " negative values in '{}'."),
                "drop_row": ("Dropped ", " rows with negative values in '{}'.")}
    counts = coerced.agg(F.count(F.lit(1)).alias("rows"), *[
        F.count(F.when(F.col(quoted(c)) < 0, 1)).alias(f"n{i}") for i, c in enumerate(negatives)])
    actions = []
    if policy.standardize_column_names:
        actions.append(F.lit(f"Standardized {len(names)} column names to snake_case."))
    actions += [F.lit(f"Coerced formatted strings in measure column '{c}' to numeric Float64.") for c in money]
    for i, c in enumerate(negatives):
        before, behind = sentence[policy.negatives]
        n = F.col(f"n{i}")
        actions.append(F.when(n > 0, F.concat(F.lit(before), n.cast("string"), F.lit(behind.format(c)))))
    if policy.drop_duplicates:
        kept = handle_negatives(coerced, policy.negatives)
        copies = duplicate_rows(kept).select("duplicate_rows")
        counts = counts.crossJoin(F.broadcast(copies))  # two single rows
        n = F.col("duplicate_rows")
        actions.append(F.when(n > 0, F.concat(F.lit("Removed "), n.cast("string"), F.lit(" exact duplicate records."))))
    listed = F.array_compact(F.array(*actions)) if actions else F.array().cast("array<string>")
    return counts.select(F.posexplode(listed).alias("position", "action")).select(
        (F.col("position") + 1).alias("position"), "action")


# -- K9 ---------------------------------------------------------------------------------------

def outliers(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns with values beyond 1.5 interquartile ranges: bounds, count, share, five samples.

    Needs at least ten values and a positive range. Quartiles are exact; the bounds, two
    numbers per column, become literals, so that one pass counts and picks the outliers.
    """
    rows = column_quantiles(df, columns, [0.25, 0.75]).collect()  # two rows per column
    found = {(r["column_name"], r["prob"]): r["quantile"] for r in rows}
    bounds = {}
    for name in columns:
        q1, q3 = found.get((name, 0.25)), found.get((name, 0.75))
        if q1 is not None and q3 > q1:
            bounds[name] = (q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
    spark = df.sparkSession
    shape = ("column_name string, method string, lower_bound double, upper_bound double, outlier_count long, "
             "outlier_percentage double, sample_outliers array<double>")
    if not bounds:
        return spark.createDataFrame([], shape)
    names = list(bounds)
    values = [F.nanvl(F.col(quoted(c)).cast("double"), F.lit(None).cast("double")) for c in names]
    outside = [(v < bounds[c][0]) | (v > bounds[c][1]) for c, v in zip(names, values)]
    counts = df.agg(*[F.count(v).alias(f"n{i}") for i, v in enumerate(values)],
                    *[F.count(F.when(o, 1)).alias(f"o{i}") for i, o in enumerate(outside)])
    per_column = counts.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.lit(bounds[c][0]).alias("lower_bound"),
                 F.lit(bounds[c][1]).alias("upper_bound"), F.col(f"n{i}").alias("n"),
                 F.col(f"o{i}").alias("outlier_count")) for i, c in enumerate(names)])).alias("r")).select("r.*")
    cells = df.filter(reduce(Column.__or__, outside)).select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.when(o, v).alias("num"))
        for c, v, o in zip(names, values, outside)])).alias("c")).select("c.*").filter(F.col("num").isNotNull())
    smallest = W.partitionBy("column_name").orderBy("num")
    samples = (cells.withColumn("place", F.row_number().over(smallest))
               .filter(F.col("place") <= 5).groupBy("column_name")
               .agg(F.array_sort(F.collect_list(F.round("num", 4))).alias("sample_outliers")))
    kept = per_column.filter((F.col("n") >= 10) & (F.col("outlier_count") > 0))
    # One row per examined column on either side.
    return kept.join(F.broadcast(samples), "column_name").select(
        "column_name", F.lit("IQR").alias("method"), F.round("lower_bound", 4).alias("lower_bound"),
        F.round("upper_bound", 4).alias("upper_bound"), "outlier_count",
        F.round(F.col("outlier_count") * 100.0 / F.col("n"), 2).alias("outlier_percentage"), "sample_outliers")


def dataset_outliers(df: DataFrame, profile_rows: DataFrame) -> DataFrame:
    """Outliers of every numeric measure named in a profile (one row per column is collected)."""
    measures = [r["column_name"] for r in profile_rows.filter(
        (F.col("detected_type") == "numeric") & (F.col("role") == "measure")).select("column_name").collect()]
    return outliers(df, [c for c in df.columns if c in measures])


# -- K11 --------------------------------------------------------------------------------------

def quality_warnings(profile_rows: DataFrame, duplicates: DataFrame) -> DataFrame:
    """Warnings (column_name, warning_type, severity, message, metric_value) from a profile and duplicate counts."""
    c = F.col
    name, null_pct = c("column_name"), c("null_percentage")

    def warn(test: Column, kind: Column | str, severity: Column | str, message: Column, value: Column) -> Column:
        return F.when(test, F.struct(
            (F.lit(kind) if isinstance(kind, str) else kind).alias("warning_type"),
            (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"),
            message.alias("message"), value.cast("double").alias("metric_value")))

    # Bounds and sentences of the warnings.
    high = null_pct > 50
    checks = [
        warn(null_pct >= 5, F.when(high, "high_missing_values").otherwise("missing_values"),
             F.when(high, "critical").otherwise("warning"),
             F.concat(F.lit("Column '"), name, F.lit("' has "), null_pct.cast("string"), F.lit("% missing values ("),
                      c("null_count").cast("string"), F.lit(" nulls).")), null_pct),
        warn((c("detected_type") == "numeric") & (c("min") < 0) & name.rlike(NON_NEGATIVE_NAMES),
             "negative_values", "warning",
             F.concat(F.lit("Measure column '"), name, F.lit("' contains negative values (minimum: "),
                      c("min").cast("string"), F.lit(").")), c("min")),
        warn((c("unique_count") == 1) & (c("row_count") > 1), "constant_column", "info",
             F.concat(F.lit("Column '"), name, F.lit("' contains only 1 unique value across all rows.")), F.lit(1.0)),
        warn((c("role") == "dimension") & (c("unique_count") > 500) & (c("uniqueness_percentage") > 70),
             "high_cardinality", "info",
             F.concat(F.lit("Dimension '"), name, F.lit("' has high cardinality with "),
                      c("unique_count").cast("string"), F.lit(" distinct values.")), c("unique_count")),
    ]
    per_column = profile_rows.select("column_name", F.explode(F.array_compact(F.array(*checks))).alias("w")).select(
        "column_name", "w.*")
    pct = c("duplicate_percentage")
    dataset = duplicates.filter(c("duplicate_rows") > 0).select(
        F.lit(None).cast("string").alias("column_name"), F.lit("duplicate_rows").alias("warning_type"),
        F.when(pct > 20, "critical").otherwise("warning").alias("severity"),
        F.concat(F.lit("Dataset contains "), c("duplicate_rows").cast("string"), F.lit(" duplicate rows ("),
                 pct.cast("string"), F.lit("% of total records).")).alias("message"),
        c("duplicate_rows").cast("double").alias("metric_value"))
    return dataset.unionByName(per_column)


def confidence_context(profile_rows: DataFrame, warnings: DataFrame) -> DataFrame:
    """One row (row_count, avg_null_percentage, warnings, criticals) for the confidence score."""
    shape = profile_rows.agg(F.max("row_count").alias("row_count"),
                             F.avg("null_percentage").alias("avg_null_percentage"))
    counts = warnings.agg(F.count(F.lit(1)).alias("warnings"),
                          F.count(F.when(F.col("severity") == "critical", 1)).alias("criticals"))
    return shape.crossJoin(F.broadcast(counts))  # two single rows
