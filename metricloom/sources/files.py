"""CSV and Parquet in, clean Parquet and CSV out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metricloom.model import quoted

# Text that stands for a missing value.
NULL_TOKENS = ("", "NA", "N/A", "null", "NULL", "none", "NONE", "NaN", "nan", "-")


def blank_to_null(df: DataFrame) -> DataFrame:
    """Null tokens of every text column become null."""
    texts = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    return df.select(*[
        F.when(~F.col(quoted(c)).isin(*NULL_TOKENS), F.col(quoted(c))).alias(c) if c in texts else F.col(quoted(c))
        for c in df.columns])


_BOOLEAN = ("true", "false")


def _readers(text: Column) -> dict[str, Column]:
    """Ways to read text, narrowest type first."""
    whole = F.when(text.rlike(r"^\s*[+-]?\d+\s*$"), text.try_cast("long"))
    number = F.when(text.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"), text.try_cast("double"))
    truth = F.when(F.lower(text).isin(*_BOOLEAN), F.lower(text) == "true")
    day = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text.try_cast("date"))
    moment = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}"), text.try_cast("timestamp_ntz"))
    return {"long": whole, "double": number, "boolean": truth, "date": day, "timestamp": moment}


def typed(df: DataFrame) -> DataFrame:
    """Text columns to the narrowest type that reads all of their values; one aggregate over the whole data decides."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not texts:
        return df
    kinds = list(_readers(F.lit("")))
    aggregates = []
    for i, name in enumerate(texts):
        column = F.col(quoted(name))
        aggregates.append(F.count(column).alias(f"n{i}"))
        aggregates += [F.count(reader).alias(f"{kind}{i}") for kind, reader in _readers(column).items()]
    counts = df.agg(*aggregates).first()
    chosen = {name: next((k for k in kinds if counts[f"n{i}"] and counts[f"{k}{i}"] == counts[f"n{i}"]), None)
              for i, name in enumerate(texts)}
    return df.select(*[
        _readers(F.col(quoted(c)))[chosen[c]].alias(c) if chosen.get(c) else F.col(quoted(c)) for c in df.columns])


def read_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """CSV with a header: null tokens, types that fit every value, extra fields cut.

    ``multi_line`` also reads line breaks inside quotes; such a file can't be split, so each is read by one task.
    """
    raw = (spark.read.option("header", True).option("mode", "PERMISSIVE").option("escape", '"')
           .option("multiLine", multi_line).csv(path))
    return typed(blank_to_null(raw))


def read_explorer_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV as the record explorer reads it: rows of the wrong length drop, true/false become 1/0.

    A column is numeric when every filled value is a number or true/false.
    """
    raw = (spark.read.option("header", True).option("mode", "DROPMALFORMED").option("escape", '"')
           .option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True)
           # All columns are parsed, so that rows of the wrong length are seen whatever is selected.
           .option("columnPruning", False).csv(path))
    return explorer_typed(raw)


def explorer_typed(raw: DataFrame) -> DataFrame:
    """Text columns as the record explorer types them: blank cells null, columns of numbers and true/false as doubles."""
    rows = raw.select(*[F.nullif(F.trim(F.col(quoted(c))), F.lit("")).alias(c) for c in raw.columns])

    def number(name: str) -> Column:
        text = F.col(quoted(name))
        return (F.when(F.lower(text) == "true", 1.0).when(F.lower(text) == "false", 0.0)
                .otherwise(text.try_cast("double")))

    counts = rows.agg(*[F.count(F.col(quoted(c))).alias(f"n{i}") for i, c in enumerate(rows.columns)],
                      *[F.count(number(c)).alias(f"d{i}") for i, c in enumerate(rows.columns)]).first()
    numeric = {c for i, c in enumerate(rows.columns) if counts[f"n{i}"] and counts[f"n{i}"] == counts[f"d{i}"]}
    return rows.select(*[number(c).alias(c) if c in numeric else F.col(quoted(c)) for c in rows.columns])


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def schema_rows(df: DataFrame) -> DataFrame:
    """(position, column_name, data_type, is_text) of a data set, from its schema alone."""
    rows = [(n, f.name, f.dataType.simpleString(), isinstance(f.dataType, T.StringType))
            for n, f in enumerate(df.schema.fields, 1)]
    return df.sparkSession.createDataFrame(rows, "position int, column_name string, data_type string, is_text boolean")


def write_clean_parquet(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """The clean table; partitioning by a period column lets date filters skip files."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV export as one folder of part files, written by the tasks in parallel."""
    df.write.mode("overwrite").option("header", True).csv(path)
