"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The characters that separate words, and the words they leave.
SPACE_WORDS = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset (tests), one of our own, set for the session.

    On a cluster it must be set: executors don't see a folder of the driver's machine, and rows would be lost.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.split("[")[0] == "local":
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors share (master: {master})")
        folder = "file://" + tempfile.mkdtemp(prefix="llm-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Let Spark hand tasks fewer rows at once, for what is run inside: long texts then take less memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def saved(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Write a frame to the shared folder and read it back: its lineage ends there, and every executor sees it.

    With ``by``, reads that ask for a value of that column read its files only.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.partitionBy(*([by] if by else [])).option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application, so that tasks can import it wherever they run."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="llm-package-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for module in sorted(package.rglob("*.py")):
            out.write(module, module.relative_to(package.parent))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


def in_arrow(df: DataFrame, function: Callable, schema) -> DataFrame:
    """mapInArrow() with this package at hand in the tasks."""
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def lower_ascii(text: Column) -> Column:
    """Only A-Z become lower case; other letters stay."""
    return F.translate(text, UPPER, LOWER)


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Add the row number (from 0) in a global order, without one task that sees all rows.

    Rows are dealt by range; each range numbers its own rows and starts at the count of the ranges before it.
    """
    dealt = saved(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    start = counts.select(F.col("_range"), (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_start"))
    local = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return (dealt.join(start, "_range").withColumn(name, (F.col("_start") + local).cast("long"))
            .drop("_range", "_start"))
