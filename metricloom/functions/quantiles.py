"""Exact quantiles of many columns without gathering a column in one task.

Spark's ``percentile`` keeps every distinct value of a group in one aggregation
buffer, which cannot hold a column of a large table. Here each wanted rank is searched
by counting: the value range of a column is cut into equal cells, a count per cell
(combined in the map tasks) tells in which cell the rank lies, and the search goes on
inside that cell until few enough rows are left to be put in order.

Only the bounds of the current cells, a few numbers per column, come to the driver.
Every round is one scan that shuffles counters, not rows, for all columns at once. As
ranks come from counts, the result is exact for any distribution; a skewed one only
takes another round. Infinities have cells of their own.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metricloom.model import quoted

#: Cells of a range; the first and the last are for the infinities.
CELLS = 1024
MOST = sys.float_info.max
FEW_ROWS = 20_000

_SHAPE = "item int, prob double, position double, rank long"


@dataclass(frozen=True)
class _Item:
    """A value range of a column, and the ranks wanted inside it, counted from its start."""

    column: str
    low: float
    high: float
    size: int
    targets: tuple[tuple[float, float, int], ...]  # (prob, position in the column, rank here)
    whole: bool = False

    def is_open(self) -> bool:
        return self.size > FEW_ROWS and self.low / 2 < self.high / 2

    def finite(self) -> tuple[float, float]:
        """Half of each bound, infinite ones replaced: their difference is always a number."""
        return max(self.low, -MOST) / 2, min(self.high, MOST) / 2


def _value(df: DataFrame, column: str) -> Column:
    """The column as a double; not-a-number counts as missing."""
    number = F.col(quoted(column)).cast("double")
    if isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(number), number)
    return number


def _columns(df: DataFrame, columns: Iterable[str], probs: list[float]) -> list[_Item]:
    """One item per column that has values, over its whole range."""
    columns = list(columns)
    shape = df.agg(*[f(_value(df, c)).alias(f"{name}{n}") for n, c in enumerate(columns)
                     for name, f in (("size", F.count), ("low", F.min), ("high", F.max))]).first()
    items = []
    for n, column in enumerate(columns):
        size = shape[f"size{n}"]
        if size:
            targets = []
            for p in probs:
                position = p * (size - 1)
                targets += [(p, position, rank) for rank in {math.floor(position), math.ceil(position)}]
            items.append(_Item(column, shape[f"low{n}"], shape[f"high{n}"], size, tuple(targets), whole=True))
    return items


def _cells(df: DataFrame, items: list[_Item]) -> DataFrame:
    """Rows (item, num) for every value inside an item's range.

    Values outside all ranges of their column become null first, so that only the rest
    is matched to items. Unpivot runs as an Expand inside generated code.
    """
    by_column: dict[str, list[int]] = {}
    for n, item in enumerate(items):
        by_column.setdefault(item.column, []).append(n)

    def inside(n: int, value: Column) -> Column:
        return F.lit(True) if items[n].whole else value.between(items[n].low, items[n].high)

    wide = []
    for k, (column, numbers) in enumerate(by_column.items()):
        value = _value(df, column)
        kept = reduce(Column.__or__, [inside(n, value) for n in numbers])
        wide.append((value if any(items[n].whole for n in numbers) else F.when(kept, value)).alias(str(k)))
    long = (df.select(*wide).unpivot([], [str(k) for k in range(len(wide))], "slot", "num")
            .filter(F.col("num").isNotNull()).withColumn("slot", F.col("slot").cast("int")))
    if len(by_column) == len(items):
        return long.select(F.col("slot").alias("item"), "num")
    matches = F.array_compact(F.array(*[
        F.when((F.col("slot") == k) & inside(n, F.col("num")), n)
        for k, numbers in enumerate(by_column.values()) for n in numbers]))
    return long.select(F.explode(matches).alias("item"), "num")


def _by_item(numbers: Iterable[float]) -> Column:
    """The number of the row's item, looked up in a literal array."""
    return F.element_at(F.array(*[F.lit(float(x)) for x in numbers]), F.col("item") + 1)


def _narrower(df: DataFrame, items: list[_Item]) -> list[_Item]:
    """The cells of the items' ranges that hold their ranks, as new items."""
    low, high = (_by_item(i.finite()[side] for i in items) for side in (0, 1))
    place = F.least(F.floor((F.col("num") / 2 - low) / (high - low) * (CELLS - 2)), F.lit(CELLS - 3)) + 1
    cell = (F.when(F.col("num") == math.inf, CELLS - 1).when(F.col("num") == -math.inf, 0)
            .otherwise(place).cast("int"))
    counts = (_cells(df, items).groupBy("item", cell.alias("cell"))
              .agg(F.count(F.lit(1)).alias("size"), F.min("num").alias("low"), F.max("num").alias("high")))
    # At most CELLS rows per item.
    upto = F.sum("size").over(W.partitionBy("item").orderBy("cell").rowsBetween(W.unboundedPreceding, W.currentRow))
    wanted = df.sparkSession.createDataFrame(
        sorted({(n, t[2]) for n, item in enumerate(items) for t in item.targets}), "item int, rank long")
    placed = (counts.withColumn("upto", upto).join(F.broadcast(wanted), "item")
              .filter((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("size") <= F.col("rank")))
              .drop("rank").distinct())
    out = []
    for row in placed.collect():
        old, before = items[row["item"]], row["upto"] - row["size"]
        targets = tuple((p, q, rank - before) for p, q, rank in old.targets if before <= rank < row["upto"])
        out.append(_Item(old.column, row["low"], row["high"], row["size"], targets))
    return out


def column_quantiles(df: DataFrame, columns: Iterable[str], probs: Iterable[float]) -> DataFrame:
    """Exact quantiles (linear interpolation) of numeric columns: rows (column_name, prob, quantile).

    The search runs when this is called; the last step, which orders the few rows left, is lazy.
    """
    return _in_order(df, _searched(df, _columns(df, columns, [float(p) for p in probs])))


def _searched(df: DataFrame, items: list[_Item]) -> list[_Item]:
    while any(item.is_open() for item in items):
        found = _narrower(df, [i for i in items if i.is_open()])
        items = [i for i in items if not i.is_open()] + found
    return items


def value_at_rank(df: DataFrame, column: str, rank: int) -> float | None:
    """The value at a rank (from 0) of a numeric column, nulls left out; None past the end.

    Values are compared as doubles, so whole numbers beyond 2**53 may share one.
    """
    items = _columns(df, [column], [])
    if not items or rank >= items[0].size:
        return None
    items = _searched(df, [replace(items[0], targets=((0.0, float(rank), rank),))])
    return _in_order(df, items).first()["quantile"]


def _in_order(df: DataFrame, items: list[_Item]) -> DataFrame:
    spark = df.sparkSession
    names = F.array(*[F.lit(item.column) for item in items])
    targets = spark.createDataFrame([(n, *t) for n, item in enumerate(items) for t in item.targets], _SHAPE)
    settled = [(n, item.low) for n, item in enumerate(items) if item.low == item.high]
    hits = targets.join(F.broadcast(spark.createDataFrame(settled, "item int, num double")), "item") if settled else None
    rest = [(n, item) for n, item in enumerate(items) if item.low < item.high]
    if rest:
        numbers = F.array(*[F.lit(n) for n, _ in rest])
        values = (_cells(df, [item for _, item in rest]).groupBy("item", "num")
                  .agg(F.count(F.lit(1)).alias("size"))
                  .withColumn("item", F.element_at(numbers, F.col("item") + 1)))
        upto = F.sum("size").over(W.partitionBy("item").orderBy("num").rowsBetween(W.unboundedPreceding, W.currentRow))
        ranked = values.withColumn("upto", upto)
        found = ranked.join(F.broadcast(targets), "item").filter(
            (F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("size")))
        found = found.select("item", "prob", "position", "rank", "num")
        hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        return spark.createDataFrame([], "column_name string, prob double, quantile double")
    # Both neighbours of a position may lie in different items of the same column.
    part = F.col("position") - F.floor("position")
    width = F.col("high") - F.col("low")
    return (hits.withColumn("column_name", F.element_at(names, F.col("item") + 1))
            .groupBy("column_name", "prob", "position").agg(F.min("num").alias("low"), F.max("num").alias("high"))
            .select("column_name", "prob", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(
                F.when(width < math.inf, F.col("low") + part * width)
                .otherwise(F.col("low") * (1 - part) + F.col("high") * part)).alias("quantile")))


def spread_quantiles(quantiles: DataFrame, names: dict[float, str]) -> DataFrame:
    """One row per column with a column for each probability."""
    return quantiles.groupBy("column_name").agg(*[
        F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(name) for p, name in names.items()])
