"""Plain descriptions of a dataset: filters, metrics and the role each column plays."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame

FILTER_OPERATORS = ("eq", "neq", "in", "not_in", "gt", "gte", "lt", "lte", "like", "between")


@dataclass(frozen=True)
class Filter:
    """One predicate; a list of filters is ANDed."""

    column: str
    op: str
    value: Any

    def __post_init__(self):
        if self.op not in FILTER_OPERATORS:
            raise ValueError(f"unknown filter operator {self.op!r}")


@dataclass(frozen=True)
class NumberFormat:
    prefix: str = ""
    decimals: int = 2
    suffix: str = ""
    grouped: bool = True


@dataclass(frozen=True)
class Metric:
    """A named aggregate.

    ``agg`` builds the aggregate column. ``row`` is set when the metric is a plain
    sum of a per-row amount; operators that split the sum by a condition need it.
    """

    id: str
    label: str
    kind: str
    unit: str
    format: NumberFormat
    agg: Callable[[], Column]
    row: Callable[[], Column] | None = None

    def column(self) -> Column:
        """The aggregate as a double, named after the metric."""
        return self.agg().cast("double").alias(self.id)


@dataclass(frozen=True)
class SemanticModel:
    """Which column carries which business concept.

    ``mappings`` goes from concept (``quantity``, ``sale_price`` ...) to column name.
    """

    mappings: Mapping[str, str] = field(default_factory=dict)
    dimensions: tuple[str, ...] = ()
    measures: tuple[str, ...] = ()
    time_dimensions: tuple[str, ...] = ()
    identifiers: tuple[str, ...] = ()
    domain: str = "generic_analytics"
    dataset_type: str = "tabular_data"
    confidence: Mapping[str, float] = field(default_factory=dict)
    unmapped: tuple[str, ...] = ()
    custom_metrics: tuple[Metric, ...] = ()

    def column(self, concept: str) -> str | None:
        return self.mappings.get(concept)

    @property
    def date_column(self) -> str | None:
        """HR trends follow the hiring date; every other domain prefers the plain date."""
        first = ("hire_date", "date") if self.domain == "human_resources" else ("date", "hire_date")
        for concept in first:
            if concept in self.mappings:
                return self.mappings[concept]
        return self.time_dimensions[0] if self.time_dimensions else None

    def with_metric(self, metric: Metric) -> SemanticModel:
        """Register a custom metric; one with the same id is replaced."""
        kept = tuple(m for m in self.custom_metrics if m.id != metric.id)
        return replace(self, custom_metrics=(*kept, metric))

    def segment_column(self, *concepts: str) -> str | None:
        """First mapped concept of the list, else the first dimension."""
        for concept in concepts:
            if concept in self.mappings:
                return self.mappings[concept]
        return self.dimensions[0] if self.dimensions else None

    def check_columns(self, df: DataFrame) -> None:
        missing = sorted(c for c in self.mappings.values() if c not in df.columns)
        if missing:
            raise ValueError(f"mapped columns not in the data: {missing}")


def resolve_column(df: DataFrame, name: str) -> str:
    """Find a column whatever its case, underscores or spaces."""

    def key(text: str) -> str:
        return text.lower().replace("_", "").replace(" ", "")

    if name in df.columns:
        return name
    for column in df.columns:
        if key(column) == key(name):
            return column
    raise ValueError(f"column {name!r} does not exist; columns are {df.columns}")


def quoted(name: str) -> str:
    """Column reference that survives dots and spaces in the name."""
    return "`" + name.replace("`", "``") + "`"
