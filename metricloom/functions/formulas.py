"""User-written metric formulas turned into aggregate columns; Spark's own parser reads them."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metricloom.functions.metrics import MONEY, PERCENT, PLAIN, WHOLE
from metricloom.model import Metric, quoted

# The functions a formula may call and the words it may not contain.
FUNCTIONS = ("SUM", "AVG", "COUNT", "MIN", "MAX", "ROUND", "ABS")
FORBIDDEN = ("DROP", "DELETE", "INSERT", "UPDATE", "ALTER", "EXEC", "UNION", ";", "--", "/*")

_CALLS = {"SUM": F.sum, "AVG": F.avg, "COUNT": F.count, "MIN": F.min, "MAX": F.max, "ABS": F.abs}
_FORMATS = {"number": PLAIN, "integer": WHOLE, "percentage": PERCENT, "currency": MONEY}
_ARITHMETIC = {
    "Add": lambda a, b: a + b,
    "Subtract": lambda a, b: a - b,
    "Multiply": lambda a, b: a * b,
    # A zero denominator gives null, never an ANSI error.
    "Divide": lambda a, b: F.try_divide(a.cast("double"), b.cast("double")),
    "Remainder": lambda a, b: F.try_mod(a, b),
}


def _kind(node) -> str:
    return node.getClass().getSimpleName()


def _each(sequence) -> list:
    return [sequence.apply(i) for i in range(sequence.size())]


def _nodes(node) -> Iterator:
    yield node
    for child in _each(node.children()):
        yield from _nodes(child)


def _column_name(node, by_name: dict[str, str]) -> str:
    name = ".".join(_each(node.nameParts()))
    if name.lower() not in by_name:
        raise ValueError(f"Column '{name}' does not exist in dataset.")
    return by_name[name.lower()]


def check_formula(formula: str, columns: list[str]) -> tuple[object, list[str], bool]:
    """Spark's expression, used columns and whether the formula calls a function itself."""
    text = formula.strip()
    if not text:
        raise ValueError("Formula expression cannot be empty.")
    bare = re.sub(r"`(?:[^`]|``)*`", " ", text)
    for word in FORBIDDEN:
        if re.search(rf"\b{word}\b" if word.isalpha() else re.escape(word), bare, re.IGNORECASE):
            raise ValueError(f"Forbidden keyword '{word}' in formula.")
    try:
        tree = SparkSession.active()._jsparkSession.sessionState().sqlParser().parseExpression(text)
    except PySparkException as error:
        raise ValueError(f"Formula cannot be read: {error}") from None
    by_name = {c.lower(): c for c in columns}
    nodes = list(_nodes(tree))
    used = [_column_name(n, by_name) for n in nodes if _kind(n) == "UnresolvedAttribute"]
    return tree, list(dict.fromkeys(used)), any(_kind(n) == "UnresolvedFunction" for n in nodes)


def formula_column(formula: str, columns: list[str]) -> Callable[[], Column]:
    """Aggregate column builder for a formula.

    A formula that calls no function sums each of its columns: ``a * b`` means
    ``SUM(a) * SUM(b)``. Names with spaces or of keywords stand in backticks.
    """
    tree, _, calls = check_formula(formula, columns)
    by_name = {c.lower(): c for c in columns}

    def build(node) -> Column:
        kind = _kind(node)
        if kind == "Literal" and re.fullmatch(r"[\d.eE+-]+[LD]?(BD)?", node.sql()):
            return F.expr(node.sql())
        if kind == "UnresolvedAttribute":
            column = F.col(quoted(_column_name(node, by_name)))
            return column if calls else F.sum(column)
        if kind in ("UnaryMinus", "UnaryPositive"):
            value = build(_each(node.children())[0])
            return -value if kind == "UnaryMinus" else value
        if kind in _ARITHMETIC:
            return _ARITHMETIC[kind](*(build(c) for c in _each(node.children())))
        if kind == "UnresolvedFunction" and not node.isDistinct():
            name, args = _each(node.nameParts())[-1].upper(), _each(node.arguments())
            if name == "COUNT" and len(args) == 1 and _kind(args[0]) == "UnresolvedStar":
                return F.count(F.lit(1))
            if name == "ROUND" and 1 <= len(args) <= 2:
                digits = args[1].sql() if len(args) == 2 else "0"
                if not re.fullmatch(r"-?\d+", digits):
                    raise ValueError("ROUND takes a whole number of digits.")
                return F.round(build(args[0]), int(digits))
            if name in _CALLS and len(args) == 1:
                return _CALLS[name](build(args[0]))
            raise ValueError(f"Function '{name}' is not one of {', '.join(FUNCTIONS)}.")
        raise ValueError(f"Formula part not allowed: {node.sql()}")

    build(tree)  # errors show now
    return lambda: build(tree)


def formula_metric(name: str, label: str, formula: str, df: DataFrame, style: str = "currency") -> Metric:
    """A metric from a formula, analysed against ``df`` at once so that errors show early."""
    agg = formula_column(formula, df.columns)
    metric = Metric(name.lower().replace(" ", "_"), label, style, "", _FORMATS.get(style, MONEY), agg)
    df.agg(metric.column()).schema  # analysis only, nothing runs
    return metric
