"""Read-only SQL over a DataFrame under the table name ``data``."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Mapping
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

#: Kinds of plan nodes that a query may hold as it is written. Others are refused, whatever they are.
WRITTEN_PLANS = frozenset(
    "Project Filter Aggregate Sort Distinct Deduplicate GlobalLimit LocalLimit Offset Join LateralJoin Union Except "
    "Intersect SubqueryAlias UnresolvedWith UnresolvedRelation UnresolvedHaving UnresolvedInlineTable LocalRelation "
    "OneRowRelation WithWindowDefinition Window Pivot Unpivot Generate UnresolvedSubqueryColumnAliases Sample Tail "
    "ResolvedInlineTable UnionLoop".split())
#: Expressions that only names and parameters not yet looked up need. All others are Spark's own, of the package below.
WRITTEN_NAMES = frozenset(
    "UnresolvedAttribute UnresolvedFunction UnresolvedStar UnresolvedAlias UnresolvedOrdinal UnresolvedExtractValue "
    "UnresolvedRegex MultiAlias UnresolvedGenerator NamedParameter PosParameter UnresolvedInlineTable".split())
#: Kinds of plan nodes that have no input and may stand in a query once names are looked up; ``data`` apart.
LEAVES = frozenset("OneRowRelation LocalRelation CTERelationRef UnionLoopRef".split())
EXPRESSIONS = "org.apache.spark.sql.catalyst.expressions."
#: Functions, and the expressions they become, that run any code of the JVM or of users.
CODE_FUNCTIONS = ("reflect", "try_reflect", "java_method")
CODE_EXPRESSIONS = frozenset(
    "CallMethodViaReflection ScalaUDF ScalaUDAF ScalaAggregator PythonUDF PythonUDAF PythonUDTF UserDefinedExpression "
    "ApplyFunctionExpression V2Aggregator".split())


def _each(sequence) -> Iterator:
    return (sequence.apply(i) for i in range(sequence.size()))


def _expressions(plan) -> Iterator:
    open_ = list(_each(plan.expressions()))
    while open_:
        expression = open_.pop()
        yield expression
        open_ += _each(expression.children())


def _is_code(expression, name: str) -> bool:
    return name in CODE_EXPRESSIONS or not expression.getClass().getName().startswith(EXPRESSIONS)


def _check_written(plan, known: frozenset[str]) -> bool:
    """Whether a parsed plan reads ``data``; ValueError for any node, table or function that a query may not hold."""
    kind = plan.getClass().getSimpleName()
    if kind not in WRITTEN_PLANS:
        raise ValueError(f"Only read-only SELECT queries over 'data' are permitted, not {kind}.")
    reads = False
    if kind == "UnresolvedWith":
        for entry in _each(plan.cteRelations()):
            name = entry._1().lower()
            reads |= _check_written(entry._2(), known | {name} if plan.allowRecursion() else known)
            known |= {name}
        return _check_written(plan.child(), known) | reads
    if kind == "UnresolvedRelation":
        name = ".".join(_each(plan.multipartIdentifier()))
        if name.lower() not in known | {"data"}:
            raise ValueError(f"Unknown table {name}; the data set is called 'data'.")
        reads = name.lower() == "data"
    for expression in _expressions(plan):
        name = expression.getClass().getSimpleName()
        if name not in WRITTEN_NAMES and _is_code(expression, name):
            raise ValueError(f"{name} is not permitted.")
        if name == "UnresolvedFunction" and list(_each(expression.nameParts()))[-1].lower() in CODE_FUNCTIONS:
            raise ValueError(f"Function {list(_each(expression.nameParts()))[-1]} is not permitted.")
    for part in (*_each(plan.children()), *_each(plan.subqueries())):
        reads |= _check_written(part, known)
    return reads


def _check_resolved(plan) -> None:
    """ValueError unless a resolved plan ends in ``data`` alone and calls built-in functions alone."""
    kind = plan.getClass().getSimpleName()
    if kind == "View":
        if plan.desc().identifier().table() != "data":
            raise ValueError(f"Unknown table {plan.desc().identifier().table()}; the data set is called 'data'.")
        return
    parts = [*_each(plan.children()), *_each(plan.subqueries()), *_each(plan.innerChildren())]
    if kind == "WithCTE":
        parts += _each(plan.cteDefs())
    if not parts and kind not in LEAVES:
        raise ValueError(f"{kind} is not permitted.")
    for expression in _expressions(plan):
        name = expression.getClass().getSimpleName()
        if _is_code(expression, name):
            raise ValueError(f"{name} is not permitted.")
    for part in parts:
        if hasattr(part, "subqueries"):
            _check_resolved(part)


def check_sql(spark: SparkSession, sql: str) -> str:
    """The single query, or ValueError. Spark's own parser reads it; only ``data`` may be queried."""
    statement = sql.strip().rstrip(";")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(statement)
    except PySparkException as error:
        raise ValueError(f"SQL cannot be read: {error}") from error
    if not _check_written(plan, frozenset()):
        raise ValueError("SQL query must specify a FROM clause.")
    return statement


def safe_sql(df: DataFrame, sql: str, args: Mapping[str, Any] | list | None = None) -> DataFrame:
    """Run one read-only query; unknown columns fail at once, before any data is read.

    It runs in a session of its own, which sees no view but ``data``; a view of that name elsewhere stays as it is. The
    query is judged as written, before anything in it is looked up, and again as Spark resolved it: only known kinds of
    nodes pass, all of them end in ``data``, and all functions are built in.
    """
    spark = df.sparkSession
    statement = check_sql(spark, sql)
    own = spark.newSession()
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"data_{uuid.uuid4().hex}"
    df.createGlobalTempView(name)
    try:
        own.table(f"global_temp.{name}").createOrReplaceTempView("data")
        found = own.sql(statement, args=args)
        _check_resolved(found._jdf.queryExecution().analyzed())
        return found
    except PySparkException as error:
        raise ValueError(f"SQL Execution Error: {error}") from error
    finally:
        spark.catalog.dropGlobalTempView(name)
