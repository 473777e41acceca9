"""What stored SQL may do, decided on Spark's own plans of the text and never on the text itself.

The parsed plan is walked first, before anything is looked up: only nodes of a query are allowed, relations only by the
single name of a given view or of a ``WITH`` part in scope, and functions only if they are built in and of a group that
computes values. So neither files, tables and table functions nor ``IDENTIFIER(...)``, scripts, commands and calls of Java methods
get any further. Then the analysed plan is walked, made over empty views: whatever it still reads must be one of these.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

from pyspark.errors import ParseException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_SHAPES = 1000

# Spark's names of the nodes that a query is made of.
QUERY_NODES = set(
    """Aggregate Distinct Except Filter Generate GlobalLimit Intersect Join LateralJoin LocalLimit LocalRelation Offset
    OneRowRelation PipeOperator Pivot Project Sample Sort SubqueryAlias Union UnresolvedHaving UnresolvedHint UnresolvedInlineTable
    UnresolvedRelation UnresolvedSubqueryColumnAliases UnresolvedWith Unpivot Window WithWindowDefinition""".split()
)
# Spark's names of the leaves that read nothing, and of expressions that compute a name.
EMPTY_LEAVES = {"CTERelationRef", "LocalRelation", "OneRowRelation", "UnionLoopRef"}
REFUSED_EXPRESSIONS = {"ExpressionWithUnresolvedIdentifier"}
# Spark's groups of built-in functions that are not for stored SQL, and single ones of these that are.
REFUSED_GROUPS = {"misc_funcs", "table_funcs"}
ALLOWED_MISC = {"typeof", "uuid"}
# Names that the parser itself knows and the registry of functions lists without a class.
PARSER_FUNCTIONS = {"!=", "<>", "||", "case", "between"}


class Refused(ValueError):
    """The text is not a query over the given views."""


def _each(found) -> Iterator:
    return (found.apply(at) for at in range(found.size()))


def _kind(node) -> str:
    return node.getClass().getSimpleName()


def _expressions(node) -> Iterator:
    stack = list(_each(node.expressions()))
    while stack:
        found = stack.pop()
        yield found
        stack.extend(_each(found.children()))


@lru_cache(maxsize=1024)
def _function_allowed(spark: SparkSession, name: str) -> bool:
    if name in PARSER_FUNCTIONS or name in ALLOWED_MISC:
        return True
    identifier = spark._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(name)
    found = spark._jsparkSession.sessionState().functionRegistry().lookupFunction(identifier)
    return found.isDefined() and found.get().getSource() == "built-in" and found.get().getGroup() not in REFUSED_GROUPS


def _check_expressions(spark: SparkSession, node) -> None:
    for found in _expressions(node):
        kind = _kind(found)
        if kind in REFUSED_EXPRESSIONS:
            raise Refused(f"not allowed: {kind}")
        if kind == "UnresolvedFunction":
            parts = [part.lower() for part in _each(found.nameParts())]
        elif kind == "UnresolvedGenerator":
            parts = [found.name().funcName().lower()]
        else:
            continue
        if len(parts) != 1 or not _function_allowed(spark, parts[0]):
            raise Refused(f"no such function: {'.'.join(parts)}")


def _check_parsed(spark: SparkSession, node, names: frozenset[str]) -> None:
    kind = _kind(node)
    if kind not in QUERY_NODES:
        raise Refused(f"only SELECT queries are allowed, not {kind}")
    if kind == "UnresolvedRelation":
        parts = [part.lower() for part in _each(node.multipartIdentifier())]
        if len(parts) != 1 or parts[0] not in names or node.isStreaming() or not node.options().isEmpty():
            raise Refused(f"no such view: {'.'.join(parts)}")
    _check_expressions(spark, node)
    inside = names
    if kind == "UnresolvedWith":
        for part in _each(node.cteRelations()):
            name = part._1().lower()
            _check_parsed(spark, part._2(), inside | {name} if node.allowRecursion() else inside)
            inside = inside | {name}
    for child in _each(node.children()):
        _check_parsed(spark, child, inside)
    for child in _each(node.subqueries()):
        _check_parsed(spark, child, inside)


def check_text(spark: SparkSession, text: str, views: Iterable[str]) -> None:
    """Raises ``Refused`` (or Spark's ``ParseException``) unless the text is one query over the views; nothing is looked up."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    _check_parsed(spark, plan, frozenset(view.lower() for view in views))


def check_leaves(query: DataFrame) -> None:
    """Raises ``Refused`` if the analysed plan of a query over empty views without a relation reads anything else."""
    stack = [query._jdf.queryExecution().analyzed()]
    while stack:
        node = stack.pop()
        below = [*_each(node.children()), *_each(node.innerChildren()), *_each(node.subqueries())]
        if not below and _kind(node) not in EMPTY_LEAVES:
            raise Refused(f"reads {_kind(node)}")
        stack.extend(below)


def empty_like(rows: DataFrame) -> DataFrame:
    """No rows under the same columns, with a plan that reads nothing."""
    columns = [F.lit(None).cast(field.dataType).alias(field.name) for field in rows.schema]
    return rows.sparkSession.sql("SELECT 1").select(*columns).where(F.lit(False))


def shape_of(text: Column) -> Column:
    """A text without what its literals hold: texts of one shape get one verdict."""
    return F.regexp_replace(text, "'(?:[^']|'')*'", "''")


def with_verdicts(texts: DataFrame, column: str, views: Iterable[str], prepare: Callable[[str], str] = str) -> DataFrame:
    """``refused``: why a stored text may not run, null if it may.

    The driver parses each shape of text once. There may be ``MAX_SHAPES`` of them; more is an error, as stored texts are
    few templates in many wordings of their literals.
    """
    spark = texts.sparkSession
    marked = texts.withColumn("_shape", shape_of(F.coalesce(F.col(column), F.lit(""))))
    shapes = [row[0] for row in marked.select("_shape").distinct().limit(MAX_SHAPES + 1).collect()]
    if len(shapes) > MAX_SHAPES:
        raise ValueError(f"more than {MAX_SHAPES} shapes of stored texts")

    def verdict(text: str) -> str | None:
        try:
            check_text(spark, prepare(text), views)
        except Refused as refused:
            return str(refused)
        except (ParseException, ValueError):
            return "not a query"
        return None

    found = spark.createDataFrame([(shape, verdict(shape)) for shape in shapes], "_shape string, refused string")
    return marked.join(F.broadcast(found), "_shape").drop("_shape")  # at most MAX_SHAPES rows
