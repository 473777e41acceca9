"""Stored SQL: reports and widgets that live in tables and run over the view ``shipments``."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import unpack_params
from ..operators.changes import SELECT_START
from ..operators.filters import active, build_query
from ..operators.windows import calendar_range
from ..sources import normalise, with_classes
from . import guard

VIEW = "shipments"
_TOKEN = re.compile(r"""--[^\n]*|/\*|'(?:[^']|'')*'|"(?:[^"]|"")*"|`(?:[^`]|``)*`|[^'"`/-]+|.""", re.DOTALL)
_PARAMETER = re.compile(r"\{([A-Za-z_]\w*)\}")


def _tokens(text: str) -> list[str]:
    """Literals, quoted names, and what is between them; comments are left out."""
    tokens = [token for token in _TOKEN.findall(text) if not token.startswith("--")]
    if "/*" in tokens:
        raise ValueError("comments in brackets are not allowed")
    if any("\\'" in token for token in tokens if token.startswith("'")):
        raise ValueError("write a quote in a literal twice")
    return tokens


def to_markers(text: str, args: dict | None = None) -> str:
    """Values are bound, never pasted: ``'%{name}%'`` -> ``concat('%', :name, '%')``, and a bare ``{name}`` -> ``:name``.

    Only inside a quoted name, which cannot be bound, the value itself is put in, without its quotes. ``"Name"``
    becomes an identifier.
    """
    args = args or {}

    def in_name(found: re.Match) -> str:
        return re.sub(r'[`"]', "", str(args[found[1]])) if found[1] in args else found[0]

    def bound(token: str) -> str:
        parts = _PARAMETER.split(token[1:-1])
        if len(parts) == 1:
            return token
        pieces = [f":{part}" if at % 2 else f"'{part}'" for at, part in enumerate(parts) if part]
        return pieces[0] if len(pieces) == 1 else f"concat({', '.join(pieces)})"

    done = []
    for token in _tokens(text):
        if token[0] == "'" and len(token) > 1:
            done.append(bound(token))
        elif token[0] in '"`' and len(token) > 1:
            name = token[1:-1].replace('""', '"') if token[0] == '"' else token[1:-1].replace("``", "`")
            done.append("`" + _PARAMETER.sub(in_name, name).replace("`", "``") + "`")
        else:
            done.append(_PARAMETER.sub(r":\1", token))
    return "".join(done)


def check_select(spark: SparkSession, text: str, views: Iterable[str] = (VIEW,)) -> str:
    """The text without a closing semicolon, if it is one query over the given views; else it is refused before it runs."""
    query = text.strip().rstrip(";").rstrip()
    if not re.match(SELECT_START, query):
        raise guard.Refused("only SELECT queries are allowed")
    guard.check_text(spark, query, views)
    return query


def verdicts(texts: DataFrame, column: str = "sql_query", views: Iterable[str] = (VIEW,)) -> DataFrame:
    """Stored texts with why each may not run (``refused``), null if it may; an empty one may not."""
    return guard.with_verdicts(texts, column, views, lambda text: check_select(texts.sparkSession, to_markers(text), views))


def _over(spark: SparkSession, rows: DataFrame, query: str, args: dict) -> DataFrame:
    """The query over ``rows`` by a view with a name of its own, which is gone when the plan is made."""
    view = f"{VIEW}_{uuid.uuid4().hex}"
    rows.createOrReplaceTempView(view)
    try:
        return spark.sql(f"WITH {VIEW} AS (SELECT * FROM {view}) SELECT * FROM (\n{query}\n)", args=args)
    finally:
        spark.catalog.dropTempView(view)


def run_sql(spark: SparkSession, shipments: DataFrame, text: str, **args) -> DataFrame:
    """Runs stored SQL over shipments with its parameters bound. ``"Name"`` in it is an identifier.

    The text is parsed and checked, then analysed over empty rows and checked again, and only then reads shipments. Calls
    don't disturb one another.
    """
    query = check_select(spark, to_markers(text, args))
    rows = with_classes(shipments)
    guard.check_leaves(_over(spark, guard.empty_like(rows), query, args))
    return _over(spark, rows, query, args)


def _row(table: DataFrame, id_: int, what: str):
    found = table.where(F.col("id") == id_).limit(1).first()
    if found is None:
        raise LookupError(f"{what} {id_} not found")
    return found


def run_report(
    spark: SparkSession, shipments: DataFrame, reports: DataFrame, id_: int, as_of: date | None = None, **args
) -> DataFrame:
    """Runs a stored report; one without SQL is built from its stored filters and columns."""
    report = _row(reports.withColumn("given", unpack_params(F.col("parameters"))), id_, "report")
    if report["sql_query"]:
        return run_sql(spark, shipments, report["sql_query"], **args)
    given = report["given"]
    filters, columns = (given["filters"], given["columns"]) if given else ({}, [])
    return build_query(normalise(shipments), filters, columns, as_of)


def run_widget(
    spark: SparkSession,
    shipments: DataFrame,
    widgets: DataFrame,
    id_: int,
    as_of: date | None = None,
    start: date | str | None = None,
    end: date | str | None = None,
) -> DataFrame:
    """Runs a widget over its calendar range.

    ``{start_date}`` and ``{end_date}`` in its text become ``DD-Mon-YY`` texts; the markers ``:start_date`` and
    ``:end_date`` are ISO dates.
    """
    widget = _row(widgets, id_, "widget")
    first, last = calendar_range(widget["date_range"], as_of, start, end)
    text = widget["sql_query"]
    for name, day in (("start_date", first), ("end_date", last)):
        text = text.replace(f"{{{name}}}", f"{day:%d-%b-%y}")
    given = {"start_date": first.isoformat(), "end_date": last.isoformat()}
    return run_sql(spark, shipments, text, **{name: day for name, day in given.items() if f":{name}" in text})


def run_event(reports: DataFrame, id_: int, used_at: str) -> DataFrame:
    """The usage event of one run, to be applied with ``apply_usage``."""
    return reports.where(F.col("id") == id_).select("id", F.lit(used_at).cast("timestamp_ntz").alias("used_at"))


def active_schedules(schedules: DataFrame, reports: DataFrame) -> DataFrame:
    """Active schedules with the name and text of their report, next run first.

    Which side is broadcast, if any, is left to Spark, which knows the sizes.
    """
    titles = reports.select(
        F.col("id").alias("_report"),
        F.col("report_name").alias("report_title"),
        F.col("description").alias("report_description"),
    )
    return (
        active(schedules)
        .join(titles, F.col("report_id") == F.col("_report"))
        .drop("_report")
        .orderBy(F.asc_nulls_last("next_run_at"), F.desc_nulls_first("created_at"), F.asc("id"))
    )


def list_reports(reports: DataFrame) -> DataFrame:
    return reports.orderBy(F.desc_nulls_first("created_at"), F.asc("id"))


def get_report(reports: DataFrame, id_: int) -> DataFrame:
    return reports.where(F.col("id") == id_)


def list_searches(searches: DataFrame) -> DataFrame:
    return searches.orderBy(F.desc_nulls_first("last_used_at"), F.desc_nulls_first("created_at"), F.asc("id"))


def list_widgets(widgets: DataFrame) -> DataFrame:
    return active(widgets).orderBy(F.asc_nulls_last("position"), F.asc("id"))
