"""The JSON parameter bundle of a stored report."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The keys of the bundle, in order.
PARAMS_SCHEMA = (
    "filters map<string,string>, columns array<string>, report_type string, "
    "chart_config map<string,string>, schedule_config map<string,string>, is_public boolean"
)


def pack_params(
    filters: Column,
    columns: Column,
    report_type: Column | None = None,
    chart_config: Column | None = None,
    schedule_config: Column | None = None,
    is_public: Column | None = None,
) -> Column:
    empty = F.lit("{}")
    no_map = F.from_json(empty, "map<string,string>")
    given = lambda column, default: default if column is None else F.coalesce(column, default)
    return F.to_json(
        F.struct(
            given(filters, no_map).alias("filters"),
            given(columns, F.array().cast("array<string>")).alias("columns"),
            given(report_type, F.lit("custom")).alias("report_type"),
            given(chart_config, no_map).alias("chart_config"),
            given(schedule_config, no_map).alias("schedule_config"),
            given(is_public, F.lit(False)).alias("is_public"),
        )
    )


def unpack_params(text: Column) -> Column:
    """Struct of the bundle; NULL fields where a key is missing."""
    return F.from_json(text, PARAMS_SCHEMA)
