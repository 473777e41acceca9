"""Fixed schemas of the shipments table and of the four small tables that sit beside it."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

_S = T.StringType()
_L = T.LongType()
_I = T.IntegerType()
_B = T.BooleanType()
_TS = T.TimestampNTZType()


def _struct(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, *rest) for name, dtype, *rest in fields])


SHIPMENTS = _struct(
    ("id", _L, False),
    ("number_shipment", _S),
    ("country_code", _S),
    ("shipper_city", _S),
    ("shipper_phone", _S),
    ("shipper_name", _S),
    ("shipper_address", _S),
    ("consignee_city", _S),
    ("consignee_phone", _S),
    ("consignee_name", _S),
    ("consignee_address", _S),
    ("shipment_reference_number", _S),
    ("shipment_creation_date", _S),
    ("cod", _S),
    ("shipment_weight", _S),
    ("number_of_shipment_boxes", _S),
    ("shipment_description", _S),
    ("pdf_filename", _S),
    ("processing_date", _S),
    ("created_at", _TS),
)

SHIPMENT_COLUMNS = SHIPMENTS.fieldNames()

SAVED_SEARCHES = _struct(
    ("id", _L, False),
    ("title", _S, False),
    ("description", _S),
    ("filters", _S, False),
    ("created_at", _TS),
    ("last_used_at", _TS),
    ("usage_count", _I),
    ("user_id", _S),
)

CUSTOM_REPORTS = _struct(
    ("id", _L, False),
    ("report_name", _S, False),
    ("description", _S),
    ("sql_query", _S, False),
    ("parameters", _S),
    ("created_at", _TS),
    ("last_executed", _TS),
    ("execution_count", _I),
    ("user_id", _S),
)

SCHEDULED_REPORTS = _struct(
    ("id", _L, False),
    ("report_id", _L),
    ("schedule_name", _S, False),
    ("schedule_type", _S, False),
    ("schedule_time", _S),
    ("schedule_days", _S),
    ("email_recipients", _S),
    ("email_subject", _S),
    ("email_body", _S),
    ("is_active", _B),
    ("next_run_at", _TS),
    ("last_run_at", _TS),
    ("created_at", _TS),
    ("updated_at", _TS),
    ("user_id", _S),
)

DASHBOARD_WIDGETS = _struct(
    ("id", _L, False),
    ("widget_name", _S, False),
    ("description", _S),
    ("widget_type", _S),
    ("sql_query", _S, False),
    ("icon", _S),
    ("color", _S),
    ("date_range", _S),
    ("position", _I),
    ("is_active", _B),
    ("created_at", _TS),
    ("updated_at", _TS),
    ("user_id", _S),
)

NOW = object()
"""Marks a default that is the time of the change."""


@dataclass(frozen=True)
class TableSpec:
    """How one small table takes changes.

    ``defaults`` fill absent values on insert, ``replaced`` are the columns a full update writes (an absent one goes
    back to its value in ``reset``), ``patched`` are the columns a patch may write, and ``stamped`` names the
    operations that set ``updated_at``. ``required`` columns may not be null.
    """

    schema: T.StructType
    defaults: dict
    replaced: tuple[str, ...] = ()
    reset: dict = field(default_factory=dict)
    patched: tuple[str, ...] = ()
    stamped: tuple[str, ...] = ()
    required: tuple[str, ...] = ()


# The column defaults of the four tables.
TABLES: dict[str, TableSpec] = {
    "saved_searches": TableSpec(
        schema=SAVED_SEARCHES,
        defaults={
            "description": "",
            "created_at": NOW,
            "last_used_at": NOW,
            "usage_count": 0,
            "user_id": "default_user",
        },
        replaced=("title", "description", "filters"),
        reset={"description": ""},
        required=("title", "filters"),
    ),
    "custom_reports": TableSpec(
        schema=CUSTOM_REPORTS,
        defaults={
            "description": "",
            "sql_query": "",
            "parameters": "{}",
            "created_at": NOW,
            "execution_count": 0,
            "user_id": "default_user",
        },
        replaced=("report_name", "description", "sql_query", "parameters"),
        reset={"description": "", "sql_query": "", "parameters": "{}"},
        required=("report_name",),
    ),
    "scheduled_reports": TableSpec(
        schema=SCHEDULED_REPORTS,
        defaults={
            "schedule_type": "daily",
            "schedule_time": "09:00:00",
            "schedule_days": "[]",
            "email_recipients": "[]",
            "email_subject": "",
            "email_body": "",
            "is_active": True,
            "created_at": NOW,
            "updated_at": NOW,
            "user_id": "default_user",
        },
        replaced=(
            "schedule_name",
            "schedule_type",
            "schedule_time",
            "schedule_days",
            "email_recipients",
            "email_subject",
            "email_body",
        ),
        reset={
            "schedule_type": "daily",
            "schedule_time": "09:00:00",
            "schedule_days": "[]",
            "email_recipients": "[]",
            "email_subject": "",
            "email_body": "",
        },
        stamped=("update", "set_active"),
        required=("report_id", "schedule_name"),
    ),
    "dashboard_widgets": TableSpec(
        schema=DASHBOARD_WIDGETS,
        defaults={
            "description": "",
            "widget_type": "number_card",
            "icon": "activity",
            "color": "#3B82F6",
            "date_range": "today",
            "is_active": True,
            "created_at": NOW,
            "updated_at": NOW,
            "user_id": "default_user",
        },
        patched=("widget_name", "description", "widget_type", "sql_query", "icon", "color", "date_range"),
        stamped=("patch",),
        required=("widget_name", "sql_query"),
    ),
}
