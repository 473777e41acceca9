"""Reading, normalising and writing shipments and the small tables beside them."""

from .normalised import normalise, with_classes, write_normalised
from .rows import from_json_rows, from_rows
from .scratch import scratch_path, write_once
from .sinks import export_csv, export_csv_parts, export_summary
from .tables import ensure_tables, load_jdbc, load_shipments, load_table, publish, with_defaults

__all__ = [
    "ensure_tables",
    "export_csv",
    "export_csv_parts",
    "export_summary",
    "from_json_rows",
    "from_rows",
    "load_jdbc",
    "load_shipments",
    "load_table",
    "normalise",
    "publish",
    "scratch_path",
    "with_classes",
    "with_defaults",
    "write_once",
    "write_normalised",
]
