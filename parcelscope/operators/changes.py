"""Batches of changes merged into a keyed table.

A change has a unique increasing ``seq``, a time ``changed_at``, an ``op`` (insert, update, patch, delete or
set_active), a key and the new values. The merged table is a new DataFrame; publish it as a new version.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import TABLES, TableSpec
from ..sources.tables import with_defaults

# Fixed value: how a stored query begins.
SELECT_START = r"^(?i:\s*(SELECT|WITH)\b)"
_NUMBERING_RANGES = 1 << 12
_ROWS_PER_RANGE = 1_000_000


def numbered(df: DataFrame, order: str, name: str, first: Column, rows_per_task: int = _ROWS_PER_RANGE) -> DataFrame:
    """Consecutive numbers from ``first`` in the order of a unique integer column.

    Rows are counted per range of the column and the counts are summed up; each range then numbers its own rows, so
    that no task sorts the whole table. A range that holds many rows, because the values crowd there, is cut again
    between its own smallest and largest value.
    """
    at = F.col(order)
    low = df.agg(F.min(order)).scalar()
    span = df.agg(F.max(order) - F.min(order) + 1).scalar()
    coarse = df.withColumn("_range", F.floor((at - low) / F.ceil(span / F.lit(_NUMBERING_RANGES))).cast("long"))
    ranges = coarse.groupBy("_range").agg(
        F.min(order).alias("_low"),
        F.ceil((F.max(order) - F.min(order) + 1) / F.ceil(F.count(F.lit(1)) / F.lit(rows_per_task))).alias("_width"),
    )
    # At most one row per coarse range, whatever the size of the table.
    fine = coarse.join(F.broadcast(ranges), "_range").withColumn(
        "_part", F.floor((at - F.col("_low")) / F.col("_width")).cast("long")
    )
    counts = fine.groupBy("_range", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_range", "_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("_range", "_part", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range", "_part").orderBy(order))
    return (
        fine.join(starts, ["_range", "_part"])
        .withColumn(name, first + F.col("_before") + inside - 1)
        .drop("_range", "_part", "_low", "_width", "_before")
    )


def _written(spec: TableSpec) -> dict[str, list[tuple[Column, Column]]]:
    """Per column, which changes write it and what they write."""
    op = F.col("op")
    writes: dict[str, list[tuple[Column, Column]]] = {}
    for name in spec.replaced:
        value = F.coalesce(F.col(name), F.lit(spec.reset[name])) if name in spec.reset else F.col(name)
        writes.setdefault(name, []).append((op == "update", value))
    for name in spec.patched:
        writes.setdefault(name, []).append(((op == "patch") & F.col(name).isNotNull(), F.col(name)))
    if "is_active" in spec.schema.fieldNames():
        writes["is_active"] = [(op == "set_active", F.coalesce(F.col("is_active"), F.lit(True)))]
    if spec.stamped:
        writes["updated_at"] = [(op.isin(*spec.stamped), F.col("changed_at"))]
    return writes


def fold_changes(changes: DataFrame, name: str, key: str = "id") -> DataFrame:
    """One row per key: when it was deleted, and per column the last value written with its place, as if applied in order.

    ``max_by`` combines on the map side, so one key may hold any part of the batch.
    """
    spec = TABLES[name]
    absent = [field for field in spec.schema if field.name not in changes.columns]
    rows = changes.where((F.col("op") != "insert") & F.col(key).isNotNull())
    rows = rows.select("*", *[F.lit(None).cast(field.dataType).alias(field.name) for field in absent])
    last = []
    for column, writes in _written(spec).items():
        for writes_it, value in writes:
            at = F.when(writes_it, F.col("seq"))
            last.append(F.max_by(F.struct(value.alias("value"), "seq"), at).alias(f"new_{column}"))
    deleted = F.max(F.when(F.col("op") == "delete", F.col("seq")))
    return rows.groupBy(key).agg(deleted.alias("deleted"), *last)


def apply_changes(
    base: DataFrame, changes: DataFrame, name: str, key: str = "id", first_id: int | Column | None = None
) -> DataFrame:
    """The table after a batch, as if its changes were applied in order.

    Inserts get consecutive new keys, and later changes of the batch may name those. Changes of keys that do not exist
    at their time do nothing: the last write of a key counts if it is behind the key's insert, so one pass over the
    changes is enough.
    """
    columns = TABLES[name].schema.fieldNames()
    folded = fold_changes(changes, name, key)
    written = {column[4:] for column in folded.columns if column.startswith("new_")}
    born = F.lit(None).cast("long").alias("_born")
    rows = base.select(*columns, born).unionByName(_filled(_numbered_inserts(base, changes, key, first_id), base, name, key, first_id, True))
    merged = rows.join(folded, key, "left")
    behind = lambda at: F.col("_born").isNull() | (at > F.col("_born"))
    deleted = F.col("deleted").isNotNull() & behind(F.col("deleted"))
    return merged.where(~deleted).select(
        *[
            F.when(F.col(f"new_{c}").isNotNull() & behind(F.col(f"new_{c}.seq")), F.col(f"new_{c}.value")).otherwise(F.col(c)).alias(c)
            if c in written
            else F.col(c)
            for c in columns
        ]
    )


def new_rows(
    base: DataFrame, changes: DataFrame, name: str, key: str = "id", first_id: int | Column | None = None
) -> DataFrame:
    """Inserted rows with defaults, keys after the largest one, and for widgets positions after the last one."""
    return _filled(_numbered_inserts(base, changes, key, first_id), base, name, key, first_id)


def _first_key(base: DataFrame, key: str, first_id: int | Column | None) -> Column:
    return F.coalesce(base.agg(F.max(key)).scalar(), F.lit(0)) + 1 if first_id is None else F.lit(first_id)


def _numbered_inserts(base: DataFrame, changes: DataFrame, key: str, first_id: int | Column | None) -> DataFrame:
    inserts = changes.where(F.col("op") == "insert").drop(key)
    return numbered(inserts, "seq", key, _first_key(base, key, first_id))


def _filled(
    rows: DataFrame, base: DataFrame, name: str, key: str, first_id: int | Column | None, with_seq: bool = False
) -> DataFrame:
    if "position" in TABLES[name].schema.fieldNames():
        nth = F.col(key) - _first_key(base, key, first_id)
        rows = rows.withColumn("position", F.coalesce(base.agg(F.max("position")).scalar(), F.lit(-1)) + 1 + nth)
    if with_seq:
        return with_defaults(rows, name, F.col("changed_at"), F.col("seq").alias("_born"))
    return with_defaults(rows, name, F.col("changed_at"))


def deleted_keys(changes: DataFrame, key: str = "id") -> DataFrame:
    return changes.where(F.col("op") == "delete").select(key).distinct()


def cascade(children: DataFrame, parent_key: str, deleted: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose parent was not deleted."""
    gone = deleted.select(F.col(key).alias("_gone"))
    return children.join(gone, children[parent_key] == F.col("_gone"), "left_anti")


def apply_usage(base: DataFrame, events: DataFrame, count: str, last: str, key: str = "id") -> DataFrame:
    """Adds the number of uses to a counter and sets the time of the last one."""
    used = events.groupBy(key).agg(F.count(F.lit(1)).alias("_uses"), F.max("used_at").alias("_last"))
    joined = base.join(used, key, "left")
    changed = {
        count: (F.col(count) + F.coalesce(F.col("_uses"), F.lit(0))).cast("int"),
        last: F.coalesce(F.col("_last"), F.col(last)),
    }
    return joined.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in base.columns])


def reorder(widgets: DataFrame, order: DataFrame, key: str = "id") -> DataFrame:
    """Position = place in the given order ``(id, index)``, the last place of a repeated id; others keep theirs."""
    places = order.groupBy(key).agg(F.max("index").alias("_place"))
    position = F.coalesce(F.col("_place"), F.col("position")).cast("int").alias("position")
    joined = widgets.join(places, key, "left")
    return joined.select(*[position if c == "position" else F.col(c) for c in widgets.columns])


def check_unique(df: DataFrame, *keys: str) -> DataFrame:
    """Key values that occur more than once, with their number of rows; empty when the keys are unique."""
    counts = df.groupBy(*(keys or ("report_name", "user_id"))).agg(F.count(F.lit(1)).alias("rows"))
    return counts.where(F.col("rows") > 1)


class Merge(NamedTuple):
    """A table after a batch, the changes that were refused, and one row with the largest key and ``seq`` ever given out.

    ``children`` is the table below it without the rows whose parent the batch deleted.
    """

    rows: DataFrame
    rejected: DataFrame
    last_id: DataFrame
    children: DataFrame | None = None


def broken_rule(changes: DataFrame, name: str) -> Column:
    """Why a change may not be merged, judged by itself, or null.

    Stored SQL must begin like a query; a widget can't do without. Columns that may not be null must be given by an
    insert and by an update that writes them.
    """
    spec, fields = TABLES[name], set(changes.columns)
    op, found = F.col("op"), F.lit(None).cast("string")
    if "sql_query" in fields & set(spec.schema.fieldNames()):
        text = F.col("sql_query")
        bad = ~F.coalesce(text, F.lit("")).rlike(SELECT_START)
        absent = text.isNull() & (op == "patch")
        allowed = absent if name == "dashboard_widgets" else text.isNull() | (text == "")
        writes = op.isin("insert", "update", "patch")
        found = F.when(writes & bad & ~allowed, F.lit("only SELECT queries are allowed"))
    for column in spec.required:
        given = F.col(column) if column in fields else F.lit(None)
        writes = op == "insert"
        if column in spec.replaced:
            writes = op.isin("insert", "update")
        found = F.coalesce(found, F.when(writes & given.isNull(), F.lit(f"{column} is missing")))
    return found


def rejected_changes(
    base: DataFrame, changes: DataFrame, name: str, key: str = "id", last_id: int | None = None
) -> DataFrame:
    """``(seq, reason)`` of changes that may not be merged: those that break a rule, and those whose name is taken.

    The name of a report is unique per user at every moment, as if the changes were applied one by one.
    """
    return _judged(base, changes, name, key, last_id).where("reason IS NOT NULL").select("seq", "reason")


def _mark(base: DataFrame, key: str, last_id: int | None) -> Column:
    return F.greatest(F.coalesce(base.agg(F.max(key)).scalar(), F.lit(0)), F.lit(last_id or 0))


def _judged(base: DataFrame, changes: DataFrame, name: str, key: str, last_id: int | None) -> DataFrame:
    judged = changes.withColumn("reason", broken_rule(changes, name))
    if "report_name" not in TABLES[name].schema.fieldNames() or "report_name" not in changes.columns:
        return judged
    from .names import taken_names

    user = F.coalesce(F.col("user_id"), F.lit("default_user")) if "user_id" in changes.columns else F.lit("default_user")
    batch = judged.where("reason IS NULL AND op IN ('insert', 'update', 'patch', 'delete')").select(
        "seq",
        "op",
        F.when(F.col("op") != "insert", F.col(key)).cast("long").alias("key"),
        F.when(F.col("op") != "delete", F.col("report_name")).alias("name"),
        F.when(F.col("op") == "insert", user).alias("user"),
    )
    taken = taken_names(base, batch, "report_name", "user_id", key, last_id)
    taken = taken.select("seq", F.lit("name is taken").alias("_taken"))
    return judged.join(taken, "seq", "left").withColumn("reason", F.coalesce("reason", "_taken")).drop("_taken")


def merge_batch(
    base: DataFrame,
    changes: DataFrame,
    name: str,
    last_id: int | None = None,
    key: str = "id",
    last_seq: int | None = None,
    children: tuple[DataFrame, str] | None = None,
) -> Merge:
    """``apply_changes`` with the rules of the table. Keep ``last_id`` and ``last_seq`` with the table and pass them on.

    Keys come after the largest one ever given out, so that of a deleted row doesn't come again. Changes up to
    ``last_seq`` have been merged before and are skipped, so a batch that comes again changes nothing. ``children`` is a
    table with the name of its column that holds keys of this one: its rows go with their parent.
    """
    if last_seq is not None:
        changes = changes.where(F.col("seq") > last_seq)
    judged = _judged(base, changes, name, key, last_id)
    rejected = judged.where("reason IS NOT NULL").select("seq", "reason")
    accepted = judged.where("reason IS NULL").drop("reason")
    mark = _mark(base, key, last_id)
    first_id = None if last_id is None else base.sparkSession.range(1).select(mark + 1).scalar()
    rows = apply_changes(base, accepted, name, key, first_id)
    newest = judged.agg(
        (mark + F.count_if((F.col("op") == "insert") & F.col("reason").isNull())).alias("last_id"),
        F.greatest(F.max("seq"), F.lit(last_seq).cast("long")).alias("last_seq"),
    )
    left = None
    if children:
        table, parent = children
        left = cascade(table, parent, _gone(rows, accepted, key), key)
    return Merge(rows, rejected, newest, left)


def _gone(rows: DataFrame, accepted: DataFrame, key: str) -> DataFrame:
    """Keys that the batch deletes and the table no longer has."""
    return deleted_keys(accepted.where(F.col(key).isNotNull()), key).join(rows.select(key), key, "left_anti")
