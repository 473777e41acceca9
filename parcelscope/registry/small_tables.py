"""Stored queries and change batches over the small tables (Q, M)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import changes as M
from ..plans import stored
from ..sources import sample, scratch_path
from ..sources.sample import shipments
from .base import AS_OF, register
from .oracle import over_shipments, over_tables


def _doubles(df):
    return df.select(*[F.col(n).cast("double") if kind.startswith("decimal") else F.col(n) for n, kind in df.dtypes])


def _stored_report(key: str, id_: int, sql: str, **args) -> None:
    register(key, over_shipments(sql))(
        lambda spark, sf: _doubles(
            stored.run_report(spark, shipments(spark, sf), sample.custom_reports(spark, sf), id_, AS_OF, **args)
        )
    )


_stored_report("q01_run_report", 2, "SELECT shipper_city AS city, count(*)::BIGINT AS shipments FROM ship GROUP BY 1")
_stored_report("q01_run_report_sum", 3, "SELECT country_code, sum(cod_amount)::DOUBLE AS cod FROM ship GROUP BY 1")
_stored_report(
    "q01_run_report_bound",
    4,
    "SELECT count(*)::BIGINT AS shipments FROM ship WHERE shipper_phone LIKE '%800%'",
    phone_number="800",
)
_stored_report(
    "q02_report_without_sql",
    1,
    """SELECT id, shipper_city, shipment_weight FROM ship WHERE weight_kg >= 1
    AND contains(shipper_city, 'NATION_' || (SELECT p_size % 25 FROM part WHERE p_partkey = 0)::VARCHAR)""",
)


def _stored_widget(key: str, id_: int, first: str, last: str) -> None:
    day = "CASE WHEN regexp_matches(creation_ymd, '^[0-9]{8}$') THEN strptime(creation_ymd, '%Y%m%d') END"
    sql = f"""SELECT count(*)::BIGINT AS shipments, sum(weight_kg)::DOUBLE AS weight_kg FROM ship
        WHERE {day} BETWEEN DATE '{first}' AND DATE '{last}'"""
    register(key, over_shipments(sql))(
        lambda spark, sf: _doubles(
            stored.run_widget(
                spark,
                shipments(spark, sf),
                sample.dashboard_widgets(spark, sf),
                id_,
                AS_OF,
                start="2025-06-01",
                end="2025-06-30",
            )
        )
    )


_stored_widget("q03_widget_yesterday", 1, "2025-07-31", "2025-07-31")
_stored_widget("q03_widget_this_week", 2, "2025-07-28", "2025-08-01")
_stored_widget("q03_widget_this_month", 3, "2025-08-01", "2025-08-01")
_stored_widget("q03_widget_custom", 4, "2025-06-01", "2025-06-30")


@register(
    "q04_select_only",
    over_tables(
        "custom_reports", "SELECT sql_query, count(*)::BIGINT AS reports, sql_query <> '' AS runs FROM custom_reports GROUP BY 1"
    ),
)
def q04(spark, sf):
    """Each stored text once, with whether the guard lets it run."""
    counts = sample.custom_reports(spark, sf).groupBy("sql_query").agg(F.count(F.lit(1)).alias("reports"))
    return stored.verdicts(counts).withColumn("runs", F.col("refused").isNull()).drop("refused")


@register(
    "q04_guard",
    over_tables("guarded_texts", "SELECT id, sql_query, kind < 9 AS runs FROM guarded_texts"),
)
def q04_guard(spark, sf):
    """Texts of every kind that stored SQL may and may not be, one per part."""
    checked = stored.verdicts(sample.guarded_texts(spark, sf))
    return checked.select("id", "sql_query", F.col("refused").isNull().alias("runs"))


@register(
    "q05_run_statistics",
    over_tables(
        "custom_reports usage_events",
        """SELECT * EXCLUDE (used, n, last) REPLACE ((execution_count + coalesce(n, 0))::INT AS execution_count,
        coalesce(last, last_executed) AS last_executed) FROM custom_reports
        LEFT JOIN (SELECT id AS used, count(*) AS n, max(used_at) AS last FROM usage_events GROUP BY 1) u ON used = id""",
    ),
)
def q05(spark, sf):
    return M.apply_usage(
        sample.custom_reports(spark, sf), sample.usage_events(spark, sf), "execution_count", "last_executed"
    )


# The texts below apply a batch by numbering the changes of a key, newest first, where the Spark side folds them.
_NEW_REPORTS = """SELECT (SELECT max(id) FROM custom_reports) + row_number() OVER (ORDER BY seq) AS id, report_name,
    coalesce(description, '') AS description, coalesce(sql_query, '') AS sql_query,
    coalesce(parameters, '{}') AS parameters, changed_at AS created_at, CAST(NULL AS TIMESTAMP) AS last_executed,
    0 AS execution_count, 'default_user' AS user_id FROM report_changes WHERE op = 'insert'"""
_UPDATED_REPORTS = """SELECT r.id, coalesce(u.report_name, r.report_name) AS report_name,
    CASE WHEN u.id IS NULL THEN r.description ELSE coalesce(u.description, '') END AS description,
    CASE WHEN u.id IS NULL THEN r.sql_query ELSE coalesce(u.sql_query, '') END AS sql_query,
    CASE WHEN u.id IS NULL THEN r.parameters ELSE coalesce(u.parameters, '{}') END AS parameters,
    r.created_at, r.last_executed, r.execution_count, r.user_id
    FROM custom_reports r LEFT JOIN (
      SELECT * FROM report_changes WHERE op = 'update' QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1
    ) u ON u.id = r.id"""
_NOT_DELETED = "NOT EXISTS (SELECT 1 FROM {table} d WHERE d.op = 'delete' AND d.id = r.id)"


def _of(changes, *ops: str):
    return changes.where(F.col("op").isin(*ops))


@register(
    "m01_insert",
    over_tables("custom_reports changes report_changes", f"SELECT * FROM custom_reports UNION ALL {_NEW_REPORTS}"),
)
def m01(spark, sf):
    inserts = _of(sample.report_changes(spark, sf), "insert")
    return M.apply_changes(sample.custom_reports(spark, sf), inserts, "custom_reports")


@register(
    "m01_ids_are_not_reused",
    over_tables(
        "changes saved_searches search_changes",
        """SELECT * FROM saved_searches WHERE id <> (SELECT max(id) FROM saved_searches) UNION ALL
        SELECT (SELECT max(id) FROM saved_searches) + row_number() OVER (ORDER BY seq) AS id, title,
        coalesce(description, ''), filters, changed_at, changed_at, 0, 'default_user'
        FROM search_changes WHERE op = 'insert'""",
    ),
)
def m01_ids(spark, sf):
    """Two batches: the first deletes the newest row, the second inserts."""
    base, changes = sample.saved_searches(spark, sf), sample.search_changes(spark, sf)
    newest = base.agg(F.max("id").alias("id")).withColumn("op", F.lit("delete")).withColumn("seq", F.lit(0).cast("long"))
    deletes = changes.limit(0).unionByName(newest, allowMissingColumns=True)
    first = M.merge_batch(base, deletes, "saved_searches", 0)
    last = first.last_id.first()["last_id"]
    # Each version is published before the next batch.
    path = scratch_path(spark, "saved_searches")
    first.rows.write.parquet(path)
    return M.merge_batch(spark.read.schema(base.schema).parquet(path), _of(changes, "insert"), "saved_searches", last).rows


@register("m02_update", over_tables("custom_reports changes report_changes", _UPDATED_REPORTS))
def m02(spark, sf):
    updates = _of(sample.report_changes(spark, sf), "update")
    return M.apply_changes(sample.custom_reports(spark, sf), updates, "custom_reports")


_PATCHED = """SELECT r.id, coalesce(p.widget_name, r.widget_name) AS widget_name,
    coalesce(p.description, r.description) AS description, r.widget_type, r.sql_query, r.icon, r.color,
    coalesce(p.date_range, r.date_range) AS date_range, r.position, {active} AS is_active, r.created_at,
    coalesce(p.at, r.updated_at) AS updated_at, r.user_id
    FROM dashboard_widgets r LEFT JOIN (
      SELECT id, last(widget_name ORDER BY seq) FILTER (WHERE widget_name IS NOT NULL) AS widget_name,
        last(description ORDER BY seq) FILTER (WHERE description IS NOT NULL) AS description,
        last(date_range ORDER BY seq) FILTER (WHERE date_range IS NOT NULL) AS date_range, max(changed_at) AS at
      FROM widget_changes WHERE op = 'patch' GROUP BY id
    ) p ON p.id = r.id"""


@register(
    "m03_patch",
    over_tables("dashboard_widgets changes widget_changes", _PATCHED.format(active="r.is_active")),
)
def m03(spark, sf):
    patches = _of(sample.widget_changes(spark, sf), "patch")
    return M.apply_changes(sample.dashboard_widgets(spark, sf), patches, "dashboard_widgets")


@register(
    "m04_delete",
    over_tables(
        "saved_searches changes search_changes",
        f"SELECT * FROM saved_searches r WHERE {_NOT_DELETED.format(table='search_changes')}",
    ),
)
def m04(spark, sf):
    deletes = _of(sample.search_changes(spark, sf), "delete")
    return M.apply_changes(sample.saved_searches(spark, sf), deletes, "saved_searches")


@register(
    "m05_set_active",
    over_tables(
        "scheduled_reports changes schedule_changes",
        """SELECT r.* REPLACE (coalesce(c.active, r.is_active) AS is_active,
        coalesce(c.at, r.updated_at) AS updated_at) FROM scheduled_reports r LEFT JOIN (
          SELECT id AS changed, is_active AS active, changed_at AS at FROM schedule_changes WHERE op = 'set_active'
          QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1) c ON changed = r.id""",
    ),
)
def m05(spark, sf):
    flags = _of(sample.schedule_changes(spark, sf), "set_active")
    return M.apply_changes(sample.scheduled_reports(spark, sf), flags, "scheduled_reports")


@register(
    "m05_soft_delete",
    over_tables(
        "dashboard_widgets changes widget_changes",
        """SELECT * REPLACE (is_active AND id NOT IN (SELECT id FROM widget_changes WHERE op = 'set_active')
        AS is_active) FROM dashboard_widgets""",
    ),
)
def m05_soft(spark, sf):
    flags = _of(sample.widget_changes(spark, sf), "set_active")
    return M.apply_changes(sample.dashboard_widgets(spark, sf), flags, "dashboard_widgets")


@register(
    "m06_usage",
    over_tables(
        "saved_searches usage_events",
        """SELECT * EXCLUDE (used, n, last) REPLACE ((usage_count + coalesce(n, 0))::INT AS usage_count,
        coalesce(last, last_used_at) AS last_used_at) FROM saved_searches
        LEFT JOIN (SELECT id AS used, count(*) AS n, max(used_at) AS last FROM usage_events GROUP BY 1) u ON used = id""",
    ),
)
def m06(spark, sf):
    return M.apply_usage(
        sample.saved_searches(spark, sf), sample.usage_events(spark, sf), "usage_count", "last_used_at"
    )


@register(
    "m07_reorder",
    over_tables(
        "dashboard_widgets widget_order",
        """SELECT * EXCLUDE (moved, place) REPLACE (coalesce(place, position)::INT AS position) FROM dashboard_widgets
        LEFT JOIN (SELECT id AS moved, index AS place FROM widget_order) o ON moved = id""",
    ),
)
def m07(spark, sf):
    return M.reorder(sample.dashboard_widgets(spark, sf), sample.widget_order(spark, sf))


@register(
    "m08_unique",
    over_tables(
        "custom_reports",
        """SELECT report_name, user_id, count(*)::BIGINT AS rows FROM custom_reports GROUP BY 1, 2 HAVING count(*) > 1""",
    ),
)
def m08(spark, sf):
    return M.check_unique(sample.custom_reports(spark, sf))


# The text applies the changes one after the other, where the Spark side settles all verdicts together.
@register(
    "m08_names_in_order",
    over_tables(
        "custom_reports named_reports changes name_changes",
        """WITH c AS (SELECT *, row_number() OVER (ORDER BY seq) AS i FROM name_changes),
        s AS (
          SELECT 0::BIGINT AS i, NULL::BIGINT AS refused, (SELECT max(id) FROM named_reports) AS last,
            (SELECT list({'k': id, 'n': report_name}) FROM named_reports) AS held
          UNION ALL
          SELECT i, CASE WHEN taken THEN seq END, last + (op = 'insert' AND NOT taken)::BIGINT,
            CASE WHEN taken THEN held
              WHEN op = 'insert' THEN list_append(held, {'k': last + 1, 'n': report_name})
              WHEN op = 'delete' THEN list_filter(held, lambda x: x.k <> id)
              ELSE list_transform(held, lambda x: CASE WHEN x.k = id THEN {'k': x.k, 'n': report_name} ELSE x END) END
          FROM (SELECT c.i, c.seq, c.op, c.id, c.report_name, s.last, s.held,
              len(list_filter(s.held, lambda x: x.n = c.report_name AND x.k IS DISTINCT FROM c.id)) > 0
                AND (c.op = 'insert' OR c.op = 'update' AND len(list_filter(s.held, lambda x: x.k = c.id)) > 0) AS taken
            FROM s JOIN c ON c.i = s.i + 1) t
        )
        SELECT refused AS seq, 'name is taken' AS reason FROM s WHERE refused IS NOT NULL""",
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
def m08_in_order(spark, sf):
    """Changes of a batch that want a name which another report holds at their time."""
    return M.rejected_changes(sample.named_reports(spark, sf), sample.name_changes(spark, sf), "custom_reports")


@register(
    "m09_cascade_in_merge",
    over_tables(
        "scheduled_reports custom_reports named_reports changes report_changes",
        """SELECT * FROM scheduled_reports
        WHERE report_id NOT IN (SELECT id FROM report_changes WHERE op = 'delete')""",
    ),
)
def m09_merge(spark, sf):
    """Schedules after a batch of changes to the reports they belong to."""
    below = (sample.scheduled_reports(spark, sf), "report_id")
    batch = sample.report_changes(spark, sf)
    return M.merge_batch(sample.named_reports(spark, sf), batch, "custom_reports", children=below).children


@register(
    "m09_cascade",
    over_tables(
        "scheduled_reports changes report_changes",
        """SELECT * FROM scheduled_reports
        WHERE report_id NOT IN (SELECT id FROM report_changes WHERE op = 'delete')""",
    ),
)
def m09(spark, sf):
    deleted = M.deleted_keys(sample.report_changes(spark, sf))
    return M.cascade(sample.scheduled_reports(spark, sf), "report_id", deleted)


@register("m10_reports", over_tables("custom_reports", "SELECT * FROM custom_reports ORDER BY created_at DESC NULLS FIRST, id"))
def m10_reports(spark, sf):
    return stored.list_reports(sample.custom_reports(spark, sf))


@register("m10_report", over_tables("custom_reports", "SELECT * FROM custom_reports WHERE id = 7"))
def m10_report(spark, sf):
    return stored.get_report(sample.custom_reports(spark, sf), 7)


@register("m10_searches", over_tables("saved_searches", "SELECT * FROM saved_searches ORDER BY last_used_at DESC NULLS FIRST, created_at DESC NULLS FIRST, id"))
def m10_searches(spark, sf):
    return stored.list_searches(sample.saved_searches(spark, sf))


@register("m10_widgets", over_tables("dashboard_widgets", "SELECT * FROM dashboard_widgets WHERE is_active ORDER BY position NULLS LAST, id"))
def m10_widgets(spark, sf):
    return stored.list_widgets(sample.dashboard_widgets(spark, sf))


@register(
    "merge_custom_reports",
    over_tables(
        "custom_reports changes report_changes",
        f"SELECT * FROM ({_UPDATED_REPORTS}) r WHERE {_NOT_DELETED.format(table='report_changes')} "
        f"UNION ALL {_NEW_REPORTS}",
    ),
)
def merge_reports(spark, sf):
    return M.merge_batch(sample.custom_reports(spark, sf), sample.report_changes(spark, sf), "custom_reports").rows


_MERGED_SEARCHES = over_tables(
        "saved_searches changes search_changes",
        f"""SELECT * EXCLUDE (changed, new_title, new_description, new_filters) REPLACE (
          coalesce(new_title, title) AS title, coalesce(new_filters, filters) AS filters,
          CASE WHEN changed IS NULL THEN description ELSE coalesce(new_description, '') END AS description)
        FROM saved_searches r LEFT JOIN (
          SELECT id AS changed, title AS new_title, description AS new_description, filters AS new_filters
          FROM search_changes WHERE op = 'update' QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1
        ) u ON changed = r.id WHERE {_NOT_DELETED.format(table='search_changes')}
        UNION ALL SELECT (SELECT max(id) FROM saved_searches) + row_number() OVER (ORDER BY seq), title,
          coalesce(description, ''), filters, changed_at, changed_at, 0, 'default_user'
        FROM search_changes WHERE op = 'insert'""",
    )


@register("merge_saved_searches", _MERGED_SEARCHES)
def merge_searches(spark, sf):
    return M.merge_batch(sample.saved_searches(spark, sf), sample.search_changes(spark, sf), "saved_searches").rows


@register("m01_replay", _MERGED_SEARCHES)
def m01_replay(spark, sf):
    """A batch that comes twice: the second time it is behind the mark kept with the table and changes nothing."""
    base, batch = sample.saved_searches(spark, sf), sample.search_changes(spark, sf)
    once = M.merge_batch(base, batch, "saved_searches")
    mark = once.last_id.first()
    path = scratch_path(spark, "saved_searches")
    once.rows.write.parquet(path)
    return M.merge_batch(spark.read.schema(base.schema).parquet(path), batch, "saved_searches", mark["last_id"], last_seq=mark["last_seq"]).rows


@register(
    "merge_dashboard_widgets",
    over_tables(
        "dashboard_widgets changes widget_changes",
        _PATCHED.format(
            active="r.is_active AND r.id NOT IN (SELECT id FROM widget_changes WHERE op = 'set_active')"
        )
        + """ UNION ALL SELECT (SELECT max(id) FROM dashboard_widgets) + row_number() OVER (ORDER BY seq), widget_name,
          coalesce(description, ''), 'number_card', sql_query, 'activity', '#3B82F6', coalesce(date_range, 'today'),
          ((SELECT max(position) FROM dashboard_widgets) + row_number() OVER (ORDER BY seq))::INT, true, changed_at,
          changed_at, 'default_user' FROM widget_changes WHERE op = 'insert'""",
    ),
)
def merge_widgets(spark, sf):
    return M.merge_batch(sample.dashboard_widgets(spark, sf), sample.widget_changes(spark, sf), "dashboard_widgets").rows


@register(
    "merge_scheduled_reports",
    over_tables(
        "scheduled_reports changes schedule_changes",
        """SELECT r.id, r.report_id, coalesce(u.schedule_name, r.schedule_name) AS schedule_name,
          CASE WHEN u.id IS NULL THEN r.schedule_type ELSE coalesce(u.schedule_type, 'daily') END AS schedule_type,
          CASE WHEN u.id IS NULL THEN r.schedule_time ELSE coalesce(u.schedule_time, '09:00:00') END AS schedule_time,
          '[]' AS schedule_days, '[]' AS email_recipients,
          CASE WHEN u.id IS NULL THEN r.email_subject ELSE coalesce(u.email_subject, '') END AS email_subject,
          '' AS email_body, coalesce(a.is_active, r.is_active) AS is_active, r.next_run_at, r.last_run_at, r.created_at,
          coalesce(t.at, r.updated_at) AS updated_at, r.user_id
        FROM scheduled_reports r
        LEFT JOIN (SELECT * FROM schedule_changes WHERE op = 'update'
          QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1) u ON u.id = r.id
        LEFT JOIN (SELECT * FROM schedule_changes WHERE op = 'set_active'
          QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1) a ON a.id = r.id
        LEFT JOIN (SELECT id, max(changed_at) AS at FROM schedule_changes WHERE op <> 'insert' GROUP BY id) t
          ON t.id = r.id
        UNION ALL SELECT (SELECT max(id) FROM scheduled_reports) + row_number() OVER (ORDER BY seq), report_id,
          schedule_name, coalesce(schedule_type, 'daily'), coalesce(schedule_time, '09:00:00'), '[]', '[]',
          coalesce(email_subject, ''), '', true, NULL, NULL, changed_at, changed_at, 'default_user'
        FROM schedule_changes WHERE op = 'insert'""",
    ),
)
def merge_schedules(spark, sf):
    return M.merge_batch(sample.scheduled_reports(spark, sf), sample.schedule_changes(spark, sf), "scheduled_reports").rows
