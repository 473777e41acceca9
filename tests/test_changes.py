import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from parcelscope.operators import changes as M
from parcelscope.schema import CUSTOM_REPORTS, DASHBOARD_WIDGETS, SAVED_SEARCHES, SCHEDULED_REPORTS
from parcelscope.sources import sample

AT = dt.datetime(2025, 1, 1)
SF_DIR = "/root/testdata/sf0.001"


def stamp(seq):
    return AT + dt.timedelta(minutes=seq)


def one_by_one(base, changes):
    """Widgets after the changes were applied in order, row by row."""
    rows = {row["id"]: dict(row) for row in base}
    next_id = max(rows, default=0) + 1
    for change in sorted(changes, key=lambda c: c["seq"]):
        op, at = change["op"], stamp(change["seq"])
        row = rows.get(change["id"])
        if op == "insert":
            position = max((r["position"] for r in rows.values()), default=-1) + 1
            rows[next_id] = {
                "id": next_id,
                "widget_name": change["widget_name"],
                "description": change["description"] or "",
                "widget_type": "number_card",
                "sql_query": change["sql_query"],
                "icon": change["icon"] or "activity",
                "color": "#3B82F6",
                "date_range": "today",
                "position": position,
                "is_active": True,
                "created_at": at,
                "updated_at": at,
                "user_id": "default_user",
            }
            next_id += 1
        elif row is None:
            continue
        elif op == "patch":
            for name in ("widget_name", "description", "sql_query", "icon"):
                if change[name] is not None:
                    row[name] = change[name]
            row["updated_at"] = at
        elif op == "set_active":
            row["is_active"] = True if change["is_active"] is None else change["is_active"]
        elif op == "delete":
            del rows[change["id"]]
    return sorted(rows.values(), key=lambda r: r["id"])


def widgets_and_changes(seed, hot=False):
    dice = random.Random(seed)
    base = [
        {
            "id": i,
            "widget_name": f"w{i}",
            "description": None if i % 3 else "d",
            "widget_type": "number_card",
            "sql_query": "SELECT 1",
            "icon": "x",
            "color": "red",
            "date_range": "today",
            "position": i * 2,
            "is_active": i % 2 == 0,
            "created_at": AT,
            "updated_at": AT,
            "user_id": "u",
        }
        for i in range(1, 21)
    ]
    changes = []
    for seq in dice.sample(range(1, 5000), 200):
        op = dice.choice(["insert", "patch", "patch", "set_active", "delete"] if seq % 10 else ["patch"])
        key = 7 if hot and op != "delete" and dice.random() < 0.5 else dice.randint(1, 30)
        maybe = lambda value: value if dice.random() < 0.5 else None
        changes.append(
            {
                "seq": seq,
                "changed_at": stamp(seq),
                "op": op,
                "id": None if op == "insert" else key,
                "widget_name": f"n{seq}" if op == "insert" else maybe(f"n{seq}"),
                "description": maybe(f"d{seq}"),
                "sql_query": "SELECT 2" if op == "insert" else maybe("SELECT 3"),
                "icon": maybe(f"i{seq}"),
                "is_active": maybe(dice.random() < 0.5) if op == "set_active" else None,
            }
        )
    return base, changes


CHANGES = (
    "seq long, changed_at timestamp_ntz, op string, id long, widget_name string, description string, "
    "sql_query string, icon string, is_active boolean"
)


@pytest.mark.parametrize(("seed", "hot"), [(1, False), (2, False), (3, True)])
def test_merge_equals_changes_applied_one_by_one(spark, seed, hot):
    base, changes = widgets_and_changes(seed, hot)
    # A batch places new widgets after the last position before it; a row deleted there would move the plain version's.
    changes = [c for c in changes if not (c["op"] == "delete" and c["id"] and c["id"] >= 20)]
    merged = M.apply_changes(
        spark.createDataFrame(base, DASHBOARD_WIDGETS), spark.createDataFrame(changes, CHANGES), "dashboard_widgets"
    )
    assert [row.asDict() for row in merged.orderBy("id").collect()] == one_by_one(base, changes)


def test_replay_of_updates_and_deletes_changes_nothing(spark):
    base = sample.saved_searches(spark, SF_DIR)
    batch = sample.search_changes(spark, SF_DIR).where("op <> 'insert'")
    once = M.apply_changes(base, batch, "saved_searches")
    twice = M.apply_changes(once, batch, "saved_searches")
    assert once.exceptAll(twice).count() == 0 and twice.exceptAll(once).count() == 0


def test_insert_into_an_empty_table_starts_at_one(spark):
    base = spark.createDataFrame([], SAVED_SEARCHES)
    batch = spark.createDataFrame(
        [(50, AT, "insert", None, "a", "{}"), (70, AT, "insert", None, "b", "{}")],
        "seq long, changed_at timestamp_ntz, op string, id long, title string, filters string",
    )
    rows = M.apply_changes(base, batch, "saved_searches").orderBy("id").collect()
    assert [(r["id"], r["title"], r["description"], r["usage_count"]) for r in rows] == [(1, "a", "", 0), (2, "b", "", 0)]


def test_update_resets_absent_fields_and_stamps(spark):
    base = sample.scheduled_reports(spark, SF_DIR).where("id <= 2")
    batch = spark.createDataFrame(
        [(5, AT, "update", 1, "new", None)],
        "seq long, changed_at timestamp_ntz, op string, id long, schedule_name string, schedule_type string",
    )
    first, second = M.apply_changes(base, batch, "scheduled_reports").orderBy("id").collect()
    assert (first["schedule_name"], first["schedule_type"], first["email_subject"]) == ("new", "daily", "")
    assert first["updated_at"] == AT
    assert second["schedule_name"] == "Schedule 1"


def test_numbered_is_dense_over_sparse_order(spark):
    seqs = [5, 9, 100, 10**9, 10**9 + 1, 10**12]
    df = spark.createDataFrame([(s,) for s in reversed(seqs)], "seq long")
    rows = M.numbered(df, "seq", "n", F.lit(10)).orderBy("seq").collect()
    assert [(r["seq"], r["n"]) for r in rows] == [(s, 10 + at) for at, s in enumerate(seqs)]


def test_numbered_cuts_a_crowded_range_again(spark):
    # One far value makes a single coarse range of all the others.
    seqs = [*range(0, 3000, 3), 10**17]
    df = spark.createDataFrame([(s,) for s in seqs], "seq long").repartition(4)
    rows = M.numbered(df, "seq", "n", F.lit(1), rows_per_task=10).orderBy("seq").collect()
    assert [(r["seq"], r["n"]) for r in rows] == [(s, at) for at, s in enumerate(seqs, start=1)]


def test_usage_reorder_unique_cascade(spark):
    base = sample.saved_searches(spark, SF_DIR).where("id IN (1, 2)")
    events = spark.createDataFrame([(1, AT), (1, stamp(5)), (9, AT)], "id long, used_at timestamp_ntz")
    before = {r["id"]: r for r in base.collect()}
    after = {r["id"]: r for r in M.apply_usage(base, events, "usage_count", "last_used_at").collect()}
    assert after[1]["usage_count"] == before[1]["usage_count"] + 2 and after[1]["last_used_at"] == stamp(5)
    assert after[2] == before[2]

    widgets = spark.createDataFrame(
        [(i, "w", "SELECT 1", i) for i in range(3)], "id long, widget_name string, sql_query string, position int"
    )
    order = spark.createDataFrame([(2, 0), (0, 1), (2, 4)], "id long, index int")
    places = {r["id"]: r["position"] for r in M.reorder(widgets, order).collect()}
    assert places == {0: 1, 1: 1, 2: 4}

    names = spark.createDataFrame([("a", "u"), ("a", "u"), ("a", "v")], "report_name string, user_id string")
    assert [tuple(r) for r in M.check_unique(names).collect()] == [("a", "u", 2)]

    schedules = spark.createDataFrame([], SCHEDULED_REPORTS).select("id", "report_id").unionByName(
        spark.createDataFrame([(1, 7), (2, 8), (3, None)], "id long, report_id long")
    )
    gone = spark.createDataFrame([(7,)], "id long")
    assert {r["id"] for r in M.cascade(schedules, "report_id", gone).collect()} == {2, 3}


def test_rules_of_a_batch(spark):
    schema = "seq long, changed_at timestamp_ntz, op string, id long, report_name string, sql_query string"
    base = M.merge_batch(
        spark.createDataFrame([], CUSTOM_REPORTS),
        spark.createDataFrame(
            [
                (1, AT, "insert", None, "a", "SELECT 1"),
                (2, AT, "insert", None, "b", ""),
                (3, AT, "insert", None, "a", "SELECT 2"),
                (4, AT, "insert", None, "c", "DROP TABLE x"),
                (5, AT, "insert", None, "d", "with x as (select 1) select * from x"),
            ],
            schema,
        ),
        "custom_reports",
        0,
    )
    assert {r["seq"]: r["reason"] for r in base.rejected.collect()} == {
        3: "name is taken",
        4: "only SELECT queries are allowed",
    }
    assert sorted((r["id"], r["report_name"]) for r in base.rows.collect()) == [(1, "a"), (2, "b"), (3, "d")]
    last = base.last_id.first()["last_id"]
    assert last == 3
    def published(merge):
        return spark.createDataFrame(merge.rows.collect(), CUSTOM_REPORTS)

    second = M.merge_batch(
        published(base),
        spark.createDataFrame(
            [(9, AT, "delete", 3, None, None), (10, AT, "insert", None, "b", ""), (11, AT, "update", 1, "a", "SELECT 3")], schema
        ),
        "custom_reports",
        last,
    )
    assert [r["seq"] for r in second.rejected.collect()] == [10] and second.last_id.first()["last_id"] == 3
    third = M.merge_batch(
        published(second), spark.createDataFrame([(12, AT, "insert", None, "e", "SELECT 4")], schema), "custom_reports", 3
    )
    assert sorted((r["id"], r["report_name"]) for r in third.rows.collect()) == [(1, "a"), (2, "b"), (4, "e")]


def test_a_widget_needs_a_query(spark):
    rows = [(1, AT, "insert", None, "w", None), (2, AT, "patch", 1, None, ""), (3, AT, "patch", 1, "x", None)]
    batch = spark.createDataFrame(rows, "seq long, changed_at timestamp_ntz, op string, id long, widget_name string, sql_query string")
    refused = M.rejected_changes(spark.createDataFrame([], DASHBOARD_WIDGETS), batch, "dashboard_widgets")
    assert sorted(r["seq"] for r in refused.collect()) == [1, 2]


NAMED = "seq long, changed_at timestamp_ntz, op string, id long, report_name string, sql_query string, user_id string"


def named_one_by_one(base, changes):
    """(refused seqs, {id: (name, sql)}) after the changes were applied in order, row by row."""
    rows = {i: (name, user, "SELECT 0") for i, name, user in base}
    last, refused = max(rows, default=0), []
    for seq, op, key, name, sql, user in sorted(changes):
        owner = rows[key][1] if op != "insert" and key in rows else user
        taken = name is not None and any(r[:2] == (name, owner) for i, r in rows.items() if i != key)
        if op in ("insert", "update") and name is None or sql and not sql.startswith("SELECT"):
            refused.append(seq)
        elif op == "insert":
            if taken:
                refused.append(seq)
            else:
                last += 1
                rows[last] = (name, user, sql or "")
        elif key not in rows:
            continue
        elif op == "delete":
            del rows[key]
        elif op == "update":
            if taken:
                refused.append(seq)
            else:
                rows[key] = (name, rows[key][1], sql or "")
    return sorted(refused), {i: (r[0], r[2]) for i, r in rows.items()}


def check_names(spark, base, changes):
    schema = "id long, report_name string, user_id string"
    table = spark.createDataFrame(base, schema).selectExpr(
        "id", "report_name", "'' AS description", "'SELECT 0' AS sql_query", "'{}' AS parameters", f"TIMESTAMP_NTZ '{AT}' AS created_at",
        "CAST(NULL AS TIMESTAMP_NTZ) AS last_executed", "0 AS execution_count", "user_id",
    )
    batch = spark.createDataFrame([(s, stamp(s % 1000), op, k, n, q, u) for s, op, k, n, q, u in changes], NAMED)
    merged = M.merge_batch(table, batch, "custom_reports")
    refused, rows = named_one_by_one(base, changes)
    assert sorted(r["seq"] for r in merged.rejected.collect()) == refused
    assert {r["id"]: (r["report_name"], r["sql_query"]) for r in merged.rows.collect()} == rows
    assert merged.last_id.first()["last_seq"] == max(c[0] for c in changes)


@pytest.mark.parametrize(
    "changes",
    [
        # the update is refused for its text, so row 2 keeps "b" and the insert is refused
        [(1, "update", 2, "c", "DROP x", "u"), (2, "insert", None, "b", None, "u")],
        # the name is free only after the insert
        [(1, "insert", None, "b", None, "u"), (2, "delete", 2, None, None, "u")],
        # a name given up by a rename, and the freed name taken and given up again
        [(1, "update", 2, "c", None, "u"), (2, "insert", None, "b", None, "u"), (3, "update", 1, "b", None, "u"), (4, "update", 3, "d", None, "u"), (5, "update", 1, "b", None, "u")],
        # not null, another user's name, a key that the batch itself made, one that never was
        [(1, "update", 2, None, None, "u"), (2, "insert", None, "b", None, "v"), (3, "update", 3, "a", None, "v"), (4, "update", 9, "a", None, "u"), (5, "insert", None, "a", None, "u")],
    ],
)
def test_who_holds_a_name_when(spark, changes):
    check_names(spark, [(1, "a", "u"), (2, "b", "u")], changes)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_names_equal_changes_applied_one_by_one(spark, seed):
    dice = random.Random(seed)
    base = [(i, f"n{i}", dice.choice("uv")) for i in range(1, 13)]
    changes = []
    for seq in dice.sample(range(10**6), 150):
        op = dice.choice(["insert", "update", "update", "update", "delete"] if dice.random() < 0.6 else ["update"])
        key = None if op == "insert" else 5 if dice.random() < 0.3 else dice.randint(1, 25)
        name = None if op == "delete" or dice.random() < 0.05 else f"n{dice.randint(1, 18)}"
        changes.append((seq, op, key, name, dice.choice([None, "SELECT 1", "DROP x"]) if op != "delete" else None, dice.choice("uv")))
    check_names(spark, base, changes)


def test_a_batch_that_comes_again_changes_nothing(spark):
    base = sample.saved_searches(spark, SF_DIR)
    batch = sample.search_changes(spark, SF_DIR)
    once = M.merge_batch(base, batch, "saved_searches", 0)
    mark, rows = once.last_id.first(), spark.createDataFrame(once.rows.collect(), SAVED_SEARCHES)
    twice = M.merge_batch(rows, batch, "saved_searches", mark["last_id"], last_seq=mark["last_seq"])
    assert rows.exceptAll(twice.rows).count() == 0 and twice.rows.count() == rows.count()
    assert tuple(twice.last_id.first()) == tuple(mark)


def test_children_go_with_their_parent(spark):
    reports = sample.named_reports(spark, SF_DIR).where("id <= 3")
    schedules = spark.createDataFrame([(1, 1), (2, 2), (3, 9), (4, None)], "id long, report_id long")
    batch = spark.createDataFrame([(1, AT, "delete", 1, None, None, None), (2, AT, "update", 2, "new", None, None)], NAMED)
    left = M.merge_batch(reports, batch, "custom_reports", children=(schedules, "report_id")).children
    assert sorted(r["id"] for r in left.collect()) == [2, 3, 4]


def test_last_before_equals_a_plain_loop(spark):
    from parcelscope.operators.running import last_before

    dice = random.Random(4)
    rows = [(dice.choice(["a", "b", "b", "b", None]), at, at if dice.random() < 0.3 else None) for at in range(0, 900, 3)]
    df = spark.createDataFrame(rows, "k string, at long, v long").repartition(5)
    found = {r["at"]: r["found"] for r in last_before(df, ["k"], "at", F.col("v"), "found", 100, 700, 16).collect()}
    last = {}
    for key, at, value in rows:
        assert found[at] == last.get(key)
        last[key] = value if value is not None else last.get(key)


def test_rounds_of_name_checks_broadcast_no_rows(spark, monkeypatch):
    from parcelscope.operators import names

    kept, plans = names._kept, {}

    def seen(df, name):
        plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString())
        return kept(df, name)

    monkeypatch.setattr(names, "_kept", seen)
    base = spark.createDataFrame([(1, "a", "u"), (2, "b", "u")], "id long, report_name string, user_id string")
    rows = [(1, "insert", None, "c", "u"), (2, "update", 1, "b", None), (3, "delete", 2, None, None), (4, "update", 1, "b", None), (5, "insert", None, "c", "u")]
    batch = spark.createDataFrame(rows, "seq long, op string, key long, name string, user string")
    taken = names.taken_names(base, batch, "report_name", "user_id", "id", None)
    assert {r["seq"] for r in taken.collect()} == {2, 5}
    for name in ("lives", "held_names", "name_moments", "taken_names"):
        assert "BroadcastExchange" not in plans[name], name
