"""Registered queries: each operator over whole tables, with the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.contract import CHANGE_OPERATION, CHANGE_TIMESTAMP
from ..operators.apply import apply_delete_wins, apply_latest
from ..operators.compact import compact_changes, deduplicate, split_operations, split_upserts_deletes
from ..operators.history import as_of, current_rows, initial_history, late_changes, scd2_apply
from ..operators.measure import change_stats, size_report
from ..sources.catalog import (
    batch_from_catalog,
    catalog_totals,
    parse_catalog,
    read_batch_catalog,
    reconcile_counts,
    reconcile_files,
    validate_catalog,
)
from ..sources.changes import normalize, quarantine, read_batch
from ..sources.tables import compact_table, export_snapshot, read_table, stale_files, write_generation
from ..streaming.feed import stream_changes
from .jobs import batch_rows, initial_load, load_changes, open_batch
from .merge import apply_to_table
from .scenario import (
    CUSTOMER_WIRE_COLUMNS,
    LOAD_DATE,
    customer_changes,
    customer_wire_rows,
    customers,
    loaded_orders,
    metadata_text,
    order_changes,
    scratch_dir,
    supplier_changes,
    table,
    write_batch,
    write_text,
)

NTZ = "timestamp_ntz"


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(sql: str | None = None):
    def register(run):
        QUERIES[run.__name__] = Query(run, sql)
        return run

    return register


# SQL for the feeds and tables of `scenario`.

def customer_feed_sql(delete_above: float) -> str:
    return f"""
    feed AS (
      SELECT ts, user_id AS id, event_type AS name, value,
        CASE WHEN event_type = 'signup' THEN 'I' WHEN event_type = 'view' THEN 'B'
             WHEN event_type = 'error' AND value > {delete_above} THEN 'D' ELSE 'U' END AS op
      FROM events),
    changes AS (SELECT * FROM feed WHERE op IN ('I', 'U', 'D')),
    target AS (SELECT c_custkey AS id, c_mktsegment AS name, c_acctbal AS value FROM customer)"""


ORDER_FEED_SQL = """
    target AS (
      SELECT o_orderkey AS id, o_orderstatus AS status, o_totalprice AS amount, o_orderdate AS loaded
      FROM orders WHERE o_orderdate < TIMESTAMP '1998-07-01'),
    changes AS (
      SELECT o_orderdate AS ts, 'I' AS op, o_orderkey AS id, o_orderstatus AS status, o_totalprice AS amount
      FROM orders WHERE o_orderdate >= TIMESTAMP '1998-07-01'
      UNION ALL
      SELECT l_shipdate, CASE WHEN l_returnflag = 'R' THEN 'D' ELSE 'U' END, l_orderkey, l_linestatus, l_extendedprice
      FROM lineitem)"""

ALL_ORDERS = "1900-01-01"
ALL_ORDERS_FEED_SQL = ORDER_FEED_SQL.replace("1998-07-01", ALL_ORDERS)

ORDER_RANK = """PARTITION BY id ORDER BY ts DESC NULLS LAST, op = 'D' DESC,
        status DESC NULLS LAST, amount DESC NULLS LAST"""
CUSTOMER_RANK = """PARTITION BY id ORDER BY ts DESC NULLS LAST, op = 'D' DESC,
        name DESC NULLS LAST, value DESC NULLS LAST"""


def latest_sql(rank: str) -> str:
    return f"latest AS (SELECT * FROM changes QUALIFY row_number() OVER ({rank}) = 1)"


def merged_sql(columns: str) -> str:
    return f"""
    SELECT {columns} FROM target t WHERE NOT EXISTS (SELECT 1 FROM latest l WHERE l.id = t.id)
    UNION ALL SELECT {columns} FROM latest WHERE op <> 'D'"""


def delete_wins_sql(rank: str) -> str:
    return f"""
    upserts AS (SELECT * FROM changes WHERE op <> 'D' QUALIFY row_number() OVER ({rank}) = 1),
    removed AS (SELECT DISTINCT id FROM changes WHERE op = 'D')"""


def delete_wins_result_sql(columns: str) -> str:
    return f"""
    SELECT {columns} FROM target t
    WHERE id NOT IN (SELECT id FROM upserts) AND id NOT IN (SELECT id FROM removed)
    UNION ALL SELECT {columns} FROM upserts WHERE id NOT IN (SELECT id FROM removed)"""


def columns_of(table: str, columns: str) -> str:
    return ", ".join(f"{table}.{c.strip()}" for c in columns.split(","))


def history_sql(columns: str, order: str, base: str) -> str:
    """Versions from base versions at `base` and the changes not before them that are not the base versions."""
    return f"""
    newest AS (SELECT id, {base} AS at FROM target),
    steps AS (
      SELECT id, {columns}, {base} AS ts, 'I' AS op, 0 AS rank FROM target
      UNION ALL
      SELECT c.id, {columns_of('c', columns)}, c.ts, c.op, 1
      FROM changes c LEFT JOIN newest n ON n.id = c.id
      WHERE n.at IS NULL OR c.ts > n.at OR (c.ts = n.at AND NOT EXISTS (SELECT 1 FROM target t WHERE t.id = c.id
        AND c.op <> 'D' AND ({columns_of('t', columns)}) IS NOT DISTINCT FROM ({columns_of('c', columns)})))),
    chained AS (
      SELECT *, lead(ts) OVER w AS next_ts, lead(op) OVER w AS next_op FROM steps
      WINDOW w AS (PARTITION BY id ORDER BY rank, ts NULLS FIRST, op = 'D', {order})),
    history AS (
      SELECT id, {columns}, next_op IS NULL AS current, coalesce(next_op = 'D', false) AS deleted,
        ts AS effective_date, next_ts AS end_date
      FROM chained WHERE op <> 'D')"""


CUSTOMER_HISTORY_SQL = (
    customer_feed_sql(100)
    + ","
    + history_sql("name, value", "name NULLS FIRST, value NULLS FIRST", "TIMESTAMP '2023-01-01'")
)
ORDER_HISTORY_SQL = ORDER_FEED_SQL + "," + history_sql("status, amount", "status NULLS FIRST, amount NULLS FIRST", "loaded")


def _wide_customers(spark, sf_dir):
    """Customers with columns that the feed lacks."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"),
        F.col("c_mktsegment").alias("name"),
        F.col("c_acctbal").alias("value"),
        F.col("c_name").alias("full_name"),
        F.col("c_nationkey").alias("nation"),
    )


# Latest state.


@query(f"WITH {customer_feed_sql(0)}, {latest_sql(CUSTOMER_RANK)} SELECT id, name, value, op = 'D' AS deleted FROM latest")
def latest_change_per_key(spark, sf_dir):
    return compact_changes(customer_changes(spark, sf_dir, 0.0), ["id"]).withColumnRenamed("__deleted", "deleted")


@query(
    f"""WITH {customer_feed_sql(0)} SELECT id, name, value, op = 'D' AS deleted FROM changes
    QUALIFY row_number() OVER (PARTITION BY id, name ORDER BY ts DESC NULLS LAST, op = 'D' DESC, value DESC NULLS LAST) = 1"""
)
def latest_change_composite_key(spark, sf_dir):
    changes = customer_changes(spark, sf_dir, 0.0)
    return compact_changes(changes, ["id", "name"]).withColumnRenamed("__deleted", "deleted")


@query(
    """SELECT user_id AS id, event_type AS name, value FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1"""
)
def latest_change_by_sequence(spark, sf_dir):
    changes = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("header__sequence"),
        F.lit("U").alias(CHANGE_OPERATION),
        F.col("user_id").alias("id"),
        F.col("event_type").alias("name"),
        "value",
    )
    return compact_changes(changes, ["id"], order_by=["header__sequence"]).drop("__deleted")


@query(f"WITH {ORDER_FEED_SQL}, {latest_sql(ORDER_RANK)} {merged_sql('id, status, amount')}")
def apply_latest_orders(spark, sf_dir):
    return apply_latest(loaded_orders(spark, sf_dir), order_changes(spark, sf_dir), ["id"])


@query(f"WITH {ORDER_FEED_SQL}, {latest_sql(ORDER_RANK)} {merged_sql('id, status, amount')}")
def apply_latest_orders_one_pass(spark, sf_dir):
    return apply_latest(loaded_orders(spark, sf_dir), order_changes(spark, sf_dir), ["id"], one_pass=True)


@query(f"WITH {customer_feed_sql(0)}, {latest_sql(CUSTOMER_RANK)} {merged_sql('id, name, value')}")
def apply_latest_customers(spark, sf_dir):
    return apply_latest(customers(spark, sf_dir), customer_changes(spark, sf_dir, 0.0), ["id"])


@query(f"WITH {customer_feed_sql(0)}, {latest_sql(CUSTOMER_RANK)} SELECT id, name, value FROM latest WHERE op <> 'D'")
def apply_latest_new_table(spark, sf_dir):
    empty = read_table(spark, scratch_dir(spark), schema=customers(spark, sf_dir).schema)
    return apply_latest(empty, customer_changes(spark, sf_dir, 0.0), ["id"])


@query(
    f"""WITH {customer_feed_sql(0)}, {latest_sql(CUSTOMER_RANK)}
    SELECT c_custkey AS id, coalesce(l.name, c_mktsegment) AS name, CASE WHEN l.id IS NULL THEN c_acctbal ELSE l.value END AS value,
      c_name AS full_name, c_nationkey AS nation
    FROM customer LEFT JOIN latest l ON l.id = c_custkey WHERE l.id IS NULL OR l.op <> 'D'
    UNION ALL SELECT id, name, value, NULL, NULL FROM latest WHERE op <> 'D' AND id NOT IN (SELECT c_custkey FROM customer)"""
)
def apply_latest_wider_table(spark, sf_dir):
    return apply_latest(_wide_customers(spark, sf_dir), customer_changes(spark, sf_dir, 0.0), ["id"])


@query(f"WITH {customer_feed_sql(0)}, {latest_sql(CUSTOMER_RANK)} {merged_sql('id, name, value')}")
def apply_latest_two_batches(spark, sf_dir):
    """The feed cut in time: the first batch removes customers that the second may bring back."""
    changes = customer_changes(spark, sf_dir, 0.0)
    cut = F.lit("2024-01-15").cast(NTZ)
    first = apply_latest(customers(spark, sf_dir), changes.where(F.col(CHANGE_TIMESTAMP) < cut), ["id"])
    return apply_latest(first, changes.where(F.col(CHANGE_TIMESTAMP) >= cut), ["id"])


TWICE_SQL = f"""WITH {customer_feed_sql(100)}, {latest_sql(CUSTOMER_RANK)},
    twice AS (SELECT * FROM target UNION ALL SELECT id, 'twin', value FROM target WHERE value < 0)
    SELECT t.id, CASE WHEN l.id IS NULL THEN t.name ELSE l.name END AS name,
      CASE WHEN l.id IS NULL THEN t.value ELSE l.value END AS value
    FROM twice t LEFT JOIN latest l ON l.id = t.id WHERE l.id IS NULL OR l.op <> 'D'
    UNION ALL SELECT id, name, value FROM latest WHERE op <> 'D' AND id NOT IN (SELECT id FROM twice)"""


def _customers_twice(spark, sf_dir):
    """Every customer, and those who owe a second time: a table with several rows for a key."""
    once = customers(spark, sf_dir)
    return once.unionByName(once.where("value < 0").withColumn("name", F.lit("twin")))


@query(TWICE_SQL)
def apply_latest_duplicate_target(spark, sf_dir):
    return apply_latest(_customers_twice(spark, sf_dir), customer_changes(spark, sf_dir, 100.0), ["id"])


@query(TWICE_SQL)
def apply_latest_duplicate_target_one_pass(spark, sf_dir):
    return apply_latest(_customers_twice(spark, sf_dir), customer_changes(spark, sf_dir, 100.0), ["id"], one_pass=True)



# Upserts first, deletes after.


@query(f"WITH {customer_feed_sql(100)}, {delete_wins_sql(CUSTOMER_RANK)} {delete_wins_result_sql('id, name, value')}")
def apply_delete_wins_customers(spark, sf_dir):
    return apply_delete_wins(customers(spark, sf_dir), customer_changes(spark, sf_dir, 100.0), ["id"])


@query(f"WITH {ORDER_FEED_SQL}, {delete_wins_sql(ORDER_RANK)} {delete_wins_result_sql('id, status, amount')}")
def apply_delete_wins_orders(spark, sf_dir):
    return apply_delete_wins(loaded_orders(spark, sf_dir), order_changes(spark, sf_dir), ["id"])


@query(
    f"""WITH {ORDER_FEED_SQL}, {delete_wins_sql(ORDER_RANK + ", op DESC")}
    SELECT id, status, amount, NULL::TIMESTAMP AS header__timestamp, NULL::VARCHAR AS header__change_oper FROM target
    WHERE id NOT IN (SELECT id FROM upserts) AND id NOT IN (SELECT id FROM removed)
    UNION ALL SELECT id, status, amount, ts, op FROM upserts WHERE id NOT IN (SELECT id FROM removed)"""
)
def apply_delete_wins_with_metadata(spark, sf_dir):
    return apply_delete_wins(
        loaded_orders(spark, sf_dir), order_changes(spark, sf_dir), ["id"], keep_metadata=True, one_pass=True
    )


# History.


def _customer_history(spark, sf_dir):
    base = initial_history(customers(spark, sf_dir), F.lit("2023-01-01").cast(NTZ))
    return scd2_apply(base, customer_changes(spark, sf_dir, 100.0), ["id"])


def _order_base(spark, sf_dir):
    loaded = table(spark, sf_dir, "orders").where(F.col("o_orderdate") < F.lit(LOAD_DATE).cast(NTZ))
    rows = loaded.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").alias("amount"),
        "o_orderdate",
    )
    return initial_history(rows, F.col("o_orderdate")).drop("o_orderdate")


@query(f"WITH {CUSTOMER_HISTORY_SQL} SELECT * FROM history")
def history_customers(spark, sf_dir):
    return _customer_history(spark, sf_dir)


@query(f"WITH {ORDER_HISTORY_SQL} SELECT * FROM history")
def history_orders(spark, sf_dir):
    return scd2_apply(_order_base(spark, sf_dir), order_changes(spark, sf_dir), ["id"])


@query(f"WITH {ORDER_HISTORY_SQL} SELECT * FROM history")
def history_orders_one_pass(spark, sf_dir):
    return scd2_apply(_order_base(spark, sf_dir), order_changes(spark, sf_dir), ["id"], one_pass=True)


@query(f"WITH {CUSTOMER_HISTORY_SQL} SELECT * FROM history")
def history_hot_keys(spark, sf_dir):
    """Keys with more than 50 changes count as hot, so that their time is cut into parts."""
    base = initial_history(customers(spark, sf_dir), F.lit("2023-01-01").cast(NTZ))
    return scd2_apply(base, customer_changes(spark, sf_dir, 100.0), ["id"], hot_key_rows=50)


SEVERAL_OPEN_SQL = f"""WITH {customer_feed_sql(100)},
    signups AS (SELECT * FROM changes WHERE name = 'signup'),
    base AS (SELECT id, name, value, TIMESTAMP '2023-01-01' AS ts FROM target
      UNION ALL SELECT id, 'twin', value, TIMESTAMP '2023-02-01' FROM target WHERE value < 0),
    steps AS (SELECT id, name, value, ts, 0 AS rank FROM base UNION ALL SELECT id, name, value, ts, 1 FROM signups),
    chained AS (SELECT *, CASE WHEN id IN (SELECT id FROM signups) THEN lead(ts) OVER
      (PARTITION BY id ORDER BY rank, ts, name NULLS FIRST, value NULLS FIRST) END AS end_date FROM steps)
    SELECT id, name, value, end_date IS NULL AS current, false AS deleted, ts AS effective_date, end_date FROM chained"""


def _several_open(spark, sf_dir, **options):
    """Some customers with two open versions; only customers who sign up have changes."""
    once = customers(spark, sf_dir)
    first = initial_history(once, F.lit("2023-01-01").cast(NTZ))
    second = initial_history(once.where("value < 0").withColumn("name", F.lit("twin")), F.lit("2023-02-01").cast(NTZ))
    signups = customer_changes(spark, sf_dir, 100.0).where("name = 'signup'")
    return scd2_apply(first.unionByName(second), signups, ["id"], **options)


@query(SEVERAL_OPEN_SQL)
def history_several_open_versions(spark, sf_dir):
    return _several_open(spark, sf_dir)


@query(SEVERAL_OPEN_SQL)
def history_several_open_versions_one_pass(spark, sf_dir):
    return _several_open(spark, sf_dir, one_pass=True)



@query(f"WITH {CUSTOMER_HISTORY_SQL} SELECT * FROM history")
def history_replayed(spark, sf_dir):
    """Half the feed, then the whole feed: what is already in the history is not applied again."""
    base = initial_history(customers(spark, sf_dir), F.lit("2023-01-01").cast(NTZ))
    changes = customer_changes(spark, sf_dir, 100.0)
    half = changes.where(F.col(CHANGE_TIMESTAMP) < F.lit("2024-01-15").cast(NTZ))
    return scd2_apply(scd2_apply(base, half, ["id"]), changes, ["id"])


EQUAL_TIMES_SQL = """WITH
    feed AS (
      SELECT date_trunc('month', l_shipdate)::TIMESTAMP AS ts, CASE WHEN l_returnflag = 'R' THEN 'D' ELSE 'U' END AS op,
        l_suppkey AS id, l_linestatus AS status, l_extendedprice AS amount, l_linenumber FROM lineitem),
    cut AS (SELECT *, CASE WHEN ts < TIMESTAMP '1995-06-01' OR (ts = TIMESTAMP '1995-06-01' AND l_linenumber <= 3) THEN 1 ELSE 2 END AS batch
      FROM feed),
    held AS (SELECT *, lead(ts) OVER w AS next_ts, lead(op) OVER w AS next_op FROM cut WHERE batch = 1
      WINDOW w AS (PARTITION BY id ORDER BY ts, op = 'D', status, amount)),
    seen AS (
      SELECT DISTINCT id, op, status, amount FROM held WHERE op = 'U' AND ts = TIMESTAMP '1995-06-01'
      UNION ALL SELECT DISTINCT id, 'D', NULL, NULL FROM held
        WHERE op = 'U' AND next_op = 'D' AND next_ts = TIMESTAMP '1995-06-01'),
    fresh AS (SELECT c.* FROM cut c LEFT JOIN seen s ON c.batch = 2 AND c.ts = TIMESTAMP '1995-06-01' AND s.id = c.id
      AND s.op = c.op AND (c.op = 'D' OR (s.status = c.status AND s.amount = c.amount)) WHERE s.id IS NULL
      -- A delete that closed nothing left no trace, so it comes again with the second batch.
      UNION ALL SELECT c.* REPLACE (2 AS batch) FROM cut c WHERE batch = 1 AND ts = TIMESTAMP '1995-06-01' AND op = 'D'
        AND NOT EXISTS (SELECT 1 FROM seen s WHERE s.id = c.id AND s.op = 'D')),
    chained AS (SELECT *, lead(ts) OVER w AS next_ts, lead(op) OVER w AS next_op FROM fresh
      WINDOW w AS (PARTITION BY id ORDER BY batch, ts, op = 'D', status, amount))
    SELECT id, status, amount, next_op IS NULL AS current, coalesce(next_op = 'D', false) AS deleted,
      ts AS effective_date, next_ts AS end_date FROM chained WHERE op <> 'D'"""


@query(EQUAL_TIMES_SQL)
def history_equal_times_two_batches(spark, sf_dir):
    """The feed is cut inside a month that many changes share; the second batch brings the first one's again."""
    feed = supplier_changes(spark, sf_dir)
    time, cut = F.col(CHANGE_TIMESTAMP), F.lit("1995-06-01").cast(NTZ)
    first = feed.where((time < cut) | ((time == cut) & (F.col("l_linenumber") <= 3))).drop("l_linenumber")
    feed = feed.drop("l_linenumber")
    base = initial_history(feed.select("id", "status", "amount").limit(0), F.lit(None).cast(NTZ))
    return scd2_apply(scd2_apply(base, first, ["id"]), feed, ["id"], one_pass=True)


@query(
    f"""WITH {customer_feed_sql(100)},
    steps AS (
      SELECT id, name, value, TIMESTAMP '2023-01-01' AS ts, 'I' AS op, 0 AS rank FROM target
      UNION ALL SELECT id, name, value, ts, op, 1 FROM changes WHERE ts > TIMESTAMP '2023-01-01'),
    chained AS (SELECT *, lead(ts) OVER w AS next_ts, lead(op) OVER w AS next_op,
        count(*) FILTER (op = 'D') OVER (w ROWS UNBOUNDED PRECEDING) AS deletes FROM steps
      WINDOW w AS (PARTITION BY id ORDER BY rank, ts, op = 'D', name NULLS FIRST, value NULLS FIRST))
    SELECT id, name, value, CASE WHEN deletes = 0 THEN c_name END AS full_name, CASE WHEN deletes = 0 THEN c_nationkey END AS nation,
      next_op IS NULL AS current, coalesce(next_op = 'D', false) AS deleted, ts AS effective_date, next_ts AS end_date
    FROM chained LEFT JOIN customer ON c_custkey = id WHERE op <> 'D'"""
)
def history_wider_table(spark, sf_dir):
    """The feed lacks two of the table's columns: they go from version to version until a delete."""
    return scd2_apply(initial_history(_wide_customers(spark, sf_dir), F.lit("2023-01-01").cast(NTZ)), customer_changes(spark, sf_dir, 100.0), ["id"])


@query(f"WITH {CUSTOMER_HISTORY_SQL} SELECT * FROM history")
def history_hot_keys_text_time(spark, sf_dir):
    """The order column is a text, and keys with more than 50 changes are cut by it."""
    changes = customer_changes(spark, sf_dir, 100.0)
    text = F.date_format(CHANGE_TIMESTAMP, "yyyyMMddHHmmssSSSSSS").alias("header__sequence")
    base = initial_history(customers(spark, sf_dir), F.lit("2023-01-01").cast(NTZ))
    return scd2_apply(base, changes.select("*", text), ["id"], order_by=["header__sequence"], hot_key_rows=50)


@query(
    f"""WITH {CUSTOMER_HISTORY_SQL} SELECT id, name, value FROM history
    WHERE effective_date <= TIMESTAMP '2024-01-15' AND (end_date IS NULL OR end_date > TIMESTAMP '2024-01-15')"""
)
def history_as_of(spark, sf_dir):
    return as_of(_customer_history(spark, sf_dir), "2024-01-15")


@query(f"WITH {customer_feed_sql(100)}, {latest_sql(CUSTOMER_RANK)} {merged_sql('id, name, value')}")
def history_current(spark, sf_dir):
    """The history's current rows are the latest state."""
    return current_rows(_customer_history(spark, sf_dir))


@query(
    f"""WITH {ORDER_FEED_SQL}
    SELECT c.ts AS header__timestamp, c.op AS header__change_oper, c.id, c.status, c.amount
    FROM changes c JOIN target t ON t.id = c.id WHERE c.ts < t.loaded
      OR (c.ts = t.loaded AND c.op <> 'D' AND c.status = t.status AND c.amount = t.amount)"""
)
def history_late_changes(spark, sf_dir):
    return late_changes(_order_base(spark, sf_dir), order_changes(spark, sf_dir), ["id"])


@query(
    f"""WITH {customer_feed_sql(100)},
    once AS (SELECT * FROM changes QUALIFY row_number() OVER
      (PARTITION BY id, op ORDER BY ts NULLS FIRST, name NULLS FIRST, value NULLS FIRST) = 1),
    base AS (SELECT id, name, value, true AS current, false AS deleted,
      TIMESTAMP '2023-01-01' AS effective_date, NULL::TIMESTAMP AS end_date FROM target),
    inserted AS (SELECT * FROM base UNION ALL
      SELECT id, name, value, true, false, ts, NULL FROM once WHERE op = 'I'),
    closed AS (SELECT s.id, s.name, s.value, s.current AND u.id IS NULL AS current, s.deleted, s.effective_date,
      CASE WHEN s.current AND u.id IS NOT NULL THEN u.ts ELSE s.end_date END AS end_date
      FROM inserted s LEFT JOIN once u ON u.id = s.id AND u.op = 'U'),
    updated AS (SELECT * FROM closed UNION ALL
      SELECT id, name, value, true, false, ts, NULL FROM once WHERE op = 'U')
    SELECT s.id, s.name, s.value, s.current AND d.id IS NULL AS current,
      s.deleted OR (s.current AND d.id IS NOT NULL) AS deleted, s.effective_date,
      CASE WHEN s.current AND d.id IS NOT NULL THEN d.ts ELSE s.end_date END AS end_date
    FROM updated s LEFT JOIN once d ON d.id = s.id AND d.op = 'D'"""
)
def history_phases(spark, sf_dir):
    changes = customer_changes(spark, sf_dir, 100.0).where(F.col(CHANGE_OPERATION) != "B")
    first = F.min(F.struct(CHANGE_TIMESTAMP, "name", "value")).alias("first")
    once = changes.groupBy("id", CHANGE_OPERATION).agg(first).select("id", CHANGE_OPERATION, "first.*")
    base = initial_history(customers(spark, sf_dir), F.lit("2023-01-01").cast(NTZ))
    return scd2_apply(base, once, ["id"], order="op_phase")


PHASES_LINES_SQL = """WITH
    lines AS (SELECT CASE WHEN l_linenumber <= 2 THEN 0 ELSE l_orderkey END AS id, l_linestatus AS status,
      l_extendedprice AS amount, l_shipdate AS ts, l_returnflag AS flag FROM lineitem),
    closed AS (SELECT id, max(ts) AS updated, max(ts) FILTER (flag = 'R') + INTERVAL 1 DAY AS deleted_at FROM lines GROUP BY id),
    base AS (SELECT o_orderkey AS id, o_orderstatus AS status, o_totalprice AS amount, o_orderdate AS ts FROM orders),
    before AS (SELECT * FROM base UNION ALL SELECT id, status, amount, ts FROM lines)
    SELECT b.id, b.status, b.amount, c.id IS NULL AS current, false AS deleted, b.ts AS effective_date, c.updated AS end_date
    FROM before b LEFT JOIN closed c ON c.id = b.id
    UNION ALL SELECT id, 'U', NULL, deleted_at IS NULL, deleted_at IS NOT NULL, updated, deleted_at FROM closed"""


@query(PHASES_LINES_SQL)
def history_phases_hot_key(spark, sf_dir):
    """Every line item is an insert, two in seven of one key; each key has one update and, if returned, one delete."""
    lines = table(spark, sf_dir, "lineitem")
    key = F.when(F.col("l_linenumber") <= 2, 0).otherwise(F.col("l_orderkey")).cast("bigint").alias("id")
    row = [F.col("l_linestatus").alias("status"), F.col("l_extendedprice").alias("amount")]
    inserts = lines.select(F.col("l_shipdate").alias(CHANGE_TIMESTAMP), F.lit("I").alias(CHANGE_OPERATION), key, *row, "l_returnflag")
    last = F.max(CHANGE_TIMESTAMP)
    returned = F.max(F.when(F.col("l_returnflag") == "R", F.col(CHANGE_TIMESTAMP)))
    closing = inserts.groupBy("id").agg(last.alias("updated"), (returned + F.expr("INTERVAL 1 DAY")).alias("deleted_at"))
    none = [F.lit("U").alias("status"), F.lit(None).cast("double").alias("amount")]
    updates = closing.select(F.col("updated").alias(CHANGE_TIMESTAMP), F.lit("U").alias(CHANGE_OPERATION), "id", *none)
    deletes = closing.where("deleted_at IS NOT NULL").select(
        F.col("deleted_at").alias(CHANGE_TIMESTAMP), F.lit("D").alias(CHANGE_OPERATION), "id", *none
    )
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("amount"), "o_orderdate"
    )
    base = initial_history(rows, F.col("o_orderdate")).drop("o_orderdate")
    feed = inserts.drop("l_returnflag").unionByName(updates).unionByName(deletes)
    return scd2_apply(base, feed, ["id"], order="op_phase", hot_key_rows=1000)


# Counts, splits, sizes.


CHANGE_REPORT_SQL = f"""WITH {customer_feed_sql(100)},
    sent AS (SELECT *, CASE WHEN name = 'signup' AND value < 10 THEN NULL ELSE id END AS key, name = 'click' AND value < 10 AS garbled FROM feed)
    SELECT unnest(['rows', 'inserts', 'updates', 'deletes', 'others', 'null_keys', 'unreadable_times', 'sound', 'rejected', 'declared', 'compacted']) AS metric,
      unnest([count(*), count(*) FILTER (op = 'I'), count(*) FILTER (op = 'U'), count(*) FILTER (op = 'D'), count(*) FILTER (op = 'B'),
        count(*) FILTER (op <> 'B' AND key IS NULL), count(*) FILTER (op <> 'B' AND garbled), count(*), 0, count(*),
        count(DISTINCT key) FILTER (op <> 'B') + max(CASE WHEN op <> 'B' AND key IS NULL THEN 1 ELSE 0 END)]) AS n FROM sent"""


@query(CHANGE_REPORT_SQL)
def change_report(spark, sf_dir):
    """What a job counts while it loads: some keys are missing, some times cannot be read."""
    sent = customer_wire_rows(spark, sf_dir, 100.0)
    low = F.col("cents") < 1000
    garbled = F.when((F.col("name") == "click") & low, F.lit("soon")).otherwise(F.col(CHANGE_TIMESTAMP))
    keyless = F.when(~((F.col("name") == "signup") & low), F.col("id"))
    path = scratch_dir(spark)
    write_batch(sent.withColumns({CHANGE_TIMESTAMP: garbled, "id": keyless}), path, CUSTOMER_WIRE_COLUMNS)
    report = load_changes(spark, path, path + "_table", timestamp_type=NTZ).report
    return spark.createDataFrame(list(report.items()), "metric string, n bigint")



@query(f"WITH {customer_feed_sql(100)} SELECT op AS operation, count(*) AS rows, op IN ('I', 'U', 'D') AS applied FROM feed GROUP BY op")
def change_stats_customers(spark, sf_dir):
    return change_stats(customer_changes(spark, sf_dir, 100.0))


@query(f"WITH {ALL_ORDERS_FEED_SQL} SELECT op AS operation, count(*) AS rows, true AS applied FROM changes GROUP BY op")
def change_stats_orders(spark, sf_dir):
    return change_stats(order_changes(spark, sf_dir, ALL_ORDERS))


@query(
    f"""WITH {customer_feed_sql(100)} SELECT CASE WHEN op = 'D' THEN 'delete' ELSE 'upsert' END AS part,
    ts AS header__timestamp, op AS header__change_oper, id, name, value FROM changes"""
)
def split_upserts_and_deletes(spark, sf_dir):
    upserts, deletes = split_upserts_deletes(customer_changes(spark, sf_dir, 100.0))
    return upserts.withColumn("part", F.lit("upsert")).unionByName(deletes.withColumn("part", F.lit("delete")))


@query(f"WITH {ALL_ORDERS_FEED_SQL} SELECT op AS part, ts AS header__timestamp, id, status, amount FROM changes")
def split_by_operation(spark, sf_dir):
    parts = split_operations(order_changes(spark, sf_dir, ALL_ORDERS))
    inserts, updates, deletes = (parts[op].withColumn("part", F.lit(op)).drop(CHANGE_OPERATION) for op in "IUD")
    return inserts.unionByName(updates).unionByName(deletes)


SIZED = {
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"],
    "documents": ["doc_id", "text", "lang", "source", "n_chars"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"],
}


def _size_sql(name: str, columns: list[str]) -> str:
    total = " + ".join(f"coalesce(length({c}::VARCHAR), 0)" for c in columns)
    return f"""SELECT '{name}' AS name, count(*) AS rows, sum({total})::BIGINT AS text_bytes,
      greatest(1, ceil(sum({total}) / 1000))::BIGINT AS partitions FROM {name}"""


@query(" UNION ALL ".join(_size_sql(n, c) for n, c in SIZED.items()))
def partition_estimates(spark, sf_dir):
    reports = [
        size_report(table(spark, sf_dir, n).select(*c), max_bytes=1000).withColumn("name", F.lit(n)) for n, c in SIZED.items()
    ]
    return reports[0].unionByName(reports[1]).unionByName(reports[2])


# Files.


@query(
    """SELECT event_id, ts AS header__timestamp,
    strftime(ts, '%Y-%m-%d %H:%M:%S.%f') || (event_id % 10)::VARCHAR AS header__timestamp_raw FROM events"""
)
def normalize_datetimes(spark, sf_dir):
    text = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), (F.col("event_id") % 10).cast("string"))
    rows = table(spark, sf_dir, "events").select("event_id", text.alias(CHANGE_TIMESTAMP))
    return normalize(rows, [CHANGE_TIMESTAMP], timestamp_type=NTZ)


def _written_customer_feed(spark, sf_dir, delete_above: float, prefix: str = "") -> str:
    path = scratch_dir(spark)
    write_batch(customer_wire_rows(spark, sf_dir, delete_above), path, CUSTOMER_WIRE_COLUMNS, prefix)
    return path


WIRE_COLUMNS_SQL = "id, name, round(value * 100)::BIGINT AS cents"


@query(f"WITH {customer_feed_sql(100)} SELECT ts AS header__timestamp, op AS header__change_oper, {WIRE_COLUMNS_SQL} FROM feed")
def read_json_batch(spark, sf_dir):
    batch = open_batch(spark, _written_customer_feed(spark, sf_dir, 100.0))
    return batch_rows(spark, batch, timestamp_type=NTZ).drop("header__timestamp_raw")


@query("SELECT count(*) AS declared, count(*) AS actual, true AS matches FROM events")
def reconcile_record_counts(spark, sf_dir):
    path = _written_customer_feed(spark, sf_dir, 100.0)
    catalog = read_batch_catalog(spark, path, data_dir=path)
    per_file = reconcile_counts(catalog, read_batch(spark, batch_from_catalog(catalog)))
    return per_file.agg(
        F.sum("declared").alias("declared"), F.sum("actual").alias("actual"), F.every("matches").alias("matches")
    )


@query(
    """SELECT 'matches' AS status, count(*) AS declared, count(*) AS actual FROM events
    UNION ALL SELECT 'differs', count(*) + 1, count(*) FROM nation
    UNION ALL SELECT 'missing', count(*), 0 FROM region
    UNION ALL SELECT 'undeclared', 0, count(*) FROM supplier"""
)
def reconcile_with_missing_files(spark, sf_dir):
    """A batch with a file that is gone, one that lost a line, and one that no metadata names."""
    path = _written_customer_feed(spark, sf_dir, 100.0)

    def beside(name: str, rows: DataFrame, declared: int | None, there: bool = True) -> None:
        if there:
            write_text(spark, f"{path}/{name}.json", "".join(r + "\n" for r in rows.toJSON().collect()))
        if declared is not None:
            write_text(spark, f"{path}/{name}.dfm", metadata_text(name, "json", path, declared, CUSTOMER_WIRE_COLUMNS))

    nations, regions = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    beside("short", nations, nations.count() + 1)
    beside("gone", regions, regions.count(), there=False)
    beside("stray", table(spark, sf_dir, "supplier").select("s_suppkey"), None)
    catalog = read_batch_catalog(spark, path, data_dir=path)
    found = reconcile_files(spark, catalog, path)
    return found.groupBy("status").agg(F.sum("declared").alias("declared"), F.sum("actual").alias("actual"))


ALL_TYPES = [
    {"name": "id", "type": "INT8", "primaryKeyPos": 1},
    {"name": "customer", "type": "INT4", "primaryKeyPos": 0},
    {"name": "large", "type": "BOOLEAN", "primaryKeyPos": 0},
    {"name": "amount", "type": "NUMERIC", "primaryKeyPos": 0},
    {"name": "placed", "type": "DATETIME", "primaryKeyPos": 0},
    {"name": "status", "type": "STRING", "primaryKeyPos": 0},
    {"name": "priority", "type": "WSTRING", "primaryKeyPos": 0},
    {"name": "code", "type": "BYTES", "primaryKeyPos": 0},
    {"name": "remark", "type": "NCLOB", "primaryKeyPos": 0},
]


@query(
    """SELECT o_orderkey AS id, o_custkey::INTEGER AS customer, o_totalprice > 100000 AS large, o_totalprice::DECIMAL(14, 2) AS amount,
      o_orderdate::TIMESTAMP AS placed, o_orderstatus AS status, 'naïve ' || o_orderpriority AS priority,
      to_base64(encode(o_orderpriority)) AS code, o_orderstatus || ' "' || o_orderpriority || '"' || chr(10) || '日本' AS remark FROM orders"""
)
def read_json_all_types(spark, sf_dir):
    """Every source type there is, numbers as decimals, texts with quotes, line ends and other scripts."""
    orders = table(spark, sf_dir, "orders")
    rows = orders.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("customer"),
        (F.col("o_totalprice") > 100000).alias("large"),
        F.col("o_totalprice").cast("decimal(14,2)").alias("amount"),
        F.concat(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("0")).alias("placed"),
        F.col("o_orderstatus").alias("status"),
        F.concat(F.lit("naïve "), "o_orderpriority").alias("priority"),
        F.base64(F.encode("o_orderpriority", "UTF-8")).alias("code"),
        F.concat("o_orderstatus", F.lit(' "'), "o_orderpriority", F.lit('"\n日本')).alias("remark"),
    )
    path = scratch_dir(spark)
    write_batch(rows, path, ALL_TYPES, "LOAD")
    root = path + "_table"
    initial_load(spark, path, root, numeric_type=T.DecimalType(14, 2), timestamp_type=NTZ)
    return read_table(spark, root)


@query(
    f"""WITH {customer_feed_sql(100)} SELECT name, id, round(value * 100)::BIGINT AS cents FROM changes
    QUALIFY row_number() OVER (PARTITION BY name, id ORDER BY ts DESC, op = 'D' DESC, value DESC) = 1 AND op <> 'D'"""
)
def load_changes_reversed_key(spark, sf_dir):
    """A key of two columns whose positions are not the order in which the columns stand."""
    positions = {"name": 1, "id": 2}
    columns = [c | {"primaryKeyPos": positions.get(c["name"], 0)} for c in CUSTOMER_WIRE_COLUMNS]
    path = scratch_dir(spark)
    write_batch(customer_wire_rows(spark, sf_dir, 100.0), path, columns)
    if open_batch(spark, path).keys != ("name", "id"):
        raise ValueError("key columns are not in the order of their positions")
    load_changes(spark, path, path + "_table", timestamp_type=NTZ)
    return read_table(spark, path + "_table").select("name", "id", "cents")


@query("SELECT c_custkey AS id, c_mktsegment AS name, c_acctbal AS value FROM customer")
def load_changes_empty_folder(spark, sf_dir):
    """A folder without metadata files leaves the table at its generation."""
    path = scratch_dir(spark)
    customer_wire_rows(spark, sf_dir, 100.0).limit(0).write.json(path)
    root = path + "_table"
    first = write_generation(customers(spark, sf_dir), root)
    if load_changes(spark, path, root) != first:
        raise ValueError("an empty folder made a generation")
    return read_table(spark, root)


@query(
    f"""WITH {customer_feed_sql(0)}, {latest_sql(CUSTOMER_RANK)}
    SELECT {WIRE_COLUMNS_SQL} FROM latest WHERE op <> 'D'"""
)
def load_changes_from_files(spark, sf_dir):
    """The whole job: metadata, JSON lines, merge into a new table, read back."""
    path = _written_customer_feed(spark, sf_dir, 0.0)
    load_changes(spark, path, path + "_table", "latest", timestamp_type=NTZ)
    return read_table(spark, path + "_table")


def _supplier_metadata(spark, sf_dir) -> DataFrame:
    """A metadata text per supplier; some nations' texts break one rule each."""
    columns = '"dataInfo":{"columns":[{"name":"id","type":"INT4","primaryKeyPos":1},{"name":"name","type":"%s"%s}]}}'
    nation = F.col("s_nationkey")
    text = F.concat(
        F.when(nation == 0, "[{").otherwise("{"),
        F.lit('"dfmVersion":"'),
        F.when(nation == 1, "1.0").otherwise("1.1"),
        F.lit('","formatInfo":{"format":"'),
        F.when(nation == 2, "csv").otherwise("json"),
        F.lit('"},"fileInfo":{"extension":"json","name":"'),
        "s_name",
        F.lit('","recordCount":'),
        F.col("s_suppkey").cast("string"),
        F.lit("},"),
        F.when(nation == 3, F.lit(columns % ("MONEY", ""))).otherwise(F.lit(columns % ("STRING", ""))),
        F.when(nation == 0, "]").otherwise(""),
    )
    # Names sort by supplier; the prefix keeps a sound one first.
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.when(nation < 4, "b-").otherwise("a-"), "s_name").alias("metadata_file"), text.alias("value")
    )


@query(
    """SELECT 'b-' || s_name AS metadata_file, CASE s_nationkey WHEN 0 THEN 'object' WHEN 1 THEN 'version'
      WHEN 2 THEN 'format' ELSE 'columns' END AS "check" FROM supplier WHERE s_nationkey < 4
    UNION ALL SELECT 'b-' || s_name, 'types' FROM supplier WHERE s_nationkey = 3"""
)
def validate_metadata(spark, sf_dir):
    return validate_catalog(parse_catalog(_supplier_metadata(spark, sf_dir))).select("metadata_file", "check")


@query("SELECT count(*) AS files, sum(s_suppkey) FILTER (WHERE s_nationkey <> 0)::BIGINT AS record_count FROM supplier")
def metadata_totals(spark, sf_dir):
    """Files that are no JSON object declare no records."""
    return catalog_totals(parse_catalog(_supplier_metadata(spark, sf_dir)))


def _lines_with_broken_ones(spark, sf_dir) -> DataFrame:
    """Events as JSON lines; the closing brace is missing from views."""
    events = table(spark, sf_dir, "events")
    line = F.to_json(F.struct("event_id", "user_id", "event_type"))
    broken = F.regexp_replace(line, r"\}$", "")
    path = scratch_dir(spark)
    events.select(F.when(F.col("event_type") == "view", broken).otherwise(line).alias("value")).write.text(path)
    return quarantine(spark, [path], events.select("event_id", "user_id", "event_type").schema)


@query("SELECT event_id, user_id, event_type FROM events WHERE event_type <> 'view'")
def quarantine_rows(spark, sf_dir):
    return _lines_with_broken_ones(spark, sf_dir)[0]


@query("SELECT event_id FROM events WHERE event_type = 'view'")
def quarantine_rejected(spark, sf_dir):
    rejected = _lines_with_broken_ones(spark, sf_dir)[1]
    return rejected.select(F.regexp_extract("line", r'"event_id":(\d+)', 1).cast("bigint").alias("event_id"))


# Tables.


@query(
    """SELECT o_custkey, o_orderdate, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER
    (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC, o_totalprice DESC) = 1"""
)
def initial_load_deduplicated(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    root = scratch_dir(spark)
    write_generation(deduplicate(rows, ["o_custkey"], ["o_orderdate"]), root)
    return read_table(spark, root)


@query("SELECT c_custkey AS id, c_mktsegment AS name FROM customer WHERE c_acctbal >= 0")
def initial_load_job(spark, sf_dir):
    """A folder with a full load, in which the lines of customers who owe are broken, and with changes beside it."""
    path, root = scratch_dir(spark), scratch_dir(spark)
    line = F.to_json(F.struct("id", "name"))
    broken = F.when(F.col("value") < 0, F.regexp_replace(line, r"\}$", "")).otherwise(line)
    columns = [c for c in CUSTOMER_WIRE_COLUMNS if c["name"] in ("id", "name")]
    write_batch(customers(spark, sf_dir).select(broken.alias("value")), path, columns, "LOAD", lines=True)
    write_batch(customer_wire_rows(spark, sf_dir, 100.0), path, CUSTOMER_WIRE_COLUMNS)
    initial_load(spark, path, root)
    return read_table(spark, root)


@query("SELECT o_orderkey, o_orderstatus, o_orderpriority, o_totalprice FROM orders")
def initial_load_partitioned(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    root = scratch_dir(spark)
    write_generation(rows, root, partition_by=["o_orderpriority"])
    return read_table(spark, root, schema=rows.schema)


@query(f"WITH {ORDER_FEED_SQL}, {latest_sql(ORDER_RANK)} {merged_sql('id, status, amount')}")
def export_snapshot_orders(spark, sf_dir):
    """The whole table of orders after its changes."""
    path = scratch_dir(spark)
    state = apply_latest(loaded_orders(spark, sf_dir), order_changes(spark, sf_dir), ["id"])
    rows = state.withColumn("_hoodie_record_key", F.col("id").cast("string"))
    export_snapshot(rows, path)
    return spark.read.parquet(path)


@query(f"WITH {ORDER_FEED_SQL}, {latest_sql(ORDER_RANK)} {merged_sql('id, status, amount')}")
def merge_orders_in_buckets(spark, sf_dir):
    """Two batches, cut in time, into a stored table of 16 buckets."""
    root = scratch_dir(spark)
    loaded, changes = loaded_orders(spark, sf_dir), order_changes(spark, sf_dir)
    write_generation(loaded, root, keys=["id"], buckets=16)
    cut = F.lit("1999-01-01").cast(NTZ)
    for part in (changes.where(F.col(CHANGE_TIMESTAMP) < cut), changes.where(F.col(CHANGE_TIMESTAMP) >= cut)):
        apply_to_table(spark, root, part, ["id"], loaded.schema, one_pass=True)
    return read_table(spark, root)


@query(f"WITH {ORDER_HISTORY_SQL} SELECT * FROM history")
def merge_history_in_buckets(spark, sf_dir):
    """Two batches, cut in time, into a stored history: closed versions are not rewritten."""
    root = scratch_dir(spark)
    base, changes = _order_base(spark, sf_dir), order_changes(spark, sf_dir)
    write_generation(base, root, partition_by=["current"], keys=["id"], buckets=16)
    cut = F.lit("1999-01-01").cast(NTZ)
    for part in (changes.where(F.col(CHANGE_TIMESTAMP) < cut), changes):
        apply_to_table(spark, root, part, ["id"], loaded_orders(spark, sf_dir).schema, "history", one_pass=True)
    return read_table(spark, root)


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_shipdate FROM lineitem")
def compact_table_lineitem(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate")
    root = scratch_dir(spark)
    write_generation(rows.repartition(32), root)
    compact_table(spark, root)
    return read_table(spark, root)


@query("SELECT 0 AS generation, count(*) AS rows FROM orders")
def stale_files_after_compaction(spark, sf_dir):
    """Rows held by the files that compaction made obsolete."""
    root = scratch_dir(spark)
    write_generation(table(spark, sf_dir, "orders"), root)
    compact_table(spark, root, sizing="files")
    rows = spark.read.option("basePath", root).parquet(root).select(F.col("_metadata.file_path").alias("path"))
    counts = rows.groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    stale = stale_files(spark, root).select(F.regexp_extract("path", r"gen=.*$", 0).alias("file"), "generation")
    by_file = counts.select(F.regexp_extract("path", r"gen=.*$", 0).alias("file"), "n")
    return stale.join(by_file, "file").groupBy("generation").agg(F.sum("n").alias("rows"))


# Stream.


@query(
    f"""WITH {customer_feed_sql(0)}, {latest_sql(CUSTOMER_RANK)}
    SELECT {WIRE_COLUMNS_SQL} FROM target t WHERE NOT EXISTS (SELECT 1 FROM latest l WHERE l.id = t.id)
    UNION ALL SELECT {WIRE_COLUMNS_SQL} FROM latest WHERE op <> 'D'"""
)
def stream_latest(spark, sf_dir):
    path = _written_customer_feed(spark, sf_dir, 0.0)
    batch = open_batch(spark, path)
    root = path + "_table"
    cents = F.round(F.col("value") * 100).cast("bigint").alias("cents")
    write_generation(customers(spark, sf_dir).select("id", "name", cents), root)
    stream = stream_changes(
        spark,
        path,
        batch.batch_schema,
        root,
        batch.keys,
        batch.table_schema,
        checkpoint=path + "_checkpoint",
        datetime_columns=batch.datetime_columns,
        timestamp_type=NTZ,
    )
    stream.awaitTermination()
    return read_table(spark, root)


BROKEN_SQL = f"""WITH {customer_feed_sql(0)},
    broken AS (SELECT * FROM feed WHERE name = 'error' AND round(value * 100) > 5000),
    sound AS (SELECT * FROM changes WHERE NOT (name = 'error' AND round(value * 100) > 5000)),
    latest AS (SELECT * FROM sound QUALIFY row_number() OVER ({CUSTOMER_RANK}) = 1)
    SELECT id, name, round(value * 100)::BIGINT AS cents, false AS rejected FROM target t WHERE NOT EXISTS (SELECT 1 FROM latest l WHERE l.id = t.id)
    UNION ALL SELECT id, name, round(value * 100)::BIGINT, false FROM latest WHERE op <> 'D'
    UNION ALL SELECT id, name, round(value * 100)::BIGINT, true FROM broken"""


@query(BROKEN_SQL)
def stream_with_broken_lines(spark, sf_dir):
    """Some deletes arrive as broken lines: they are kept apart and reported, not lost, and delete nothing."""
    rows = customer_wire_rows(spark, sf_dir, 0.0)
    line = F.to_json(F.struct(*rows.columns))
    broken = (F.col("name") == "error") & (F.col("cents") > 5000)
    path = scratch_dir(spark)
    lines = rows.select(F.when(broken, F.regexp_replace(line, r"\}$", "")).otherwise(line).alias("value"))
    write_batch(lines, path, CUSTOMER_WIRE_COLUMNS, lines=True)
    batch = open_batch(spark, path)
    root = path + "_table"
    cents = F.round(F.col("value") * 100).cast("bigint").alias("cents")
    write_generation(customers(spark, sf_dir).select("id", "name", cents), root)
    for _ in range(2):  # the second run finds nothing new
        stream_changes(
            spark, path, batch.batch_schema, root, batch.keys, batch.table_schema, checkpoint=path + "_checkpoint",
            datetime_columns=batch.datetime_columns, timestamp_type=NTZ, files="*.txt",
        ).awaitTermination()
    kept = spark.read.schema("file_name string, line string").json(root + "__rejected/*")
    read = F.from_json(F.concat("line", F.lit("}")), "id bigint, name string, cents bigint").alias("row")
    rejected = kept.select(read).select("row.*", F.lit(True).alias("rejected"))
    return read_table(spark, root).withColumn("rejected", F.lit(False)).unionByName(rejected)
