"""Changes reduced to one row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import (
    check_keys,
    is_change,
    is_delete,
    is_upsert,
    order_columns,
    payload_columns,
    table_columns,
)
from ..functions.contract import CHANGE_OPERATION, DELETE, INSERT, UPDATE

DELETED = "__deleted"


def greatest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row of each key that is greatest by `order`, null lowest; only these columns remain.

    A maximum over a struct is combined before the shuffle: each task sends one row per
    key, however many rows a hot key has.
    """
    greatest = "__greatest"
    rows = df.groupBy(*keys).agg(F.max(F.struct(*order)).alias(greatest))
    return rows.select(*keys, *[F.col(f"{greatest}.`{c}`") for c in order])


def compact_changes(
    changes: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str] | None = None,
    delete_wins: bool = False,
    keep_metadata: bool = False,
) -> DataFrame:
    """The latest insert, update or delete of each key, with a `__deleted` flag.

    Among changes of one time a delete beats the others, then the larger payload (columns
    in declared order, null lowest). `delete_wins` puts any delete above all times.
    """
    keys = check_keys(changes, keys)
    times = order_columns(changes, order_by)
    order = [DELETED, *times] if delete_wins else [*times, DELETED]
    order += [c for c in payload_columns(changes, keys) if c not in order]
    if keep_metadata:
        order += [c for c in changes.columns if c not in order and c not in keys]
    flagged = changes.where(is_change()).withColumn(DELETED, is_delete())
    latest = greatest_per_key(flagged, keys, order)
    columns = changes.columns if keep_metadata else table_columns(changes)
    return latest.select(*columns, DELETED)


def deduplicate(df: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """One row per key: the highest `by` values, then the larger row in declared order."""
    keys = check_keys(df, keys)
    rest = [c for c in df.columns if c not in keys and c not in by]
    return greatest_per_key(df, keys, [*by, *rest]).select(*df.columns)


def split_operations(changes: DataFrame) -> dict[str, DataFrame]:
    """Changes by operation: I, U and D."""
    return {op: changes.where(F.col(CHANGE_OPERATION) == op) for op in (INSERT, UPDATE, DELETE)}


def split_upserts_deletes(changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Changes split into (inserts and updates, deletes)."""
    return changes.where(is_upsert()), changes.where(is_delete())
