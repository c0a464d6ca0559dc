"""Column expressions and column lists shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .contract import (
    CHANGE_OPERATION,
    CHANGE_PREFIX,
    CHANGE_TIMESTAMP,
    CHANGE_TIMESTAMP_RAW,
    DATETIME_FORMAT,
    DELETE,
    INSERT,
    UPDATE,
)


def is_change() -> Column:
    """The row is an insert, update or delete; anything else (before-images, null) is not."""
    return F.col(CHANGE_OPERATION).isin(INSERT, UPDATE, DELETE)


def is_upsert() -> Column:
    return F.col(CHANGE_OPERATION).isin(INSERT, UPDATE)


def is_delete() -> Column:
    return F.col(CHANGE_OPERATION) == DELETE


def has_null(keys: Sequence[str]) -> Column:
    """Some key column is null. Such a row equals no other row."""
    return F.greatest(*[F.col(k).isNull() for k in keys]) if len(keys) > 1 else F.col(keys[0]).isNull()


def table_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if not c.startswith(CHANGE_PREFIX)]


def payload_columns(df: DataFrame, keys: Sequence[str]) -> list[str]:
    return [c for c in table_columns(df) if c not in keys]


def order_columns(df: DataFrame, order_by: Sequence[str] | None) -> list[str]:
    """Columns that put changes in time order, most significant first."""
    if order_by is not None:
        return list(order_by)
    return [c for c in (CHANGE_TIMESTAMP, CHANGE_TIMESTAMP_RAW) if c in df.columns]


def check_keys(df: DataFrame, keys: Sequence[str]) -> list[str]:
    keys = list(keys)
    if not keys:
        raise ValueError("a table without key columns cannot take changes")
    missing = [k for k in keys if k not in df.columns]
    if missing:
        raise ValueError(f"key columns not in the data: {missing}")
    return keys


def parse_datetime(column: Column, timestamp_type: str) -> Column:
    """Text to timestamp, null where the text is not in the feed's format."""
    if timestamp_type == "timestamp_ntz":
        # A cast follows no session time zone; the pattern rejects what the feed's format would.
        fits = column.rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d{1,7}$")
        return F.when(fits, column.try_cast("timestamp_ntz"))
    return F.try_to_timestamp(column, F.lit(DATETIME_FORMAT))


def broadcastable(df: DataFrame) -> bool:
    """Whether the planner takes the rows for small enough to send to every executor, by the session's threshold."""
    execution = df._jdf.queryExecution()
    threshold = execution.sparkSession().sessionState().conf().autoBroadcastJoinThreshold()
    return int(str(execution.optimizedPlan().stats().sizeInBytes())) <= threshold


def text_length(field: T.StructField) -> Column:
    """Length of a value as text; nested values count as JSON, nulls as nothing."""
    column = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        column = F.to_json(column)
    return F.coalesce(F.length(column).cast("bigint"), F.lit(0).cast("bigint"))
