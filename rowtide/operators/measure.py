"""Counts and sizes."""

from __future__ import annotations

from math import ceil

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, functions as F

from ..functions.columns import has_null, is_change, text_length
from ..functions.contract import (
    CHANGE_OPERATION,
    CHANGE_TIMESTAMP,
    CHANGE_TIMESTAMP_RAW,
    DELETE,
    INSERT,
    MAX_PARTITION_BYTES,
    UPDATE,
)


def change_stats(changes: DataFrame) -> DataFrame:
    """Rows per operation in one pass, with whether the operation takes part."""
    return changes.groupBy(CHANGE_OPERATION).agg(F.count(F.lit(1)).alias("rows")).select(
        F.col(CHANGE_OPERATION).alias("operation"),
        "rows",
        F.coalesce(is_change(), F.lit(False)).alias("applied"),
    )


def observe_changes(changes: DataFrame, keys: Sequence[str], observation: Observation) -> DataFrame:
    """The same changes; whoever reads them lets `observation` count them on the way.

    Metrics: rows, inserts, updates, deletes, others (no change of ours), null_keys (of the
    changes), unreadable_times (a time is written, but not in the feed's format; without
    the text as written, a time that is missing).
    """
    operation = F.col(CHANGE_OPERATION)
    no_time = F.col(CHANGE_TIMESTAMP).isNull()
    if CHANGE_TIMESTAMP_RAW in changes.columns:
        no_time = no_time & F.col(CHANGE_TIMESTAMP_RAW).isNotNull()
    return changes.observe(
        observation,
        F.count(F.lit(1)).alias("rows"),
        F.count_if(operation == INSERT).alias("inserts"),
        F.count_if(operation == UPDATE).alias("updates"),
        F.count_if(operation == DELETE).alias("deletes"),
        F.count_if(~F.coalesce(is_change(), F.lit(False))).alias("others"),
        F.count_if(is_change() & has_null(keys)).alias("null_keys"),
        F.count_if(is_change() & no_time).alias("unreadable_times"),
    )


def size_report(df: DataFrame, max_bytes: int = MAX_PARTITION_BYTES) -> DataFrame:
    """One row: row count, length of all values as text, partitions of at most `max_bytes`."""
    lengths = sum((text_length(f) for f in df.schema.fields[1:]), text_length(df.schema.fields[0]))
    total = df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(lengths), F.lit(0).cast("bigint")).alias("text_bytes"))
    partitions = F.greatest(F.lit(1).cast("bigint"), F.ceil(F.col("text_bytes") / F.lit(max_bytes)))
    return total.withColumn("partitions", partitions.cast("bigint"))


def estimate_partitions(df: DataFrame, max_bytes: int = MAX_PARTITION_BYTES) -> int:
    """Partition count from the length of all values as text; reads the whole data once."""
    return size_report(df, max_bytes).first()["partitions"]


def partitions_for_bytes(stored_bytes: int, max_bytes: int = MAX_PARTITION_BYTES) -> int:
    """Partition count from stored file sizes, for tables too large to read just for this."""
    return max(1, ceil(stored_bytes / max_bytes))
