"""Changes applied to a stored table: read what they touch, write the next generation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T

from ..functions.columns import is_change
from ..functions.contract import CHANGE_TIMESTAMP
from ..operators.apply import apply_delete_wins, apply_latest
from ..operators.history import feed_order, history_schema, scd2_versions
from ..sources.tables import (
    BUCKET,
    TableState,
    bucket_of,
    current_generation,
    read_folders,
    table_state,
    write_generation,
)

LATEST, DELETE_WINS, HISTORY = "latest", "delete_wins", "history"
MODES = (LATEST, DELETE_WINS, HISTORY)
_OPEN, _CLOSED = "current=true", "current=false"


def _touched_buckets(changes: DataFrame, keys: Sequence[str], schema: T.StructType, buckets: int) -> set[int]:
    """Buckets with changes: at most `buckets` numbers reach the driver."""
    typed = changes.where(is_change()).select(*[F.col(k).cast(schema[k].dataType).alias(k) for k in keys])
    return {r[0] for r in typed.select(bucket_of(keys, buckets)).distinct().collect()}


def _in_buckets(folder: str, buckets: set[int] | None) -> bool:
    return buckets is None or int(folder.rsplit(f"{BUCKET}=", 1)[1].split("/")[0]) in buckets


def apply_to_table(
    spark: SparkSession,
    root: str,
    changes: DataFrame,
    keys: Sequence[str],
    table_schema: T.StructType,
    mode: str = LATEST,
    buckets: int | None = None,
    base: int | None = None,
    generation: int | None = None,
    order_by: Sequence[str] | None = None,
    keep_metadata: bool = False,
    phase_order: str = "event_time",
    one_pass: bool | None = None,
    feed_rows: int | None = None,
    cache_feed: bool = True,
    observation: Observation | None = None,
) -> int | None:
    """Apply changes to generation `base` (the current one) and write `generation` (the next).

    Modes: `latest` (latest change wins), `delete_wins`, `history` (SCD type 2). A missing
    table starts empty with `table_schema`, in `buckets` parts if given. A table in
    buckets has only those read and written that the changes touch. A history never
    rewrites closed versions: the new generation takes over their files.

    The merge looks at the feed several times (keys first, then rows). `cache_feed` holds
    it, parsed, in executor memory and disk until the generation is written. `observation`
    gets what the operator counts while it writes.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    if cache_feed:
        changes = changes.persist()
    try:
        return _apply_to_table(
            spark, root, changes, keys, table_schema, mode, buckets, base, generation,
            order_by, keep_metadata, phase_order, one_pass, feed_rows, observation,
        )
    finally:
        if cache_feed:
            changes.unpersist()


def _apply_to_table(
    spark, root, changes, keys, table_schema, mode, buckets, base, generation,
    order_by, keep_metadata, phase_order, one_pass, feed_rows, observation,
) -> int | None:
    keys = list(keys)
    partition_by: tuple[str, ...] = ("current",) if mode == HISTORY else ()
    state = table_state(spark, root, base)
    if state is None:
        if mode == HISTORY:
            time_type = changes.schema[CHANGE_TIMESTAMP].dataType.simpleString()
            table_schema = history_schema(table_schema, time_type, feed_order(changes, order_by))
        state = TableState(-1, table_schema, (), partition_by, tuple(keys), buckets)
    touched = None
    if state.buckets:
        keys = list(state.keys)
        touched = _touched_buckets(changes, keys, state.schema, state.buckets)
        if not touched and state.folders and generation is None:
            return current_generation(spark, root)
    read = [f for f in state.folders if _in_buckets(f, touched)]
    keep = [f for f in state.folders if f not in set(read)]
    target = read_folders(spark, root, state, read)

    if mode == HISTORY:
        if state.partition_by == partition_by:
            keep += [f for f in read if _CLOSED in f.split("/")]
            closed = None
        else:
            closed = target.where(~F.col("current"))
        result = scd2_versions(
            target, changes, keys, order=phase_order, order_by=order_by, one_pass=one_pass, feed_rows=feed_rows,
            observation=observation,
        )
        result = result if closed is None else result.unionByName(closed)
    else:
        partition_by = state.partition_by
        if mode == DELETE_WINS:
            result = apply_delete_wins(target, changes, keys, order_by, keep_metadata, one_pass, observation)
        else:
            result = apply_latest(target, changes, keys, order_by, one_pass, observation)
    return write_generation(
        result, root, generation, partition_by=partition_by, keys=keys, buckets=state.buckets, keep=keep
    )
