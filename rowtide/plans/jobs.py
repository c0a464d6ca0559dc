"""The jobs: from metadata files in a folder to a table's next generation."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T

from ..functions.contract import MAX_PARTITION_BYTES
from ..operators.compact import deduplicate
from ..operators.measure import observe_changes
from ..sources.catalog import Batch, batch_from_catalog, read_batch_catalog
from ..sources.changes import normalize, observed_lines, quarantine
from ..sources.tables import (
    compact_table,
    current_generation,
    export_snapshot,
    next_generation,
    packed,
    partitions_for_table,
    read_table,
    stale_files,
    table_state,
    write_generation,
)
from .merge import LATEST, MODES, apply_to_table

LOAD_PREFIX = "LOAD"  # fixed value: how names of full-load metadata files begin
ONE_PASS_BYTES = 10 * 1024 * 1024


def open_batch(
    spark: SparkSession, path: str, prefix: str = "", numeric_type: T.DataType | None = None
) -> Batch | None:
    """The batch in a folder, data files beside their metadata; None if there is none."""
    return batch_from_catalog(read_batch_catalog(spark, path, prefix, data_dir=path), numeric_type)


class Generation(int):
    """The number of the generation that a job wrote, with what it counted on the way.

    `report` has sound and rejected lines, declared records, and for changes the metrics of
    `observe_changes`, `compacted` (latest state) and `late` (history).
    """

    report: dict[str, int]

    def __new__(cls, number: int, report: dict[str, int]):
        generation = super().__new__(cls, number)
        generation.report = report
        return generation


def batch_rows(
    spark: SparkSession, batch: Batch, parse_datetime: bool = True, timestamp_type: str = "timestamp"
) -> DataFrame:
    """The batch's sound lines."""
    rows, _ = quarantine(spark, batch.files, batch.batch_schema)
    return normalize(rows, batch.datetime_columns, parse_datetime, timestamp_type)


def _held_rows(spark, batch, table_root, generation, observation, **options) -> tuple[DataFrame, dict[str, int]]:
    """The batch's rows, parsed once and held by the executors, and the counts of its lines.

    Lines that are no JSON object are written to `<table_root>__rejected/generation=<n>` with
    the names of their files; a job that runs again for this generation writes them over.
    """
    lines = Observation()
    rows, rejected = observed_lines(spark, batch.files, batch.batch_schema, lines)
    rows = normalize(rows, batch.datetime_columns, **options)
    if observation is not None:
        rows = observe_changes(rows, batch.keys, observation)
    rows = rows.persist()
    rows.write.format("noop").mode("overwrite").save()
    report = dict(lines.get)
    if report["rejected"]:
        folder = f"{table_root.rstrip('/')}__rejected"
        rejected.write.mode("overwrite").json(f"{folder}/generation={generation}")
        warnings.warn(f"{report['rejected']} lines are no JSON object and were written to {folder}", stacklevel=3)
    if report["sound"] != batch.record_count:
        warnings.warn(f"{batch.record_count} records declared, {report['sound']} found", stacklevel=3)
    return rows, report | {"declared": batch.record_count}


def batch_bytes(spark: SparkSession, batch: Batch) -> int:
    """Size of the batch's data files, from a listing."""
    return spark.read.format("binaryFile").load(list(batch.files)).agg(F.sum("length")).first()[0] or 0


def initial_load(
    spark: SparkSession,
    load_path: str,
    table_root: str,
    dedup_by: Sequence[str] | None = None,
    partition_by: Sequence[str] = (),
    buckets: int | None = None,
    numeric_type: T.DataType | None = None,
    **options,
) -> int | None:
    """Full load into a new generation. `dedup_by` keeps the highest row per key (keyed bulk load).

    Lines that are no JSON object are never loaded as rows: they are kept apart (see `Generation`).
    """
    batch = open_batch(spark, load_path, LOAD_PREFIX, numeric_type)
    if batch is None:
        return current_generation(spark, table_root)
    generation = next_generation(spark, table_root)
    rows, report = _held_rows(spark, batch, table_root, generation, None, **options)
    try:
        df = rows if dedup_by is None else deduplicate(rows, batch.keys, dedup_by)
        write_generation(df, table_root, generation, partition_by=partition_by, keys=batch.keys, buckets=buckets)
    finally:
        rows.unpersist()
    return Generation(generation, report)


def load_changes(
    spark: SparkSession,
    changes_path: str,
    table_root: str,
    mode: str = LATEST,
    one_pass_above: int = ONE_PASS_BYTES,
    parse_datetime: bool = True,
    timestamp_type: str = "timestamp",
    numeric_type: T.DataType | None = None,
    **options,
) -> int | None:
    """Apply every change batch in a folder to a table; options as for `apply_to_table`.

    Returns a `Generation`: its number, with a report of what was counted without a further pass.

    Without metadata files the table stays as it is. Batches of more than
    `one_pass_above` bytes are merged in one pass; set it to what the session broadcasts
    (`spark.sql.autoBroadcastJoinThreshold`).
    """
    batch = open_batch(spark, changes_path, numeric_type=numeric_type)
    if batch is None:
        return current_generation(spark, table_root)
    if not batch.keys:
        raise ValueError("a table without key columns cannot take changes")
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    generation, feed, merge = next_generation(spark, table_root), Observation(), Observation()
    changes, report = _held_rows(
        spark, batch, table_root, generation, feed, parse=parse_datetime, timestamp_type=timestamp_type
    )
    try:
        written = apply_to_table(
            spark,
            table_root,
            changes,
            batch.keys,
            changes.select(*batch.table_schema.names).schema,
            mode,
            one_pass=batch_bytes(spark, batch) > one_pass_above,
            feed_rows=report["sound"],
            cache_feed=False,
            observation=merge,
            **options,
        )
    finally:
        changes.unpersist()
    report |= feed.get
    if written == generation and options.get("phase_order", "event_time") == "event_time":
        report |= merge.get
    return Generation(written, report)


def snapshot(
    spark: SparkSession, table_root: str, path: str, max_bytes: int = MAX_PARTITION_BYTES, sizing: str = "files"
) -> None:
    """The current state as plain Parquet, without metadata columns.

    The number of files follows the stored bytes; `sizing="text"` reads the whole table
    once more to measure its values as text.
    """
    state = table_state(spark, table_root)
    if state is None:
        raise FileNotFoundError(f"no table at {table_root}")
    rows = read_table(spark, table_root, generation=state.generation)
    if sizing == "files":
        export_snapshot(packed(rows, partitions_for_table(spark, table_root, state, max_bytes)), path)
    else:
        export_snapshot(rows, path, max_bytes=max_bytes)


def vacuum(
    spark: SparkSession, table_root: str, max_bytes: int = MAX_PARTITION_BYTES, sizing: str = "files"
) -> DataFrame:
    """Compact the table, then list the files no longer needed. Removing them is left to the operator."""
    compact_table(spark, table_root, max_bytes, sizing)
    return stale_files(spark, table_root)
