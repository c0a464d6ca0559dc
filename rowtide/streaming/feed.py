"""The change feed as a stream: each file of changes is applied once."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from ..plans.merge import LATEST, apply_to_table
from ..sources.changes import normalize, split_lines
from ..sources.tables import committed_generations


def apply_batch(
    batch: DataFrame,
    batch_id: int,
    table_root: str,
    keys: Sequence[str],
    table_schema: T.StructType,
    mode: str = LATEST,
    **options,
) -> None:
    """Apply micro-batch n of a feed to generation n; the result is generation n + 1.

    Generation 0 is the table before the feed began, if there was one. A batch that Spark
    repeats after a failure finds its generation committed, or writes it again from the
    same input, so it is never applied twice.
    """
    spark = batch.sparkSession
    done = committed_generations(spark, table_root)
    if batch_id + 1 in done:
        return
    if batch_id not in done and batch_id > 0:
        raise FileNotFoundError(f"generation {batch_id} of {table_root} is missing")
    base = batch_id if batch_id in done else None
    apply_to_table(
        spark, table_root, batch, keys, table_schema, mode, base=base, generation=batch_id + 1, **options
    )


def stream_changes(
    spark: SparkSession,
    changes_dir: str,
    batch_schema: T.StructType,
    table_root: str,
    keys: Sequence[str],
    table_schema: T.StructType,
    checkpoint: str,
    mode: str = LATEST,
    datetime_columns: Sequence[str] = (),
    timestamp_type: str = "timestamp",
    files: str = "*.json",
    files_per_batch: int | None = None,
    **options,
) -> StreamingQuery:
    """Apply the change files not yet seen, oldest first, then stop.

    `mode` and further options are those of `apply_to_table`. One checkpoint belongs to
    one table, and only the stream writes to that table. Lines that are no JSON object are
    written to `<table_root>__rejected/batch=<n>` with the names of their files, and
    reported by a warning; a batch that Spark repeats writes its folder over. Each line is
    parsed once, and the batch held by the executors until it is applied.
    """
    reader = spark.readStream.option("pathGlobFilter", files)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    lines = reader.text(changes_dir).select(F.col("_metadata.file_name").alias("__file"), F.col("value").alias("__line"))

    def step(batch: DataFrame, batch_id: int) -> None:
        counts = Observation()
        rows, rejected = split_lines(batch, batch_schema, counts)
        changes = normalize(rows, datetime_columns, timestamp_type=timestamp_type).persist()
        try:
            changes.write.format("noop").mode("overwrite").save()
            if counts.get["rejected"]:
                folder = f"{table_root.rstrip('/')}__rejected"
                rejected.write.mode("overwrite").json(f"{folder}/batch={batch_id}")
                warnings.warn(f"{counts.get['rejected']} lines are no JSON object and were written to {folder}", stacklevel=2)
            apply_batch(
                changes, batch_id, table_root, keys, table_schema, mode,
                **{"feed_rows": counts.get["sound"], "cache_feed": False} | options,
            )
        finally:
            changes.unpersist()

    return (
        lines.writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
