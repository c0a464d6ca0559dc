"""Helpers shared by the operators on texts."""

from __future__ import annotations

import string
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

PARQUET_FOLDER = "llm-steps"
# Spark's setting: a query's shuffle files go when it ends, not when the driver next collects garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """A folder that the driver and all executors see.

    The cluster's `spark.checkpoint.dir`, else the context's checkpoint folder. Where
    neither is set, as in tests, a folder in the warehouse.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        set_by_user = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = set_by_user.get() if set_by_user.isDefined() else None
    if not folder:
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_{PARQUET_FOLDER}"
    return folder.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder and read again.

    Cuts the lineage, survives lost executors, and fixes generated ids. The new scan knows
    its size, so Spark broadcasts it only while it is below the session's threshold. Once
    the rows are written, Spark removes the shuffle files that led to them.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{PARQUET_FOLDER}/{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def lower_ascii(text: Column) -> Column:
    """A to Z in lower case, all else as it is; null is empty."""
    text = text_or_empty(text)
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Join condition under which a null key equals a null key."""
    condition = F.lit(True)
    for key in keys:
        condition = condition & left[key].eqNullSafe(right[key])
    return condition


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
