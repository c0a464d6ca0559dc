"""Data files: JSON lines with a declared schema."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T

from ..functions.columns import parse_datetime
from ..functions.contract import CHANGE_TIMESTAMP, CHANGE_TIMESTAMP_RAW
from .catalog import Batch


def read_batch(spark: SparkSession, batch: Batch) -> DataFrame:
    """All rows of a batch. Fields that do not fit their type are null, extra fields are ignored."""
    return spark.read.schema(batch.batch_schema).json(list(batch.files))


def normalize(
    df: DataFrame,
    datetime_columns: Sequence[str],
    parse: bool = True,
    timestamp_type: str = "timestamp",
) -> DataFrame:
    """Turn datetime texts into timestamps; `parse=False` leaves them as text.

    The change time is also kept as written (`header__timestamp_raw`), so that changes
    less than a microsecond apart stay in order.
    """
    found = [c for c in datetime_columns if c in df.columns]
    if not parse or not found:
        return df
    columns = {c: parse_datetime(F.col(c), timestamp_type) for c in found}
    if CHANGE_TIMESTAMP in columns:
        columns[CHANGE_TIMESTAMP_RAW] = F.col(CHANGE_TIMESTAMP)
    return df.withColumns(columns)


_CORRUPT = "__corrupt"


def with_corrupt(schema: T.StructType) -> T.StructType:
    return T.StructType(schema.fields + [T.StructField(_CORRUPT, T.StringType())])


def classified(lines: DataFrame, schema: T.StructType) -> DataFrame:
    """Lines (__file, __line) that are not blank, with __row and __malformed.

    A field out of range marks a line, too; only text that is no JSON object is malformed.
    That is looked at in marked lines alone, so a sound line is parsed once.
    """
    parsed = lines.where(F.trim("__line") != "").withColumn(
        "__row", F.from_json("__line", with_corrupt(schema), {"columnNameOfCorruptRecord": _CORRUPT})
    )
    is_object = F.coalesce(F.schema_of_variant(F.try_parse_json("__line")).startswith("OBJECT"), F.lit(False))
    marked = F.col("__row").isNull() | F.col(f"__row.{_CORRUPT}").isNotNull()
    return parsed.withColumn("__malformed", F.when(marked, ~is_object).otherwise(False))


def _lines(spark: SparkSession, files: Sequence[str]) -> DataFrame:
    return spark.read.text(list(files)).select(F.col("_metadata.file_name").alias("__file"), F.col("value").alias("__line"))


def _rows(parsed: DataFrame, schema: T.StructType) -> DataFrame:
    return parsed.where("NOT __malformed").select([F.col(f"__row.`{c}`") for c in schema.names])


def _rejected(parsed: DataFrame) -> DataFrame:
    return parsed.where("__malformed").select(F.col("__file").alias("file_name"), F.col("__line").alias("line"))


def quarantine(spark: SparkSession, files: Sequence[str], schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Split data files into (rows, lines that are no JSON object).

    Lines are read as text and parsed once per branch, so neither branch needs a cache
    of the whole feed.
    """
    parsed = classified(_lines(spark, files), schema)
    return _rows(parsed, schema), _rejected(parsed)


def split_lines(lines: DataFrame, schema: T.StructType, observation: Observation) -> tuple[DataFrame, DataFrame]:
    """Lines (__file, __line) as (rows, rejected lines).

    Reading the rows counts the lines as `sound` and `rejected` on the way; the rejected
    lines are read again only by whoever wants them.
    """
    parsed = classified(lines, schema)
    counted = parsed.observe(
        observation, F.count_if(~F.col("__malformed")).alias("sound"), F.count_if("__malformed").alias("rejected")
    )
    return _rows(counted, schema), _rejected(parsed)


def observed_lines(
    spark: SparkSession, files: Sequence[str], schema: T.StructType, observation: Observation
) -> tuple[DataFrame, DataFrame]:
    """As `quarantine`, with the counts of `split_lines`."""
    return split_lines(_lines(spark, files), schema, observation)
