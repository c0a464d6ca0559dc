"""Change feeds and tables made from the supplied data, and files written from them.

Two feeds:

* customers: every event is a change of the customer it belongs to;
* orders: orders placed before a date are the full load; later orders are inserts, and
  every line item is an update or, if returned, a delete of its order.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.contract import CHANGE_OPERATION, CHANGE_TIMESTAMP, DATA_FORMAT, METADATA_VERSION

LOAD_DATE = "1998-07-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("name"), F.col("c_acctbal").alias("value")
    )


def customer_changes(spark: SparkSession, sf_dir: str, delete_above: float) -> DataFrame:
    """Signup inserts, view is none of ours, an error above a value deletes, the rest updates."""
    kind = F.col("event_type")
    operation = (
        F.when(kind == "signup", "I")
        .when(kind == "view", "B")
        .when((kind == "error") & (F.col("value") > delete_above), "D")
        .otherwise("U")
    )
    return table(spark, sf_dir, "events").select(
        F.col("ts").alias(CHANGE_TIMESTAMP),
        operation.alias(CHANGE_OPERATION),
        F.col("user_id").alias("id"),
        kind.alias("name"),
        "value",
    )


def _as_order(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("amount")
    )


def loaded_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_order(table(spark, sf_dir, "orders").where(F.col("o_orderdate") < F.lit(LOAD_DATE).cast("timestamp_ntz")))


def order_changes(spark: SparkSession, sf_dir: str, since: str = LOAD_DATE) -> DataFrame:
    """Orders placed since a date as inserts, and every line item as an update or delete."""
    placed = table(spark, sf_dir, "orders").where(F.col("o_orderdate") >= F.lit(since).cast("timestamp_ntz"))
    inserts = placed.select(
        F.col("o_orderdate").alias(CHANGE_TIMESTAMP),
        F.lit("I").alias(CHANGE_OPERATION),
        F.col("o_orderkey").alias("id"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").alias("amount"),
    )
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_shipdate").alias(CHANGE_TIMESTAMP),
        F.when(F.col("l_returnflag") == "R", "D").otherwise("U").alias(CHANGE_OPERATION),
        F.col("l_orderkey").alias("id"),
        F.col("l_linestatus").alias("status"),
        F.col("l_extendedprice").alias("amount"),
    )
    return inserts.unionByName(lines)


def supplier_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line item as an update or delete of its supplier, at the first of its month: many share a time."""
    return table(spark, sf_dir, "lineitem").select(
        F.date_trunc("month", "l_shipdate").cast("timestamp_ntz").alias(CHANGE_TIMESTAMP),
        F.when(F.col("l_returnflag") == "R", "D").otherwise("U").alias(CHANGE_OPERATION),
        F.col("l_suppkey").alias("id"),
        F.col("l_linestatus").alias("status"),
        F.col("l_extendedprice").alias("amount"),
        "l_linenumber",
    )


def customer_wire_rows(spark: SparkSession, sf_dir: str, delete_above: float) -> DataFrame:
    """The customer feed as the files carry it: text times of seven digits, whole cents."""
    changes = customer_changes(spark, sf_dir, delete_above)
    return changes.select(
        F.concat(F.date_format(CHANGE_TIMESTAMP, "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("0")).alias(CHANGE_TIMESTAMP),
        CHANGE_OPERATION,
        "id",
        "name",
        F.round(F.col("value") * 100).cast("bigint").alias("cents"),
    )


CUSTOMER_WIRE_COLUMNS = [
    {"name": CHANGE_TIMESTAMP, "type": "DATETIME", "primaryKeyPos": 0},
    {"name": CHANGE_OPERATION, "type": "STRING", "primaryKeyPos": 0},
    {"name": "id", "type": "INT8", "primaryKeyPos": 1},
    {"name": "name", "type": "WSTRING", "primaryKeyPos": 0},
    {"name": "cents", "type": "INT8", "primaryKeyPos": 0},
]


def scratch_dir(spark: SparkSession) -> str:
    """A new folder path below the cluster's shared checkpoint folder, or the warehouse where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        folder = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = folder.get() if folder.isDefined() else spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/rowtide-{uuid.uuid4().hex}"


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file, on any storage Hadoop knows."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    out = fs.create(target, True)
    try:
        out.write(bytearray(text, "utf-8"))
    finally:
        out.close()


def metadata_text(name: str, extension: str, location: str, records: int, columns: Sequence[dict]) -> str:
    return json.dumps(
        {
            "dfmVersion": METADATA_VERSION,
            "formatInfo": {"format": DATA_FORMAT},
            "fileInfo": {"name": name, "extension": extension, "location": location, "recordCount": records},
            "dataInfo": {"columns": list(columns)},
        }
    )


def write_batch(df: DataFrame, path: str, columns: Sequence[dict], prefix: str = "", lines: bool = False) -> None:
    """Write rows as JSON lines, or `lines` as they are, and a metadata file for each data file."""
    spark = df.sparkSession
    if lines:
        df.write.mode("append").text(path)
    else:
        df.write.mode("append").json(path)
    files = spark.read.text(path + ("/*.txt" if lines else "/*.json")).groupBy("_metadata.file_name", "_metadata.file_path").count().collect()
    for file in files:
        name, extension = file["file_name"].rsplit(".", 1)
        text = metadata_text(name, extension, file["file_path"], file["count"], columns)
        write_text(spark, f"{path}/{prefix}{name}.dfm", text)
