"""Batch metadata files: scan, validation, and the schema derived from them."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.contract import CHANGE_PREFIX, DATA_FORMAT, METADATA_VERSION, SOURCE_TYPES

_METADATA_SCHEMA = (
    "dfmVersion string, formatInfo struct<format:string>, "
    "fileInfo struct<name:string,extension:string,location:string,recordCount:string>, "
    "dataInfo struct<columns:array<struct<name:string,type:string,primaryKeyPos:string>>>"
)


class CatalogError(ValueError):
    """The metadata files of a batch break the contract."""


@dataclass(frozen=True)
class Batch:
    """What the metadata files say about a set of data files: plan-time facts only."""

    keys: tuple[str, ...]
    batch_schema: T.StructType
    table_schema: T.StructType
    datetime_columns: tuple[str, ...]
    files: tuple[str, ...]
    record_count: int

    @property
    def metadata_columns(self) -> list[str]:
        return [c for c in self.batch_schema.names if c.startswith(CHANGE_PREFIX)]

    @property
    def payload_columns(self) -> list[str]:
        return [c for c in self.table_schema.names if c not in self.keys]


def read_batch_catalog(
    spark: SparkSession, path: str, prefix: str = "", data_dir: str | None = None
) -> DataFrame:
    """One row per metadata file `<prefix>*.dfm` directly under `path`."""
    raw = spark.read.option("pathGlobFilter", f"{prefix}*.dfm").text(path, wholetext=True)
    return parse_catalog(raw.select(F.col("_metadata.file_path").alias("metadata_file"), "value"), data_dir)


def parse_catalog(raw: DataFrame, data_dir: str | None = None) -> DataFrame:
    """Metadata texts (metadata_file, value) as columns.

    `data_dir` names the folder that holds the data files; without it each metadata
    file's own location counts. `columns_json` is the column list with object fields
    sorted, so that two lists are equal exactly when the texts are.
    """
    parsed = raw.select(
        "metadata_file",
        F.from_json("value", _METADATA_SCHEMA).alias("m"),
        F.try_parse_json("value").alias("v"),
    )
    # Null if either is missing: a folder must never stand in for a file.
    file_name = F.concat("m.fileInfo.name", F.lit("."), "m.fileInfo.extension")
    data_file = (
        F.concat(F.lit(data_dir.rstrip("/") + "/"), file_name) if data_dir else F.col("m.fileInfo.location")
    )
    columns = F.transform(
        "m.dataInfo.columns",
        lambda c: F.struct(
            c["name"].alias("name"),
            c["type"].alias("type"),
            c["primaryKeyPos"].try_cast("int").alias("key_position"),
        ),
    )
    return parsed.select(
        "metadata_file",
        F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False)).alias("is_object"),
        F.col("m.dfmVersion").alias("version"),
        F.col("m.formatInfo.format").alias("format"),
        columns.alias("columns"),
        F.to_json(F.try_variant_get("v", "$.dataInfo.columns", "variant")).alias("columns_json"),
        file_name.alias("file_name"),
        data_file.alias("data_file"),
        F.col("m.fileInfo.recordCount").try_cast("bigint").alias("record_count"),
    )


def _violations(first: Column) -> Column:
    """What is wrong with a file, given the column list that all must have."""
    unknown = F.array_except(F.transform("columns", lambda c: c["type"]), F.lit(list(SOURCE_TYPES)))

    def violation(name, broken, detail):
        return F.when(broken, F.struct(F.lit(name).alias("check"), detail.cast("string").alias("detail")))

    ok = F.col("is_object")
    found = F.array(
        violation("object", ~ok, F.lit("not a JSON object")),
        violation("version", ok & ~F.col("version").eqNullSafe(METADATA_VERSION), F.col("version")),
        violation("format", ok & ~F.col("format").eqNullSafe(DATA_FORMAT), F.col("format")),
        violation("columns", ok & ~F.col("columns_json").eqNullSafe(first), F.col("columns_json")),
        violation("types", ok & (F.size(unknown) > 0), F.array_join(unknown, ",")),
    )
    return F.array_compact(found)


def _first_by_name(value: Column) -> Column:
    """The value of the first readable file by name."""
    return F.min_by(value, F.when(F.col("columns_json").isNotNull(), F.col("metadata_file")))


def validate_catalog(catalog: DataFrame) -> DataFrame:
    """Violations, one row each: metadata_file, check, detail.

    The column list all others must equal, in the same order, is that of the first
    readable file by name.
    """
    first = catalog.agg(_first_by_name(F.col("columns_json"))).first()[0]
    return catalog.select("metadata_file", F.explode(_violations(F.lit(first))).alias("v")).select(
        "metadata_file", "v.check", "v.detail"
    )


def catalog_totals(catalog: DataFrame) -> DataFrame:
    """One row: number of files and records declared."""
    return catalog.agg(
        F.count(F.lit(1)).alias("files"),
        F.coalesce(F.sum("record_count"), F.lit(0).cast("bigint")).alias("record_count"),
    )


def source_type(name: str, numeric_type: T.DataType | None = None) -> T.DataType:
    if name not in SOURCE_TYPES:
        raise CatalogError(f"unknown source type {name!r}")
    if name == "NUMERIC" and numeric_type is not None:
        return numeric_type
    return T.DataType.fromDDL(SOURCE_TYPES[name])


def schemas_from_columns(columns, numeric_type: T.DataType | None = None):
    """Column descriptors (name, type, key_position) to (keys, batch schema, table schema)."""
    positions: Mapping[str, int] = {c["name"]: int(c["key_position"] or 0) for c in columns}
    keys = tuple(sorted((n for n, p in positions.items() if p > 0), key=positions.get))
    batch_schema = T.StructType(
        [T.StructField(c["name"], source_type(c["type"], numeric_type), positions[c["name"]] <= 0) for c in columns]
    )
    table_schema = T.StructType([f for f in batch_schema.fields if not f.name.startswith(CHANGE_PREFIX)])
    return keys, batch_schema, table_schema


def batch_from_catalog(catalog: DataFrame, numeric_type: T.DataType | None = None) -> Batch | None:
    """Check the catalogue and derive the batch; None when there are no metadata files.

    One aggregation reads the metadata files once; only if they break the contract are they
    read again, to say how. The driver receives the names of the data files (the reader
    needs them to plan its scan) and one column list, never rows of data.
    """
    columns = F.col("columns_json")
    facts = catalog.agg(
        F.array_sort(F.collect_list(F.struct("metadata_file", "data_file", "record_count"))).alias("files"),
        _first_by_name(F.struct("columns")).alias("first"),
        # Without a column list of its own to differ from, a file is checked against itself.
        F.count_if(F.size(_violations(columns)) > 0).alias("broken"),
        (F.min(columns) != F.max(columns)).alias("differ"),
        F.count_if(columns.isNull()).alias("without_columns"),
    ).first()
    if not facts["files"]:
        return None
    if facts["broken"] or facts["differ"] or facts["without_columns"]:
        broken = validate_catalog(catalog).take(20)
        raise CatalogError("; ".join(f"{r.metadata_file}: {r.check} ({r.detail})" for r in broken) or "no column list")
    files = facts["files"]
    nameless = [r.metadata_file for r in files if not r.data_file]
    if nameless:
        raise CatalogError(f"no data file named by {nameless[:20]}")
    columns = facts["first"]["columns"]
    keys, batch_schema, table_schema = schemas_from_columns(columns, numeric_type)
    return Batch(
        keys=keys,
        batch_schema=batch_schema,
        table_schema=table_schema,
        datetime_columns=tuple(c["name"] for c in columns if c["type"] == "DATETIME"),
        files=tuple(r.data_file for r in files),
        record_count=sum(r.record_count or 0 for r in files),
    )


def list_files(spark: SparkSession, path: str, files: str = "*") -> DataFrame:
    """file_name and bytes of the files in a folder whose names match, empty ones too (Spark's readers skip those)."""
    paths = spark._jvm.org.apache.hadoop.fs
    folder = paths.Path(path)
    listing = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(paths.Path(folder, files))
    found = [(f.getPath().getName(), f.getLen()) for f in listing or [] if f.isFile()]
    return spark.createDataFrame(found, "file_name string, bytes bigint")


def reconcile_files(spark: SparkSession, catalog: DataFrame, data_dir: str, files: str = "*.json") -> DataFrame:
    """Files that metadata declares against files in the folder, and their lines against the records declared.

    One row per file on either side: file_name, declared, actual (lines that are not blank),
    status: `matches`, `differs`, `missing` (declared, but not there) or `undeclared` (there,
    but in no metadata). To be used before a batch is read, which fails on a missing file.
    """
    lines = spark.read.option("pathGlobFilter", files).text(data_dir).where(F.trim("value") != "")
    counted = lines.groupBy(F.col("_metadata.file_name").alias("file_name")).agg(F.count(F.lit(1)).alias("lines"))
    present = list_files(spark, data_dir, files).join(counted, "file_name", "left").select("file_name", F.coalesce("lines", F.lit(0).cast("bigint")).alias("lines"))
    declared = catalog.groupBy("file_name").agg(F.coalesce(F.sum("record_count"), F.lit(0).cast("bigint")).alias("records"))
    both = declared.join(present, "file_name", "full_outer")
    status = (
        F.when(F.col("lines").isNull(), "missing")
        .when(F.col("records").isNull(), "undeclared")
        .when(F.col("lines") == F.col("records"), "matches")
        .otherwise("differs")
    )
    zero = F.lit(0).cast("bigint")
    return both.select(
        "file_name", F.coalesce("records", zero).alias("declared"), F.coalesce("lines", zero).alias("actual"), status.alias("status")
    )


def reconcile_counts(catalog: DataFrame, rows: DataFrame) -> DataFrame:
    """Declared against actual records per data file.

    `rows` comes straight from a file scan, so that the name of its file is known.
    """
    actual = rows.groupBy(F.col("_metadata.file_name").alias("file_name")).agg(F.count(F.lit(1)).alias("actual"))
    declared = catalog.groupBy("file_name").agg(F.sum("record_count").alias("declared"))
    zero = F.lit(0).cast("bigint")
    return declared.join(actual, "file_name", "full_outer").select(
        "file_name",
        F.coalesce("declared", zero).alias("declared"),
        F.coalesce("actual", zero).alias("actual"),
        F.coalesce("declared", zero).eqNullSafe(F.coalesce("actual", zero)).alias("matches"),
    )
