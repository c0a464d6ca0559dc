"""The file contract of the replication feed."""

# Names, formats and type names that the files use.
DATETIME_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSSS"
METADATA_VERSION = "1.1"
DATA_FORMAT = "json"
CHANGE_PREFIX = "header__"
CHANGE_TIMESTAMP = "header__timestamp"
CHANGE_OPERATION = "header__change_oper"
TABLE_FORMAT_PREFIX = "_hoodie_"
INSERT, UPDATE, DELETE = "I", "U", "D"
MAX_PARTITION_BYTES = 1073741824  # 1 GiB

# Source type name -> Spark type.
SOURCE_TYPES = {
    "BOOLEAN": "boolean",
    "INT4": "int",
    "INT8": "bigint",
    "NUMERIC": "bigint",
    "DATETIME": "string",
    "STRING": "string",
    "WSTRING": "string",
    "BYTES": "string",
    "NCLOB": "string",
}

# Column added by `normalize`: the change time exactly as written. It keeps the
# seventh fractional digit, which a Spark timestamp (microseconds) cannot hold.
CHANGE_TIMESTAMP_RAW = "header__timestamp_raw"

# Columns a history table has in addition to the table's own.
HISTORY_COLUMNS = ("current", "deleted", "effective_date", "end_date")

# Columns that a history may have besides: the order columns, other than the change time, of
# the changes that began and ended a version.
HISTORY_ORDER_COLUMNS = ("effective_order", "end_order")
