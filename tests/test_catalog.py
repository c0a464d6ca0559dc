import json

import pytest
from pyspark.sql import types as T

from rowtide.plans.jobs import open_batch
from rowtide.plans.scenario import metadata_text, write_text
from rowtide.sources.catalog import (
    CatalogError,
    batch_from_catalog,
    catalog_totals,
    read_batch_catalog,
    reconcile_counts,
    source_type,
    validate_catalog,
)
from rowtide.sources.changes import normalize, quarantine, read_batch

COLUMNS = [
    {"name": "header__timestamp", "type": "DATETIME", "primaryKeyPos": 0},
    {"name": "header__change_oper", "type": "STRING", "primaryKeyPos": 0},
    {"name": "id", "type": "INT4", "primaryKeyPos": 1},
    {"name": "name", "type": "WSTRING", "primaryKeyPos": 0},
]


def metadata(path, name, records=0, columns=COLUMNS, **changed):
    content = json.loads(metadata_text(name, "json", f"/elsewhere/{name}.json", records, columns))
    content.update(changed)
    (path / f"{name}.dfm").write_text(json.dumps(content))


def lines(path, name, *rows):
    (path / f"{name}.json").write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")


def violations(spark, path):
    found = validate_catalog(read_batch_catalog(spark, str(path))).collect()
    return sorted((r["metadata_file"].rsplit("/", 1)[1], r["check"]) for r in found)


def test_catalog_reads_only_matching_files_of_the_folder(spark, tmp_path):
    metadata(tmp_path, "LOAD1", 5)
    metadata(tmp_path, "20240101", 7)
    (tmp_path / "LOAD1.json").write_text("{}\n")
    (tmp_path / "sub").mkdir()
    metadata(tmp_path / "sub", "LOAD2", 1)
    everything = read_batch_catalog(spark, str(tmp_path))
    assert sorted(r["file_name"] for r in everything.collect()) == ["20240101.json", "LOAD1.json"]
    loads = read_batch_catalog(spark, str(tmp_path), "LOAD", data_dir=str(tmp_path))
    assert [(r["data_file"], r["record_count"]) for r in loads.collect()] == [(f"{tmp_path}/LOAD1.json", 5)]
    assert catalog_totals(everything).first().asDict() == {"files": 2, "record_count": 12}


def test_data_files_default_to_their_location(spark, tmp_path):
    metadata(tmp_path, "a")
    assert batch_from_catalog(read_batch_catalog(spark, str(tmp_path))).files == ("/elsewhere/a.json",)


def test_schema_and_keys(spark, tmp_path):
    columns = [
        {"name": "header__change_oper", "type": "STRING", "primaryKeyPos": 0},
        {"name": "b", "type": "STRING", "primaryKeyPos": "2"},
        {"name": "a", "type": "INT8", "primaryKeyPos": 1},
        *[{"name": t.lower(), "type": t, "primaryKeyPos": 0}
          for t in ("BOOLEAN", "INT4", "INT8", "NUMERIC", "DATETIME", "STRING", "WSTRING", "BYTES", "NCLOB")],
    ]
    metadata(tmp_path, "a", columns=columns)
    batch = batch_from_catalog(read_batch_catalog(spark, str(tmp_path)))
    assert batch.keys == ("a", "b")
    assert batch.metadata_columns == ["header__change_oper"]
    assert batch.table_schema.names == [c["name"] for c in columns[1:]]
    assert batch.payload_columns == [c["name"] for c in columns[3:]]
    assert batch.datetime_columns == ("datetime",)
    types = {f.name: (f.dataType.simpleString(), f.nullable) for f in batch.batch_schema.fields}
    assert types["a"] == ("bigint", False) and types["b"] == ("string", False)
    assert [types[c["name"]][0] for c in columns[3:]] == [
        "boolean", "int", "bigint", "bigint", "string", "string", "string", "string", "string",
    ]
    exact = batch_from_catalog(read_batch_catalog(spark, str(tmp_path)), T.DecimalType(10, 2))
    assert exact.batch_schema["numeric"].dataType == T.DecimalType(10, 2)


def test_violations_name_the_file(spark, tmp_path):
    metadata(tmp_path, "a")
    metadata(tmp_path, "version", dfmVersion="1.0")
    metadata(tmp_path, "format", formatInfo={"format": "csv"})
    metadata(tmp_path, "swapped", columns=COLUMNS[::-1])
    metadata(tmp_path, "typed", columns=[*COLUMNS[:3], {"name": "name", "type": "MONEY", "primaryKeyPos": 0}])
    (tmp_path / "list.dfm").write_text("[1]")
    (tmp_path / "text.dfm").write_text('{"dfmVersion": ')
    assert violations(spark, tmp_path) == [
        ("format.dfm", "format"), ("list.dfm", "object"), ("swapped.dfm", "columns"), ("text.dfm", "object"),
        ("typed.dfm", "columns"), ("typed.dfm", "types"), ("version.dfm", "version"),
    ]
    with pytest.raises(CatalogError, match="version.dfm"):
        batch_from_catalog(read_batch_catalog(spark, str(tmp_path)))


def test_order_of_fields_inside_a_column_does_not_matter(spark, tmp_path):
    metadata(tmp_path, "a")
    metadata(tmp_path, "b", columns=[dict(reversed(list(c.items()))) for c in COLUMNS])
    assert violations(spark, tmp_path) == []
    metadata(tmp_path, "c", columns=[{**c, "length": 50} for c in COLUMNS])
    assert violations(spark, tmp_path) == [("c.dfm", "columns")]


def test_unknown_type_and_empty_folder(spark, tmp_path):
    with pytest.raises(CatalogError, match="MONEY"):
        source_type("MONEY")
    assert open_batch(spark, str(tmp_path)) is None


def test_missing_data_file_is_an_error(spark, tmp_path):
    metadata(tmp_path, "a", 1)
    batch = open_batch(spark, str(tmp_path))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_batch(spark, batch).collect()


def test_rows_follow_the_declared_schema(spark, tmp_path):
    columns = [*COLUMNS, {"name": "price", "type": "NUMERIC", "primaryKeyPos": 0}]
    metadata(tmp_path, "a", 4, columns)
    lines(
        tmp_path, "a",
        {"header__timestamp": "2024-01-01 00:00:01.1234567", "header__change_oper": "I", "id": 1, "name": 5, "price": 12},
        {"header__timestamp": "nonsense", "header__change_oper": "I", "id": 99999999999, "name": "b", "extra": 1},
        {"header__timestamp": "2024-01-01 00:00:01", "header__change_oper": "I", "id": 3, "price": 12.50},
        '{"id": 4, "na',
    )
    batch = open_batch(spark, str(tmp_path))
    got = [(r["id"], r["name"], r["price"]) for r in read_batch(spark, batch).collect()]
    assert got == [(1, "5", 12), (None, "b", None), (3, None, None), (None, None, None)]
    exact = batch_from_catalog(read_batch_catalog(spark, str(tmp_path), data_dir=str(tmp_path)), T.DecimalType(10, 2))
    assert str(read_batch(spark, exact).collect()[2]["price"]) == "12.50"

    good, bad = quarantine(spark, batch.files, batch.batch_schema)
    assert [(r["id"], r["name"]) for r in good.collect()] == [(1, "5"), (None, "b"), (3, None)]
    assert [tuple(r) for r in bad.collect()] == [("a.json", '{"id": 4, "na')]


@pytest.mark.parametrize("timestamp_type", ["timestamp", "timestamp_ntz"])
def test_normalize(spark, timestamp_type):
    texts = ["2024-01-01 00:00:01.1234567", "2024-01-01", "nonsense", None, "2024-01-01 00:00:01.5"]
    df = spark.createDataFrame([(t, "2024-02-30 00:00:00.0000000") for t in texts], "header__timestamp string, other string")
    out = normalize(df, ["header__timestamp", "other", "absent"], timestamp_type=timestamp_type)
    assert out.schema["header__timestamp"].dataType.simpleString() == timestamp_type
    got = out.collect()
    assert [r["header__timestamp"] and r["header__timestamp"].microsecond for r in got] == [123456, None, None, None, 500000]
    assert [r["header__timestamp_raw"] for r in got] == texts
    assert [r["other"] for r in got] == [None] * 5
    assert normalize(df, ["header__timestamp"], parse=False).schema == df.schema


def test_reconcile(spark, tmp_path):
    metadata(tmp_path, "a", 2)
    metadata(tmp_path, "b", 5)
    row = {"id": 1}
    lines(tmp_path, "a", row, row)
    lines(tmp_path, "b", row)
    catalog = read_batch_catalog(spark, str(tmp_path), data_dir=str(tmp_path))
    result = reconcile_counts(catalog, read_batch(spark, batch_from_catalog(catalog)))
    assert sorted(tuple(r) for r in result.collect()) == [("a.json", 2, 2, True), ("b.json", 5, 1, False)]


def test_write_text(spark, tmp_path):
    write_text(spark, f"{tmp_path}/deep/x.dfm", "äß")
    assert (tmp_path / "deep" / "x.dfm").read_text("utf-8") == "äß"
