"""What jobs and the stream count, keep apart and compare, without reading anything twice."""

import json

import pytest

from feeds import SCENARIO, changes, rows, table
from rowtide.plans.jobs import initial_load, load_changes
from rowtide.plans.scenario import metadata_text
from rowtide.sources import catalog as catalog_module
from rowtide.sources.catalog import CatalogError, batch_from_catalog, read_batch_catalog, reconcile_files
from rowtide.sources.tables import read_table
from rowtide.streaming.feed import stream_changes

COLUMNS = [
    {"name": "header__timestamp", "type": "DATETIME", "primaryKeyPos": 0},
    {"name": "header__change_oper", "type": "STRING", "primaryKeyPos": 0},
    {"name": "id", "type": "INT4", "primaryKeyPos": 1},
    {"name": "name", "type": "STRING", "primaryKeyPos": 0},
]


def line(second, oper, key, name):
    time = "soon" if second is None else f"2024-01-01 00:00:{second:02}.0000000"
    return json.dumps({"header__timestamp": time, "header__change_oper": oper, "id": key, "name": name})


def written(folder, lines, name="1", declared=None):
    folder.mkdir(exist_ok=True)
    declared = len(lines) if declared is None else declared
    (folder / f"{name}.dfm").write_text(metadata_text(name, "json", str(folder), declared, COLUMNS))
    (folder / f"{name}.json").write_text("".join(x + "\n" for x in lines))
    return str(folder)


FEED = [line(1, "I", 1, "a"), line(2, "U", 1, "b"), line(2, "B", 1, "a"), line(3, "U", None, "n"), line(None, "I", 2, "x"), '{"id": 3, "na', line(4, "D", 9, "z")]


@pytest.mark.parametrize("mode", ["latest", "history"])
def test_report_of_a_job_and_of_its_repetition(spark, tmp_path, mode):
    feed, root = written(tmp_path / "ct", FEED), str(tmp_path / "t")
    with pytest.warns(UserWarning):
        first = load_changes(spark, feed, root, mode, timestamp_type="timestamp_ntz")
    lines = {"sound": 6, "rejected": 1, "declared": 7, "rows": 6, "inserts": 2, "updates": 2, "deletes": 1, "others": 1}
    assert first == 0 and lines.items() <= first.report.items()
    assert first.report["null_keys"] == 1 and first.report["unreadable_times"] == 1
    assert first.report["compacted" if mode == "latest" else "late"] == (4 if mode == "latest" else 0)
    with pytest.warns(UserWarning):
        again = load_changes(spark, feed, root, mode, timestamp_type="timestamp_ntz")
    # The row without a key and the delete of an unknown one are not known again.
    assert again == 1 and again.report.get("late", 3) == 3
    kept = spark.read.json(root + "__rejected").collect()
    assert sorted((r["generation"], r["line"]) for r in kept) == [(0, '{"id": 3, "na'), (1, '{"id": 3, "na')]


def test_full_load_reports_its_lines(spark, tmp_path):
    folder = written(tmp_path / "load", FEED[:2], "LOAD1", declared=2)
    assert initial_load(spark, folder, str(tmp_path / "t")).report == {"sound": 2, "rejected": 0, "declared": 2}


def test_stream_keeps_broken_lines_by_batch(spark, tmp_path):
    folder, root = tmp_path / "ct", str(tmp_path / "t")
    schema = changes(spark, SCENARIO).schema
    text = schema.fromDDL("header__timestamp string, header__change_oper string, id int, name string")
    for k, lines in enumerate(([line(1, "I", 1, "a"), line(1, "I", 2, "b"), '{"id": 1,'], [line(5, "D", 2, "b"), "broken delete"])):
        written(folder, lines, str(k))
        with pytest.warns(UserWarning, match="1 lines"):
            stream_changes(
                spark, str(folder), text, root, ["id"], table(spark).schema, str(tmp_path / "cp"),
                datetime_columns=["header__timestamp"], timestamp_type="timestamp_ntz",
            ).awaitTermination()
    assert rows(read_table(spark, root)) == [(1, "a")]
    kept = spark.read.json(root + "__rejected").collect()
    assert sorted((r["batch"], r["line"], r["file_name"]) for r in kept) == [(0, '{"id": 1,', "0.json"), (1, "broken delete", "1.json")]


def test_sound_metadata_is_read_once(spark, tmp_path, monkeypatch):
    folder = written(tmp_path / "ct", FEED)
    catalog = read_batch_catalog(spark, folder, data_dir=folder)
    monkeypatch.setattr(catalog_module, "validate_catalog", lambda c: pytest.fail("a second pass"))
    tracker, context = spark.sparkContext.statusTracker(), spark.sparkContext
    context.setJobGroup("catalog", "one aggregation")
    try:
        assert batch_from_catalog(catalog).files == (f"{folder}/1.json",)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert len(tracker.getJobIdsForGroup("catalog")) <= 2  # one query: its map stage and its result


def test_broken_metadata_is_named(spark, tmp_path):
    folder = written(tmp_path / "ct", FEED)
    (tmp_path / "ct" / "2.dfm").write_text("[]")
    with pytest.raises(CatalogError, match="2.dfm: object"):
        batch_from_catalog(read_batch_catalog(spark, folder, data_dir=folder))


def test_files_on_either_side(spark, tmp_path):
    folder = written(tmp_path / "ct", FEED[:3])
    written(tmp_path / "ct", FEED[:2], "2", declared=3)
    (tmp_path / "ct" / "gone.dfm").write_text(metadata_text("gone", "json", folder, 5, COLUMNS))
    (tmp_path / "ct" / "stray.json").write_text(FEED[0] + "\n\n")
    (tmp_path / "ct" / "empty.json").write_text("")
    found = reconcile_files(spark, read_batch_catalog(spark, folder, data_dir=folder), folder)
    assert rows(found) == [
        ("1.json", 3, 3, "matches"), ("2.json", 3, 2, "differs"), ("empty.json", 0, 0, "undeclared"),
        ("gone.json", 5, 0, "missing"), ("stray.json", 0, 1, "undeclared"),
    ]
