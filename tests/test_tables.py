import json

import pytest
from pyspark.sql import functions as F

from feeds import SCENARIO, SCENARIO_HISTORY, SCENARIO_STATE, changes, plan, rows, table, versions
from rowtide.operators.measure import estimate_partitions, partitions_for_bytes, size_report
from rowtide.plans.jobs import initial_load, load_changes, snapshot, vacuum
from rowtide.plans.merge import apply_to_table
from rowtide.plans.scenario import metadata_text, write_batch
from rowtide.sources.catalog import CatalogError
from rowtide.sources.tables import (
    bucket_of,
    committed_generations,
    compact_table,
    current_generation,
    export_snapshot,
    read_table,
    stale_files,
    table_files,
    table_state,
    write_generation,
)
from rowtide.streaming.feed import apply_batch, stream_changes

NTZ = "timestamp_ntz"
COLUMNS = [
    {"name": "header__timestamp", "type": "DATETIME", "primaryKeyPos": 0},
    {"name": "header__change_oper", "type": "STRING", "primaryKeyPos": 0},
    {"name": "id", "type": "INT4", "primaryKeyPos": 1},
    {"name": "name", "type": "WSTRING", "primaryKeyPos": 0},
]


def wire(spark, feed):
    text = F.concat(F.date_format("header__timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("0"))
    return changes(spark, feed).withColumn("header__timestamp", text).coalesce(1)


def written_feed(spark, path, feed=SCENARIO, prefix=""):
    write_batch(wire(spark, feed), str(path), COLUMNS, prefix)
    return str(path)


# Sizes.


def test_estimates(spark):
    df = table(spark, [(1, "abc"), (22, None)])
    assert size_report(df, 2).first().asDict() == {"rows": 2, "text_bytes": 6, "partitions": 3}
    assert estimate_partitions(df) == 1
    assert estimate_partitions(table(spark)) == 1
    assert estimate_partitions(spark.createDataFrame([(None,)], "a string"), 1) == 1
    nested = spark.createDataFrame([([1, 2], {"a": 1}, (1,), True)], "a array<int>, m map<string,int>, s struct<x:int>, b boolean")
    assert size_report(nested, 1).first()["text_bytes"] == len("[1,2]") + len('{"a":1}') + len('{"x":1}') + len("true")
    assert [partitions_for_bytes(n, 10) for n in (0, 10, 11)] == [1, 1, 2]


# Generations.


def test_generations_are_kept_and_only_committed_ones_count(spark, tmp_path):
    root = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        read_table(spark, root)
    assert rows(read_table(spark, root, table(spark).schema)) == []
    assert write_generation(table(spark, [(1, "a")]), root) == 0
    assert write_generation(table(spark, [(2, "b")]), root) == 1
    (tmp_path / "t" / "gen=2").mkdir()
    assert committed_generations(spark, root) == [0, 1]
    assert rows(read_table(spark, root)) == [(2, "b")]
    assert rows(read_table(spark, root, generation=0)) == [(1, "a")]
    with pytest.raises(FileExistsError):
        write_generation(table(spark), root, 1)
    assert write_generation(table(spark), root) == 3
    assert rows(read_table(spark, root)) == [] and read_table(spark, root).columns == ["id", "name"]


def test_an_uncommitted_generation_is_written_over(spark, tmp_path):
    root = str(tmp_path / "t")
    write_generation(table(spark, [(1, "a")]), root)
    table(spark, [(9, "left over")]).write.parquet(f"{root}/gen=1")
    assert write_generation(table(spark, [(2, "b")]), root, 1) == 1
    assert rows(read_table(spark, root)) == [(2, "b")]


def test_partitions_keep_types_and_column_order(spark, tmp_path):
    root = str(tmp_path / "t")
    df = spark.createDataFrame([(1, True, "01", None), (2, False, "x/y", 2.5)], "id int, flag boolean, code string, v double")
    write_generation(df, root, partition_by=["flag", "code"])
    assert read_table(spark, root).dtypes == df.dtypes
    assert rows(read_table(spark, root)) == rows(df)
    compact_table(spark, root)
    assert table_state(spark, root).partition_by == ("flag", "code")
    assert rows(read_table(spark, root)) == rows(df)


def test_gen_is_reserved(spark, tmp_path):
    with pytest.raises(ValueError, match="gen"):
        write_generation(table(spark, [(1,)], "gen int"), str(tmp_path / "t"))


def test_only_touched_buckets_are_written(spark, tmp_path):
    root = str(tmp_path / "t")
    many = spark.range(1000).selectExpr("cast(id as int) id", "cast(id as string) name")
    write_generation(many, root, keys=["id"], buckets=8)
    before = table_state(spark, root)
    assert len(before.folders) == 8
    bucket = many.where("id = 5").select(bucket_of(["id"], 8)).first()[0]
    feed = changes(spark, [(1, "U", 5, "five"), (2, "B", 6, "no change")])
    assert apply_to_table(spark, root, feed, ["id"], many.schema) == 1
    after = table_state(spark, root)
    assert set(after.folders) - set(before.folders) == {f"gen=1/__bucket={bucket}"}
    assert set(before.folders) - set(after.folders) == {f"gen=0/__bucket={bucket}"}
    expected = {(i, str(i)) for i in range(1000) if i != 5} | {(5, "five")}
    assert set(rows(read_table(spark, root))) == expected
    assert read_table(spark, root).columns == ["id", "name"]
    stale = stale_files(spark, root).collect()
    assert stale and all(f"gen=0/__bucket={bucket}/" in r["path"] for r in stale)


def test_a_bucket_may_become_empty(spark, tmp_path):
    root = str(tmp_path / "t")
    write_generation(table(spark, [(1, "a"), (2, "b")]), root, keys=["id"], buckets=64)
    apply_to_table(spark, root, changes(spark, [(1, "D", 1, "a")]), ["id"], table(spark).schema)
    assert rows(read_table(spark, root)) == [(2, "b")]
    apply_to_table(spark, root, changes(spark, [(2, "D", 2, "b")]), ["id"], table(spark).schema)
    assert rows(read_table(spark, root)) == []
    apply_to_table(spark, root, changes(spark, [(3, "I", 1, "c")]), ["id"], table(spark).schema)
    assert rows(read_table(spark, root)) == [(1, "c")]


@pytest.mark.parametrize("buckets", [None, 4])
@pytest.mark.parametrize("mode", ["latest", "delete_wins", "history"])
def test_batches_cut_in_time_lead_to_the_scenario(spark, tmp_path, mode, buckets):
    root = str(tmp_path / "t")
    for low, high in ((0, 6), (6, 8), (8, 20)):
        part = changes(spark, [c for c in SCENARIO if low <= c[0] < high])
        apply_to_table(spark, root, part, ["id"], table(spark).schema, mode, buckets=buckets)
    result = read_table(spark, root)
    if mode == "history":
        assert set(versions(result)) == SCENARIO_HISTORY
    else:
        assert set(rows(result)) == SCENARIO_STATE


def test_closed_versions_are_not_rewritten(spark, tmp_path):
    root = str(tmp_path / "h")
    for low, high in ((0, 9), (9, 10), (10, 11)):
        part = changes(spark, [c for c in [*SCENARIO, (10, "U", 3, "x")] if low <= c[0] < high])
        apply_to_table(spark, root, part, ["id"], table(spark).schema, "history")
    assert table_state(spark, root).folders == ("gen=0/current=false", "gen=2/current=false", "gen=2/current=true")
    compact_table(spark, root)
    assert table_state(spark, root).folders == ("gen=3/current=false", "gen=3/current=true")
    history = read_table(spark, root)
    assert dict(history.dtypes)["current"] == "boolean"
    assert set(versions(history)) == (SCENARIO_HISTORY - {(3, "number_three", True, False, 3, None)}) | {
        (3, "number_three", False, False, 3, 10), (3, "x", True, False, 10, None),
    }
    used = stale_files(spark, root).collect()
    assert {r["generation"] for r in used} == {0, 1, 2}


def test_history_of_another_layout_is_rewritten_whole(spark, tmp_path):
    root = str(tmp_path / "h")
    first = changes(spark, [c for c in SCENARIO if c[0] < 7])
    apply_to_table(spark, str(tmp_path / "x"), first, ["id"], table(spark).schema, "history")
    write_generation(read_table(spark, str(tmp_path / "x")), root)
    apply_to_table(spark, root, changes(spark, SCENARIO), ["id"], table(spark).schema, "history")
    assert set(versions(read_table(spark, root))) == SCENARIO_HISTORY
    assert table_state(spark, root).partition_by == ("current",)


def test_untouched_buckets_are_not_read(spark, tmp_path):
    root = str(tmp_path / "t")
    write_generation(spark.range(100).selectExpr("cast(id as int) id", "'x' name"), root, keys=["id"], buckets=4)
    state = table_state(spark, root)
    for folder in state.folders[1:]:
        for file in (tmp_path / "t" / folder).glob("*.parquet"):
            file.write_text("damaged")
    bucket = int(state.folders[0].rsplit("=", 1)[1])
    key = next(r["id"] for r in spark.range(100).select(F.col("id").cast("int")).withColumn("b", bucket_of(["id"], 4)).collect() if r["b"] == bucket)
    apply_to_table(spark, root, changes(spark, [(1, "D", key, "")]), ["id"], table(spark).schema)
    assert table_state(spark, root).folders[:1] == (state.folders[1],)


def test_stale_files(spark, tmp_path):
    root = str(tmp_path / "t")
    for i in range(3):
        write_generation(table(spark, [(i, "a")]).coalesce(1), root)
    table(spark, [(9, "in the making")]).write.parquet(f"{root}/gen=7")
    assert sorted(r["generation"] for r in stale_files(spark, root).collect()) == [0, 1]
    assert sorted(r["generation"] for r in stale_files(spark, root, keep=2).collect()) == [0]
    oldest = table_files(spark, root).agg(F.min("modified")).first()[0]
    assert stale_files(spark, root, older_than=oldest).count() == 0
    assert "content" not in plan(stale_files(spark, root)).split("ReadSchema")[-1]


def test_export(spark, tmp_path):
    df = table(spark, [(1, "a", "I", "k")], "id int, name string, header__change_oper string, _hoodie_record_key string")
    for _ in range(2):
        export_snapshot(df, str(tmp_path / "s"), partitions=1)
    out = spark.read.parquet(str(tmp_path / "s"))
    assert out.columns == ["id", "name"] and rows(out) == [(1, "a")]


# Jobs.


def test_jobs_from_files(spark, tmp_path):
    load = written_feed(spark, tmp_path / "load", [c for c in SCENARIO if c[0] <= 5], "LOAD")
    feed = written_feed(spark, tmp_path / "load__ct", [c for c in SCENARIO if c[0] > 5])
    root = str(tmp_path / "t")
    assert initial_load(spark, feed, root) is None
    assert initial_load(spark, load, root, dedup_by=["header__timestamp"], timestamp_type=NTZ) == 0
    plain = [c for c in read_table(spark, root).columns if not c.startswith("header__")]
    write_generation(read_table(spark, root).select(*plain), root)
    assert load_changes(spark, feed, root, timestamp_type=NTZ) == 2
    assert set(rows(read_table(spark, root))) == SCENARIO_STATE
    assert load_changes(spark, feed, root, timestamp_type=NTZ, one_pass_above=0) == 3
    assert set(rows(read_table(spark, root))) == SCENARIO_STATE
    snapshot(spark, root, str(tmp_path / "snapshot"))
    assert set(rows(spark.read.parquet(str(tmp_path / "snapshot")))) == SCENARIO_STATE
    stale = vacuum(spark, root)
    assert {r["generation"] for r in stale.collect()} == {0, 1, 2, 3}


def test_jobs_on_an_empty_folder_change_nothing(spark, tmp_path):
    (tmp_path / "none").mkdir()
    root = str(tmp_path / "t")
    assert load_changes(spark, str(tmp_path / "none"), root) is None
    write_generation(table(spark, [(1, "a")]), root)
    assert load_changes(spark, str(tmp_path / "none"), root) == 0
    with pytest.raises(ValueError, match="mode"):
        load_changes(spark, written_feed(spark, tmp_path / "ct"), root, "other")


@pytest.mark.parametrize("parse", [True, False])
def test_history_job(spark, tmp_path, parse):
    feed = written_feed(spark, tmp_path / "ct")
    root = str(tmp_path / "h")
    load_changes(spark, feed, root, "history", parse_datetime=parse, timestamp_type=NTZ)
    history = read_table(spark, root)
    if not parse:
        assert dict(history.dtypes)["effective_date"] == "string"
        to_time = {c: F.col(c).cast(NTZ) for c in ("effective_date", "end_date")}
        history = history.withColumns(to_time)
    assert set(versions(history)) == SCENARIO_HISTORY


def test_key_is_required(spark, tmp_path):
    keyless = [{**c, "primaryKeyPos": 0} for c in COLUMNS]
    write_batch(wire(spark, SCENARIO), str(tmp_path / "ct"), keyless)
    for mode in ("latest", "delete_wins", "history"):
        with pytest.raises(ValueError, match="key"):
            load_changes(spark, str(tmp_path / "ct"), str(tmp_path / "t"), mode)


# Stream.


@pytest.mark.parametrize("mode", ["latest", "history"])
def test_stream_takes_up_where_it_stopped(spark, tmp_path, mode):
    feed, root = tmp_path / "ct", str(tmp_path / "t")
    for low, high in ((0, 6), (6, 20)):
        written_feed(spark, feed, [c for c in SCENARIO if low <= c[0] < high])
        schema = wire(spark, SCENARIO).schema
        query = stream_changes(
            spark, str(feed), schema, root, ["id"], table(spark).schema, str(tmp_path / "checkpoint"), mode,
            datetime_columns=["header__timestamp"], timestamp_type=NTZ, buckets=2,
        )
        query.awaitTermination()
    assert committed_generations(spark, root) == [1, 2]
    result = read_table(spark, root)
    assert set(versions(result) if mode == "history" else rows(result)) == (
        SCENARIO_HISTORY if mode == "history" else SCENARIO_STATE
    )


def test_a_repeated_micro_batch_is_not_applied_twice(spark, tmp_path):
    root = str(tmp_path / "t")
    feed = changes(spark, SCENARIO)
    apply_batch(feed, 0, root, ["id"], table(spark).schema)
    apply_batch(changes(spark, [(99, "D", 1, "")]), 0, root, ["id"], table(spark).schema)
    assert set(rows(read_table(spark, root))) == SCENARIO_STATE
    assert current_generation(spark, root) == 1
    with pytest.raises(FileNotFoundError):
        apply_batch(feed, 5, root, ["id"], table(spark).schema)


def test_commit_file_is_plain_json(spark, tmp_path):
    root = str(tmp_path / "t")
    write_generation(table(spark, [(1, "a")]), root)
    facts = json.loads((tmp_path / "t" / "gen=0" / "_table.json").read_text())
    assert facts["folders"] == ["gen=0"]


def test_jobs_keep_broken_lines_apart(spark, tmp_path):
    """A line that is no JSON object is neither loaded as a row of nulls nor lost silently."""
    folder, root = tmp_path / "load", str(tmp_path / "t")
    folder.mkdir()
    columns = [{"name": "id", "type": "INT4", "primaryKeyPos": 1}, {"name": "name", "type": "STRING", "primaryKeyPos": 0}]
    (folder / "LOAD1.dfm").write_text(metadata_text("LOAD1", "json", "x", 9, columns))
    (folder / "LOAD1.json").write_text('{"id": 1, "name": "a"}\n{"id": 2, "na\n{"id": 3, "name": "c"}\n')
    with pytest.warns(UserWarning) as said:
        initial_load(spark, str(folder), root)
    assert any("1 lines" in str(w.message) for w in said) and any("9 records declared, 2 found" in str(w.message) for w in said)
    assert sorted(map(tuple, read_table(spark, root).collect())) == [(1, "a"), (3, "c")]
    (line,) = spark.read.json(root + "__rejected").collect()
    assert line["line"] == '{"id": 2, "na' and line["file_name"] == "LOAD1.json"


def test_metadata_without_a_file_name_does_not_read_the_folder(spark, tmp_path):
    columns = [{"name": "id", "type": "INT4", "primaryKeyPos": 1}]
    nameless = json.loads(metadata_text("LOAD1", "json", "x", 1, columns))
    del nameless["fileInfo"]["name"]
    (tmp_path / "LOAD1.dfm").write_text(json.dumps(nameless))
    (tmp_path / "stray.json").write_text('{"id": 1}\n')
    with pytest.raises(CatalogError):
        initial_load(spark, str(tmp_path), str(tmp_path / "t"))


def test_compaction_gives_no_task_more_than_spark_reads_at_once(spark, tmp_path):
    root = str(tmp_path / "t")
    many = spark.range(0, 100_000, 1, 20).selectExpr("cast(id as int) id", "sha2(cast(id as string), 256) name")
    write_generation(many, root)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        compact_table(spark, root)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    sizes = [f.stat().st_size for f in (tmp_path / "t" / "gen=1").glob("*.parquet")]
    assert 1 < len(sizes) < 20 and max(sizes) <= 2 << 20
    assert read_table(spark, root).exceptAll(many).isEmpty() and read_table(spark, root).count() == 100_000
    compact_table(spark, root)  # as much as a task reads by default is one file
    assert len(list((tmp_path / "t" / "gen=2").glob("*.parquet"))) == 1
