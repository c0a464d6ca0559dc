import pytest
from pyspark.sql import functions as F

from feeds import SCENARIO, SCENARIO_STATE, at, changes, plan, rows, table
from rowtide.operators.apply import apply_delete_wins, apply_latest
from rowtide.operators.compact import compact_changes, deduplicate, split_operations, split_upserts_deletes
from rowtide.operators.measure import change_stats

ONE_PASS = pytest.mark.parametrize("one_pass", [False, True])


@ONE_PASS
@pytest.mark.parametrize("apply", [apply_latest, apply_delete_wins])
def test_scenario(spark, apply, one_pass):
    result = apply(table(spark), changes(spark, SCENARIO), ["id"], one_pass=one_pass)
    assert set(rows(result)) == SCENARIO_STATE


@ONE_PASS
def test_insert_delete_insert(spark, one_pass):
    feed = changes(spark, [(1, "I", 1, "a"), (2, "D", 1, "a"), (3, "I", 1, "b")])
    assert rows(apply_latest(table(spark), feed, ["id"], one_pass=one_pass)) == [(1, "b")]
    assert rows(apply_delete_wins(table(spark), feed, ["id"], one_pass=one_pass)) == []


def test_delete_beats_update_of_the_same_time(spark):
    feed = changes(spark, [(1, "D", 1, "a"), (1, "U", 1, "z")])
    assert rows(apply_latest(table(spark, [(1, "old")]), feed, ["id"])) == []


def test_larger_payload_wins_a_tie_and_null_is_lowest(spark):
    feed = changes(spark, [(1, "U", 1, "a"), (1, "U", 1, "b"), (1, "U", 1, None), (1, "U", 2, None)])
    assert rows(apply_latest(table(spark), feed, ["id"])) == [(1, "b"), (2, None)]


def test_other_operations_are_dropped(spark):
    feed = changes(spark, [(1, "I", 1, "a"), (2, "B", 1, "b"), (3, None, 1, "c")])
    assert rows(apply_latest(table(spark), feed, ["id"])) == [(1, "a")]


@ONE_PASS
def test_unknown_keys(spark, one_pass):
    feed = changes(spark, [(1, "D", 1, "a"), (1, "U", 2, "b")])
    for apply in (apply_latest, apply_delete_wins):
        assert rows(apply(table(spark, [(3, "c")]), feed, ["id"], one_pass=one_pass)) == [(2, "b"), (3, "c")]


@ONE_PASS
def test_replay_changes_nothing(spark, one_pass):
    feed = changes(spark, SCENARIO)
    once = apply_latest(table(spark), feed, ["id"], one_pass=one_pass)
    assert rows(apply_latest(once, feed, ["id"], one_pass=one_pass)) == rows(once)


@ONE_PASS
def test_null_key_matches_nothing(spark, one_pass):
    feed = changes(spark, [(1, "U", None, "new"), (2, "D", 1, "x")])
    result = apply_latest(table(spark, [(None, "old"), (1, "x")]), feed, ["id"], one_pass=one_pass)
    assert set(rows(result)) == {(None, "old"), (None, "new")}


@ONE_PASS
def test_composite_key(spark, one_pass):
    ddl = "header__timestamp timestamp_ntz, header__change_oper string, a int, b string, v int"
    feed = changes(spark, [(1, "U", 1, "x", 10), (2, "D", 1, "y", 0), (3, "I", 2, "x", 30), (4, "U", 2, "x", 40)], ddl)
    target = table(spark, [(1, "x", 1), (1, "y", 2), (1, "z", 3)], "a int, b string, v int")
    result = apply_latest(target, feed, ["a", "b"], one_pass=one_pass)
    assert set(rows(result)) == {(1, "x", 10), (1, "z", 3), (2, "x", 40)}


@ONE_PASS
def test_extra_target_columns_keep_their_value(spark, one_pass):
    target = table(spark, [(1, "a", "keep"), (2, "b", "gone"), (3, "c", "same")], "id int, name string, note string")
    feed = changes(spark, [(1, "U", 1, "A"), (1, "D", 2, ""), (1, "I", 4, "d")])
    result = apply_latest(target, feed, ["id"], one_pass=one_pass)
    assert set(rows(result)) == {(1, "A", "keep"), (3, "c", "same"), (4, "d", None)}


@ONE_PASS
def test_update_to_null_is_applied(spark, one_pass):
    feed = changes(spark, [(1, "U", 1, None)])
    assert rows(apply_latest(table(spark, [(1, "a")]), feed, ["id"], one_pass=one_pass)) == [(1, None)]


@ONE_PASS
def test_key_only_table(spark, one_pass):
    feed = changes(spark, [(1, "I", 1), (2, "D", 2), (3, "U", 3)],
                   "header__timestamp timestamp_ntz, header__change_oper string, id int")
    assert rows(apply_latest(table(spark, [(2,), (4,)], "id int"), feed, ["id"], one_pass=one_pass)) == [(1,), (3,), (4,)]


def test_columns_the_target_lacks_are_refused(spark):
    with pytest.raises(ValueError, match="name"):
        apply_latest(table(spark, [(1,)], "id int"), changes(spark, SCENARIO), ["id"])


def test_keys_are_required(spark):
    with pytest.raises(ValueError):
        apply_latest(table(spark), changes(spark, SCENARIO), [])
    with pytest.raises(ValueError, match="other"):
        compact_changes(changes(spark, SCENARIO), ["other"])


def test_raw_text_orders_changes_within_a_microsecond(spark):
    feed = changes(spark, [(1, "U", 1, "z"), (1, "U", 1, "a")]).withColumn(
        "header__timestamp_raw",
        F.when(F.col("name") == "a", "2024-01-01 00:00:01.0000002").otherwise("2024-01-01 00:00:01.0000001"),
    )
    assert rows(apply_latest(table(spark), feed, ["id"])) == [(1, "a")]


def test_sequence_column_can_lead(spark):
    feed = changes(spark, [(9, "U", 1, "first"), (1, "U", 1, "second")]).withColumn(
        "header__seq", F.when(F.col("name") == "first", 1).otherwise(2)
    )
    result = apply_latest(table(spark), feed, ["id"], order_by=["header__seq", "header__timestamp"])
    assert rows(result) == [(1, "second")]


@ONE_PASS
def test_metadata_columns_stay_on_request(spark, one_pass):
    feed = changes(spark, [(1, "U", 1, "a"), (2, "I", 2, "b"), (3, "D", 3, "c")])
    target = table(spark, [(3, "c"), (4, "d")])
    result = apply_delete_wins(target, feed, ["id"], keep_metadata=True, one_pass=one_pass)
    assert result.columns == ["id", "name", "header__timestamp", "header__change_oper"]
    assert set(rows(result)) == {(1, "a", at(1), "U"), (2, "b", at(2), "I"), (4, "d", None, None)}


def test_deduplicate_takes_the_highest(spark):
    df = table(spark, [(1, "a", 1), (1, "b", 3), (1, "c", 2), (2, "x", None)], "id int, name string, crdate int")
    assert rows(deduplicate(df, ["id"], ["crdate"])) == [(1, "b", 3), (2, "x", None)]


def test_splits_and_stats(spark):
    feed = changes(spark, [*SCENARIO, (11, "B", 1, ""), (12, None, 1, "")])
    upserts, deletes = split_upserts_deletes(feed)
    assert (upserts.count(), deletes.count()) == (9, 1)
    assert {op: df.count() for op, df in split_operations(feed).items()} == {"I": 7, "U": 2, "D": 1}
    stats = {r["operation"]: (r["rows"], r["applied"]) for r in change_stats(feed).collect()}
    assert stats == {"I": (7, True), "U": (2, True), "D": (1, True), "B": (1, False), None: (1, False)}


def test_hot_key_is_combined_before_the_shuffle(spark):
    feed = spark.range(0, 20000, 1, 8).select(
        F.timestamp_seconds("id").cast("timestamp_ntz").alias("header__timestamp"),
        F.lit("U").alias("header__change_oper"),
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).cast("int").alias("id"),
        F.col("id").cast("string").alias("name"),
    )
    latest = compact_changes(feed, ["id"])
    text = plan(latest)
    assert text.index("partial_max") > text.index("Exchange hashpartitioning")
    assert latest.where("id = 0").first()["name"] == "19998"
    assert latest.count() == 1 + sum(1 for i in range(20000) if i % 3)


def test_small_batch_leaves_the_target_unshuffled(spark, tmp_path):
    spark.range(10000).selectExpr("cast(id as int) id", "cast(id as string) name").write.parquet(str(tmp_path / "t"))
    changes(spark, SCENARIO).write.parquet(str(tmp_path / "c"))
    target, feed = spark.read.parquet(str(tmp_path / "t")), spark.read.parquet(str(tmp_path / "c"))
    text = plan(apply_latest(target, feed, ["id"]))
    target_side = text[: text.index("BroadcastExchange")]
    assert "BroadcastHashJoin" in target_side and "LeftOuter" in target_side
    assert "Exchange hashpartitioning" not in target_side
    for word in ("Python", "SortMergeJoin", "CartesianProduct", "NestedLoop"):
        assert word not in text


def test_one_pass_shuffles_each_side_once(spark, tmp_path):
    spark.range(1000).selectExpr("cast(id as int) id", "cast(id as string) name").write.parquet(str(tmp_path / "t"))
    changes(spark, SCENARIO).write.parquet(str(tmp_path / "c"))
    target, feed = spark.read.parquet(str(tmp_path / "t")), spark.read.parquet(str(tmp_path / "c"))
    text = plan(apply_latest(target, feed, ["id"], one_pass=True))
    assert text.count("FileScan") == 2
    assert text.count("Exchange hashpartitioning") == 2
