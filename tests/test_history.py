import bisect
import random

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from feeds import (
    SCENARIO,
    SCENARIO_HISTORY,
    at,
    changes,
    empty_history,
    plan,
    rows,
    seconds,
    table,
    versions,
)
from rowtide.operators.apply import apply_delete_wins, apply_latest
from rowtide.operators.history import (
    as_of,
    current_rows,
    feed_order,
    history_schema,
    hot_key_bounds,
    initial_history,
    late_changes,
    scd2_apply,
)

VARIANTS = [
    {},
    {"one_pass": True},
    {"hot_key_rows": 1},
    {"hot_key_rows": 2, "one_pass": True},
    {"hot_key_rows": None},
]


@pytest.mark.parametrize("options", [*VARIANTS, {"order": "op_phase"}])
def test_scenario(spark, options):
    result = scd2_apply(empty_history(spark), changes(spark, SCENARIO), ["id"], **options)
    assert set(versions(result)) == SCENARIO_HISTORY


def test_schema_is_kept_and_names_may_not_collide(spark):
    history = empty_history(spark)
    assert scd2_apply(history, changes(spark, SCENARIO), ["id"]).columns == history.columns
    with pytest.raises(ValueError, match="deleted"):
        history_schema(table(spark, ddl="id int, deleted boolean").schema)


@pytest.mark.parametrize("options", VARIANTS)
def test_reinserted_key_is_current(spark, options):
    feed = changes(spark, [(1, "I", 1, "a"), (2, "D", 1, "a"), (3, "I", 1, "b")])
    assert versions(scd2_apply(empty_history(spark), feed, ["id"], **options)) == [
        (1, "a", False, True, 1, 2),
        (1, "b", True, False, 3, None),
    ]


def test_phases_close_a_reinserted_key(spark):
    feed = changes(spark, [(1, "I", 1, "a"), (2, "D", 1, "a"), (3, "I", 1, "b")])
    assert versions(scd2_apply(empty_history(spark), feed, ["id"], order="op_phase")) == [
        (1, "a", False, True, 1, 2),
        (1, "b", False, True, 3, 2),
    ]


def test_phases_refuse_two_updates_of_a_key(spark):
    feed = changes(spark, [(1, "U", 1, "a"), (2, "U", 1, "b")])
    with pytest.raises(Exception, match="more than one U"):
        scd2_apply(empty_history(spark), feed, ["id"], order="op_phase").collect()
    assert versions(scd2_apply(empty_history(spark), feed, ["id"])) == [
        (1, "a", False, False, 1, 2),
        (1, "b", True, False, 2, None),
    ]


@pytest.mark.parametrize("options", [*VARIANTS, {"order": "op_phase"}])
def test_unknown_keys(spark, options):
    feed = changes(spark, [(1, "D", 1, "a"), (1, "U", 2, "b")])
    assert versions(scd2_apply(empty_history(spark), feed, ["id"], **options)) == [(2, "b", True, False, 1, None)]


@pytest.mark.parametrize("options", [*VARIANTS, {"order": "op_phase"}])
def test_null_keys_never_meet(spark, options):
    feed = changes(spark, [(1, "I", None, "a"), (2, "U", None, "b"), (3, "D", None, "c")])
    assert versions(scd2_apply(empty_history(spark), feed, ["id"], **options)) == [
        (None, "a", True, False, 1, None),
        (None, "b", True, False, 2, None),
    ]


@pytest.mark.parametrize("options", VARIANTS)
def test_replay_changes_nothing_and_late_changes_are_listed(spark, options):
    feed = changes(spark, SCENARIO)
    once = scd2_apply(empty_history(spark), feed, ["id"])
    assert versions(scd2_apply(once, feed, ["id"], **options)) == versions(once)
    late = changes(spark, [(5, "U", 1, "late"), (20, "U", 1, "new"), (1, "U", 9, "unknown")])
    assert [r["name"] for r in late_changes(once, late, ["id"]).collect()] == ["late"]
    names = {v[1] for v in versions(scd2_apply(once, late, ["id"], **options)) if v[0] == 1}
    assert names == {"number_one", "number_one_changed", "new"}


@pytest.mark.parametrize("options", VARIANTS)
def test_a_change_without_a_time_is_the_oldest(spark, options):
    feed = changes(spark, [(None, "I", 1, "a"), (2, "U", 1, "b"), (None, "U", 2, "x")])
    base = initial_history(table(spark, [(2, "y")]), F.lit("2024-01-01 00:00:01").cast("timestamp_ntz"))
    assert [r["name"] for r in late_changes(base, feed, ["id"]).collect()] == ["x"]
    assert versions(scd2_apply(base, feed, ["id"], **options)) == [
        (1, "a", False, False, None, 2), (1, "b", True, False, 2, None), (2, "y", True, False, 1, None),
    ]


@pytest.mark.parametrize("options", VARIANTS)
def test_late_changes_do_not_close_versions_of_a_phase_ordered_history(spark, options):
    """Phases may leave an open version that is older than the newest time of its key."""
    phased = scd2_apply(empty_history(spark), changes(spark, [(5, "I", 1, "a"), (3, "U", 1, "b")]), ["id"], order="op_phase")
    assert versions(phased) == [(1, "a", False, False, 5, 3), (1, "b", True, False, 3, None)]
    result = scd2_apply(phased, changes(spark, [(4, "U", 1, "late"), (6, "D", 1, "")]), ["id"], **options)
    assert versions(result) == [(1, "a", False, False, 5, 3), (1, "b", False, True, 3, 6)]


@pytest.mark.parametrize("options", VARIANTS)
def test_order_by_a_sequence_that_disagrees_with_time(spark, options):
    ddl = "header__timestamp timestamp_ntz, header__change_oper string, id int, name string, header__seq int"
    feed = changes(spark, [(9, "I", 1, "first", 1), (8, "U", 1, "second", 2), (10, "U", 1, "third", 3)], ddl)
    assert versions(scd2_apply(empty_history(spark), feed, ["id"], order_by=["header__seq"], **options)) == [
        (1, "first", False, False, 9, 8), (1, "second", False, False, 8, 10), (1, "third", True, False, 10, None),
    ]


def test_untouched_versions_pass_through(spark):
    base = initial_history(table(spark, [(1, "a"), (2, "b")]), F.lit("2024-01-01").cast("timestamp_ntz"))
    result = scd2_apply(base, changes(spark, [(5, "U", 2, "B")]), ["id"])
    assert versions(result) == [(1, "a", True, False, 0, None), (2, "B", True, False, 5, None), (2, "b", False, False, 0, 5)]


def test_as_of(spark):
    history = scd2_apply(empty_history(spark), changes(spark, SCENARIO), ["id"])
    assert rows(as_of(history, at(6))) == [
        (1, "number_one_changed"), (2, "number_two"), (3, "number_three"), (4, "number_four"), (5, "number_five"),
    ]
    assert rows(as_of(history, at(0))) == []


def test_composite_key(spark):
    ddl = "header__timestamp timestamp_ntz, header__change_oper string, a int, b string, v int"
    feed = changes(spark, [(1, "I", 1, "x", 1), (2, "I", 1, "y", 2), (3, "U", 1, "x", 3), (4, "D", 1, "y", 0)], ddl)
    history = empty_history(spark, "a int, b string, v int, current boolean, deleted boolean, "
                                   "effective_date timestamp_ntz, end_date timestamp_ntz")
    for options in VARIANTS:
        assert versions(scd2_apply(history, feed, ["a", "b"], **options)) == [
            (1, "x", 1, False, False, 1, 3), (1, "x", 3, True, False, 3, None), (1, "y", 2, False, True, 2, 4),
        ]


def replay(feed):
    """Versions, latest state and delete-wins state of a feed, one change at a time."""
    done, open_versions, state, upserted, removed = [], {}, {}, {}, set()
    for t, op, key, name in sorted(feed, key=lambda c: c[0]):
        if key in open_versions:
            started, value = open_versions.pop(key)
            done.append((key, value, False, op == "D", started, t))
        if op == "D":
            state.pop(key, None)
            removed.add(key)
        else:
            open_versions[key] = (t, name)
            state[key] = upserted[key] = name
    done += [(k, v, True, False, t, None) for k, (t, v) in open_versions.items()]
    return sorted(done, key=repr), state, {k: v for k, v in upserted.items() if k not in removed}


def random_feed(seed, keys, per_key):
    rng = random.Random(seed)
    feed = []
    for key in range(keys):
        times = rng.sample(range(1, 100), rng.randint(1, per_key))
        feed += [(t, rng.choice("IUD"), key, rng.choice("abc")) for t in times]
    return feed


@pytest.mark.parametrize("options", VARIANTS)
def test_many_random_keys_match_a_replay(spark, options):
    feed = random_feed(7, 400, 12)
    expected, state, delete_wins = replay(feed)
    df = changes(spark, feed)
    assert versions(scd2_apply(empty_history(spark), df, ["id"], **options)) == expected
    if not options:
        assert dict(rows(apply_latest(table(spark), df, ["id"]))) == state
        assert dict(rows(apply_delete_wins(table(spark), df, ["id"]))) == delete_wins


@pytest.mark.parametrize("options", VARIANTS[:4])
def test_cutting_the_feed_in_time_changes_nothing(spark, tmp_path, options):
    feed = random_feed(11, 300, 10)
    expected, state, _ = replay(feed)
    history, current = empty_history(spark), table(spark)
    for low, high in ((0, 30), (30, 60), (60, 100)):
        part = changes(spark, [c for c in feed if low <= c[0] < high])
        scd2_apply(history, part, ["id"], **options).write.parquet(f"{tmp_path}/history{low}")
        apply_latest(current, part, ["id"]).write.parquet(f"{tmp_path}/current{low}")
        history = spark.read.parquet(f"{tmp_path}/history{low}")
        current = spark.read.parquet(f"{tmp_path}/current{low}")
    assert versions(history) == expected
    assert dict(rows(current)) == state
    assert dict(rows(current_rows(history))) == state


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    feed=st.lists(
        st.tuples(st.integers(1, 50), st.sampled_from("IUD"), st.integers(0, 4), st.sampled_from("abc")),
        min_size=1, max_size=25, unique_by=lambda c: (c[0], c[2]),
    ),
    cut=st.integers(1, 50),
)
def test_any_feed(spark, feed, cut):
    expected, state, delete_wins = replay(feed)
    df = changes(spark, feed)
    once = scd2_apply(empty_history(spark), df, ["id"])
    assert versions(once) == expected
    before = changes(spark, [c for c in feed if c[0] < cut])
    assert versions(scd2_apply(scd2_apply(empty_history(spark), before, ["id"]), df, ["id"], hot_key_rows=3)) == expected
    assert dict(rows(apply_delete_wins(table(spark), df, ["id"]))) == delete_wins
    by_key = {}
    for key, _, current, _, start, end in expected:
        by_key.setdefault(key, []).append((start, end, current))
    for spans in by_key.values():
        spans.sort()
        assert sum(c for _, _, c in spans) <= 1
        assert all(a[1] is not None and a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def hot_feed(spark, n):
    """A third of all changes belong to key 0."""
    return spark.range(0, n, 1, 8).select(
        F.timestamp_seconds(F.col("id") + 1704067200).cast("timestamp_ntz").alias("header__timestamp"),
        F.when(F.col("id") % 7 == 3, "D").otherwise("U").alias("header__change_oper"),
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 1000).cast("int").alias("id"),
        F.col("id").cast("string").alias("name"),
    )


def test_hot_key_is_cut_into_even_parts(spark):
    feed = hot_feed(spark, 30000)
    bounds = hot_key_bounds(feed, ["id"], "header__timestamp", 1000)
    (row,) = bounds.collect()
    assert row["id"] == 0 and sum(len(group) for group in row["__bounds"]) == 10
    split = scd2_apply(empty_history(spark), feed, ["id"], hot_key_rows=1000)
    whole = scd2_apply(empty_history(spark), feed, ["id"], hot_key_rows=None)
    assert versions(split) == versions(whole)
    # The changes are shuffled by key and segment; by key alone would gather the hot key in one task.
    shuffles = [line for line in plan(split).splitlines() if "Exchange hashpartitioning(id" in line]
    assert any("__segment" in line for line in shuffles)


def test_very_hot_key_has_nested_bounds(spark):
    feed = spark.range(0, 30000, 1, 4).select(
        F.timestamp_seconds(F.col("id") + 1704067200).cast("timestamp_ntz").alias("header__timestamp"),
        F.lit("U").alias("header__change_oper"),
        F.when(F.col("id") % 3 == 0, 1).otherwise(0).cast("int").alias("id"),
        F.col("id").cast("string").alias("name"),
    )
    bounds = hot_key_bounds(feed, ["id"], "header__timestamp", 100)
    groups = {r["id"]: [len(g) for g in r["__bounds"]] for r in bounds.collect()}
    assert groups[0][:3] == [64, 64, 64] and 190 <= sum(groups[0]) <= 200
    assert 90 <= sum(groups[1]) <= 110
    split = scd2_apply(empty_history(spark), feed, ["id"], hot_key_rows=100)
    whole = scd2_apply(empty_history(spark), feed, ["id"], hot_key_rows=None)
    assert split.exceptAll(whole).count() == 0 and split.count() == whole.count() == 30000


def test_sequence_text_is_cut_like_a_time(spark):
    feed = changes(spark, SCENARIO).withColumn("header__seq", F.date_format("header__timestamp", "yyyyMMddHHmmss"))
    assert hot_key_bounds(feed, ["id"], "header__seq", 1).count() == 3
    result = scd2_apply(empty_history(spark), feed, ["id"], order_by=["header__seq"], hot_key_rows=1)
    assert set(versions(result)) == SCENARIO_HISTORY


def test_hot_keys_ordered_by_text_have_no_large_segment(spark):
    """A sample of 512 rows a segment, sorted, keeps every segment below the limit; only ties stay together."""
    feed = spark.range(0, 60000, 1, 4).select(
        F.lit("U").alias("header__change_oper"),
        F.expr("timestamp_seconds(1704067200 + id)").cast("timestamp_ntz").alias("header__timestamp"),
        F.date_format(F.timestamp_seconds(F.col("id") + 1704067200), "yyyyMMddHHmmss").alias("header__seq"),
        F.when(F.col("id") % 3 == 0, 1).otherwise(0).cast("int").alias("id"),
        F.col("id").cast("string").alias("name"),
    )
    for limit in (300, 4096):
        bounds = hot_key_bounds(feed, ["id"], ["header__seq", "header__timestamp"], limit)
        cuts = {r["id"]: [b["r0"] for group in r["__bounds"] for b in group] for r in bounds.collect()}
        for key, rows in ((0, 40000), (1, 20000)):
            texts = sorted(r["header__seq"] for r in feed.where(F.col("id") == key).select("header__seq").collect())
            ends = [bisect.bisect_right(texts, c) for c in cuts[key]] + [rows]
            assert max(b - a for a, b in zip([0, *ends], ends)) <= limit
    split = scd2_apply(empty_history(spark), feed, ["id"], order_by=["header__seq"], hot_key_rows=300)
    whole = scd2_apply(empty_history(spark), feed, ["id"], order_by=["header__seq"], hot_key_rows=None)
    assert split.exceptAll(whole).count() == 0 and split.count() == whole.count() == 60000


def test_many_hot_keys(spark):
    """Twelve hundred keys over the limit, each cut into parts."""
    feed = spark.range(0, 1200 * 12, 1, 4).select(
        F.timestamp_seconds(F.col("id") + 1704067200).cast("timestamp_ntz").alias("header__timestamp"),
        F.when(F.col("id") % 5 == 4, "D").otherwise("U").alias("header__change_oper"),
        (F.col("id") % 1200).cast("int").alias("id"),
        F.col("id").cast("string").alias("name"),
    )
    bounds = hot_key_bounds(feed, ["id"], "header__timestamp", 4)
    assert {sum(map(len, r["__bounds"])) for r in bounds.collect()} == {3} and bounds.count() == 1200
    split = scd2_apply(empty_history(spark), feed, ["id"], hot_key_rows=4)
    assert versions(split) == versions(scd2_apply(empty_history(spark), feed, ["id"], hot_key_rows=None))


EQUAL_TIMES = [[(1, "I", 1, "a"), (2, "U", 1, "b"), (2, "I", 2, "x"), (3, "I", 3, "p"), (4, "D", 3, "p")], [(2, "U", 1, "c"), (2, "D", 2, "x"), (4, "I", 3, "q")], [(2, "U", 1, "a"), (2, "I", 2, "y")]]


@pytest.mark.parametrize("options", VARIANTS)
def test_changes_of_one_time_in_several_batches(spark, options):
    """None is lost, and batches that come again add nothing."""
    history = empty_history(spark)
    for k, batch in enumerate(EQUAL_TIMES):
        feed = changes(spark, batch)
        assert late_changes(history, feed, ["id"]).count() == 0
        history = spark.createDataFrame(scd2_apply(history, feed, ["id"], **options).collect(), history.schema)
        for old in EQUAL_TIMES[: k + 1]:
            assert late_changes(history, changes(spark, old), ["id"]).count() == len(old)
            assert versions(scd2_apply(history, changes(spark, old), ["id"], **options)) == versions(history)
    assert versions(history) == sorted(
        [
            (1, "a", False, False, 1, 2), (1, "b", False, False, 2, 2), (1, "c", False, False, 2, 2), (1, "a", True, False, 2, None),
            (2, "x", False, True, 2, 2), (2, "y", True, False, 2, None), (3, "p", False, True, 3, 4), (3, "q", True, False, 4, None),
        ],
        key=repr,
    )


@pytest.mark.parametrize("ordered", [True, False])
@pytest.mark.parametrize("options", VARIANTS)
def test_order_columns_of_a_history(spark, ordered, options):
    """A sequence tells changes of one time apart; a history that does not keep it still loses none."""
    ddl = "header__timestamp timestamp_ntz, header__change_oper string, id int, name string, header__seq int"
    by = ["header__timestamp", "header__seq"]
    first = changes(spark, [(1, "I", 1, "a", 1), (2, "U", 1, "b", 5)], ddl)
    schema = history_schema(table(spark).schema, "timestamp_ntz", feed_order(first, by) if ordered else None)
    history = spark.createDataFrame([], schema)
    step = lambda h, feed: spark.createDataFrame(scd2_apply(h, feed, ["id"], order_by=by, **options).collect(), schema)
    history = step(history, first)
    later = changes(spark, [(2, "U", 1, "earlier", 4), (2, "U", 1, "b", 6), (2, "U", 1, "b", 5)], ddl)
    names = [r["name"] for r in late_changes(history, later, ["id"], by).collect()]
    result = step(history, later)
    if ordered:
        assert sorted(names) == ["b", "earlier"]
        assert versions(result) == [(1, "a", False, False, 1, 2), (1, "b", False, False, 2, 2), (1, "b", True, False, 2, None)]
        assert {r["effective_order"]["header__seq"] for r in result.collect()} == {1, 5, 6}
    else:
        assert names == ["b", "b"]  # equal to what the history holds, as far as it can tell
        assert len(versions(result)) == 3
    assert late_changes(result, later, ["id"], by).count() == 3
    assert versions(step(result, later)) == versions(result)


@pytest.mark.parametrize("options", VARIANTS)
def test_columns_that_the_feed_lacks(spark, options):
    ddl = "id int, name string, note string, current boolean, deleted boolean, effective_date timestamp_ntz, end_date timestamp_ntz"
    base = [(1, "a", "one", True, False, at(0), None), (2, "b", "two", True, False, at(0), None), (3, "c", "three", True, False, at(0), None), (None, "n", "null", True, False, at(0), None)]
    feed = [(1, "U", 1, "a1"), (2, "U", 1, "a2"), (3, "D", 2, "b"), (4, "I", 2, "b2"), (5, "U", 2, "b3"), (6, "I", 4, "d"), (7, "U", None, "m")]
    result = scd2_apply(spark.createDataFrame(base, ddl), changes(spark, feed), ["id"], **options)
    assert versions(result) == sorted(
        [
            (1, "a", "one", False, False, 0, 1), (1, "a1", "one", False, False, 1, 2), (1, "a2", "one", True, False, 2, None),
            (2, "b", "two", False, True, 0, 3), (2, "b2", None, False, False, 4, 5), (2, "b3", None, True, False, 5, None),
            (3, "c", "three", True, False, 0, None), (4, "d", None, True, False, 6, None),
            (None, "n", "null", True, False, 0, None), (None, "m", None, True, False, 7, None),
        ],
        key=repr,
    )
    phased = scd2_apply(spark.createDataFrame(base, ddl), changes(spark, [(1, "U", 1, "a1")]), ["id"], order="op_phase")
    assert (1, "a1", None, True, False, 1, None) in versions(phased)


def test_small_batch_leaves_open_versions_unshuffled(spark, tmp_path):
    base = initial_history(
        spark.range(5000).selectExpr("cast(id as int) id", "cast(id as string) name"),
        F.lit("2023-01-01").cast("timestamp_ntz"),
    )
    base.write.partitionBy("current").parquet(str(tmp_path / "h"))
    history = spark.read.parquet(str(tmp_path / "h")).withColumn("current", F.col("current").cast("boolean"))
    changes(spark, SCENARIO).write.parquet(str(tmp_path / "c"))
    text = plan(scd2_apply(history, spark.read.parquet(str(tmp_path / "c")), ["id"]))
    anti = text[text.index("LeftAnti") :]
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text
    assert "Exchange hashpartitioning" not in anti[: anti.index("BroadcastExchange")]
    assert "PartitionFilters: [cast(current" in text or "PartitionFilters: [isnotnull(current" in text
    assert "Python" not in text


def test_versions_follow_each_other(spark):
    history = scd2_apply(empty_history(spark), hot_feed(spark, 3000), ["id"], hot_key_rows=100)
    spans = {}
    for r in history.collect():
        spans.setdefault(r["id"], []).append((seconds(r["effective_date"]), seconds(r["end_date"])))
    for parts in spans.values():
        parts.sort()
        assert all(a[1] is not None and a[1] <= b[0] for a, b in zip(parts, parts[1:]))


def test_hot_key_without_any_time(spark):
    """A key over the limit whose changes have no time is one segment, not an error."""
    feed = changes(spark, [(None, "U", 1, f"name {i}") for i in range(40)])
    assert hot_key_bounds(feed, ["id"], "header__timestamp", 10).first()["__bounds"] == []


def test_late_changes_shuffle_the_feed_only_where_needed(spark):
    first = [(5, "I", 1, "a"), (3, "I", 2, "b"), (5, "D", 2, None)]
    history = scd2_apply(empty_history(spark), changes(spark, first), ["id"])
    late = [(4, "U", 1, "older"), (4, "U", 1, "older"), (5, "U", 1, "a"), (5, "D", 2, None), (4, "U", 2, "older, too")]
    new = [(5, "U", 1, "same time"), (6, "U", 1, "new"), (6, "U", 2, "new"), (1, "U", 3, "no history"), (1, "U", None, "no key")]
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = late_changes(history, changes(spark, late + new), ["id"])
        assert sorted((r["id"], r["name"] or "") for r in found.collect()) == sorted((c[2], c[3] or "") for c in late)
        # History and feed are each dealt out by key once, and only changes that may be late a second time.
        stored = spark.createDataFrame(history.collect(), history.schema)
        shuffles = plan(late_changes(stored, changes(spark, late + new), ["id"])).count("Exchange hashpartitioning")
        assert shuffles <= 5
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
