"""Slowly changing dimension, type 2: every version of a row with its validity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window, functions as F, types as T

from ..functions.columns import (
    broadcastable,
    check_keys,
    has_null,
    is_change,
    is_delete,
    order_columns,
    table_columns,
)
from ..functions.contract import (
    CHANGE_OPERATION,
    CHANGE_TIMESTAMP,
    DELETE,
    HISTORY_COLUMNS,
    HISTORY_ORDER_COLUMNS,
    INSERT,
    UPDATE,
)
from .compact import DELETED

_TIME = "__time"
_ORDER = "__order"
_KIND = "__kind"
_MARK, _VERSION, _CHANGE = 0, 1, 2
_KNOWN = "__known"
_SEGMENT = "__segment"
_BOUNDS = "__bounds"
_NEWEST = "__newest"
_NEXT = "__next"
_EXTRA = "__extra"

_SAMPLED = 512  # rows of a segment that are looked at to cut it
_MARGIN = 0.75  # segments are cut smaller by this, as a sample does not tell their size exactly
_BOUND_GROUP = 64
_NULL_KEY_SEGMENTS = 1024


def history_schema(
    table_schema: T.StructType, timestamp_type: str = "timestamp", order: T.StructType | None = None
) -> T.StructType:
    """Schema of the history of a table.

    `order` has the feed's order columns other than the change time. A history that keeps
    them tells changes of one time apart by them, also over several batches.
    """
    names = HISTORY_COLUMNS + (HISTORY_ORDER_COLUMNS if order else ())
    taken = [c for c in names if c in table_schema.names]
    if taken:
        raise ValueError(f"table columns collide with history columns: {taken}")
    time = T.DataType.fromDDL(timestamp_type)
    current, deleted, effective, end = HISTORY_COLUMNS
    return T.StructType(
        table_schema.fields
        + [
            T.StructField(current, T.BooleanType(), False),
            T.StructField(deleted, T.BooleanType(), False),
            T.StructField(effective, time, True),
            T.StructField(end, time, True),
        ]
        + [T.StructField(c, order, True) for c in HISTORY_ORDER_COLUMNS if order]
    )


def feed_order(changes: DataFrame, order_by: Sequence[str] | None = None) -> T.StructType | None:
    """The order columns of a feed other than the change time; None if there are none."""
    fields = [changes.schema[c] for c in order_columns(changes, order_by) if c != CHANGE_TIMESTAMP]
    return T.StructType([T.StructField(f.name, f.dataType) for f in fields]) if fields else None


def initial_history(df: DataFrame, effective: Column, order: T.StructType | None = None) -> DataFrame:
    """A full load as first versions, all current. `order` as for `history_schema`."""
    schema = history_schema(df.schema, order=order)
    ends = F.lit(None).cast(df.select(effective.alias("t")).schema["t"].dataType)
    first = df.select(
        "*",
        F.lit(True).alias("current"),
        F.lit(False).alias("deleted"),
        effective.alias("effective_date"),
        ends.alias("end_date"),
    )
    return first.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields[len(first.columns) :]])


def current_rows(history: DataFrame) -> DataFrame:
    """The table's present state."""
    return history.where("current").drop(*HISTORY_COLUMNS, *HISTORY_ORDER_COLUMNS)


def as_of(history: DataFrame, moment) -> DataFrame:
    """The table's state at a moment: versions in effect then."""
    at = F.lit(moment).cast(history.schema["effective_date"].dataType)
    in_effect = (F.col("effective_date") <= at) & (F.col("end_date").isNull() | (F.col("end_date") > at))
    return history.where(in_effect).drop(*HISTORY_COLUMNS, *HISTORY_ORDER_COLUMNS)


class _Ranks:
    """How far a history is: what it keeps of the order of its changes.

    `times` are the feed's order columns; `kept` those that history versions have, too: all
    of them if the history has them in its order columns, else the change time.
    """

    def __init__(self, history: DataFrame, changes: DataFrame, order_by: Sequence[str] | None):
        self.times = order_columns(changes, order_by)
        self.by = [c for c in self.times if c != CHANGE_TIMESTAMP]
        self.types = {f.name: f.dataType for f in history.schema.fields}
        order = self.types.get(HISTORY_ORDER_COLUMNS[0])
        self.ordered = order is not None
        self.order_type = order if self.ordered else T.StructType([T.StructField(c, changes.schema[c].dataType) for c in self.by])
        missing = [c for c in self.by if c not in self.order_type.names]
        self.kept = [CHANGE_TIMESTAMP] if missing or not self.ordered else self.times
        self.whole = self.kept == self.times

    def rank(self, time: Column, order: Column, columns: Sequence[str] | None = None) -> Column:
        """A change's or version's place; a single column where that is all there is, as this is faster."""
        parts = [time if c == CHANGE_TIMESTAMP else order[c] for c in (self.kept if columns is None else columns)]
        return parts[0] if len(parts) == 1 else F.struct(*[p.alias(f"r{i}") for i, p in enumerate(parts)])

    def order_of(self) -> Column:
        """The further order columns of a change as a struct, of the history's type."""
        there = lambda f: F.col(f.name) if f.name in self.by else F.lit(None)
        fields = [there(f).cast(f.dataType).alias(f.name) for f in self.order_type.fields]
        return F.struct(*fields) if fields else F.lit(None).cast("string")

    def stored(self, at: str) -> Column:
        """A history's order column, or nothing in its place."""
        return F.col(at) if self.ordered else F.lit(None).cast(self.order_type if self.order_type.fields else "string")


def _holders(history: DataFrame) -> DataFrame:
    """Versions among which are all that a key's newest changes began or ended.

    A version that was closed by an update has a successor that begins then.
    """
    return history.where("current OR deleted OR end_date IS NULL OR end_date <= effective_date")


def _newest(holders: DataFrame, keys: Sequence[str], ranks: _Ranks) -> DataFrame:
    """Per key the place of the last change that its history holds."""
    begun = ranks.rank(F.col("effective_date"), ranks.stored(HISTORY_ORDER_COLUMNS[0]))
    ended = ranks.rank(F.col("end_date"), ranks.stored(HISTORY_ORDER_COLUMNS[1]))
    last = F.greatest(F.when(F.col("effective_date").isNotNull(), begun), F.when(F.col("end_date").isNotNull(), ended))
    return holders.groupBy(*keys).agg(F.max(last).alias(_NEWEST))


def _known(holders: DataFrame, keys: Sequence[str], payload: Sequence[str], ranks: _Ranks) -> DataFrame:
    """The changes that can be read off these versions: keys, payload (null for deletes), time, order, deleted."""
    held = holders.where(~has_null(keys))
    begun = held.select(
        *keys, *payload, F.col("effective_date").alias(_TIME), ranks.stored(HISTORY_ORDER_COLUMNS[0]).alias(_ORDER), F.lit(False).alias(DELETED)
    )
    ended = held.where("deleted").select(
        *keys,
        *[F.lit(None).cast(ranks.types[c]).alias(c) for c in payload],
        F.col("end_date").alias(_TIME),
        ranks.stored(HISTORY_ORDER_COLUMNS[1]).alias(_ORDER),
        F.lit(True).alias(DELETED),
    )
    return begun.unionByName(ended)


def _identity(payload: Sequence[str], rank: Column) -> Column:
    """Equal for two sights of one change. A history does not tell what a delete carried."""
    return F.struct(rank.alias("rank"), DELETED, *[F.when(~F.col(DELETED), F.col(c)).alias(f"p{i}") for i, c in enumerate(payload)])


def _may_be_new(rank: Column, newest: Column) -> Column:
    """The key has no history, or none newer than this change. A change without a time is the oldest."""
    return newest.isNull() | F.coalesce(rank >= newest, F.lit(False))


def _typed(changes: DataFrame, ranks: _Ranks, *also: str) -> DataFrame:
    """Changes in the history's types: table columns, time, order, deleted."""
    return changes.select(
        *also,
        *[F.col(c).cast(ranks.types[c]).alias(c) for c in table_columns(changes) if c not in also],
        F.col(CHANGE_TIMESTAMP).cast(ranks.types["effective_date"]).alias(_TIME),
        ranks.order_of().alias(_ORDER),
        is_delete().alias(DELETED),
    )


def _flag_late(history: DataFrame, changes: DataFrame, keys: list[str], ranks: _Ranks, only: bool = False) -> DataFrame:
    """Changes with `__late`: older than their key's history, or in it already. Joins by key.

    `only`: without the changes that are newer than their key's history or have none, of
    which none is late. Only columns of the feed go through the joins; what is compared is
    worked out beside them.
    """
    payload = [c for c in table_columns(changes) if c not in keys]
    if broadcastable(changes.select(*keys)):
        history = history.join(changes.select(*keys).distinct(), keys, "left_semi")
    holders = _holders(history)
    names = [f"__key{i}" for i in range(len(keys))]
    key_names = [F.col(k).alias(n) for k, n in zip(keys, names)]
    same = F.lit(True)
    for k, n in zip(keys, names):
        same = same & (F.col(k).cast(ranks.types[k]) == F.col(n))
    rank = ranks.rank(F.col(CHANGE_TIMESTAMP).cast(ranks.types["effective_date"]), ranks.order_of())
    newest = _newest(holders, keys, ranks).select(*key_names, _NEWEST)
    older = ~_may_be_new(rank, F.col(_NEWEST))
    placed = changes.join(newest, same, "inner" if only else "left")
    if only:
        placed = placed.where(F.col(_NEWEST).isNull() | ~F.coalesce(rank > F.col(_NEWEST), F.lit(False)))
    placed = placed.select(*changes.columns, older.alias("__older"))
    held_rank = ranks.rank(F.col(_TIME), F.col(_ORDER))
    seen = _known(holders, keys, payload, ranks).select(*key_names, _identity(payload, held_rank).alias(_KNOWN)).distinct()
    values = [F.when(~is_delete(), F.col(c).cast(ranks.types[c])).alias(f"p{i}") for i, c in enumerate(payload)]
    identity = F.struct(rank.alias("rank"), is_delete().alias(DELETED), *values)
    marked = placed.join(seen, same & identity.eqNullSafe(F.col(_KNOWN)), "left")
    return marked.select(*changes.columns, (F.col("__older") | F.col(_KNOWN).isNotNull()).alias("__late"))


def late_changes(
    history: DataFrame, changes: DataFrame, keys: Sequence[str], order_by: Sequence[str] | None = None
) -> DataFrame:
    """Changes that `scd2_apply` leaves out: older than their key's history, or already in it."""
    ranks = _Ranks(history, changes, order_by)
    return _flag_late(history, changes.where(is_change()), list(keys), ranks, only=True).where("__late").drop("__late")


def hot_key_bounds(changes: DataFrame, keys: Sequence[str], order: str | Sequence[str], max_rows: int) -> DataFrame | None:
    """Keys with more than `max_rows` changes, each with places that cut them into parts of at most so many.

    `order` may have columns of any type that sorts, text included: the places are taken
    from a sample of each key's rows by hash, sorted, or from all rows where `max_rows` is
    small. Only rows with equal order columns are never cut apart. The places are nested in
    groups of 64, so that finding a row's part takes few comparisons. The keys stay a
    DataFrame, held by the executors; Spark broadcasts it while it is small enough. None if
    no key is hot.
    """
    keys, order = list(keys), [order] if isinstance(order, str) else list(order)
    place = F.struct(*[F.col(c).alias(f"r{i}") for i, c in enumerate(order)])
    hashed = F.xxhash64(*changes.columns)
    rows = changes.where(~has_null(keys)).select(*keys, place.alias("place"), hashed.alias("hash"))
    hot = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_rows).select(*keys).persist()
    if hot.isEmpty():
        hot.unpersist()
        return None
    step = max(1, max_rows // _SAMPLED)
    every = max_rows if step == 1 else int(_SAMPLED * _MARGIN)
    sampled = rows.where((F.pmod("hash", F.lit(step)) == 0) & F.col("place.r0").isNotNull()).join(hot, keys, "left_semi")
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("place"))
    cuts = sampled.withColumn("nth", nth).where(F.col("nth") % every == 0).groupBy(*keys)
    cuts = cuts.agg(F.array_sort(F.collect_set("place")).alias("cuts"))
    groups = F.transform(
        F.sequence(F.lit(0), F.ceil(F.size("cuts") / _BOUND_GROUP).cast("int") - 1),
        lambda i: F.slice("cuts", i * _BOUND_GROUP + 1, F.lit(_BOUND_GROUP)),
    )
    none = F.lit(None).cast(T.ArrayType(T.ArrayType(cuts.schema["cuts"].dataType.elementType)))
    found = hot.join(cuts, keys, "left").select(*keys, F.when(F.size("cuts") > 0, groups).otherwise(none).alias(_BOUNDS))
    nothing = F.array().cast(found.schema[_BOUNDS].dataType)
    return found.withColumn(_BOUNDS, F.coalesce(_BOUNDS, nothing)).persist()


def _part(place: Column) -> Column:
    """A place's segment, rising with it: groups that end before it, then bounds in the next group."""
    whole = F.size(F.filter(_BOUNDS, lambda group: F.element_at(group, -1) < place))
    group = F.get(_BOUNDS, whole)
    within = F.coalesce(F.size(F.filter(group, lambda bound: bound < place)), F.lit(0))
    return whole * _BOUND_GROUP + within


def _segment(df: DataFrame, keys: list[str], hot: DataFrame | None, places: Sequence[Column]) -> DataFrame:
    """Rows with a segment number that rises with their place in the order.

    Only hot keys have more than one segment. A row with a null key gets one of many, as
    such rows never meet.
    """
    spread = -1 - F.pmod(F.xxhash64(*df.columns), F.lit(_NULL_KEY_SEGMENTS)).cast("int")
    if hot is None:
        return df.withColumn(_SEGMENT, F.when(has_null(keys), spread).otherwise(0))
    place = F.struct(*[p.alias(f"r{i}") for i, p in enumerate(places)])
    part = F.when(F.col(_BOUNDS).isNull() | places[0].isNull(), 0).otherwise(_part(place))
    bounded = df.withColumn("__spread", spread).join(hot, keys, "left")
    return bounded.withColumn(_SEGMENT, F.when(has_null(keys), F.col("__spread")).otherwise(part)).drop(_BOUNDS, "__spread")


def _all_segments(df: DataFrame, keys: list[str], hot: DataFrame | None) -> DataFrame:
    """Rows of keys repeated for each of the key's segments."""
    last = F.lit(0)
    if hot is not None:
        df = df.join(hot, keys, "left")
        last = F.coalesce(F.size(_BOUNDS) * _BOUND_GROUP, last)
    return df.withColumn(_SEGMENT, F.explode(F.sequence(F.lit(0), last))).drop(_BOUNDS)


def _segment_seams(rows: DataFrame, keys: list[str], hot: DataFrame, order: list[Column], extra: bool) -> DataFrame:
    """For each segment of a hot key: `seam`, the first new change of a later segment, and what goes before.

    New changes are combined before the shuffle to one row per task and segment, so the
    hot keys' changes are not gathered by key. `carried` is what a version takes over from
    the last open version; null once a delete stands in between.
    """
    names = hot.select(*keys)
    new = rows.where(F.col(_KIND) != _MARK).join(names, keys, "left_semi")
    by = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    change = F.col(_KIND) == _CHANGE
    facts = [F.min_by(F.when(change, F.struct(_TIME, DELETED, _ORDER)), F.when(change, by)).alias("head")]
    if extra:
        facts += [
            F.max(change & F.col(DELETED)).alias("deletes"),
            F.max_by(F.when(~change, F.col(_EXTRA)), F.when(~change, F.struct(_TIME))).alias("opened"),
        ]
    heads = new.groupBy(*keys, _SEGMENT).agg(*facts)
    segments = _all_segments(names, keys, hot).join(heads, [*keys, _SEGMENT], "left")
    in_order = Window.partitionBy(*keys).orderBy(_SEGMENT)
    found = segments.withColumn("seam", F.first("head", ignorenulls=True).over(in_order.rowsBetween(1, Window.unboundedFollowing)))
    if extra:
        before = in_order.rowsBetween(Window.unboundedPreceding, -1)
        deleted = F.coalesce(F.max("deletes").over(before), F.lit(False))
        found = found.withColumn("carried", F.when(~deleted, F.last("opened", ignorenulls=True).over(before)))
    return found.drop("head", "deletes", "opened")


def _event_time(history, changes, keys, order_by, one_pass, hot_key_rows, feed_rows, observation) -> DataFrame:
    columns = table_columns(changes)
    payload = [c for c in columns if c not in keys]
    ranks = _Ranks(history, changes, order_by)
    own = [*columns, *HISTORY_COLUMNS, *HISTORY_ORDER_COLUMNS]
    extra = [c for c in history.columns if c not in own]
    changes = changes.where(is_change())
    if one_pass is None:
        one_pass = not broadcastable(changes.select(*keys))
    if not ranks.whole:  # the history does not know the whole order of its changes: late ones go by a join
        flagged = _flag_late(history, changes, keys, ranks)
        if observation is not None:
            flagged = flagged.observe(observation, F.count_if("__late").alias("late"))
        changes = flagged.where("NOT __late").drop("__late")
    hot = None
    if hot_key_rows is not None:
        if feed_rows is None:
            feed_rows = changes.count()
        if feed_rows > hot_key_rows:
            hot = hot_key_bounds(changes, keys, ranks.times, hot_key_rows)

    open_versions = history.where("current")
    if one_pass:
        untouched, touched_open, holders = None, open_versions, _holders(history)
    else:
        changed_keys = changes.select(*keys).distinct()
        untouched = open_versions.join(changed_keys, keys, "left_anti")
        touched_open = open_versions.join(changed_keys, keys, "left_semi")
        holders = _holders(history).join(changed_keys, keys, "left_semi")

    # Four kinds of rows meet in one shuffle and sort by key: a mark with the newest place
    # the history knows, open versions, changes that the history holds, and new ones.
    typed = _typed(changes, ranks).withColumn(_KNOWN, F.lit(False))
    in_order = [F.col(_TIME) if c == CHANGE_TIMESTAMP else F.col(_ORDER)[c] for c in ranks.times]
    opened = touched_open.select(
        *columns, F.col("effective_date").alias(_TIME), ranks.stored(HISTORY_ORDER_COLUMNS[0]).alias(_ORDER), F.lit(False).alias(DELETED), F.lit(False).alias(_KNOWN),
        *([F.struct(*extra).alias(_EXTRA)] if extra else []),
    )
    parts = [
        _segment(opened, keys, None, in_order).withColumn(_KIND, F.lit(_VERSION)),
        _segment(typed, keys, hot, in_order).withColumn(_KIND, F.lit(_CHANGE)),
    ]
    if ranks.whole:
        newest = _newest(holders, keys, ranks)
        marks = _all_segments(newest, keys, hot).withColumn(_KIND, F.lit(_MARK))
        known = _known(holders, keys, payload, ranks).withColumn(_KNOWN, F.lit(True))
        parts += [marks, _segment(known, keys, hot, in_order).withColumn(_KIND, F.lit(_CHANGE))]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)

    # Changes of one time: a delete comes last. Versions that are open together: oldest first.
    change_order = [*in_order, F.col(DELETED), *[F.col(c) for c in payload]]
    order = [F.col(_KIND), F.when(F.col(_KIND) == _VERSION, F.col(_TIME)), *change_order, ~F.col(_KNOWN)]
    if ranks.times[0] == CHANGE_TIMESTAMP:
        order.pop(1)
    window = Window.partitionBy(*keys, _SEGMENT).orderBy(*order)
    so_far = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if ranks.whole:
        rank = ranks.rank(F.col(_TIME), F.col(_ORDER))
        identity = _identity(payload, rank)
        rows = rows.withColumns(
            {
                _NEWEST: F.max(_NEWEST).over(so_far),
                "__seen": F.last(F.when(F.col(_KNOWN), identity), ignorenulls=True).over(so_far),
            }
        )
        late = ~has_null(keys) & (~_may_be_new(rank, F.col(_NEWEST)) | F.col("__seen").eqNullSafe(identity))
        change = (F.col(_KIND) == _CHANGE) & ~F.col(_KNOWN)
        if observation is not None:
            rows = rows.observe(observation, F.count_if(change & late).alias("late"))
        rows = rows.where((F.col(_KIND) == _VERSION) | (change & ~late)).drop(_NEWEST, "__seen")

    following = F.when(~has_null(keys), F.lead(F.struct(_TIME, DELETED, _ORDER)).over(window))
    # A version of a key without new changes stays as it is, also beside others that are open.
    any_change = F.max(F.col(_KIND) == _CHANGE).over(Window.partitionBy(*keys, _SEGMENT))
    found = rows.withColumns({_NEXT: following, "__goes_on": any_change})
    carrier = F.when((F.col(_KIND) == _VERSION) | F.col(DELETED), F.struct(F.when(~F.col(DELETED), F.col(_EXTRA)).alias("x"))) if extra else None
    if extra:
        found = found.withColumn("__carrier", F.when(~has_null(keys) | (F.col(_KIND) == _VERSION), F.last(carrier, ignorenulls=True).over(so_far)))
    if hot is not None:
        seams = _segment_seams(rows, keys, hot, change_order, bool(extra))
        found = found.join(seams, [*keys, _SEGMENT], "left").withColumns(
            {_NEXT: F.coalesce(_NEXT, "seam"), "__goes_on": F.col("__goes_on") | F.col("seam").isNotNull()}
        )
        if extra:
            found = found.withColumn("__carrier", F.coalesce("__carrier", F.struct(F.col("carried").alias("x"))))
    found = found.withColumn(_NEXT, F.when(F.col("__goes_on"), F.col(_NEXT)))
    result = {
        "current": F.col(_NEXT).isNull(),
        "deleted": F.coalesce(F.col(_NEXT)[DELETED], F.lit(False)),
        "effective_date": F.col(_TIME),
        "end_date": F.col(_NEXT)[_TIME],
    }
    if ranks.ordered:
        result |= {HISTORY_ORDER_COLUMNS[0]: F.col(_ORDER), HISTORY_ORDER_COLUMNS[1]: F.col(_NEXT)[_ORDER]}
    result |= {c: F.col("__carrier")["x"][c] for c in extra}
    versions = found.where(~F.col(DELETED)).select(*[result[c].alias(c) if c in result else F.col(c) for c in history.columns])
    return versions if untouched is None else versions.unionByName(untouched)


def _op_phase(history, changes, keys, hot_key_rows, feed_rows) -> DataFrame:
    columns = table_columns(changes)
    types = {f.name: f.dataType for f in history.schema.fields}
    time = F.col(CHANGE_TIMESTAMP).cast(types["effective_date"])
    changes = changes.where(is_change())

    def single(op: str) -> Column:
        n = F.count_if(F.col(CHANGE_OPERATION) == op)
        error = F.raise_error(F.lit(f"more than one {op} for a key in one batch: use order='event_time'"))
        return F.when(n > 1, error.cast(types["effective_date"])).otherwise(
            F.max(F.when(F.col(CHANGE_OPERATION) == op, time))
        )

    # One row per key, combined before the shuffle: when its versions close.
    by_key = changes.where(~has_null(keys)).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__rows"), single(UPDATE).alias("__updated"), single(DELETE).alias("__deleted_at")
    )
    closed_at = by_key.where("__updated IS NOT NULL OR __deleted_at IS NOT NULL").drop("__rows")
    appended = changes.where(F.col(CHANGE_OPERATION) != DELETE).select(
        *[F.col(c).cast(types[c]).alias(c) for c in columns],
        F.lit(True).alias("current"),
        F.lit(False).alias("deleted"),
        time.alias("effective_date"),
        F.lit(None).cast(types["end_date"]).alias("end_date"),
        (F.col(CHANGE_OPERATION) == UPDATE).alias("__update"),
    )
    present = history.where("current").withColumn("__update", F.lit(False))
    rows = present.unionByName(appended, allowMissingColumns=True)

    hot = None
    if hot_key_rows is not None:
        if feed_rows is None:
            feed_rows = changes.count()
        if feed_rows > hot_key_rows:
            hot = by_key.where(F.col("__rows") > hot_key_rows).drop("__rows").persist()
            if hot.isEmpty():
                hot.unpersist()
                hot = None
    null_key = has_null(keys)
    keyed = rows.where(~null_key)
    # Rows of hot keys meet the few rows that close them without being gathered by key; null keys meet none.
    closing = [F.lit(None).cast(types["effective_date"]).alias(c) for c in ("__updated", "__deleted_at")]
    parts = [rows.where(null_key).select("*", *closing)]
    if hot is not None:
        parts.append(keyed.join(hot, keys))
        keyed = keyed.join(hot.select(*keys), keys, "left_anti")
        closed_at = closed_at.join(hot.select(*keys), keys, "left_anti")
    joined = keyed.join(closed_at, keys, "left")
    for part in parts:
        joined = joined.unionByName(part)
    # An update closes what was there before it; a delete closes what is open after that.
    by_update = ~F.col("__update") & F.col("__updated").isNotNull()
    by_delete = ~by_update & F.col("__deleted_at").isNotNull()
    versions = joined.withColumns(
        {
            "current": ~(by_update | by_delete),
            "deleted": by_delete | F.col("deleted"),
            "end_date": F.when(by_update, F.col("__updated"))
            .when(by_delete, F.col("__deleted_at"))
            .otherwise(F.col("end_date")),
        }
    )
    return versions.select(*history.columns)


def scd2_versions(
    history: DataFrame,
    changes: DataFrame,
    keys: Sequence[str],
    order: str = "event_time",
    order_by: Sequence[str] | None = None,
    one_pass: bool | None = None,
    hot_key_rows: int | None = 1_000_000,
    feed_rows: int | None = None,
    observation: Observation | None = None,
) -> DataFrame:
    """What a batch of changes makes of a history, without the versions closed before.

    Those never change again: a history that is stored by `current` keeps their files and
    needs only these rows written.

    `event_time`: changes take effect in time order. Each insert or update starts a
    version that ends at the key's next change, deleted if that is a delete. Changes older
    than the newest that the key's history holds, and those that it holds already, are left
    out (`late_changes` lists them), so applying a batch again changes nothing. A change of
    the newest one's time that the history does not hold comes after it. Times are compared
    with all order columns that the history keeps (`history_schema`), a delete by these
    alone.

    Columns that the feed lacks: open and closed versions keep theirs. A new version takes
    over those of the version before it; after a delete, or as a key's first, it has nulls.

    `op_phase`: all inserts, then all updates, then all deletes; at most one update and
    one delete per key in a batch. Applying a batch again appends its versions again.
    Columns that the feed lacks are null in new versions.

    Open versions without changes pass an anti join and are not shuffled while the
    changed keys are small enough to broadcast; `one_pass` is for batches beyond that:
    all open versions meet the changes in one shuffle. By default the planner's estimate of
    the keys' size decides. `observation` gets the number of changes left out, as `late`. A key with more than
    `hot_key_rows` changes is cut by its order columns into parts that are worked on apart
    and joined at the seams; the search for such keys is left out if the whole feed
    (`feed_rows`, counted if not given) is no larger.
    """
    keys = check_keys(changes, keys)
    if order == "event_time":
        return _event_time(history, changes, keys, order_by, one_pass, hot_key_rows, feed_rows, observation)
    if order == "op_phase":
        return _op_phase(history, changes, keys, hot_key_rows, feed_rows)
    raise ValueError(f"unknown order {order!r}")


def scd2_apply(history: DataFrame, changes: DataFrame, keys: Sequence[str], **options) -> DataFrame:
    """The whole history after a batch of changes; options as for `scd2_versions`."""
    closed = history.where(~F.col("current"))
    return closed.unionByName(scd2_versions(history, changes, keys, **options))
