"""Changes applied to a table that holds one row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, functions as F

from ..functions.columns import broadcastable
from .compact import DELETED, compact_changes


def merge_latest(target: DataFrame, latest: DataFrame, keys: Sequence[str], one_pass: bool | None = None) -> DataFrame:
    """The table after one change per key.

    Every row of a matched key is updated or, when deleted, removed, also where the table
    has several; an unmatched key is added unless deleted. A null key matches nothing.
    Target columns the changes do not carry keep their value, or are null in added rows.

    Two plans give the same rows. While the changes are small enough for Spark to
    broadcast, the target is left-joined to them and neither shuffled nor sorted. Beyond
    that size one full outer join reads and shuffles each side once. `one_pass` says which;
    by default the planner's estimate of the changes' size does.
    """
    keys = list(keys)
    if one_pass is None:
        one_pass = not broadcastable(latest)
    values = [c for c in latest.columns if c not in keys and c != DELETED]
    foreign = [c for c in values if c not in target.columns]
    if foreign:
        raise ValueError(f"columns not in the target table: {foreign}")
    types = {f.name: f.dataType for f in target.schema.fields}
    typed = latest.select(*[F.col(c).cast(types[c]).alias(c) for c in [*keys, *values]], DELETED)

    new = "__new"
    changed = typed.select(*keys, DELETED, F.struct(F.lit(True).alias(DELETED), *values).alias(new))
    joined = target.join(changed, keys, "full_outer" if one_pass else "left")
    merged = joined.where(~F.coalesce(F.col(DELETED), F.lit(False))).select(
        *[
            F.when(F.col(new).isNull(), F.col(c)).otherwise(F.col(f"{new}.`{c}`")).alias(c) if c in values else F.col(c)
            for c in target.columns
        ]
    )
    if one_pass:
        return merged
    present = target.select(*keys).join(typed.select(*keys), keys, "left_semi")
    added = typed.where(~F.col(DELETED)).join(present, keys, "left_anti")
    extra = {c: F.lit(None).cast(types[c]) for c in target.columns if c not in values and c not in keys}
    return merged.unionByName(added.withColumns(extra).select(*target.columns))


def _counted(latest: DataFrame, observation: Observation | None) -> DataFrame:
    return latest if observation is None else latest.observe(observation, F.count(F.lit(1)).alias("compacted"))


def apply_latest(
    target: DataFrame,
    changes: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str] | None = None,
    one_pass: bool | None = None,
    observation: Observation | None = None,
) -> DataFrame:
    """Latest change wins: the table after each key's last insert, update or delete.

    `observation` gets the number of changes after compaction, as `compacted`.
    """
    latest = compact_changes(changes, keys, order_by)
    if one_pass is None:
        one_pass = not broadcastable(latest)
    return merge_latest(target, _counted(latest, observation), keys, one_pass)


def apply_delete_wins(
    target: DataFrame,
    changes: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str] | None = None,
    keep_metadata: bool = False,
    one_pass: bool | None = None,
    observation: Observation | None = None,
) -> DataFrame:
    """Upserts first, deletes after: a key with any delete in the batch is gone, whatever its time.

    Equal to writing the latest insert or update of each key and then removing every
    deleted key, in one merge. `keep_metadata` keeps the change columns in the table.
    """
    latest = compact_changes(changes, keys, order_by, delete_wins=True, keep_metadata=keep_metadata)
    if keep_metadata:
        added = [f for f in latest.schema.fields if f.name not in target.columns and f.name != DELETED]
        target = target.withColumns({f.name: F.lit(None).cast(f.dataType) for f in added})
    if one_pass is None:
        one_pass = not broadcastable(latest)
    return merge_latest(target, _counted(latest, observation), keys, one_pass)
