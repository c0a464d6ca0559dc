"""Places of rows in an order, group by group, without a task that sees a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .common import stored


def positions(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """`rows`, stored, with `pos` (the place in its group, from 0) and `n` (the group's rows).

    Rows are dealt out by ranges of group and order, so a large group takes many tasks.
    Counts of each task and group then tell where a task's rows of the group begin. A null
    group is not allowed; nulls in `order` come first. Equal rows stand in any order, which
    is fixed by storing them.
    """
    dealt = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    placed = stored(dealt.withColumn("__id", F.monotonically_increasing_id()))
    placed = placed.withColumn("__task", F.shiftright("__id", 33))
    chunks = placed.groupBy("__task", group).agg(F.min("__id").alias("__first"), F.count("*").alias("__rows"))
    of_group = Window.partitionBy(group)
    before = F.sum("__rows").over(of_group.orderBy("__task").rowsBetween(Window.unboundedPreceding, -1))
    begun = chunks.select(
        "__task",
        group,
        (F.coalesce(before, F.lit(0)) - F.col("__first")).alias("__shift"),
        F.sum("__rows").over(of_group).alias("n"),
    )
    found = placed.join(begun, ["__task", group])
    return stored(found.withColumn("pos", F.col("__id") + F.col("__shift")).select(*rows.columns, "pos", "n"))
