"""Mixing sources to target weights by Pareto order sampling.

Every source has a target number of words. Within a source, a document is wanted a number
of times in proportion to its weight, at most `most` times. The whole part of that number
is allocated for certain. The rest is an inclusion probability, and one further copy goes
to a sample of the documents: each draws a uniform number u, and documents are ranked by
the odds of u divided by the odds of inclusion (Pareto order sampling). The sample is the
first of this order until the source's remaining words are used up. A draw is a hash of
source, id and text; rows equal in all three are numbered, so that each draws for itself.

The order of a source is never sorted as a whole: ranks fall into bins, words are summed
by bin, and only the words before a document within its bin are counted by a window.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import stored, text_or_empty
from .order import positions

WEIGHTS = (5, 2, 1)
MOST = 3
BINS = 4096
WORD = r"[^\x20\x09-\x0D]+"


class Mix(NamedTuple):
    """What decides how often a document is taken: small tables by source."""

    sources: DataFrame  # source, source_size, target
    wanted: DataFrame  # source, boost, whole, odds
    cuts: DataFrame  # source, cut: the last of the order that is still in


def word_count(text: Column) -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("bigint")


def length_boost(size: Column) -> Column:
    """Exponent of two of a document's weight: texts of 16 words and more count double, of 256 and more fourfold."""
    return F.when(size < 16, 0).when(size < 256, 1).otherwise(2)


def _twin() -> Column:
    """Equal for rows of one source, id and text."""
    name = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    text = F.md5(text_or_empty(F.col("text")).cast("binary"))
    return F.md5(F.concat_ws("|", name, F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text).cast("binary"))


def numbered(rows: DataFrame) -> DataFrame:
    """`rows` (with `twin`) and `copy`: a number from 0 among equal rows. Only repeated rows are shuffled for it."""
    repeated = stored(rows.groupBy("twin").agg(F.count("*").alias("rows")).where("rows > 1").select("twin"))
    if repeated.isEmpty():
        return rows.withColumn("copy", F.lit(0).cast("bigint"))
    alone = rows.join(repeated, "twin", "left_anti").withColumn("copy", F.lit(0).cast("bigint"))
    several = rows.join(repeated, "twin", "left_semi").withColumn("__rid", F.monotonically_increasing_id())
    placed = positions(stored(several), "twin", "__rid").withColumnRenamed("pos", "copy").drop("__rid", "n")
    return alone.unionByName(placed)


def _digest(seed: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), F.col("twin"), F.col("copy").cast("string")).cast("binary"))


def _uniform(seed: str) -> Column:
    return (F.conv(F.substring(_digest(seed), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target): all words shared by weight, no target above `most` times its source.

    Weights go to the sources in the order of their names, null last, again and again.
    Sources are filled in the order of limit over weight. One whose limit is below its
    share gets its limit, and what is left is shared by the others. The one window over
    all sources has a row for each source.
    """
    totals = stored(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    named = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(named) - 1) % len(weights)
    weighted = totals.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), turn.cast("int") + 1))
    limit = F.col("source_size") * most
    filling = Window.orderBy(limit / F.col("weight"), F.col("source").asc_nulls_last())
    before, onward = filling.rowsBetween(Window.unboundedPreceding, -1), filling.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum(limit).over(before), F.lit(0))
    share = left.cast("double") / F.sum("weight").over(onward)
    level = weighted.withColumn("share", share).withColumn("full", F.col("share") * F.col("weight") > limit)
    # The share at the first source that is not full holds for all that follow, and is the largest of theirs.
    open_share = F.max(F.when(~F.col("full"), F.col("share"))).over(everything)
    target = F.when(F.col("full"), limit.cast("double")).otherwise(open_share * F.col("weight"))
    return stored(level.select("source", "source_size", target.alias("target")))


def _wanted(sizes: DataFrame, sources: DataFrame, most: int) -> DataFrame:
    """How often a document of each source and weight is taken: for certain, and the odds of once more."""
    classes = sizes.groupBy("source", "boost").agg(F.sum("size").alias("words")).where("words > 0")
    classes = classes.join(sources, classes["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    heaviest = Window.partitionBy("source").orderBy(F.col("boost").desc())
    before, onward = heaviest.rowsBetween(Window.unboundedPreceding, -1), heaviest.rowsBetween(0, Window.unboundedFollowing)
    times = F.pow(F.lit(2.0), F.col("boost"))
    left = F.col("target") - most * F.coalesce(F.sum("words").over(before), F.lit(0))
    rate = left / F.sum(F.col("words") * times).over(onward)
    rated = classes.withColumn("rate", rate).withColumn("full", F.col("rate") * times >= most)
    of_source = Window.partitionBy("source")
    open_rate = F.max(F.when(~F.col("full"), F.col("rate"))).over(of_source)
    copies = F.when(F.col("full"), F.lit(float(most))).otherwise(F.greatest(open_rate * times, F.lit(0.0)))
    chance = F.col("copies") - F.col("whole")
    counted = rated.withColumn("copies", copies).withColumn("whole", F.floor("copies"))
    rest = F.col("target") - F.sum(F.col("whole") * F.col("words")).over(of_source)
    return stored(
        counted.select("source", "boost", "whole", F.when(chance > 0, chance / (1 - chance)).alias("odds"), rest.alias("rest"))
    )


def _with_source(rows: DataFrame, small: DataFrame, *also: str) -> DataFrame:
    on = rows["source"].eqNullSafe(small["source"])
    for c in also:
        on = on & (rows[c] == small[c])
    return rows.join(small, on, "left").drop(small["source"], *[small[c] for c in also])


def _ranked(sizes: DataFrame, wanted: DataFrame, seed: str) -> DataFrame:
    u = _uniform(seed)
    q = u / (1 - u) / F.col("odds")
    return _with_source(sizes, wanted, "boost").withColumn("rank", q / (1 + q))


def _place(seed: str) -> Column:
    """A row's place in the order: by rank, ties by the whole of its draw."""
    return F.struct("rank", _digest(seed).alias("draw"))


def plan_mix(
    sizes: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    most: int = MOST,
    bins: int = BINS,
    seed: str = "mix",
) -> Mix:
    """`sizes` has source, size, boost (exponent of two of a document's weight), twin and copy."""
    sources = source_targets(sizes, weights, most)
    wanted = _wanted(sizes, sources, most)
    ranked = _ranked(sizes, wanted, seed).where("rank IS NOT NULL").withColumn("bin", F.floor(F.col("rank") * bins))
    ranked = ranked.withColumn("place", _place(seed))
    by_bin = ranked.groupBy("source", "bin").agg(F.sum("size").alias("words"), F.max("rest").alias("rest"))
    ordered = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    by_bin = stored(by_bin.withColumn("before", F.coalesce(F.sum("words").over(ordered), F.lit(0))))
    # Bins that fit as a whole end before `rest`; one bin of each source is cut.
    last_whole = by_bin.where("before + words <= rest").groupBy("source").agg(F.max("bin").alias("whole_bin"))
    edge = by_bin.where("before <= rest AND before + words > rest").select("source", "bin", "before")
    inside = ranked.join(edge, ranked["source"].eqNullSafe(edge["source"]) & (ranked["bin"] == edge["bin"]))
    inside = inside.select(ranked["source"], "place", "size", "rest", "before")
    earlier = Window.partitionBy("source").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.col("before") + F.coalesce(F.sum("size").over(earlier), F.lit(0))
    taken = inside.withColumn("ahead", ahead).where(F.col("ahead") + F.col("size") / 2 <= F.col("rest"))
    last = taken.groupBy("source").agg(F.max("place").alias("cut"))
    cuts = sources.select("source")
    cuts = _with_source(_with_source(cuts, last_whole), last)
    end_of_whole = F.struct(((F.col("whole_bin") + 1) / bins).alias("rank"), F.lit("").alias("draw"))
    cut = F.coalesce(F.col("cut"), F.when(F.col("whole_bin").isNotNull(), end_of_whole))
    return Mix(sources, wanted, stored(cuts.select("source", cut.alias("cut"))))


def with_copies(sizes: DataFrame, mix: Mix, seed: str = "mix") -> DataFrame:
    """`sizes` with source_size, target and copies. Joins only tables of a row or a few by source."""
    rows = _with_source(_with_source(_ranked(sizes, mix.wanted, seed), mix.cuts), mix.sources)
    once_more = F.col("rank").isNotNull() & F.col("cut").isNotNull() & (_place(seed) <= F.col("cut"))
    copies = F.coalesce(F.col("whole"), F.lit(0)) + F.when(once_more, 1).otherwise(0)
    return rows.withColumn("copies", copies.cast("bigint")).drop("boost", "whole", "odds", "rest", "rank", "cut", "twin", "copy")


def sized(docs: DataFrame, *also: str) -> DataFrame:
    """doc_id, source, size, boost, twin and copy of every row, and the columns in `also`."""
    rows = docs.select(*also, "doc_id", "source", word_count(F.col("text")).alias("size"), _twin().alias("twin"))
    return numbered(rows.withColumn("boost", length_boost(F.col("size"))))


def mix_sources(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, bins: int = BINS, seed: str = "mix"
) -> DataFrame:
    """How much of every document the mix takes.

    Returns one row per row of `docs`: doc_id, size (words), source_size, target (its
    source's), copies, taken (size times copies). A null text has size 0 and takes
    nothing; a null source is a source, the last one. Rows without doc_id, and repeated
    rows, are drawn one by one: of equal rows as many are taken on every run, no matter
    which. A source with no words has target 0. An empty table gives an empty result. Other
    columns of `docs` are not looked at.
    """
    sizes = stored(sized(docs))
    mixed = with_copies(sizes, plan_mix(sizes, weights, most, bins, seed), seed)
    return mixed.select(
        "doc_id", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken")
    )
