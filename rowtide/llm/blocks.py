"""Exact duplicates by deterministic block naming.

Every text is cut into blocks of a fixed number of characters. The distinct blocks are
sorted and numbered: a block's name is an integer, and equal blocks have equal names.
Then the distinct pairs of adjacent names are sorted and numbered in their turn, level by
level, until each document is down to one name. Two documents with the same name at the
same level are equal; nothing rests on a hash having no collisions.

A block's text is shuffled once, to be numbered. The places where it occurs find their
name by a 64-bit hash of the block, as a few bytes each; hashes that two different blocks
share (there are hardly ever any) are set apart and matched by text instead.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .common import lower_ascii, stored

BLOCK_CHARS = 4096


def numbered(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The distinct values of `columns`, each with an integer `name` by sort order within its partition.

    Needs to be stored before it is used twice.
    """
    distinct = rows.select(*columns).distinct().sortWithinPartitions(*columns)
    return distinct.withColumn("name", F.monotonically_increasing_id())


def _cut(text: Column, block_chars: int) -> Column:
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{block_chars}}}"), F.lit(0))
    return F.when(F.length(text) == 0, F.array(F.lit(""))).otherwise(blocks)


def document_names(
    docs: DataFrame,
    block_chars: int = BLOCK_CHARS,
    block_hash: Callable[[Column], Column] = F.xxhash64,
) -> DataFrame:
    """One row per row of `docs`: rid (unique), doc_id, text_sha256, level, name.

    Rows with equal (level, name) have equal normalised texts, and only those.
    """
    norm = docs.select("doc_id", lower_ascii(F.col("text")).alias("norm"))
    blocks = norm.select(F.explode(_cut(F.col("norm"), block_chars)).alias("block"))
    names = stored(numbered(blocks, ["block"]).select(block_hash(F.col("block")).alias("h"), "name"))
    clashes = stored(names.groupBy("h").agg(F.count("*").alias("blocks")).where("blocks > 1").select("h"))
    hashes_suffice = clashes.isEmpty()

    ready = norm.select(
        "doc_id",
        F.monotonically_increasing_id().alias("rid"),
        F.sha2(F.encode("norm", "UTF-8"), 256).alias("sha"),
        _cut(F.col("norm"), block_chars).alias("blocks"),
    )
    exploded = ready.select(
        "doc_id", "rid", "sha", F.size("blocks").cast("bigint").alias("n"), F.posexplode("blocks").alias("pos", "block")
    )
    first = F.col("pos") == 0
    places = exploded.select(
        "rid",
        F.when(first, F.col("doc_id")).alias("doc_id"),
        F.when(first, F.col("sha")).alias("text_sha256"),
        F.col("pos").cast("bigint").alias("pos"),
        "n",
        block_hash(F.col("block")).alias("h"),
        F.lit(None).cast("string").alias("block") if hashes_suffice else F.col("block"),
    )
    if not hashes_suffice:
        shared = clashes.withColumn("shared", F.lit(True))
        places = places.join(shared, "h", "left").withColumn("block", F.when(F.col("shared"), F.col("block"))).drop("shared")
    places = stored(places)  # fixes the row ids

    matched = places.where("block IS NULL").join(names, "h").select("rid", "pos", "n", "name")
    if not hashes_suffice:
        apart = places.where("block IS NOT NULL")
        by_text = stored(numbered(apart, ["block"]).withColumn("name", -1 - F.col("name")))
        matched = matched.unionByName(apart.join(by_text, "block").select("rid", "pos", "n", "name"))
    named = stored(matched)

    level, most, done = 0, named.agg(F.max("n")).first()[0] or 1, []
    while True:
        done.append(named.where("n = 1").select("rid", F.lit(level).alias("level"), "name"))
        if most == 1:
            break
        even = F.col("pos") % 2 == 0
        pairs = (
            named.where("n > 1")
            .groupBy("rid", F.floor(F.col("pos") / 2).alias("pair"), "n")
            .agg(
                F.max(F.when(even, F.col("name"))).alias("a"),
                # An odd one out pairs with a name that no block or pair has.
                F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-(2**63))).alias("b"),
            )
        )
        names = stored(numbered(pairs, ["a", "b"]))
        named = stored(
            pairs.join(names, ["a", "b"]).select(
                "rid", F.col("pair").alias("pos"), F.ceil(F.col("n") / 2).alias("n"), "name"
            )
        )
        level, most = level + 1, -(-most // 2)
    found = functools.reduce(DataFrame.unionByName, done)
    return places.where("pos = 0").select("rid", "doc_id", "text_sha256").join(found, "rid")


def exact_duplicates(
    docs: DataFrame,
    block_chars: int = BLOCK_CHARS,
    block_hash: Callable[[Column], Column] = F.xxhash64,
) -> DataFrame:
    """Groups of documents whose texts are equal after lower-casing A to Z.

    Returns one row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256.
    The row with the largest doc_id stays. A null text is an empty text, and empty texts
    are equal. A null doc_id is below all others. Of repeated rows (same doc_id, same
    text) exactly one is kept. An empty table gives an empty result. Columns of `docs`
    other than doc_id and text are not looked at.
    """
    named = stored(document_names(docs, block_chars, block_hash))
    best = F.max(F.struct("doc_id", (-F.col("rid")).alias("order")))
    groups = stored(
        named.groupBy("level", "name")
        .agg(best.alias("best"), F.count("*").alias("group_size"))
        .select("level", "name", "group_size", F.col("best.doc_id").alias("keep_id"), (-F.col("best.order")).alias("keep_rid"))
    )
    return named.join(groups, ["level", "name"]).select(
        "doc_id", "keep_id", "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"), "text_sha256"
    )
