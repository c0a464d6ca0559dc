"""A manifest of a data set as a Merkle tree, with a proof for every document.

Documents are the leaves of a tree for each source; the sources' roots are the leaves of
one more tree. Each level is one conditional aggregate (a slot pivot): the children of a
parent go to as many columns as a node may have children, and the hash over those columns
in order is the parent. The same columns without a child's own slot are its siblings, so
the proofs come down the tree from the stored levels and nothing is hashed twice.

A row of a level holds one parent's children, and a join has one parent's children as its
key, so a source with a third of all documents is spread like any other.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from .common import lower_ascii, stored
from .order import positions

FANOUT = 16
TAMPERED = 5


class Tree(NamedTuple):
    """The trees of all groups, level by level; a group ends at the level where one node is left."""

    leaves: DataFrame  # group, pos, n (nodes of the group in this level), digest
    families: list[DataFrame]  # group, parent, n, c0, c1, ...: the children's digests
    lone: list[DataFrame]  # group, pos, digest: groups of which one node is left


def hashed(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the concatenation; a null part is left out."""
    return F.sha2(F.concat_ws("", *parts), 256)


def field(value: Column) -> Column:
    """A value with the number of its bytes before it, so that fields can't run into each other; `-` if null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(text: Column) -> Column:
    return hashed(field(F.col("doc_id")), field(F.col("source")), field(F.col("lang")), field(F.col("n_chars")), field(text))


def _slots(fanout: int) -> list[str]:
    return [f"c{k}" for k in range(fanout)]


def _slot_pivot(nodes: DataFrame, fanout: int) -> DataFrame:
    """The children of each parent, one to a column."""
    spread = [F.max(F.when(F.col("pos") % fanout == k, F.col("digest"))).alias(c) for k, c in enumerate(_slots(fanout))]
    parent = F.expr(f"pos div {fanout}").alias("parent")
    return nodes.groupBy("group", parent).agg(F.max("n").alias("n"), *spread)


def build(leaves: DataFrame, fanout: int = FANOUT) -> Tree:
    """Trees over `leaves` (group, pos, n, digest). Levels are added until no group has several nodes."""
    most = leaves.agg(F.max("n")).first()[0] or 0
    nodes, families, lone = leaves, [], []
    while most:
        lone.append(nodes.where("n = 1").select("group", "pos", "digest"))
        if most == 1:
            break
        families.append(stored(_slot_pivot(nodes.where("n > 1"), fanout)))
        nodes = families[-1].select(
            "group",
            F.col("parent").alias("pos"),
            F.expr(f"(n + {fanout - 1}) div {fanout}").alias("n"),
            hashed(*map(F.col, _slots(fanout))).alias("digest"),
        )
        most = -(-most // fanout)
    return Tree(leaves, families, lone)


def _beside(slot: Column, fanout: int) -> Column:
    """The siblings of a slot, as the texts that stand before and after it."""
    before = F.concat_ws("", *[F.when(slot > k, F.col(c)) for k, c in enumerate(_slots(fanout))])
    after = F.concat_ws("", *[F.when(slot < k, F.col(c)) for k, c in enumerate(_slots(fanout))])
    return F.struct(before.alias("before"), after.alias("after"))


def proofs(tree: Tree, tops: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """The leaves with `path`, and the columns of `tops`.

    `tops` has group, path and any more columns: the path on from a group's last node. A
    path lists the siblings before and after a node, from its own level up. Paths are
    handed down to a level's parents; only there do the leaves meet them.
    """
    carried = [c for c in tops.columns if c not in ("group", "path")]
    alone = tree.leaves.where("n = 1").join(tops, "group")
    if not tree.families:
        return alone

    def ended(level: int) -> DataFrame:
        return tree.lone[level].join(tops, "group").select("group", F.col("pos").alias("parent"), "path", *carried)

    def longer(slot: Column) -> Column:
        return F.concat(F.array(_beside(slot, fanout)), F.col("path"))

    above = ended(len(tree.families))
    for level in range(len(tree.families) - 1, 0, -1):
        family = tree.families[level].join(above, ["group", "parent"])
        there = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.lit(k)) for k, c in enumerate(_slots(fanout))]))
        slot = F.col("slot")
        children = family.withColumn("slot", F.explode(there)).select(
            "group", (F.col("parent") * fanout + slot).alias("parent"), longer(slot).alias("path"), *carried
        )
        above = children.unionByName(ended(level))
    family = tree.families[0].drop("n").join(above, ["group", "parent"])
    slot = (F.col("pos") % fanout).cast("int")
    below = tree.leaves.where("n > 1").withColumn("parent", F.expr(f"pos div {fanout}"))
    found = below.join(family, ["group", "parent"]).select(*tree.leaves.columns, longer(slot).alias("path"), *carried)
    return found.unionByName(alone)


def folded(digest: Column, path: Column) -> Column:
    """The root that a digest leads to along a path."""
    return F.aggregate(path, digest, lambda below, beside: F.sha2(F.concat(beside["before"], below, beside["after"]), 256))


def tampered(text: Column, doc_id: Column) -> Column:
    """The text as an unnoticed change leaves it: some documents are lower-cased, null texts stay."""
    hit = F.coalesce(F.crc32(doc_id.cast("string")) % TAMPERED == 0, F.lit(False))
    return F.when(hit & text.isNotNull(), lower_ascii(text)).otherwise(text)


def manifest(docs: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """The manifest of `docs`, and each document's proof checked against a later, tampered copy.

    Returns one row per row of `docs`: doc_id, leaf, subroot (of its source), root,
    proof_sha256 (of all siblings from its level up to the root), folded_root (from the
    leaf that the copy has, along the proof), verified (whether that is the root).

    Within a source leaves stand by doc_id; rows without doc_id come first and are never
    tampered with, and rows of one id stand by their leaf. A null in any column is a value
    of its own, other than an empty text. A null source is a source, the first one.
    Repeated rows are leaves each. An empty table gives an empty result. Texts are hashed
    whole, whatever their length. Columns of `docs` other than doc_id, source, lang,
    n_chars and text are not looked at.
    """
    text = F.col("text")
    own, later = leaf(text), leaf(tampered(text, F.col("doc_id")))
    facts = stored(
        docs.select(
            "doc_id",
            F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("group"),
            own.alias("digest"),
            F.when(own != later, later).alias("later"),
            F.monotonically_increasing_id().alias("rid"),
        )
    )
    sources = build(positions(facts, "group", "doc_id", "digest", "rid"), fanout)

    subroots = sources.leaves.where("n = 1").select("group", "digest")
    for ended in sources.lone[1:]:
        subroots = subroots.unionByName(ended.select("group", "digest"))
    subroots = subroots.select(F.lit(0).alias("group"), F.col("group").alias("name"), "digest")
    whole = build(positions(subroots, "group", "name"), fanout)
    root = whole.lone[-1] if whole.lone else whole.leaves
    nothing = F.array().cast("array<struct<before:string,after:string>>")
    tops = proofs(whole, root.select("group", nothing.alias("path"), F.col("digest").alias("root")), fanout)
    tops = stored(tops.select(F.col("name").alias("group"), "path", F.col("digest").alias("subroot"), "root"))

    found = proofs(sources, tops, fanout)
    beside = F.transform("path", lambda p: F.concat(p["before"], p["after"]))
    return found.select(
        "doc_id",
        F.col("digest").alias("leaf"),
        "subroot",
        "root",
        F.sha2(F.array_join(beside, ""), 256).alias("proof_sha256"),
        folded(F.coalesce("later", "digest"), F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
