"""Fixity audit of replicated web archives by Merkle trees.

Every record is hashed with its header and payload. An archive file is cut into ranges of
bytes; a range's hash covers the offsets, lengths and hashes of the records that begin in
it. Ranges are the leaves of a tree over the file, in order of their offsets, and the
files are the leaves of a tree over the replica. Two replicas with equal roots hold the
same bytes. Otherwise the comparison goes down from the roots, and looks at the children
of differing nodes only, until it is down to ranges, whose records are compared one by one.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import stored

RANGE_BYTES = 1 << 16
FANOUT = 16
FILE_RECORDS = 1000


class Tree(NamedTuple):
    """A replica's records and its tree. Both lists go from the leaves up; their last level is one node each."""

    records: DataFrame  # file, offset, length, digest, record_id
    ranges: list[DataFrame]  # file, node, digest
    files: list[DataFrame]  # node, digest; in the first level a node is a file, counted from `first_file`
    first_file: int = 0


def warc_record(uri: Column, record_id: Column, payload: Column) -> Column:
    """A record as it stands in an archive file."""
    body = F.coalesce(payload, F.lit(""))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(record_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(uri, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
        body,
        F.lit("\r\n\r\n"),
    )


def archive(pages: DataFrame, file_records: int = FILE_RECORDS) -> DataFrame:
    """Pages as records (file, record_id, offset, length, digest) of archive files of so many consecutive ids.

    Records follow each other by page_id, then url, then digest. Null ids share one file.
    The window runs over lengths and digests within a file, never over pages.
    """
    record = F.encode(warc_record(F.col("url"), F.col("page_id"), F.col("html")), "UTF-8")
    hashed = pages.select(
        "page_id",
        F.coalesce(F.floor(F.col("page_id") / file_records), F.lit(-1)).alias("file"),
        "url",
        record.alias("record"),
    ).select("page_id", "file", "url", F.length("record").cast("bigint").alias("length"), F.sha2("record", 256).alias("digest"))
    before = Window.partitionBy("file").orderBy(F.col("page_id").asc_nulls_first(), F.col("url").asc_nulls_first(), "digest").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offset = F.coalesce(F.sum("length").over(before), F.lit(0))
    return hashed.withColumn("offset", offset).select("file", F.col("page_id").alias("record_id"), "offset", "length", "digest")


def _line(parts: Column, *fields: str) -> Column:
    """Structs in order as one text."""
    return F.array_join(F.transform(parts, lambda p: F.concat_ws(":", *[p[f].cast("string") for f in fields])), "|")


def _parents(children: DataFrame, keys: list[str], fanout: int) -> DataFrame:
    """Nodes over up to `fanout` children each, whose numbers and digests they hash in order."""
    parts = F.array_sort(F.collect_list(F.struct("node", "digest")))
    parent = F.floor(F.col("node") / fanout).alias("parent")
    hashed = F.sha2(_line(parts, "node", "digest"), 256).alias("digest")
    return children.groupBy(*keys, parent).agg(hashed).withColumnRenamed("parent", "node")


def _ranges(records: DataFrame, range_bytes: int) -> DataFrame:
    facts = F.array_sort(F.collect_list(F.struct("offset", "length", "digest")))
    hashed = F.sha2(_line(facts, "offset", "length", "digest"), 256).alias("digest")
    return records.groupBy("file", F.floor(F.col("offset") / range_bytes).alias("node")).agg(hashed)


def build_trees(replicas: list[DataFrame], range_bytes: int = RANGE_BYTES, fanout: int = FANOUT) -> list[Tree]:
    """Trees of one height for all replicas. Each level is stored.

    Replicas have file, offset, length, digest and record_id. Levels are added until the
    largest file is under one node, and then until all files are.
    """
    trees = [Tree(r, [stored(_ranges(r, range_bytes))], []) for r in map(stored, replicas)]
    last = max((t.ranges[0].agg(F.max("node")).first()[0] or 0 for t in trees), default=0)
    while last:
        for t in trees:
            t.ranges.append(stored(_parents(t.ranges[-1], ["file"], fanout)))
        last //= fanout
    ends = [t.ranges[-1].agg(F.min("file"), F.max("file")).first() for t in trees]
    least = min((e[0] for e in ends if e[0] is not None), default=0)
    most = max((e[1] for e in ends if e[1] is not None), default=0) - least
    trees = [t._replace(first_file=least) for t in trees]
    for t in trees:
        t.files.append(stored(t.ranges[-1].select((F.col("file") - least).alias("node"), "digest")))
    while most:
        for t in trees:
            t.files.append(stored(_parents(t.files[-1], [], fanout)))
        most //= fanout
    return trees


def _differing(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Nodes on one side only, or on both with other digests."""
    both = left.withColumnRenamed("digest", "l").join(right.withColumnRenamed("digest", "r"), keys, "full_outer")
    return both.where(~F.col("l").eqNullSafe(F.col("r"))).select(*keys)


def suspect_ranges(a: Tree, b: Tree, fanout: int = FANOUT) -> DataFrame | None:
    """(file, node) of the ranges that differ, found from the roots down; None if the roots are equal.

    Of each level only the children of differing nodes are read and compared.
    """
    suspects = stored(_differing(a.files[-1], b.files[-1], ["node"]))
    if suspects.isEmpty():
        return None
    for left, right in zip(a.files[-2::-1], b.files[-2::-1]):
        above = suspects.withColumnRenamed("node", "parent")
        below = [level.join(above, F.floor(level["node"] / fanout) == above["parent"], "left_semi") for level in (left, right)]
        suspects = stored(_differing(*below, ["node"]))
    suspects = suspects.select((F.col("node") + a.first_file).alias("file"), F.lit(0).cast("bigint").alias("node"))
    for left, right in zip(a.ranges[-2::-1], b.ranges[-2::-1]):
        above = suspects.withColumnRenamed("node", "parent")
        below = [
            level.join(above, (level["file"] == above["file"]) & (F.floor(level["node"] / fanout) == above["parent"]), "left_semi")
            for level in (left, right)
        ]
        suspects = stored(_differing(*below, ["file", "node"]))
    return suspects


def audit(left: DataFrame, right: DataFrame, range_bytes: int = RANGE_BYTES, fanout: int = FANOUT) -> DataFrame:
    """Records in which two replicas differ.

    Both have file and offset (never null), length, digest and record_id, as `archive`
    makes them. Returns file, offset, record_id, status, left_digest, right_digest:
    `corrupt` if the record at an offset has other bytes or another length, `missing` if
    only the left replica has a record there, `extra` if only the right one has. Records
    at one place are compared as a set. Equal replicas, or two empty ones, give an empty
    result. Other columns are not looked at.
    """
    columns = ["file", "offset", "length", "digest", "record_id"]
    a, b = build_trees([left.select(*columns), right.select(*columns)], range_bytes, fanout)
    suspects = suspect_ranges(a, b, fanout)
    on = ["file", "offset"]

    def facts(tree: Tree, side: str) -> DataFrame:
        ranged = tree.records.withColumn("node", F.floor(F.col("offset") / range_bytes))
        looked_at = ranged.limit(0) if suspects is None else ranged.join(suspects, ["file", "node"], "left_semi")
        return looked_at.groupBy(*on).agg(
            F.max("record_id").alias(f"{side}_id"),
            F.array_sort(F.collect_list(F.struct("length", "digest"))).alias(f"{side}_facts"),
        )

    joined = facts(a, "left").join(facts(b, "right"), on, "full_outer")
    status = F.when(F.col("right_facts").isNull(), "missing").when(F.col("left_facts").isNull(), "extra").otherwise("corrupt")
    return joined.where(~F.col("left_facts").eqNullSafe(F.col("right_facts"))).select(
        *on,
        F.coalesce("left_id", "right_id").alias("record_id"),
        status.alias("status"),
        F.array_join("left_facts.digest", ",").alias("left_digest"),
        F.array_join("right_facts.digest", ",").alias("right_digest"),
    )
