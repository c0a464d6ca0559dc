"""Tables as Parquet generations.

A table is a folder. Each state of it is a generation: a folder `gen=<n>` with Parquet
files that are written once, and a small file `_table.json` that names the folders which
make up the table then. A generation may take over folders of earlier ones, so a batch
of changes rewrites only the partitions it touches. `_table.json` is written last and
commits the generation; the highest committed one is current. One writer at a time;
readers of older generations are not disturbed.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.contract import CHANGE_PREFIX, MAX_PARTITION_BYTES, TABLE_FORMAT_PREFIX
from ..operators.measure import estimate_partitions, partitions_for_bytes

BUCKET = "__bucket"
_GENERATION = re.compile(r"gen=(\d+)$")
_COMMIT = "_table.json"


@dataclass(frozen=True)
class TableState:
    """A committed generation. Folders are relative to the table's root."""

    generation: int
    schema: T.StructType
    folders: tuple[str, ...]
    partition_by: tuple[str, ...] = ()
    keys: tuple[str, ...] = ()
    buckets: int | None = None


class _Storage:
    """The few file operations Spark's readers and writers do not offer, on any storage Hadoop knows."""

    def __init__(self, spark: SparkSession, root: str):
        self._paths = spark._jvm.org.apache.hadoop.fs
        self.root = self._paths.Path(root)
        self._fs = self.root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _path(self, relative: str):
        return self._paths.Path(self.root, relative)

    def exists(self, relative: str) -> bool:
        return self._fs.exists(self._path(relative))

    def folders(self, pattern: str) -> list[str]:
        """Folders that match a glob below the root, as paths relative to it."""
        depth = pattern.count("/") + 1
        found = self._fs.globStatus(self._path(pattern)) or []
        paths = [f.getPath().toString() for f in found if f.isDirectory()]
        return sorted("/".join(p.split("/")[-depth:]) for p in paths)

    def read(self, relative: str) -> str:
        stream = self._fs.open(self._path(relative))
        try:
            return bytes(stream.readAllBytes()).decode("utf-8")
        finally:
            stream.close()

    def write(self, relative: str, text: str) -> None:
        """Write under another name first: readers see the whole file or none."""
        draft = self._path(relative + ".draft")
        stream = self._fs.create(draft, True)
        try:
            stream.write(bytearray(text, "utf-8"))
        finally:
            stream.close()
        if not self._fs.rename(draft, self._path(relative)):
            raise OSError(f"cannot write {relative} in {self.root.toString()}")


def generation_path(root: str, generation: int) -> str:
    return f"{root.rstrip('/')}/gen={generation}"


def _generations(storage: _Storage) -> list[int]:
    return sorted(int(_GENERATION.search(f).group(1)) for f in storage.folders("gen=*") if _GENERATION.search(f))


def committed_generations(spark: SparkSession, root: str) -> list[int]:
    storage = _Storage(spark, root)
    return [n for n in _generations(storage) if storage.exists(f"gen={n}/{_COMMIT}")]


def current_generation(spark: SparkSession, root: str) -> int | None:
    return max(committed_generations(spark, root), default=None)


def next_generation(spark: SparkSession, root: str) -> int:
    """The number of the generation to be written next."""
    return max(_generations(_Storage(spark, root)), default=-1) + 1


def table_state(spark: SparkSession, root: str, generation: int | None = None) -> TableState | None:
    """The current (or a given) generation, None if there is none."""
    if generation is None:
        generation = current_generation(spark, root)
    if generation is None:
        return None
    facts = json.loads(_Storage(spark, root).read(f"gen={generation}/{_COMMIT}"))
    return TableState(
        generation,
        T.StructType.fromJson(facts["schema"]),
        tuple(facts["folders"]),
        tuple(facts["partition_by"]),
        tuple(facts["keys"]),
        facts["buckets"],
    )


def read_folders(spark: SparkSession, root: str, state: TableState, folders: Sequence[str]) -> DataFrame:
    """Some of a generation's folders, in the table's column order, without the bucket number."""
    columns = [c for c in state.schema.names if c != BUCKET]
    if not folders:
        return spark.createDataFrame([], state.schema).select(*columns)
    paths = [f"{root.rstrip('/')}/{f}" for f in folders]
    return spark.read.schema(state.schema).option("basePath", root).parquet(*paths).select(*columns)


def read_table(
    spark: SparkSession,
    root: str,
    schema: T.StructType | None = None,
    generation: int | None = None,
) -> DataFrame:
    """The current (or a given) generation; an empty table of `schema` if there is none."""
    state = table_state(spark, root, generation)
    if state is not None:
        return read_folders(spark, root, state, state.folders)
    if schema is None:
        raise FileNotFoundError(f"no table at {root}")
    return spark.createDataFrame([], schema)


def bucket_of(keys: Sequence[str], buckets: int) -> Column:
    """A key's bucket. It depends on the key's type: cast to the table's types first."""
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def write_generation(
    df: DataFrame,
    root: str,
    generation: int | None = None,
    partition_by: Sequence[str] = (),
    keys: Sequence[str] = (),
    buckets: int | None = None,
    keep: Sequence[str] = (),
) -> int:
    """Write a new generation and commit it.

    `keep` names folders of earlier generations that stay part of the table. `buckets`
    lays the rows out by a hash of `keys`, so that later batches rewrite only the buckets
    they touch. Rows are gathered by partition before they are written; Spark splits
    partitions that are too large for one file and joins those that are too small.
    A failed attempt is not committed and is written over.
    """
    spark = df.sparkSession
    storage = _Storage(spark, root)
    if generation is None:
        generation = max(_generations(storage), default=-1) + 1
    commit = f"gen={generation}/{_COMMIT}"
    if storage.exists(commit):
        raise FileExistsError(f"generation {generation} of {root} is committed")
    if "gen" in df.columns:
        raise ValueError("a table column may not be called gen")
    partitions = list(partition_by)
    if buckets:
        df = df.withColumn(BUCKET, bucket_of(keys, buckets))
        partitions.append(BUCKET)
    writer = df.hint("rebalance", *partitions).write if partitions else df.write
    if partitions:
        writer = writer.partitionBy(*partitions)
    writer.mode("overwrite").parquet(generation_path(root, generation))
    pattern = "/".join([f"gen={generation}", *[f"{p}=*" for p in partitions]])
    facts = {
        "schema": json.loads(df.schema.json()),
        "folders": sorted([*keep, *storage.folders(pattern)]),
        "partition_by": list(partition_by),
        "keys": list(keys),
        "buckets": buckets,
    }
    storage.write(commit, json.dumps(facts))
    return generation


def table_files(spark: SparkSession, root: str) -> DataFrame:
    """Every data file under a folder: path, modified, bytes. Contents are not read."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return listing.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"))


def partitions_for_table(spark: SparkSession, root: str, state: TableState, max_bytes: int) -> int:
    """Partition count from the stored bytes of a generation, found by listing its folders."""
    if not state.folders:
        return 1
    paths = [f"{root.rstrip('/')}/{f}" for f in state.folders]
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    return partitions_for_bytes(listing.agg(F.sum("length")).first()[0] or 0, max_bytes)


def stale_files(spark: SparkSession, root: str, keep: int = 1, older_than=None) -> DataFrame:
    """Files that the newest `keep` committed generations do not use.

    A generation above the newest committed one may be in the making and is left alone.
    `older_than` leaves out files changed at or after that time. Nothing is removed.
    """
    done = committed_generations(spark, root)
    kept = [table_state(spark, root, n) for n in done[-keep:]] if keep > 0 else []
    folders = sorted({(f,) for state in kept for f in state.folders})
    used = spark.createDataFrame(folders, "folder string")
    files = table_files(spark, root).withColumns(
        {
            "folder": F.regexp_extract("path", r"(gen=\d+(?:/[^/]+)*)/[^/]+$", 1),
            "generation": F.regexp_extract("path", r"/gen=(\d+)/", 1).try_cast("int"),
        }
    )
    stale = files.where(F.col("generation") <= max(done, default=-1)).join(used, "folder", "left_anti")
    stale = stale.select("path", "modified", "bytes", "generation")
    return stale if older_than is None else stale.where(F.col("modified") < F.lit(older_than))


def drop_prefixed(df: DataFrame, prefixes: Sequence[str] = (CHANGE_PREFIX, TABLE_FORMAT_PREFIX)) -> DataFrame:
    """Without change metadata and table-format columns."""
    return df.drop(*[c for c in df.columns if c.startswith(tuple(prefixes))])


def resize(df: DataFrame, partitions: int | None = None, max_bytes: int = MAX_PARTITION_BYTES) -> DataFrame:
    """Even partitions: a given number, or as many as the text-length estimate asks for."""
    return df.repartition(estimate_partitions(df, max_bytes) if partitions is None else partitions)


def task_bytes(spark: SparkSession, max_bytes: int) -> int:
    """Stored bytes for one task to rewrite: what Spark gives a task to read, and no more than `max_bytes`."""
    return min(max_bytes, spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())


def packed(df: DataFrame, partitions: int) -> DataFrame:
    """A scan's rows in about so many partitions: neighbours are joined without a shuffle; only a scan of too few is dealt out anew."""
    return df.coalesce(partitions) if partitions <= df.rdd.getNumPartitions() else df.repartition(partitions)


def export_snapshot(
    df: DataFrame,
    path: str,
    partitions: int | None = None,
    drop_prefixes: Sequence[str] = (CHANGE_PREFIX, TABLE_FORMAT_PREFIX),
    max_bytes: int | None = None,
) -> None:
    """Overwrite `path` with the table's own columns as Parquet.

    By default files are as Spark sizes the last stage, so the rows are computed once and
    not shuffled for it. `partitions` asks for a number of files; `max_bytes` measures all
    values as text first and asks for as many files as that needs.
    """
    rows = drop_prefixed(df, drop_prefixes)
    if partitions is not None or max_bytes is not None:
        rows = resize(rows, partitions, MAX_PARTITION_BYTES if max_bytes is None else max_bytes)
    rows.write.mode("overwrite").parquet(path)


def compact_table(
    spark: SparkSession, root: str, max_bytes: int = MAX_PARTITION_BYTES, sizing: str = "files"
) -> int:
    """Write the current state again as a generation of its own, in well-sized files.

    `sizing="files"` goes by the stored bytes and joins small files without a shuffle, up
    to what one task reads (`spark.sql.files.maxPartitionBytes`) and `max_bytes`: a larger
    file would be read in parts anyway, but written by a single task. `"text"` measures all
    values in a pass of its own. A partitioned table keeps its partitions.
    """
    state = table_state(spark, root)
    if state is None:
        raise FileNotFoundError(f"no table at {root}")
    df = read_folders(spark, root, state, state.folders)
    if not state.partition_by and not state.buckets:
        if sizing == "files":
            df = packed(df, partitions_for_table(spark, root, state, task_bytes(spark, max_bytes)))
        else:
            df = resize(df, None, max_bytes)
    return write_generation(
        df, root, partition_by=state.partition_by, keys=state.keys, buckets=state.buckets
    )
