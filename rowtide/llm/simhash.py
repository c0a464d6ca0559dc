"""Near duplicates by SimHash, compared through a table of pivot distances.

Every distinct fingerprint gets its Hamming distances to a fixed set of reference
fingerprints, the pivots. By the triangle inequality two fingerprints within k bits have
distances to each pivot that differ by at most k, so a pair whose largest coordinate
difference is above k is discarded before its distance is taken.

Which pairs are looked at: fingerprints are cut into blocks of bits, and a pair within k
bits agrees on all but k of them. Pairs that share a bucket (the value of all but k
blocks) are compared, while the bucket has at most `bucket_rows` fingerprints. For larger
buckets, as groups of near copies make them, every fingerprint is linked to itself and to
those at one bit from it. Two fingerprints within two bits meet at such a point, and at
most 65 meet at any. This needs no pairs and loses no link, so the limit decides the way
only, never the result.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import lower_ascii, stored
from .graph import components

SEED = 42
BITS = 64
MAX_BITS = 2  # the flips of one bit meet for pairs within two
BLOCKS = 4
PIVOTS = 16
BUCKET_ROWS = 32
_CHUNK = 1 << 15


def shingle_hashes(text: str | None, words: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of the word shingles, repeats included; a shorter text is one shingle, no word gives none."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.empty(0, np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    last = max(len(found) - words, 0)
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: last + 1].tolist(), (ends[min(words, len(found)) - 1 :] - 1).tolist())
    return np.array([digest(joined[a:b], seed) for a, b in spans], np.uint64)


def fingerprint_of(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes, as a signed 64-bit integer; 0 without hashes."""
    if not len(hashes):
        return 0
    counts = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), _CHUNK):
        part = hashes[k : k + _CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes)).view(">i8")[0])


def fingerprints(text: Column, words: int = 3, seed: int = SEED) -> Column:
    """The SimHash of a text as bigint. Words are split at ASCII white space, A to Z lower-cased."""

    @F.pandas_udf("bigint")
    def simhash(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint_of(shingle_hashes(t, words, seed)) for t in texts], dtype="int64")

    return simhash(text)


def hex_fingerprint(fingerprint: Column) -> Column:
    return F.lpad(F.lower(F.hex(fingerprint)), 16, "0")


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def pivot_columns(fingerprint: Column, pivots: int = PIVOTS) -> list[Column]:
    """The pivot table's columns: distances to fixed random fingerprints."""
    return [
        _distance(fingerprint, F.xxhash64(F.lit(f"pivot {i}"))).cast("tinyint").alias(f"p{i}") for i in range(pivots)
    ]


def bucket_keys(fingerprint: Column, blocks: int = BLOCKS, max_bits: int = MAX_BITS) -> Column:
    """Array of bucket numbers: each hashes one choice of all but `max_bits` blocks, with their values."""
    width = BITS // blocks
    keys = []
    for kept in itertools.combinations(range(blocks), blocks - max_bits):
        mask = sum(((1 << width) - 1) << (b * width) for b in kept)
        mask -= (1 << 64) if mask >= 1 << 63 else 0
        keys.append(F.xxhash64(F.lit(str(kept)), fingerprint.bitwiseAND(F.lit(mask))))
    return F.array(*keys)


def fingerprint_links(
    fps: DataFrame, blocks: int = BLOCKS, pivots: int = PIVOTS, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """(a, b): links that connect exactly the distinct fingerprints `fp` that links of two bits connect."""
    keyed = fps.select("fp", *pivot_columns(F.col("fp"), pivots), F.explode(bucket_keys(F.col("fp"), blocks)).alias("key"))
    crowds = stored(keyed.groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1"))
    crowded = stored(keyed.join(crowds, "key"))

    small = crowded.where(F.col("rows") <= bucket_rows)
    a, b = small.alias("a"), small.alias("b")
    apart = F.greatest(*[F.abs(F.col(f"a.p{i}") - F.col(f"b.p{i}")) for i in range(pivots)])
    pairs = (
        a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp")) & (apart <= MAX_BITS))
        .where(_distance(F.col("a.fp"), F.col("b.fp")) <= MAX_BITS)
        .select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))
    )

    large = crowded.where(F.col("rows") > bucket_rows).select("fp").distinct()
    flips = F.array(F.lit(0).cast("bigint"), *[F.lit((1 << i) - ((1 << 64) if i == 63 else 0)).cast("bigint") for i in range(BITS)])
    meets = large.select("fp", F.explode(F.transform(flips, lambda bit: F.col("fp").bitwiseXOR(bit))).alias("point"))
    met = stored(meets.groupBy("point").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1))
    stars = met.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b")
    return pairs.unionAll(stars)


def _classes(prints: DataFrame, blocks: int, pivots: int, bucket_rows: int) -> DataFrame:
    """fp, component_id, root of every fingerprint: `prints` has doc_id and fp."""
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    links = fingerprint_links(distinct.select("fp"), blocks, pivots, bucket_rows)
    roots = components(links).withColumnRenamed("node", "fp")
    rooted = stored(distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    smallest = stored(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")))
    return stored(rooted.join(smallest, "root").select("fp", "component_id", "root"))


def near_duplicates(
    docs: DataFrame,
    words: int = 3,
    blocks: int = BLOCKS,
    pivots: int = PIVOTS,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Groups of documents linked by fingerprints with at most two differing bits.

    Returns one row per row of `docs`: doc_id, fingerprint (16 hex digits), component_id
    (the smallest doc_id reachable, itself included). Texts that are null, empty or
    without a word have fingerprint zero and are linked like any others. Repeated rows are
    each returned. A null doc_id is never the smallest; a component without any other has
    a null component_id. An empty table gives an empty result. Columns of `docs` other
    than doc_id and text are not looked at.
    """
    prints = stored(docs.select("doc_id", fingerprints(F.col("text"), words).alias("fp")))
    classes = _classes(prints, blocks, pivots, bucket_rows).drop("root")
    return prints.join(classes, "fp").select("doc_id", hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def near_duplicate_rows(
    docs: DataFrame,
    words: int = 3,
    blocks: int = BLOCKS,
    pivots: int = PIVOTS,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """As `near_duplicates`, with text_sha256 (of the text with A to Z in lower case) and kept.

    One row of each group is kept: that with the smallest doc_id, a null above all others,
    then the smallest text_sha256. Of rows equal in both any one.
    """
    sha = F.sha2(F.encode(lower_ascii(F.col("text")), "UTF-8"), 256).alias("text_sha256")
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("rid"), sha, fingerprints(F.col("text"), words).alias("fp"))
    prints = stored(rows)
    rooted = stored(prints.join(_classes(prints, blocks, pivots, bucket_rows), "fp"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_sha256", "rid")
    firsts = stored(rooted.groupBy("root").agg(F.min(order).alias("first")).select("root", F.col("first.rid").alias("first")))
    kept = (F.col("rid") == F.col("first")).alias("kept")
    return rooted.join(firsts, "root").select("doc_id", "text_sha256", hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id", kept)
