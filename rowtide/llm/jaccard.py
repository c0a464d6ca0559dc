"""Similarity join of documents by their five-word shingles, exact, by skipping along set relations.

Two sets with a Jaccard similarity of 0.8 or more share a shingle of their prefixes, a
fifth of each in one order of all shingles that puts common ones last. The prefixes make
an inverted index. Two relations between sets keep most of it from being looked at:

* Position: at the first shingle that two linked sets share, enough must follow in both.
  Within a list of the index, entries are grouped into blocks by set size and by what
  follows. Blocks whose best entries allow no link are skipped as a whole.
* Similarity: a set is compared with the set that it shares most lists with, its hub. If
  they link, the hub's answers hold for it as well: pairs inside one class are never looked
  up. What is known of two sets' hub bounds their own intersection, so further pairs are
  answered from the hub's numbers without reading either set.

Pairs that are left share so many shingles of their prefixes that they may link; these are
compared by whole sets. No bound loses a pair, so the classes are exact.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import stored, text_or_empty
from .graph import components
from .simhash import shingle_hashes

SHINGLE = 5
SHARE = 80  # percent of the union
SAMPLED = 10  # of so many documents one tells common shingles, which decide the order only
COMMON = 200_000  # so many of them, the most common ones, are known to all tasks
FILTER_BITS = 1 << 22
LIST_ROWS = 32  # longer lists are cut into blocks; the pairs are the same


def shingle_set(text: str | None) -> np.ndarray:
    """The distinct shingles of a text as sorted hashes; a text of fewer words is one, without words none."""
    return np.unique(shingle_hashes(text, SHINGLE))


def prefix_of(shingles: np.ndarray, common: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The shingles of which linked sets share one: first the uncommon ones, then by `ranks` of `common`."""
    size = len(shingles)
    if not size:
        return shingles
    rank = np.zeros(size, np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
        rank = np.where(common[at] == shingles, ranks[at], 0)
    return shingles[np.lexsort((shingles, rank))][: size - -(-SHARE * size // 100) + 1]


def _common(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of several documents of a sample, sorted, and in how many they are."""

    @F.pandas_udf("array<bigint>")
    def sets(texts: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(t).view(np.int64) for t in texts], dtype=object)

    some = docs.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLED)) == 0)
    counts = some.select(F.explode(sets("text")).alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    rows = counts.where("n > 2").orderBy(F.col("n").desc(), "key").limit(COMMON).collect()
    keys = np.array([r["key"] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], np.array([r["n"] for r in rows], np.int64)[order]


def _digest(text: Column) -> Column:
    return F.md5(text_or_empty(text).cast("binary"))


def _prints(docs: DataFrame) -> DataFrame:
    """rid, doc_id, digest (of the text), n, mark (of the set; null without a word), prefix."""
    common, ranks = _common(docs)

    @F.pandas_udf("n int, mark binary, prefix array<bigint>")
    def sketch(texts: pd.Series) -> pd.DataFrame:
        found = [shingle_set(t) for t in texts]
        return pd.DataFrame(
            {
                "n": [len(x) for x in found],
                "mark": [xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in found],
                "prefix": pd.Series([prefix_of(x, common, ranks).view(np.int64) for x in found], dtype=object),
            }
        )

    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("rid"), _digest(F.col("text")).alias("digest"), sketch("text").alias("made"))
    return stored(rows.select("rid", "doc_id", "digest", "made.*"))


def _enough(overlap: Column, n_a: Column, n_b: Column) -> Column:
    """Whether sets of these sizes link with this intersection."""
    return overlap * (100 + SHARE) >= (n_a + n_b) * SHARE


def _suffix(n: Column) -> Column:
    """How many shingles of a set follow its prefix."""
    return F.ceil(n * SHARE / 100) - 1


def _index(prints: DataFrame) -> DataFrame:
    """key, rid, n, left (shingles from here on): the lists with several entries."""
    entries = prints.select("rid", "n", F.posexplode("prefix").alias("pos", "key"))
    entries = entries.select("key", "rid", "n", (F.col("n") - F.col("pos")).alias("left"))
    lists = entries.groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1")
    return stored(entries.join(lists.select("key"), "key"))


def _hub_pairs(entries: DataFrame, prints: DataFrame) -> DataFrame:
    """a, b: each set and the lead that it shares most lists with, if they may link.

    `entries` has key, rid, n, left and lead (whether an entry may lead its list). The lead
    is the one with the fewest shingles before: the others of its sort have changes there.
    """
    first = F.min(F.when(F.col("lead"), F.struct((F.col("n") - F.col("left")).alias("pos"), "rid", "n"))).alias("first")
    leads = entries.groupBy("key").agg(first).select("key", F.col("first.rid").alias("b"), F.col("first.n").alias("n_b"))
    asking = entries.join(leads, "key").where("rid <> b")
    shared = asking.groupBy(F.col("rid").alias("a"), F.col("n").alias("n_a"), "b", "n_b").agg(F.count("*").alias("lists"))
    may = _enough(F.col("lists") + F.greatest(_suffix(F.col("n_a")), _suffix(F.col("n_b"))), F.col("n_a"), F.col("n_b"))
    best = F.max(F.struct("lists", (-F.col("b")).alias("b"))).alias("best")
    return shared.where(may).groupBy("a").agg(best).select("a", (-F.col("best.b")).alias("b"))


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """mark, text for the `wanted` (mark, digest), each once.

    A filter of fixed size (`FILTER_BITS`) keeps most other texts out of the shuffle; it
    lets through all that are wanted.
    """
    bit = F.pmod(F.xxhash64("digest"), F.lit(FILTER_BITS)).alias("bit")
    word = F.expr("bit div 64").alias("word")
    bits = wanted.select(bit).groupBy(word).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits"))
    rows = docs.select(_digest(F.col("text")).alias("digest"), "text").select("digest", "text", bit).withColumn("word", word)
    rows = rows.join(F.broadcast(stored(bits)), "word").where("(shiftrightunsigned(bits, cast(bit % 64 as int)) & 1) = 1")
    rows = rows.groupBy("digest").agg(F.first("text").alias("text"))
    return stored(rows.join(wanted, "digest").select("mark", "text"))


def _intersections(pairs: DataFrame, prints: DataFrame, docs: DataFrame) -> DataFrame:
    """a, b, n_a, n_b, overlap for pairs (a, b), by whole sets. Equal sets are compared once."""

    @F.pandas_udf("int")
    def overlap(left: pd.Series, right: pd.Series) -> pd.Series:
        sets: dict[str, np.ndarray] = {}
        for text in (*left, *right):
            if text not in sets:
                sets[text] = shingle_set(text)
        return pd.Series([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(left, right)], dtype="int32")

    facts = [prints.select(F.col("rid").alias(c), F.col("n").alias(f"n_{c}"), F.col("mark").alias(f"mark_{c}")) for c in "ab"]
    known = stored(pairs.join(facts[0], "a").join(facts[1], "b"))
    apart = known.where("mark_a <> mark_b").select("mark_a", "mark_b").distinct()
    marks = apart.select(F.col("mark_a").alias("mark")).unionAll(apart.select("mark_b")).distinct()
    texts = _texts(docs, prints.join(marks, "mark", "left_semi").groupBy("mark").agg(F.min("digest").alias("digest")))
    sides = [texts.select(F.col("mark").alias(f"mark_{c}"), F.col("text").alias(f"text_{c}")) for c in "ab"]
    compared = apart.join(sides[0], "mark_a").join(sides[1], "mark_b").select("mark_a", "mark_b", overlap("text_a", "text_b").alias("overlap"))
    found = known.join(compared, ["mark_a", "mark_b"], "left")
    return stored(found.select("a", "b", "n_a", "n_b", F.coalesce("overlap", "n_a").alias("overlap")))


def _linked(found: DataFrame) -> DataFrame:
    return found.where(_enough(F.col("overlap"), F.col("n_a"), F.col("n_b"))).select("a", "b")


def _may_link(a: str, b: str) -> Column:
    """Whether the entries of two sets in one list allow that they link, and that it is the first shingle they share."""
    c = lambda side, name: F.col(f"{side}.{name}")
    n_a, n_b = c(a, "n"), c(b, "n")
    # Sets with one hub share at most what both share with it, and of the rest at most the smaller one's.
    both = F.least(c(a, "with_hub"), c(b, "with_hub")) + F.least(n_a - c(a, "with_hub"), n_b - c(b, "with_hub"))
    by_hub = (c(a, "hub") != c(b, "hub")) | _enough(both, n_a, n_b)
    return _enough(F.least(c(a, "left"), c(b, "left")), n_a, n_b) & by_hub & (c(a, "class") != c(b, "class"))


def _open_pairs(index: DataFrame, hubs: DataFrame, classes: DataFrame, doubles: DataFrame) -> DataFrame:
    """a, b: pairs of different classes that the index, its blocks and the hubs leave open."""
    rows = index.select("key", "rid", "n", "left").join(doubles, "rid", "left_anti")
    rows = rows.join(classes, "rid", "left").join(hubs, "rid", "left").select(
        "key",
        "rid",
        "n",
        "left",
        F.coalesce("class", "rid").alias("class"),
        F.coalesce("hub", "rid").alias("hub"),
        F.coalesce("with_hub", "n").alias("with_hub"),
        # A block: sets of about one size (steps of a twentieth), by how much of them follows.
        F.floor(F.log("n") / float(np.log(1.05))).cast("int").alias("size_class"),
        F.floor((F.col("n") - F.col("left")) * 50 / F.col("n")).cast("int").alias("passed"),
    )
    rows = stored(rows)
    counts = rows.groupBy("key", "class").agg(F.count("*").alias("rows"))
    lists = counts.groupBy("key").agg(F.max(F.struct("rows", "class")).alias("top"), F.count("*").alias("classes"), F.sum("rows").alias("rows"))
    lists = lists.where("classes > 1").select("key", "rows", F.col("top.class").alias("top"))
    mixed = stored(rows.join(lists, "key"))

    def once(a: str, b: str) -> Column:
        """Most entries of a list are in its top class: they are looked up by the others, not among themselves."""
        return (F.col(f"{b}.class") == F.col(f"{b}.top")) | (F.col(f"{a}.rid") < F.col(f"{b}.rid"))

    short = mixed.where(F.col("rows") <= LIST_ROWS)
    a, b = short.where("class <> top").alias("a"), short.alias("b")
    found = a.join(b, (F.col("a.key") == F.col("b.key")) & once("a", "b") & _may_link("a", "b"))
    pairs = found.select(F.col("a.rid").alias("a"), F.col("b.rid").alias("b"))

    long = mixed.where(F.col("rows") > LIST_ROWS)
    block = ["key", "size_class", "passed"]
    best = [F.max("left").alias("left"), F.min("n").alias("n")]
    asking = long.where("class <> top").groupBy(*block).agg(*best).alias("a")
    asked = long.groupBy(*block).agg(*best).alias("b")
    worth = _enough(F.least("a.left", "b.left"), F.col("a.n"), F.col("b.n"))
    kept = asking.join(asked, (F.col("a.key") == F.col("b.key")) & worth).select(
        F.col("a.key").alias("key"), *[F.col(f"{s}.{c}").alias(f"{c}_{s}") for s in "ab" for c in block[1:]]
    )
    on = lambda side: [F.col("k.key") == F.col(f"{side}.key")] + [F.col(f"k.{c}_{side}") == F.col(f"{side}.{c}") for c in block[1:]]
    every = lambda conditions: conditions[0] & conditions[1] & conditions[2]
    a, b, k = long.where("class <> top").alias("a"), long.alias("b"), stored(kept).alias("k")
    found = a.join(k, every(on("a"))).join(b, every(on("b")) & once("a", "b") & _may_link("a", "b"))
    return pairs.unionAll(found.select(F.col("a.rid").alias("a"), F.col("b.rid").alias("b"))).distinct()


def _by_prefix(pairs: DataFrame, index: DataFrame, prints: DataFrame) -> DataFrame:
    """The pairs whose prefixes share so much that they may link. Only lists of the index can be shared."""
    pairs = stored(pairs)
    asked = pairs.select(F.col("a").alias("rid")).unionAll(pairs.select("b")).distinct()
    lists = index.join(asked, "rid", "left_semi").groupBy("rid", "n").agg(F.collect_list("key").alias("keys"))
    lists = stored(lists)
    sides = [lists.select(F.col("rid").alias(c), F.col("n").alias(f"n_{c}"), F.col("keys").alias(f"keys_{c}")) for c in "ab"]
    both = F.size(F.array_intersect("keys_a", "keys_b")) + F.greatest(_suffix(F.col("n_a")), _suffix(F.col("n_b")))
    return stored(pairs.join(sides[0], "a").join(sides[1], "b").where(_enough(both, F.col("n_a"), F.col("n_b"))).select("a", "b"))


def similar_classes(docs: DataFrame) -> DataFrame:
    """Classes of documents linked by sets of five-word shingles with a Jaccard similarity of 0.8 or more.

    Words are separated by ASCII white space, with A to Z in lower case. Returns one row per
    row of `docs`: doc_id, n_shingles, component_id (the smallest doc_id reachable by
    links, itself included). A text of one to four words is one shingle. A text that is
    null, empty or without a word has no shingle and is linked with nothing. Repeated rows
    are linked rows. A null doc_id is never the smallest; a class without any other has a
    null component_id. An empty table gives an empty result. Columns of `docs` other than
    doc_id and text are not looked at. Shingles are compared as 64-bit hashes.
    """
    docs = docs.select("doc_id", "text")
    prints = _prints(docs)
    firsts = prints.where("n > 0").groupBy("mark").agg(F.min("rid").alias("first"), F.count("*").alias("rows"))
    doubles = prints.join(firsts.where("rows > 1"), "mark").where("rid <> first").select("rid", "first")
    doubles = stored(doubles)
    equal = doubles.select(F.col("first").alias("a"), F.col("rid").alias("b"))

    index = _index(prints)
    compared = _intersections(_hub_pairs(index.withColumn("lead", F.lit(True)), prints), prints, docs)
    links = stored(_linked(compared).unionAll(equal))
    classes = stored(components(links).select(F.col("node").alias("rid"), F.col("root").alias("class")))
    hubs = stored(compared.select(F.col("a").alias("rid"), F.col("b").alias("hub"), F.col("overlap").alias("with_hub")))
    open_pairs = _by_prefix(_open_pairs(index, hubs, classes, doubles.select("rid")), index, prints)
    links = links.unionAll(_linked(_intersections(open_pairs, prints, docs)))

    rooted = prints.join(components(links), F.col("rid") == F.col("node"), "left")
    rooted = stored(rooted.select("doc_id", F.col("n").cast("bigint").alias("n_shingles"), F.coalesce("root", "rid").alias("root")))
    smallest = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rooted.join(smallest, "root").select("doc_id", "n_shingles", "component_id")
