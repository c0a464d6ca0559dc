"""The prefix trie of conversations, with totals of every subtree by time-forward processing.

A node is a distinct sequence of first turns. Its key is a rolling hash of the turns (two
lanes modulo 2^61 - 1), which can be put together from hashes of parts: a conversation
that holds a third of all turns is cut into parts, hashed apart, and joined at the seams.

Totals go from the leaves up. Within a shard, nodes are sorted in reverse level order and
read once; each takes the messages that its children left for it in a priority queue, and
leaves one for its parent. The queue spills sorted runs, so neither the shard nor its
widest level has to fit in memory. Shards are subtrees: a subtree with few turns below it
is one shard, and many shards run at once. What lies above them is narrow. It takes the
messages of the shards' roots and is processed in the same way, by bands of levels from
the deepest up (there is one band unless conversations are very long).
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from .common import stored, text_or_empty
from .mixing import word_count
from .order import positions

PRIME = (1 << 61) - 1
BASES = (1_000_003_000_577, 998_244_353_000_111)
BORROWED = 4  # up to three turns
FAMILY = 20
SHARD_TURNS = 50_000  # a subtree with so many turns below it is one shard
SHARDS = 4096  # at most so many times as large in a larger corpus: the levels above shards stay this narrow
BAND = 4096
QUEUE_ROOM = 200_000
ENDS = 4096

KEY = ["depth", "k1", "k2"]
TOTALS = ["n_children", "n_leaves", "saved_tokens"]


class SpillingQueue:
    """A priority queue of tuples of six integers; what has no room is kept in sorted runs.

    A run is an unnamed file of the task: it goes with it, and no other task reads it.
    """

    record = struct.Struct("<6q")

    def __init__(self, room: int = QUEUE_ROOM):
        self.room, self.heap, self.runs = room, [], []

    def push(self, item: tuple) -> None:
        heapq.heappush(self.heap, (item, -1))
        if len(self.heap) > self.room + len(self.runs):
            self._spill()

    def _spill(self) -> None:
        run = tempfile.TemporaryFile()
        for item in sorted(item for item, source in self.heap if source < 0):
            run.write(self.record.pack(*item))
        run.seek(0)
        self.heap = [head for head in self.heap if head[1] >= 0]
        heapq.heapify(self.heap)
        self.runs.append(run)
        self._head(len(self.runs) - 1)

    def _head(self, run: int) -> None:
        packed = self.runs[run].read(self.record.size)
        if packed:
            heapq.heappush(self.heap, (self.record.unpack(packed), run))

    def pop_at(self, key: tuple) -> Iterator[tuple]:
        """What was pushed with this key, which no smaller one may be left before."""
        while self.heap and self.heap[0][0][:3] == key:
            item, source = heapq.heappop(self.heap)
            if source >= 0:
                self._head(source)
            yield item[3:]


def time_forward(nodes: DataFrame, room: int = QUEUE_ROOM) -> DataFrame:
    """`nodes` with the totals of their subtrees within their shard.

    Columns: shard, depth, k1, k2, p1, p2 (the parent's), top (whether the parent is in
    another shard), n_children, n_leaves, saved_tokens (own, and of other shards).
    """

    def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, queue = None, None
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if row.shard != shard:
                    shard, queue = row.shard, SpillingQueue(room)
                children, leaves, saved = row.n_children, row.n_leaves, row.saved_tokens
                for more in queue.pop_at((-row.depth, row.k1, row.k2)):
                    children, leaves, saved = children + more[0], leaves + more[1], saved + more[2]
                if not row.top:
                    queue.push((1 - row.depth, row.p1, row.p2, 1, leaves, saved))
                out.append((children, leaves, saved))
            yield batch.assign(**{name: values for name, values in zip(TOTALS, zip(*out))}) if out else batch

    columns = ["shard", *KEY, "p1", "p2", "top", *TOTALS]
    dealt = nodes.select(*columns).repartition("shard").sortWithinPartitions("shard", F.col("depth").desc(), "k1", "k2")
    return dealt.mapInPandas(sweep, dealt.schema)


def _conv(conv_id: Column) -> Column:
    """A conversation's id as text, empty if null."""
    return F.coalesce(conv_id.cast("string"), F.lit(""))


def _turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rebuilt conversations (conv, conv_id, length), and their turns (conv, conv_id, length, place, d1, d2, words)."""
    role, text = text_or_empty(F.col("role")), text_or_empty(F.col("text"))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    facts = conversations.select("conv_id", _conv(F.col("conv_id")).alias("conv"), "turn", role.alias("role"), digest.alias("digest"), word_count(text).alias("words"))
    facts = stored(facts.withColumn("rid", F.monotonically_increasing_id()))
    number = lambda start: F.conv(F.substring("digest", start, 15), 16, 10).cast("bigint")
    own = positions(facts, "conv", "turn", "role", "digest", "rid").select(
        "conv", "conv_id", F.col("pos").alias("place"), F.col("n").alias("own"), number(1).alias("d1"), number(16).alias("d2"), "words"
    )

    skipped = F.coalesce(F.crc32(F.col("conv_id").cast("string")) % BORROWED, F.lit(0)).cast("int")
    facts_of_turn = F.struct("place", "d1", "d2", "words")
    lenders = own.where((F.col("conv_id") % FAMILY == 0) & (F.col("place") < BORROWED - 1))
    lenders = lenders.groupBy(F.col("conv_id").alias("family")).agg(F.array_sort(F.collect_list(facts_of_turn)).alias("firsts"))
    convs = own.where("place = 0").select("conv", "conv_id", "own", skipped.alias("skipped"))
    convs = convs.withColumn("family", F.col("conv_id") - F.col("conv_id") % FAMILY).join(lenders, "family", "left")
    lent = F.when(F.col("skipped") > 0, F.slice("firsts", F.lit(1), F.col("skipped")))
    convs = convs.withColumn("lent", F.coalesce(lent, F.slice(F.array(F.struct(*[F.lit(0).cast("bigint").alias(c) for c in ("place", "d1", "d2", "words")])), 1, 0)))
    rest = F.greatest(F.col("own") - F.col("skipped"), F.lit(0))
    convs = stored(convs.select("conv", "conv_id", "skipped", "lent", (F.size("lent") + rest).alias("length")))

    turn = ["place", "d1", "d2", "words"]
    taken = convs.select("conv", "conv_id", "length", F.inline("lent"))
    kept = own.where(F.col("place") >= skipped).join(convs.drop("conv_id"), "conv")
    kept = kept.withColumn("place", F.col("place") - F.col("skipped") + F.size("lent"))
    columns = ["conv", "conv_id", "length", *turn]
    return convs.select("conv", "conv_id", "length"), taken.select(*columns).unionByName(kept.select(*columns))


def _hashed(lanes: tuple[int, int], start: tuple[int, int], turns: int) -> tuple[int, int]:
    """The hash of a whole from that of its `turns` last turns, and that of what stands before."""
    return tuple((s * pow(base, turns, PRIME) + a) % PRIME for s, a, base in zip(start, lanes, BASES))


def _paths(turns: DataFrame) -> DataFrame:
    """Every turn as a step on the path from the root: conv, conv_id, length, words, depth, k1, k2 and the parent's p1, p2.

    A task hashes what it has of a conversation; those cut between tasks, one for each
    task at most, then get the hash of what stands before.
    """

    def part_hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, conv, lanes, first = TaskContext.get().partitionId(), None, (0, 0), 0
        for batch in batches:
            found = []
            for c, place, d1, d2 in zip(batch["conv"], batch["place"], batch["d1"], batch["d2"]):
                if c != conv:
                    conv, lanes, first = c, (0, 0), place
                before, lanes = lanes, tuple((a * b + d) % PRIME for a, b, d in zip(lanes, BASES, (d1, d2)))
                found.append((*lanes, *before, first))
            made = pd.DataFrame(found, columns=["k1", "k2", "p1", "p2", "first"], dtype="int64", index=batch.index)
            yield pd.concat([batch[["conv", "conv_id", "length", "place", "words"]], made], axis=1).assign(task=task)

    def seams(parts: pd.DataFrame) -> pd.DataFrame:
        start, out = (0, 0), []
        for r in parts.sort_values("first").itertuples(index=False):
            out.append((r.conv, r.task, *start))
            start = _hashed((r.k1, r.k2), start, r.last - r.first + 1)
        return pd.DataFrame(out, columns=["conv", "task", "s1", "s2"])

    # Ids go through pandas as text, since a null among them would make them inexact.
    dealt = turns.withColumn("conv_id", F.col("conv_id").cast("string")).repartitionByRange("conv", "place").sortWithinPartitions("conv", "place")
    made = "conv string, conv_id string, length bigint, place bigint, words bigint, k1 bigint, k2 bigint, p1 bigint, p2 bigint, first bigint, task bigint"
    parts = stored(dealt.mapInPandas(part_hashes, made))
    cut = parts.where("first > 0").select("conv").distinct()
    last = F.max(F.struct(F.col("place").alias("last"), "k1", "k2")).alias("end")
    pieces = parts.join(cut, "conv", "left_semi").groupBy("conv", "task", "first").agg(last).select("conv", "task", "first", "end.*")
    begun = stored(pieces.groupBy("conv").applyInPandas(seams, "conv string, task bigint, s1 bigint, s2 bigint"))

    @F.pandas_udf("struct<k1: bigint, k2: bigint, p1: bigint, p2: bigint>")
    def joined(k1: pd.Series, k2: pd.Series, p1: pd.Series, p2: pd.Series, s1: pd.Series, s2: pd.Series, n: pd.Series) -> pd.DataFrame:
        rows = [
            (*_hashed((a, b), (s, t), m), *_hashed((c, d), (s, t), m - 1))
            for a, b, c, d, s, t, m in zip(k1, k2, p1, p2, s1, s2, n)
        ]
        return pd.DataFrame(rows, columns=["k1", "k2", "p1", "p2"], dtype="int64")

    facts = ["conv", F.col("conv_id").cast("bigint").alias("conv_id"), "length", "words", (F.col("place") + 1).alias("depth")]
    whole = parts.where("first = 0").select(*facts, "k1", "k2", "p1", "p2")
    later = parts.where("first > 0").join(begun, ["conv", "task"])
    keys = joined("k1", "k2", "p1", "p2", "s1", "s2", F.col("place") - F.col("first") + 1).alias("keys")
    return stored(whole.unionByName(later.select(*facts, keys).select("*", "keys.*").drop("keys")))


def _nodes(convs: DataFrame, paths: DataFrame) -> DataFrame:
    """conv, conv_id (smallest member), n_convs, depth, k1, k2, p1, p2, below (turns of members from here on), and own totals."""
    last_words = F.when(F.col("depth") > 0, F.col("words")).otherwise(0)
    nowhere = [F.lit(0).cast("bigint").alias(c) for c in ("words", *KEY, "p1", "p2")]
    steps = paths.unionByName(convs.select("conv", "conv_id", "length", *nowhere))
    grouped = steps.groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"),
        F.count("*").alias("n_convs"),
        F.min("p1").alias("p1"),
        F.min("p2").alias("p2"),
        F.min(last_words).alias("words"),
        F.max("length").alias("deepest"),
        F.sum(F.col("length") - F.col("depth") + 1).alias("below"),
    )
    return stored(
        grouped.select(
            *KEY,
            "p1",
            "p2",
            "conv_id",
            _conv(F.col("conv_id")).alias("conv"),
            "n_convs",
            "below",
            F.lit(0).cast("bigint").alias("n_children"),
            (F.col("deepest") == F.col("depth")).cast("bigint").alias("n_leaves"),
            ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"),
        )
    )


def _name(depth: Column, k1: Column, k2: Column) -> Column:
    return F.concat_ws(":", depth.cast("string"), k1.cast("string"), k2.cast("string"))


def _messages(tops: DataFrame) -> DataFrame:
    """What shards' roots send to their parents, added up."""
    sent = tops.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2"))
    return sent.agg(F.count("*").alias("m1"), F.sum("n_leaves").alias("m2"), F.sum("saved_tokens").alias("m3"))


def subtree_totals(nodes: DataFrame, paths: DataFrame, shard_turns: int = SHARD_TURNS, shards: int = SHARDS, band: int = BAND, room: int = QUEUE_ROOM) -> DataFrame:
    """depth, k1, k2 and the totals of every node: within shards, then across shard roots."""
    facts = nodes.agg(F.max("below"), F.max("depth")).first()
    most = max(shard_turns, (facts[0] or 0) // shards)
    heavy = stored(nodes.where(F.col("below") > most))
    light = nodes.where(F.col("below") <= most)
    parents = heavy.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"))
    # The first light node on a conversation's path; its name is the shard of all below it.
    steps = paths.select("conv", *KEY, "p1", "p2")
    roots = steps.join(parents, ["depth", "p1", "p2"], "left_semi").join(heavy.select(*KEY), KEY, "left_anti")
    roots = roots.select("conv", _name(*map(F.col, KEY)).alias("shard"))
    own = _name(*map(F.col, KEY))
    sharded = light.join(roots, "conv", "left").withColumn("shard", F.coalesce("shard", F.lit("0:0:0")))
    done = [stored(time_forward(sharded.withColumn("top", F.col("shard") == own), room))]

    deepest = heavy.agg(F.max("depth")).first()[0]
    if deepest is not None:
        band = max(band, -(-deepest // 64))
        start = F.col("depth") - F.col("depth") % band
        tops = paths.where(F.col("depth") % band == 0).select("conv", F.col("depth").alias("start"), own.alias("shard"))
        above = heavy.withColumn("start", start).join(tops, ["conv", "start"], "left").withColumn("shard", F.coalesce("shard", F.lit("0:0:0")))
        above = stored(above.withColumn("top", F.col("depth") == F.col("start")))
        sent = _messages(done[0].where("top"))
        for k in range(deepest // band, -1, -1):
            told = above.where(F.floor(F.col("depth") / band) == k).join(sent, KEY, "left")
            own_and_sent = [(F.col(c) + F.coalesce(m, F.lit(0))).alias(c) for c, m in zip(TOTALS, ("m1", "m2", "m3"))]
            told = told.select("shard", *KEY, "p1", "p2", "top", *own_and_sent)
            done.append(stored(time_forward(told, room)))
            sent = _messages(done[0].where("top").unionByName(done[-1].where("top")))
    totals = done[0]
    for more in done[1:]:
        totals = totals.unionByName(more)
    return totals.select(*KEY, *TOTALS)


def _ends(convs: DataFrame, paths: DataFrame) -> DataFrame:
    """(name, ends_sha256) of nodes at which conversations end.

    Ids are listed in order in pieces of `ENDS`. One task reads the pieces of a node, as a
    hash over them all has to, but only as a stream.
    """
    last = paths.where("depth = length").select("conv", "conv_id", _name(*map(F.col, KEY)).alias("name"))
    last = last.unionByName(convs.where("length = 0").select("conv", "conv_id", F.lit("0:0:0").alias("name")))
    placed = positions(last, "name", "conv_id").withColumn("piece", F.floor(F.col("pos") / ENDS))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "conv"))), lambda x: x["conv"]), ",")
    pieces = placed.groupBy("name", "piece").agg(listed.alias("ids"))

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, digest = None, None
        for batch in batches:
            out = []
            for n, ids in zip(batch["name"], batch["ids"]):
                if n != name:
                    if name is not None:
                        out.append((name, digest.hexdigest()))
                    name, digest = n, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield pd.DataFrame(out, columns=["name", "ends_sha256"])
        if name is not None:
            yield pd.DataFrame([(name, digest.hexdigest())], columns=["name", "ends_sha256"])

    dealt = pieces.repartition("name").sortWithinPartitions("name", "piece")
    return dealt.select("name", "ids").mapInPandas(digests, "name string, ends_sha256 string")


def prefix_trie(conversations: DataFrame, shard_turns: int = SHARD_TURNS, shards: int = SHARDS, band: int = BAND, room: int = QUEUE_ROOM) -> DataFrame:
    """The trie of the rebuilt conversations, one row per node.

    Conversation c is rebuilt from the first h = crc32(c) mod 4 turns of conversation
    c - c mod 20 and its own turns after its first h. Columns: conv_id (smallest member),
    depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns stand by `turn`, null first, then role, then a hash of the text. A null role or
    text is empty. Rows without conv_id are one conversation, which borrows nothing, is
    never the smallest member beside another, and is an empty id, the first one, in
    ends_sha256. Repeated rows are a turn each. An empty table gives an empty result. Texts
    of any length count whole. Other columns are not looked at. `shard_turns`, `shards`,
    `band` and `room` decide how the work is cut, never the result.
    """
    convs, turns = _turns(conversations)
    paths = _paths(turns)
    nodes = _nodes(convs, paths)
    totals = subtree_totals(nodes, paths, shard_turns, shards, band, room)
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    found = nodes.drop(*TOTALS).withColumn("name", _name(*map(F.col, KEY))).join(totals, KEY)
    found = found.join(parents, ["depth", "p1", "p2"], "left").join(_ends(convs, paths), "name", "left")
    nobody = F.sha2(F.lit(""), 256)
    return found.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", *TOTALS, F.coalesce("ends_sha256", nobody).alias("ends_sha256")
    )
