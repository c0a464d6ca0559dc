"""Document fingerprints as invertible Bloom lookup tables of paragraph digests.

A fingerprint holds a few cells. Every paragraph digest is added to three of them; a cell
keeps the number, the sum of the digests and the sum of a check value. The table of one
version minus that of another holds the difference alone: a cell left with one digest
(number one or minus one, check value right) gives it away, it is taken out of its other
cells too, and so on until the table is empty. If it does not empty, the difference was
too large for it, and both versions are sketched anew in four times as many cells.

Paragraphs end at a line break. Long ones are cut further, after words chosen by their last
letters, so that an edit changes the pieces around it and leaves the others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

CELLS = 9
HASHES = 3
GROWTH = 4
ATTEMPTS = 20  # 9 cells, then 36, ...: 2 to the 41 cells are more than any document has paragraphs
_STEP_CHARS = 4_000_000

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def _mixed(values: np.ndarray, seed: int) -> np.ndarray:
    x = values ^ np.uint64((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(33))) * _M2
    return x ^ (x >> np.uint64(33))


def paragraph_digests(texts: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit digests of each text's paragraphs, with the number of the text."""
    raw = [t.encode("utf-8", "replace") for t in texts]
    joined = b"\n".join(raw) + b"\n"
    data = np.frombuffer(joined, np.uint8)
    chosen = (data[1:-1] * np.uint8(31) + data[:-2] * np.uint8(17)) & np.uint8(28) == 0
    begins = np.cumsum([0] + [len(r) + 1 for r in raw])[:-1]
    ends = np.zeros(len(data), bool)
    ends[2:] = (data[2:] == 32) & chosen
    ends[begins] = False  # both letters have to be the text's own
    ends[begins[begins + 1 < len(data)] + 1] = False
    ends |= data == 10
    stops = np.flatnonzero(ends) + 1
    starts = np.concatenate(([0], stops[:-1]))
    owner = np.searchsorted(np.cumsum([len(r) + 1 for r in raw]), starts, side="right")
    digest = xxhash.xxh64_intdigest
    found = np.fromiter((digest(joined[a:b]) for a, b in zip(starts.tolist(), stops.tolist())), np.uint64, len(starts))
    filled = stops - starts > 1  # an empty line is no paragraph
    found, owner = found[filled], owner[filled]
    order = np.lexsort((found, owner))
    found, owner = found[order], owner[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
    return found[new], owner[new]


class Tables:
    """Lookup tables of many documents side by side, each of `cells` cells."""

    def __init__(self, documents: int, cells: int) -> None:
        self.cells = cells
        self.documents = documents
        self.number = np.zeros(documents * cells, np.int64)
        self.digests = np.zeros(documents * cells, np.uint64)
        self.checks = np.zeros(documents * cells, np.uint64)

    def add(self, digests: np.ndarray, owner: np.ndarray, sign: int | np.ndarray = 1) -> None:
        each = self.cells // HASHES
        signs = np.broadcast_to(np.asarray(sign, np.int64), digests.shape)
        factor = signs.astype(np.uint64)  # minus one is 2 to the 64 less one: sums wrap around
        check = _mixed(digests, 99)
        for j in range(HASHES):
            at = owner * self.cells + j * each + (_mixed(digests, self.cells * HASHES + j) % np.uint64(each)).astype(np.int64)
            np.add.at(self.number, at, signs)
            np.add.at(self.digests, at, digests * factor)
            np.add.at(self.checks, at, check * factor)

    def minus(self, other: Tables) -> Tables:
        left = Tables(self.documents, self.cells)
        left.number = self.number - other.number
        left.digests = self.digests - other.digests
        left.checks = self.checks - other.checks
        return left

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Digests found, their document, their sign, and for each document whether its table is empty now."""
        found, owners, signs = [], [], []
        while True:
            one = np.flatnonzero(np.abs(self.number) == 1)
            sign = self.number[one]
            digest = self.digests[one] * sign.astype(np.uint64)
            right = self.checks[one] * sign.astype(np.uint64) == _mixed(digest, 99)
            one, sign, digest = one[right], sign[right], digest[right]
            if not len(one):
                break
            owner = one // self.cells
            order = np.lexsort((digest, owner))
            owner, digest, sign = owner[order], digest[order], sign[order]
            new = np.ones(len(owner), bool)
            new[1:] = (owner[1:] != owner[:-1]) | (digest[1:] != digest[:-1])
            owner, digest, sign = owner[new], digest[new], sign[new]
            self.add(digest, owner, -sign)
            found.append(digest)
            owners.append(owner)
            signs.append(sign)
        rest = (self.number != 0) | (self.digests != 0) | (self.checks != 0)
        empty = ~rest.reshape(self.documents, self.cells).any(axis=1)
        join = lambda parts, kind: np.concatenate(parts) if parts else np.empty(0, kind)
        return join(found, np.uint64), join(owners, np.int64), join(signs, np.int64), empty

    def hex(self) -> list[str]:
        """Each document's table as text: per cell the number, the sum of digests, the sum of checks."""
        rows = np.empty(self.documents * self.cells, [("n", ">i4"), ("d", ">u8"), ("c", ">u4")])
        rows["n"], rows["d"], rows["c"] = self.number, self.digests, self.checks & np.uint64(0xFFFFFFFF)
        raw, width = rows.tobytes(), rows.itemsize * self.cells
        return [raw[k : k + width].hex() for k in range(0, len(raw), width)]


def sketched(digests: np.ndarray, owner: np.ndarray, documents: int, cells: int = CELLS) -> Tables:
    tables = Tables(documents, cells)
    tables.add(digests, owner)
    return tables


def differing(
    a: tuple[np.ndarray, np.ndarray],
    b: tuple[np.ndarray, np.ndarray],
    documents: int,
    first: Tables | None = None,
    cells: int = CELLS,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digests in one of two versions only: digest, document, sign (1: in `a`).

    `a` and `b` are (digests, document). `first` is the difference of their fingerprints.
    """
    found, owners, signs = [], [], []
    open_now = np.arange(documents)
    for _ in range(ATTEMPTS):
        if not len(open_now):
            break
        if first is None:
            number = np.full(documents, -1)
            number[open_now] = np.arange(len(open_now))
            in_a, in_b = number[a[1]] >= 0, number[b[1]] >= 0
            first = sketched(a[0][in_a], number[a[1][in_a]], len(open_now), cells)
            first.add(b[0][in_b], number[b[1][in_b]], -1)
        digest, owner, sign, empty = first.peel()
        good = empty[owner]
        found.append(digest[good])
        owners.append(open_now[owner[good]])
        signs.append(sign[good])
        open_now, first, cells = open_now[~empty], None, cells * GROWTH
    if len(open_now):
        raise RuntimeError("a difference could not be peeled")
    join = lambda parts, kind: np.concatenate(parts) if parts else np.empty(0, kind)
    return join(found, np.uint64), join(owners, np.int64), join(signs, np.int64)


def _likeness(size_a: np.ndarray, size_b: np.ndarray, differ: np.ndarray) -> np.ndarray:
    """Share of the paragraphs of two versions that both have; 1 if neither has any."""
    total = size_a + size_b
    return np.where(total > 0, (total - differ) / np.maximum(total, 1), 1.0)


def edited_text(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compared(texts: list[str], at: list[int], cells: int = CELLS) -> dict[str, list]:
    """Texts at the given places against their edited versions and against the texts after them."""
    size, places = len(at), np.array(at)
    edited = [edited_text(texts[i], texts[i + 1]) for i in at]
    digests, owner = paragraph_digests(texts)

    def of(where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        number = np.full(len(texts), -1)
        number[where] = np.arange(size)
        inside = number[owner] >= 0
        return digests[inside], number[owner[inside]]

    of_text, of_edited, of_next = of(places), paragraph_digests(edited), of(places + 1)
    count = lambda x: np.bincount(x[1], minlength=size)
    own, changed, behind = (sketched(*x, size, cells) for x in (of_text, of_edited, of_next))
    near = []
    for other, table in ((of_edited, changed), (of_next, behind)):
        _, differ, _ = differing(of_text, other, size, own.minus(table), cells)
        near.append(_likeness(count(of_text), count(other), np.bincount(differ, minlength=size)))
    return {
        "n_chars": [len(texts[i]) for i in at],
        "edited_sha256": [hashlib.sha256(t.encode("utf-8", "replace")).hexdigest() for t in edited],
        "fingerprint": own.hex(),
        "edited_fingerprint": changed.hex(),
        "near_edited": near[0].tolist(),
        "near_next": near[1].tolist(),
        "n_paragraphs": count(of_text).tolist(),
    }


_RESULT = (
    "doc_id string, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, n_paragraphs bigint"
)


def _ranges(docs: DataFrame, parts: int) -> tuple[list[float], dict[int, tuple[object, int]]]:
    """Cuts between ranges of ids, and for each range that has rows its first id and the range that ends before it."""
    steps = [i / parts for i in range(1, parts)]
    cuts = sorted(set(docs.approxQuantile("doc_id", steps, 1 / (4 * parts)))) if steps else []
    heads = docs.select("doc_id", _range_of(docs, cuts).alias("part")).groupBy("part").agg(F.max("doc_id").alias("head"))
    first = sorted((r["part"], r["head"]) for r in heads.collect())  # a row for each range
    return cuts, {part: (head, first[i - 1][0]) for i, (part, head) in enumerate(first)}


def _range_of(docs: DataFrame, cuts: list[float]):
    """Number of a row's range, counted from the largest ids; rows without id are in the last."""
    edges = np.array(cuts)

    @F.pandas_udf("int")
    def part(ids: pd.Series) -> pd.Series:
        values = ids.astype("float64").fillna(-np.inf).to_numpy()
        return pd.Series(len(edges) - np.searchsorted(edges, values, side="left"), dtype="int32")

    return part(F.col("doc_id"))


def versions(docs: DataFrame, cells: int = CELLS, parts: int | None = None) -> DataFrame:
    """Every document against an edited version of itself and against the next document.

    The next document is the one with the next smaller doc_id; after the last comes the
    first. The edited text has its last floor(n / 2) characters replaced by as many of the
    next document's first, or by all it has.

    Returns one row per row of `docs`: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next (of the paragraphs of both versions together,
    the share that both have; 1 if there are none), n_paragraphs. A null text is empty. Rows without a doc_id come
    last; rows with the same doc_id follow each other in the order of their texts. A table
    of one row is its own next; an empty one gives an empty result. Other columns of
    `docs` are not looked at.

    Texts are shuffled once, by ranges of ids. Each range also gets the first row of the
    next one. Each range has a task of its own, which holds a batch of rows, never the whole
    range.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    cuts, heads = _ranges(docs.select("doc_id"), parts)
    part_of = spark.createDataFrame(
        [(p, h, b) for p, (h, b) in heads.items()],
        T.StructType([T.StructField("part", T.IntegerType()), T.StructField("head", docs.schema["doc_id"].dataType), T.StructField("back", T.IntegerType())]),
    )  # as many rows as ranges
    placed = rows.withColumn("part", _range_of(rows, cuts)).join(F.broadcast(part_of), "part")
    own = F.struct("part", F.lit(False).alias("guest"))
    guest = F.struct(F.col("back").alias("part"), F.lit(True).alias("guest"))
    places = F.when(F.col("doc_id").eqNullSafe(F.col("head")), F.array(own, guest)).otherwise(F.array(own))
    dealt = placed.select("doc_id", "text", F.explode(places).alias("at")).select("at.part", "at.guest", "doc_id", "text")
    ordered = dealt.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "guest", F.col("doc_id").desc_nulls_last(), "text")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, texts, guests, held = [], [], [], 0
        for batch in batches:
            for doc_id, text, guest in zip(batch["id_text"], batch["text"], batch["guest"]):
                ids.append(doc_id)
                texts.append(text)
                guests.append(guest)
                held += len(text)
                if held >= _STEP_CHARS:
                    yield from step(ids, texts, guests)
                    ids, texts, guests, held = [doc_id], [text], [guest], len(text)
        yield from step(ids, texts, guests)

    def step(ids: list, texts: list[str], guests: list[bool]) -> Iterator[pd.DataFrame]:
        here = [i for i in range(len(ids) - 1) if not guests[i]]
        if here:
            found = compared(texts, here, cells)
            yield pd.DataFrame({"doc_id": pd.Series([ids[i] for i in here], dtype=object)} | found)

    # Ids pass through Python as texts: pandas would turn integers with a null among them into floats.
    named = ordered.select("part", "guest", F.col("doc_id").cast("string").alias("id_text"), "text")
    found = named.mapInPandas(compare, _RESULT)
    return found.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
