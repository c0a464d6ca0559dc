"""Encoding into the pieces of a SentencePiece model, and decoding.

The encoding is the segmentation of the normalised text whose pieces have the largest sum
of scores (the unigram rule). That is a shortest path, and paths over a max-plus algebra
combine associatively: a chunk of text is a matrix whose entry (i, j) is the best score of
crossing it when a piece of the chunk before reaches i characters into it and its own last
piece reaches j characters into the next. So a giant document is cut into chunks, each
chunk gives its matrix on its own. Runs of neighbouring matrices are multiplied into one,
level by level, until a document has a single one; the states at its ends are known, and
go down the levels again, each run by itself, until every chunk has its own, from which it
is traced back alone.

A document of one chunk needs no matrix: its states at both ends are zero.
"""

from __future__ import annotations

import functools
import math
import operator
import re
import sys
from array import array
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import stored

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK_CHARS = 1 << 16
RUN = 16  # neighbouring matrices that are multiplied into one of the next level
SPACE = "▁"
_WORDS_KEPT = 150_000  # as many before them that may come again
_STRETCHES_KEPT = 100_000  # of words, likewise
_LEARNT = 1 << 15  # words whose stretches are held at a time
_STEP_CHARS = 2_000_000  # of texts encoded together
_PLACES = 16
_SCALE, _TIES = 1 << 10, 1 << 20  # scores are exact to 1/1024; below that a hash of pieces and places decides
_LEAST = -1e6  # lower scores bar a piece; they count as this, so that sums stay exact
_NEVER = np.iinfo(np.int64).min // 4


def _id_bytes(number: int) -> bytes:
    return number.to_bytes(4, sys.byteorder)


class _Cache(dict):
    """What was used lately: what is not asked for again while `kept` others come is given up."""

    def __init__(self, kept: int) -> None:
        self.kept = kept
        self.before: dict[str, bytes] = {}

    def missing(self, asked: set[str]) -> set[str]:
        """Of the keys asked for those to be found out; the others are here afterwards."""
        new = asked.difference(self)
        again = new.intersection(self.before)
        self.update((key, self.before[key]) for key in again)
        return new - again

    def turn_over(self) -> None:
        if len(self) > self.kept:
            self.before = dict(self)
            self.clear()


class Pieces:
    """A model's pieces with integer weights, and best paths through texts."""

    def __init__(self, model: bytes) -> None:
        library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.normalize = library.normalize
        self.weights: dict[str, tuple[bytes, array[int]]] = {}  # id, weight by place
        self.bytes: list[bytes] | None = None
        self.unknown = library.unk_id()
        self.texts: list[bytes] = []
        self.scores: list[float] = []
        for i in range(library.get_piece_size()):
            piece, score = library.id_to_piece(i), library.get_score(i)
            plain = not (library.is_byte(i) or library.is_control(i) or library.is_unknown(i) or library.is_unused(i))
            if plain:
                self.weights[piece] = (_id_bytes(i), self._placed(score, piece))
            raw = bytes([int(piece[1:-1], 16)]) if library.is_byte(i) else piece.encode() if plain else b""
            self.texts.append(raw)
            self.scores.append(max(score, _LEAST) if plain else 0.0)
        usual = [s for s in self.scores if _LEAST < s < 0]
        self.unknown_score = min(usual, default=0.0) - 10
        if library.is_byte(library.piece_to_id("<0x00>")):
            self.bytes = [_id_bytes(library.piece_to_id(f"<0x{b:02X}>")) for b in range(256)]
            for b in range(256):  # a character in bytes has the score of an unknown one, at its first byte
                self.scores[library.piece_to_id(f"<0x{b:02X}>")] = self.unknown_score if b & 0xC0 != 0x80 else 0.0
        self.scores[self.unknown] = self.unknown_score
        self._unknown_weight = round(self.unknown_score * _SCALE) * _TIES
        self._score_of = np.array(self.scores)
        self.longest = max(map(len, self.weights), default=1)
        # Beginnings of pieces that are no pieces: nothing longer can match once a stretch is in neither.
        self._known: dict[str, tuple[bytes, array[int]] | None] = {}
        for piece in self.weights:
            for end in range(1, len(piece)):
                self._known.setdefault(piece[:end], None)
        self._known.update(self.weights)
        self._endings: dict[str, tuple[bytes, array[int]] | None] = {}
        for piece in self.weights:
            for begin in range(1, len(piece)):
                self._endings.setdefault(piece[begin:], None)
        self._endings.update(self.weights)
        # Neighbouring characters inside a piece. All paths meet between two others, as before a word's space.
        self._joined = {piece[i : i + 2] for piece in self.weights for i in range(len(piece) - 1)}
        self.forget()
        words_meet = not any(pair[0] != SPACE and pair[1] == SPACE for pair in self._joined)
        self._split = _words(self._joined).findall if words_meet else lambda text: [text] if text else []

    @staticmethod
    def _placed(score: float, piece: str) -> array[int]:
        """The weight at each place after a meeting point: the score first, then a hash that decides between equal ones."""
        main = round(max(score, _LEAST) * _SCALE) * _TIES
        return array("q", [main - xxhash.xxh32_intdigest(piece, seed=i) % _TIES for i in range(_PLACES)])

    def _reach(
        self, text: str, start: int, inner: int, offset: int = 0
    ) -> tuple[list[int | None], list[int], list[bytes | None]]:
        """Best weight of reaching each position from `start`, by pieces that begin before `inner`.

        Also where the last piece before each position begins, and its id. `offset` is the
        distance of `text` from the last position at which all paths meet. It makes the
        choice among equal scores the same wherever a text is cut.
        """
        size = len(text)
        best: list[int | None] = [None] * (size + 1)
        begin, last = [0] * (size + 1), [None] * (size + 1)
        best[start] = 0
        known, joined, longest, place = self._known, self._joined, self.longest, offset + start
        for i in range(inner):
            if i and text[i - 1 : i + 1] not in joined:
                place = 0
            elif i <= start:
                place = offset + i
            here = best[i]
            if here is None:
                place += 1
                continue
            at = place % _PLACES
            place += 1
            single = False
            for j in range(i + 1, min(i + longest, size) + 1):
                found = known.get(text[i:j], 0)
                if not found:
                    if found == 0:
                        break
                    continue
                if j == i + 1:
                    single = True
                weight = here + found[1][at]
                if best[j] is None or weight > best[j]:
                    best[j], begin[j], last[j] = weight, i, found[0]
            if not single:
                weight = here + self._unknown_weight
                if best[i + 1] is None or weight > best[i + 1]:
                    best[i + 1], begin[i + 1], last[i + 1] = weight, i, None
        return best, begin, last

    def _trace(self, text: str, begin: list[int], last: list[bytes | None], start: int, end: int) -> bytes:
        parts = []
        while end > start:
            piece, at = last[end], begin[end]
            if piece is None:
                raw = text[at].encode("utf-8", "replace")
                piece = b"".join([self.bytes[b] for b in raw]) if self.bytes else _id_bytes(self.unknown)
            parts.append(piece)
            end = at
        parts.reverse()
        return b"".join(parts)

    def _path(self, text: str, start: int, inner: int, end: int, offset: int = 0) -> bytes:
        _, begin, last = self._reach(text, start, inner, offset)
        return self._trace(text, begin, last, start, end)

    def _learn(self, stretches: Iterable[str]) -> None:
        """Remember the best path of each stretch. In order of the alphabet, what they begin with in common is done once."""
        ending, longest, unknown = self._endings.get, self.longest, self._unknown_weight
        before, best, begin, last = "", [0], [0], [None]
        for text in sorted(stretches):
            same = 0
            for a, b in zip(before, text):
                if a != b:
                    break
                same += 1
            del best[same + 1 :], begin[same + 1 :], last[same + 1 :]
            for j in range(same + 1, len(text) + 1):
                at = j - 1
                found = ending(text[at:j], 0)
                if found:
                    top, piece, by_unknown = best[at] + found[1][at % _PLACES], found[0], None
                else:
                    top, piece, by_unknown = -math.inf, None, best[at] + unknown
                if found != 0:
                    for i in range(j - 2, j - longest - 1 if j > longest else -1, -1):
                        found = ending(text[i:j], 0)
                        if found:
                            weight = best[i] + found[1][i % _PLACES]
                            if weight >= top:
                                top, at, piece = weight, i, found[0]
                        elif found == 0:
                            break
                if by_unknown is not None and by_unknown > top:
                    top, at, piece = by_unknown, j - 1, None
                best.append(top)
                begin.append(at)
                last.append(piece)
            self._stretches[text] = self._trace(text, begin, last, 0, len(text))
            before = text

    def _parts(self, word: str) -> list[str]:
        """The stretches of a word: all paths meet between two characters that no piece holds side by side."""
        if self._joined.issuperset(map(operator.add, word, word[1:])):
            return [word]
        found, begin = [], 0
        for end, pair in enumerate(map(operator.add, word, word[1:]), 1):
            if pair not in self._joined:
                found.append(word[begin:end])
                begin = end
        found.append(word[begin:])
        return found

    def _learn_words(self, words: set[str]) -> None:
        have, ordered = self._stretches, sorted(words)
        for at in range(0, len(ordered), _LEARNT):
            parts = {word: self._parts(word) for word in ordered[at : at + _LEARNT]}
            self._learn(have.missing({x for found in parts.values() for x in found}))
            for word, found in parts.items():
                self._words[word] = have[found[0]] if len(found) == 1 else b"".join([have[x] for x in found])
            have.turn_over()

    def _meets(self, before: str, text: str, after: str) -> tuple[int, int] | None:
        """First and last position of `text`, its ends included, at which all paths meet."""
        whole, shift, joined = before + text + after[:1], len(before), self._joined
        places = range(0 if before else 1, len(text) + (1 if after else 0))
        apart = lambda p: whole[p + shift - 1 : p + shift + 1] not in joined
        first = next((p for p in places if apart(p)), None)
        return None if first is None else (first, next(p for p in reversed(places) if apart(p)))

    def encode_all(self, texts: Sequence[str]) -> list[np.ndarray]:
        """Ids of normalised texts, or of stretches that begin and end where paths meet."""
        split, have = [self._split(text) for text in texts], self._words
        self._learn_words(have.missing(set().union(*split)))
        found = [np.frombuffer(b"".join(map(have.__getitem__, words)), np.int32) for words in split]
        have.turn_over()
        return found

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def forget(self) -> None:
        """Give up the words and stretches kept so far: a worker stays for other steps and need not hold them."""
        self._words = _Cache(_WORDS_KEPT)
        self._stretches = _Cache(_STRETCHES_KEPT)

    def chunks(self, text: str, size: int) -> list[tuple[str, int, str, str]]:
        """The chunks of a normalised text: character before, offset, text, and what follows as far as a piece reaches."""
        found, meet = [], 0
        for at in range(0, max(len(text), 1), size):
            meet = next((p for p in range(at, meet, -1) if text[p - 1 : p + 1] not in self._joined), meet)
            found.append((text[max(at - 1, 0) : at], at - meet, text[at : at + size], text[at + size : at + size + self.longest - 1]))
        return found

    def matrix(self, before: str, offset: int, text: str, after: str) -> list[int]:
        """The chunk's transfer matrix, row by row; weights are relative to the largest.

        States at either end are 0 to `longest` - 1 characters; `before` is the character
        before the chunk, `offset` as for a path, `after` the first `longest` - 1 characters behind it.
        """
        states, size = self.longest, len(text)
        meets = self._meets(before, text, after)
        long = text + after
        rows: list[list[int | None]] = []
        if meets:
            first, last = meets
            tail = self._reach(long[last:], 0, size - last)[0]
            ends = [tail[size - last + j] if size - last + j < len(tail) else None for j in range(states)]
            for i in range(states):
                head = self._reach(long[:first], i, first, offset)[0][-1] if i <= first else None
                rows.append([None if head is None or end is None else head + end for end in ends])
        else:
            for i in range(states):
                if i >= size:  # the piece before reaches over this whole chunk
                    rows.append([0 if j == i - size else None for j in range(states)])
                else:
                    best = self._reach(long, i, size, offset)[0]
                    rows.append([best[size + j] if size + j < len(best) else None for j in range(states)])
        top = max((w for row in rows for w in row if w is not None), default=0)
        return [_NEVER if w is None else max(w - top, _NEVER // 2) for row in rows for w in row]

    def stretch(self, before: str, offset: int, text: str, after: str, enter: int, leave: int) -> np.ndarray:
        """Ids of the pieces that begin in a chunk, given the states at its ends."""
        size = len(text)
        if enter >= size:
            return np.empty(0, np.int32)
        long = text + after
        meets = self._meets(before, text, after)
        if not meets:
            return np.frombuffer(self._path(long, enter, size, size + leave, offset), np.int32)
        first, last = meets
        head = self._path(long[:first], enter, first, first, offset)
        tail = self._path(long[last:], 0, size - last, size + leave - last)
        return np.frombuffer(head + self.encode(text[first:last]).tobytes() + tail, np.int32)

    def score(self, ids: np.ndarray) -> float:
        return float(self._score_of[ids].sum())

    def decode(self, ids: np.ndarray) -> str:
        """The normalised text, with spaces as the model writes them."""
        return b"".join(map(self.texts.__getitem__, ids.tolist())).decode("utf-8", "replace")


def _words(joined: set[str]) -> re.Pattern[str]:
    """Matches words with the spaces before them, their marks apart.

    A piece may join a few letters to marks (an underscore, say). A stretch of either that
    one of these follows or begins goes as far as the next space.
    """
    letter = re.compile(r"\w").match
    mixed = [pair for pair in joined if SPACE not in pair and bool(letter(pair[0])) != bool(letter(pair[1]))]
    both = {c for pair in mixed for c in pair if letter(c)}
    some = "".join(map(re.escape, sorted(both)))
    alone = f"(?![{some}])" if both else ""
    return re.compile(f"{SPACE}*+(?:[^\\W{some}]++{alone}|[^\\w{SPACE}]++{alone}|[^{SPACE}]++)|{SPACE}++")


def product(matrices: np.ndarray) -> np.ndarray:
    """The max-plus product of matrices (chunk, state, state), relative to its largest entry."""
    whole = matrices[0]
    for matrix in matrices[1:]:
        left, right = whole[:, :, None], matrix[None]
        through = np.where((left <= _NEVER // 2) | (right <= _NEVER // 2), _NEVER, left + right)
        whole = through.max(axis=1)
        reached = whole > _NEVER // 2
        whole = np.where(reached, whole - whole.max(), _NEVER)
    return whole


def boundary_states(matrices: np.ndarray, enter: int = 0, leave: int = 0) -> list[tuple[int, int]]:
    """The best path's state at both ends of every matrix of a run, given those of the run.

    A row vector is multiplied through the run; only differences count, so it is kept
    relative to its largest entry.
    """
    states = matrices.shape[1]
    vector = np.full(states, _NEVER, np.int64)
    vector[enter] = 0
    came = []
    for matrix in matrices:
        through = vector[:, None] + matrix
        through[(vector[:, None] <= _NEVER // 2) | (matrix <= _NEVER // 2)] = _NEVER
        came.append(through.argmax(axis=0))
        vector = through.max(axis=0)
        reached = vector > _NEVER // 2
        vector[reached] -= vector[reached].max()
    found, state = [], leave
    for back in reversed(came):
        found.append((int(back[state]), state))
        state = int(back[state])
    return found[::-1]


@functools.lru_cache(maxsize=2)
def _loaded(model: bytes) -> Pieces:
    return Pieces(model)


_RESULT = "n_tokens bigint, score double, tokens array<int>, round_trip boolean"


def _columns(pieces: Pieces, ids: list[np.ndarray], normal: list[str]) -> list[pa.Array]:
    """n_tokens, score, tokens and round_trip as columns."""
    sizes = np.array([len(x) for x in ids], np.int64)
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    values = np.concatenate(ids) if ids else np.empty(0, np.int32)
    return [
        pa.array(sizes),
        pa.array([pieces.score(x) for x in ids], pa.float64()),
        pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32())),
        pa.array([pieces.decode(x) == text for x, text in zip(ids, normal)], pa.bool_()),
    ]


def _finish(pieces: Pieces, ids: np.ndarray, normal: str) -> tuple:
    return len(ids), pieces.score(ids), ids, pieces.decode(ids) == normal


def encode_documents(docs: DataFrame, model_path: str = MODEL_PATH, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """The pieces of every text.

    Returns one row per row of `docs`: doc_id, n_chars, n_tokens, score (sum of the
    pieces' scores), tokens (ids), round_trip (decoding gives the normalised text). A text
    that is null or empty has no token and score 0. Characters the model lacks become
    their bytes, or the unknown id if it has no bytes. Equal scores are decided by a hash
    of pieces and places, so a result does not depend on `chunk_chars`. Repeated rows are
    each returned. An empty table gives an empty result. Columns of `docs` other than
    doc_id and text are not looked at. The model's file is read by the driver.
    """
    spark = docs.sparkSession
    with open(model_path, "rb") as file:
        model = file.read()
    shared = spark.sparkContext.broadcast(model)
    longest = _loaded(model).longest
    if chunk_chars < longest:
        raise ValueError(f"chunks need {longest} characters, the length of the longest piece")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n_chars = F.char_length("text").cast("bigint")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _loaded(shared.value)
        for batch in batches:
            ends = np.cumsum(batch.column("n_chars").to_numpy()) // _STEP_CHARS
            edges = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), batch.num_rows]
            for begin, end in zip(edges, edges[1:]):
                part = batch.slice(begin, end - begin)
                normal = [pieces.normalize(text) for text in part.column("text").to_pylist()]
                ids = pieces.encode_all(normal)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("n_chars"), *_columns(pieces, ids, normal)],
                    names=["doc_id", "n_chars", "n_tokens", "score", "tokens", "round_trip"],
                )
        pieces.forget()

    small = rows.where(n_chars <= chunk_chars).select("doc_id", n_chars.alias("n_chars"), "text")
    named = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_chars bigint, "
    small = small.mapInArrow(encode, named + _RESULT)
    giant = _encode_giant(rows.where(n_chars > chunk_chars).withColumn("n_chars", n_chars), shared, longest, chunk_chars)
    return small.unionAll(giant.select("doc_id", "n_chars", "e.*"))


def _encode_giant(rows: DataFrame, shared: Broadcast, longest: int, chunk_chars: int) -> DataFrame:
    @F.pandas_udf("array<struct<before: string, offset: bigint, text: string, after: string>>")
    def cut(texts: pd.Series) -> pd.Series:
        pieces = _loaded(shared.value)
        names = ("before", "offset", "text", "after")
        return texts.map(lambda text: [dict(zip(names, c)) for c in pieces.chunks(pieces.normalize(text), chunk_chars)])

    @F.pandas_udf("array<bigint>")
    def matrix(before: pd.Series, offset: pd.Series, text: pd.Series, after: pd.Series) -> pd.Series:
        pieces = _loaded(shared.value)
        return pd.Series([pieces.matrix(*row) for row in zip(before, offset.tolist(), text, after)], dtype=object)

    def cubes(run: pd.DataFrame) -> np.ndarray:
        return np.stack([np.asarray(m, np.int64).reshape(longest, longest) for m in run["matrix"]])

    def combine(run: pd.DataFrame) -> pd.DataFrame:
        whole = product(cubes(run.sort_values("k")))
        return pd.DataFrame({"rid": run["rid"].iloc[:1], "k": run["run"].iloc[:1], "matrix": [whole.ravel()]})

    def hand_down(run: pd.DataFrame) -> pd.DataFrame:
        ordered = run.sort_values("k")
        states = boundary_states(cubes(ordered), int(run["enter"].iloc[0]), int(run["leave"].iloc[0]))
        return pd.DataFrame(
            {"rid": ordered["rid"], "k": ordered["k"], "enter": [a for a, _ in states], "leave": [b for _, b in states]}
        )

    @F.pandas_udf("array<int>")
    def trace(
        before: pd.Series, offset: pd.Series, text: pd.Series, after: pd.Series, enter: pd.Series, leave: pd.Series
    ) -> pd.Series:
        pieces = _loaded(shared.value)
        places = zip(before, offset.tolist(), text, after, enter.tolist(), leave.tolist())
        found = pd.Series([pieces.stretch(*row) for row in places], dtype=object)
        pieces.forget()
        return found

    @F.pandas_udf(_RESULT)
    def finish(tokens: pd.Series, normal: pd.Series) -> pd.DataFrame:
        pieces = _loaded(shared.value)
        found = [_finish(pieces, np.asarray(ids, np.int32), text) for ids, text in zip(tokens, normal)]
        return pd.DataFrame(found, columns=["n_tokens", "score", "tokens", "round_trip"])

    numbered = rows.select("doc_id", "n_chars", F.monotonically_increasing_id().alias("rid"), cut("text").alias("chunks"))
    chunks = numbered.select("doc_id", "n_chars", "rid", F.posexplode("chunks").alias("k", "chunk"))
    chunks = stored(chunks.select("doc_id", "n_chars", "rid", "k", "chunk.*"))  # fixes rid
    given = ["before", "offset", "text", "after"]
    spread = chunks.repartition("rid", "k")
    run = F.expr(f"cast(k div {RUN} as int)")
    levels = [stored(spread.select("rid", "k", matrix(*given).alias("matrix")))]
    last = levels[0].agg(F.max("k")).first()[0] or 0
    while last:
        runs = levels[-1].withColumn("run", run).groupBy("rid", "run")
        levels.append(stored(runs.applyInPandas(combine, "rid bigint, k int, matrix array<bigint>")))
        last //= RUN
    states = levels[-1].select("rid", "k", F.lit(0).alias("enter"), F.lit(0).alias("leave"))
    for level in levels[-2::-1]:
        runs = level.withColumn("run", run).join(states.withColumnRenamed("k", "run"), ["rid", "run"])
        states = stored(runs.groupBy("rid", "run").applyInPandas(hand_down, "rid bigint, k int, enter int, leave int"))
    traced = spread.join(states, ["rid", "k"]).select(
        "rid", "k", "doc_id", "n_chars", "text", trace(*given, "enter", "leave").alias("ids")
    )
    parts = F.array_sort(F.collect_list(F.struct("k", "ids", "text"))).alias("parts")
    whole = traced.groupBy("rid").agg(F.max("doc_id").alias("doc_id"), F.max("n_chars").alias("n_chars"), parts)
    encoded = finish(F.flatten("parts.ids"), F.array_join("parts.text", ""))
    return whole.select("doc_id", "n_chars", encoded.alias("e"))


def decode_documents(encoded: DataFrame, model_path: str = MODEL_PATH) -> DataFrame:
    """`encoded` with a column text: the decoded tokens, without the space the model puts first. Null tokens give null."""
    with open(model_path, "rb") as file:
        shared = SparkSession.active().sparkContext.broadcast(file.read())

    @F.pandas_udf("string")
    def decode(tokens: pd.Series) -> pd.Series:
        pieces = _loaded(shared.value)
        return tokens.map(
            lambda ids: None if ids is None else pieces.decode(np.asarray(ids, np.int32)).removeprefix(SPACE).replace(SPACE, " ")
        )

    return encoded.withColumn("text", decode("tokens"))
