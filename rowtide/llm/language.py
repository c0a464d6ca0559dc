"""Languages of a document as a mixture, estimated from its letter n-grams.

A model holds, for each language, the smoothed probabilities of hashed three-letter
sequences. A document's n-grams are taken as draws from a mixture of languages.
Expectation maximisation estimates a mixture's proportions. Sets of languages grow from the
best single one by the language that raises the log likelihood most, and the set stays whose
log likelihood is largest after a penalty for each further language, which grows with the
logarithm of the length. Growth ends when no larger set can win: the log likelihood is
concave, so its slope bounds what all other languages together can add.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

BUCKETS = 1 << 15
MAX_LANGUAGES = 1000  # bounds the model: BUCKETS x MAX_LANGUAGES numbers at most
SMOOTHING = 0.5
UNDETERMINED = "und"
_SPACE = 32
_MOST_STEPS = 40
_TRIED = (0.02, 0.1, 0.3, 0.5)  # shares at which further languages are compared
_OVERLAP = 3.0  # a letter takes part in three n-grams: likelihoods count a third


@functools.cache
def _folded() -> np.ndarray:
    """For each code point: its lower-case letter, or a space if it is no letter."""
    table = np.full(0x110000, _SPACE, np.uint32)
    for code in range(0x110000):
        char = chr(code)
        if char.isalpha():
            small = char.lower()
            table[code] = ord(small) if len(small) == 1 else code
    return table


def ngrams(text: str | None, buckets: int = BUCKETS) -> np.ndarray:
    """Hashed three-letter sequences around every letter; words are padded with spaces."""
    codes = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = np.concatenate(([_SPACE], _folded()[codes], [_SPACE])).astype(np.uint32)
    middle = letters[1:-1]
    mixed = letters[:-2] * np.uint32(2654435761) ^ middle * np.uint32(2246822519) ^ letters[2:] * np.uint32(3266489917)
    mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(668265263)
    return ((mixed >> np.uint32(7)) % np.uint32(buckets))[middle != _SPACE]


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    probabilities: np.ndarray  # buckets x languages

    def mixture(self, text: str | None) -> tuple[list[str], list[float]]:
        """The document's languages and their proportions, largest first; nothing without a letter."""
        grams = ngrams(text, len(self.probabilities))
        if not len(grams) or not self.languages:
            return [], []
        if len(grams) > 4096:
            counts = np.bincount(grams, minlength=len(self.probabilities))
            grams = np.flatnonzero(counts)
            weights = counts[grams].astype(float)
        else:
            weights = np.ones(len(grams))
        likelihood = self.probabilities[grams]
        size = weights.sum()
        single = weights @ np.log(likelihood)
        some, part = [int(single.argmax())], np.ones(1)
        fit = single[some[0]]
        chosen, shares, best = some, part, fit / _OVERLAP
        penalty = np.log(size + 1)
        while len(some) < len(self.languages):
            now = likelihood[:, some] @ part
            slopes = likelihood.T @ (weights / now) - size
            if (fit + slopes.max()) / _OVERLAP - len(some) * penalty <= best:
                break
            others = np.flatnonzero(slopes > 0)
            others = others[~np.isin(others, some)]
            if not len(others):
                break
            ratio = likelihood[:, others] / now[:, None] - 1
            gains = np.max([weights @ np.log1p(t * ratio) for t in _TRIED], axis=0)
            some = [*some, int(others[gains.argmax()])]
            part, fit = _proportions(likelihood[:, some], weights)
            score = fit / _OVERLAP - (len(some) - 1) * penalty
            if score > best:
                chosen, shares, best = some, part, score
        ranked = sorted(zip(-shares, (self.languages[i] for i in chosen)))
        return [name for _, name in ranked], [float(-share) for share, _ in ranked]


def _proportions(likelihood: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, float]:
    """Mixture proportions by expectation maximisation, and the log likelihood."""
    shares = np.full(likelihood.shape[1], 1 / likelihood.shape[1])
    size = weights.sum()
    for _ in range(_MOST_STEPS):
        ahead = shares * (likelihood.T @ (weights / (likelihood @ shares))) / size
        moved = np.abs(ahead - shares).max()
        shares = ahead
        if moved < 1e-3:
            break
    shares /= shares.sum()
    return shares, float(weights @ np.log(likelihood @ shares))


def fit_languages(labelled: DataFrame, text: str = "text", lang: str = "lang", buckets: int = BUCKETS) -> LanguageModel:
    """N-gram counts of every labelled row, smoothed. Rows without a label are left out.

    Each task adds up its own counts, Spark adds up those of all tasks, and the driver
    receives one number for each language and n-gram that occurs.
    """
    rows = labelled.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    names = [r[0] for r in rows.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect()]
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    names = tuple(sorted(names))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, of in batch.groupby("lang")["text"]:
                have = sums.setdefault(name, np.zeros(buckets, np.int64))
                for one in of:
                    have += np.bincount(ngrams(one, buckets), minlength=buckets)
        for name, have in sums.items():
            at = np.flatnonzero(have)
            yield pd.DataFrame({"lang": name, "gram": at.astype(np.int32), "n": have[at]})

    counted = rows.mapInPandas(count, "lang string, gram int, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    table = np.full((buckets, len(names)), SMOOTHING)
    found = counted.toPandas()
    column = {name: i for i, name in enumerate(names)}
    np.add.at(table, (found["gram"].to_numpy(dtype=np.int64), found["lang"].map(column).to_numpy(dtype=np.int64)), found["n"].to_numpy(dtype=float))
    return LanguageModel(names, table / table.sum(axis=0))


def mixture_of(text: Column, model: LanguageModel) -> Column:
    """Struct of lang_pred, score (its proportion), languages and proportions ("en,fr" and an array)."""
    shared = SparkSession.active().sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, languages string, proportions array<double>")
    def detect(texts: pd.Series) -> pd.DataFrame:
        known = shared.value
        found = [known.mixture(t) for t in texts]
        return pd.DataFrame(
            {
                "lang_pred": [names[0] if names else UNDETERMINED for names, _ in found],
                "score": [shares[0] if shares else 0.0 for _, shares in found],
                "languages": [",".join(names) for names, _ in found],
                "proportions": [shares for _, shares in found],
            }
        )

    return detect(text)


def fold_of(doc_id: Column, folds: int = 3) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The columns of `docs` and lang_pred, score, languages, proportions.

    A text that is null or has no letter is `und` with score 0 and no language, and so is
    every text if the model has seen no labelled row. A score is the proportion of
    lang_pred, so 1 for a text of one language. Every row of `docs` gives one row, in
    whatever numbers it is repeated; columns of these names in `docs` are replaced.
    """
    return docs.withColumn("__found", mixture_of(F.col("text"), model)).withColumns(
        {c: F.col(f"__found.{c}") for c in ("lang_pred", "score", "languages", "proportions")}
    ).drop("__found")


def held_out_predictions(docs: DataFrame, folds: int = 3, test_fold: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """Learn from labelled rows outside a fold of ids, predict every row.

    Columns: doc_id, held_out, lang_pred, score, languages, proportions. A row without a
    doc_id belongs to no fold: it is neither learned from nor held out.
    """
    fold = fold_of(F.col("doc_id"), folds)
    model = fit_languages(docs.where(fold != test_fold), buckets=buckets)
    marked = docs.select("doc_id", "text", F.coalesce(fold == test_fold, F.lit(False)).alias("held_out"))
    return identify(marked, model).drop("text")
