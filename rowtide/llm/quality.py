"""Document quality with evidence from the site around it: hierarchical empirical Bayes.

A logistic classifier scores each document by its text. Its scores are averaged by path
and by host, and each average is shrunk toward the level above: a path's to its host's, a
host's to the whole corpus's. How strongly is estimated from the data: the less the true
rates differ between groups, the more a small group is drawn to the level above. A
document's final score combines its own evidence with its path's shrunken rate as prior,
from which its own score is left out, so that no evidence counts twice.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import stored

SAMPLE_ROWS = 20_000  # labelled rows the classifier is fitted on, about, where there are more
RIDGE = 1.0
FEATURES = (
    "log_words", "word_length", "long_words", "capitals", "digits", "spaces", "line_length", "short_lines",
    "marks", "sentence_marks", "odd_marks", "marked_words", "bars", "distinct_words", "repeated_lines", "letters",
)
_SENTENCE = np.array([ord(c) for c in ".,;:!?"], np.uint32)


def text_features(text: str | None) -> list[float]:
    """Shares and means that tell running text from tables, lists of marks and repeated lines."""
    text = text or ""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    size = max(len(codes), 1)
    lower, upper = (codes >= 97) & (codes <= 122), (codes >= 65) & (codes <= 90)
    letters, digits = lower | upper | (codes >= 0xC0), (codes >= 48) & (codes <= 57)
    blank = (codes == 32) | ((codes >= 9) & (codes <= 13))
    marks = ~(letters | digits | blank)
    sentence = np.isin(codes, _SENTENCE)
    words, lines = text.split(), text.split("\n")
    count, rows = max(len(words), 1), max(len(lines), 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    odd = marks & ~sentence
    # A word that ends in an odd mark: the mark is followed by a blank or the end.
    ends = odd & np.append(blank[1:], True)[: len(codes)] if len(codes) else odd
    return [
        float(np.log1p(len(words))),
        float(lengths.mean()) if len(words) else 0.0,
        float((lengths > 15).mean()) if len(words) else 0.0,
        float(upper.sum()) / count,
        float(digits.sum()) / size,
        float(blank.sum()) / size,
        float(np.log1p(size / rows)),
        sum(len(line) < 20 for line in lines) / rows,
        float(marks.sum()) / size,
        float(sentence.sum()) / count,
        float(odd.sum()) / size,
        float(ends.sum()) / count,
        text.count("|") / count,
        len(set(words)) / count,
        1 - len(set(lines)) / rows,
        float(letters.sum()) / size,
    ]


def features(text: Column) -> Column:
    @F.pandas_udf("array<double>")
    def measured(texts: pd.Series) -> pd.Series:
        return texts.map(text_features)

    return measured(text)


@dataclass(frozen=True)
class Classifier:
    """Logistic regression over standardised features; `base` is the rate among the rows it was fitted on."""

    center: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    intercept: float
    base: float

    def logit(self, measured: Column) -> Column:
        terms = [
            (F.element_at(measured, i + 1) - c) * (w / s)
            for i, (c, s, w) in enumerate(zip(self.center, self.scale, self.weights))
        ]
        total = F.lit(self.intercept)
        for term in terms:
            total = total + term
        return F.greatest(F.least(total, F.lit(20.0)), F.lit(-20.0))


def fit_classifier(measured: np.ndarray, good: np.ndarray, times: np.ndarray, ridge: float = RIDGE) -> Classifier:
    """Newton's method on the penalised likelihood. Without rows of both kinds all evidence is neutral.

    A row stands for `times` labels, of which the share `good` is good.
    """
    width = len(FEATURES)
    count, total = (good * times).sum(), times.sum()
    rate = (count + 0.5) / (total + 1)
    if not 0 < count < total:
        return Classifier((0.0,) * width, (1.0,) * width, (0.0,) * width, float(np.log(rate / (1 - rate))), float(rate))
    center = np.average(measured, axis=0, weights=times)
    scale = np.sqrt(np.average((measured - center) ** 2, axis=0, weights=times))
    scale = np.where(scale > 1e-9, scale, 1.0)
    x = np.column_stack([np.clip((measured - center) / scale, -8, 8), np.ones(len(good))])
    penalty = np.diag([ridge] * width + [0.0])
    w = np.zeros(width + 1)
    w[-1] = np.log(rate / (1 - rate))
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (times * (good - p)) - penalty @ w
        step = np.linalg.solve((x * (times * p * (1 - p))[:, None]).T @ x + penalty + 1e-9 * np.eye(width + 1), slope)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return Classifier(tuple(center), tuple(scale), tuple(w[:-1]), float(w[-1]), float(rate))


def _strength(groups: DataFrame, rate: str, above: str, count: str) -> float:
    """How many documents the level above counts for in each group.

    Method of moments for rates with a beta prior of strength k: the expected square of a
    group's deviation is spread * (1 / n + (n - 1) / (n * (k + 1))).
    """
    apart, spread = F.col(rate) - F.col(above), F.col(above) * (1 - F.col(above))
    extra, possible = groups.agg(
        F.sum(F.col(count) * apart * apart - spread), F.sum((F.col(count) - 1) * spread)
    ).first()
    if not extra or not possible or possible <= 0 or extra <= 0:
        return 1e6
    share = min(extra / possible, 0.5)
    return max(1 / share - 1, 1.0)


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    host: Column | None = None,
    path: Column | None = None,
    keep_at: float = 0.5,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """Quality of every document given its text and where it comes from.

    `host` is the column source, `path` the column lang within it, if not given. `labels`
    has doc_id and quality (1 good, 0 bad); rows with a null in either are left out, and
    of a doc_id labelled more than once each label counts. The classifier is fitted on all
    labelled documents, or, where there are more than `sample_rows` different ones, on a
    sample by a hash that is expected to have so many; all other figures are over all
    documents.

    Returns one row per row of `docs`: doc_id, text_score (by the classifier alone),
    host_rate, path_rate (shrunken rates of good documents, of all the host's and path's
    rows), quality (the text with what the host's and path's other rows say, 0 to 1), keep
    (quality of at least `keep_at`). Null texts are empty texts;
    null hosts and paths are groups of their own. Without labels every score is the same.
    An empty table gives an empty result. Other columns of `docs` are not looked at.
    """
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    measured = stored(docs.select("doc_id", host.alias("host"), path.alias("path"), features(F.col("text")).alias("x")))
    given = [F.sum((F.col("quality") > 0).cast("double")).alias("good"), F.count("*").alias("times")]
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(*given)
    labelled = measured.join(known, "doc_id").groupBy("doc_id", "x").agg(F.sum("good").alias("good"), F.sum("times").alias("times"))
    labelled = stored(labelled)
    share = min(1.0, sample_rows / max(labelled.count(), 1))
    drawn = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.col("x")), F.lit(1 << 30)) < int(share * (1 << 30))
    sample = labelled.where(drawn).select("x", "good", "times").orderBy("x", "good", "times").toPandas()
    x = np.array(sample["x"].tolist(), float).reshape(len(sample), len(FEATURES))
    times = sample["times"].to_numpy(float)
    model = fit_classifier(x, sample["good"].to_numpy(float) / times, times)

    evidence = model.logit(F.col("x"))
    scored = measured.select("doc_id", "host", "path", evidence.alias("logit")).withColumn("p", 1 / (1 + F.exp(-F.col("logit"))))
    paths = stored(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("good")))
    total = paths.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    overall = min(max((total["good"] or 0.0) / (total["n"] or 1), 1e-4), 1 - 1e-4)

    hosts = stored(
        paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).withColumn("rate", F.col("good") / F.col("n"))
        .withColumn("above", F.lit(overall))
    )
    k_host = _strength(hosts, "rate", "above", "n")
    host_rates = hosts.select("host", F.col("n").alias("host_n"), F.col("good").alias("host_good"), ((F.col("good") + k_host * overall) / (F.col("n") + k_host)).alias("host_rate"))
    sited = paths.join(host_rates, paths["host"].eqNullSafe(host_rates["host"])).drop(host_rates["host"])
    sited = stored(sited.withColumn("rate", F.col("good") / F.col("n")))
    k_path = _strength(sited, "rate", "host_rate", "n")
    rates = stored(
        sited.select(
            "host", "path", "n", "good", "host_n", "host_good", "host_rate",
            ((F.col("good") + k_path * F.col("host_rate")) / (F.col("n") + k_path)).alias("path_rate"),
        )
    )
    same = scored["host"].eqNullSafe(rates["host"]) & scored["path"].eqNullSafe(rates["path"])
    # What the others say: both rates without the document's own score. Strengths are 1 or more.
    host_others = (F.col("host_good") - F.col("p") + k_host * overall) / (F.col("host_n") - 1 + k_host)
    others = (F.col("good") - F.col("p") + k_path * host_others) / (F.col("n") - 1 + k_path)
    prior = F.least(F.greatest(others, F.lit(1e-4)), F.lit(1 - 1e-4))
    base = float(np.log(model.base / (1 - model.base)))
    combined = F.col("logit") - base + F.log(prior / (1 - prior))
    return scored.join(rates, same, "left").select(
        scored["doc_id"],
        F.col("p").alias("text_score"),
        "host_rate",
        "path_rate",
        (1 / (1 + F.exp(-combined))).alias("quality"),
        (1 / (1 + F.exp(-combined)) >= keep_at).alias("keep"),
    )
