"""The pipeline's decisions about rows: which stay, and how often.

Every function takes and returns a table of documents with its own columns; extra columns,
also ones with names used inside, go along. An empty table gives an empty result.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .blocks import exact_duplicates
from .common import lower_ascii, stored
from .language import UNDETERMINED, fit_languages, fold_of, identify
from .mixing import plan_mix, sized, with_copies
from .simhash import near_duplicate_rows


def _key(doc_id: Column, sha: Column) -> Column:
    return F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), sha)


def _has_letter(text: Column) -> Column:
    """Whether a text has a letter as the model sees them, so that a language can be told."""

    @F.pandas_udf("boolean")
    def lettered(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t is not None and any(map(str.isalpha, t))).astype(bool)

    return lettered(text)


def only(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of `docs` that `kept` (doc_id, text_sha256) names, each once.

    Of rows with one id and one text the first by the remaining columns stays, null first.
    """
    sha = F.sha2(F.encode(lower_ascii(F.col("text")), "UTF-8"), 256)
    named = stored(kept.select(_key(F.col("doc_id"), F.col("text_sha256")).alias("__key")).distinct())
    rows = docs.select(F.struct(*docs.columns).alias("__row"), _key(F.col("doc_id"), sha).alias("__key"))
    rows = rows.join(named, "__key", "left_semi")
    others = [F.col(f"__row.`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    first = F.row_number().over(Window.partitionBy("__key").orderBy(*others, F.col("__row.text")))
    return rows.withColumn("__nth", first).where("__nth = 1").select("__row.*")


def told_languages(docs: DataFrame) -> DataFrame:
    """Documents of which a language can be told. Texts without a letter, empty or null, go.

    The model learns from the rows with a label outside one third of the ids. If there are
    none, letters alone decide. Repeated rows are each decided; lang may be null.
    """
    model = fit_languages(docs.where(fold_of(F.col("doc_id")) != 1))
    if not model.languages:
        return docs.where(_has_letter(F.col("text")))
    found = identify(docs.select(F.struct(*docs.columns).alias("__row"), "text"), model)
    return found.where(F.col("lang_pred") != UNDETERMINED).select("__row.*")


def unlike_documents(docs: DataFrame) -> DataFrame:
    """One of the documents equal after lower-casing A to Z: that with the largest doc_id, a null below all.

    Null texts count as empty ones. Of repeated rows one stays.
    """
    return only(docs, exact_duplicates(docs).where("kept"))


def apart_documents(docs: DataFrame) -> DataFrame:
    """One document of each group of near copies, linked by SimHash fingerprints within two bits.

    That with the smallest doc_id stays, a null above all; of several, the one with the
    smallest hash of its text. Texts without a word have fingerprint zero and are a group.
    """
    return only(docs, near_duplicate_rows(docs).where("kept"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """Documents as often as the mix takes them, up to three times, or not at all. Null texts have no word and go."""
    plan = plan_mix(stored(sized(docs)))
    rows = docs.select(F.struct(*docs.columns).alias("__row"), "doc_id", "source", "text")
    taken = with_copies(sized(rows, "__row"), plan).where("copies > 0")
    return taken.select("__row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("__row.*")
