"""Token counts of a corpus, for every context limit at once.

Documents are added up by their encoded length: an exact histogram, far smaller than the
corpus. Sums over the lengths above a limit then answer how many documents are longer, and
how many tokens remain when every document is truncated there.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Sequence

import pandas as pd
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import stored

RANKS_PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the public 50k byte-level vocabulary splits a text.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK = 4096
QUANTILES = (0.5, 0.9, 0.99, 0.999)
# White space as the pattern's \s has it. A longer run is a piece but for its last character, which the next
# word may take; so it can be cut out, as the pattern's engine has no room for very long ones.
LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{4096,}")


@functools.lru_cache(maxsize=2)
def _encodings(ranks: bytes, split: str) -> tuple[tiktoken.Encoding, tiktoken.Encoding]:
    """The encoding, and one that takes a whole text for a piece."""
    pairs = [line.split() for line in ranks.splitlines() if line]
    merges = {base64.b64decode(t): int(r) for t, r in pairs}
    return tuple(
        tiktoken.Encoding(f"lengths {k}", pat_str=pattern, mergeable_ranks=merges, special_tokens={})
        for k, pattern in enumerate((split, "(?s:.+)"))
    )


def count_tokens(text: str, ranks: bytes, split: str = SPLIT) -> int:
    """The number of tokens, also of texts with very long runs of white space. `split` treats such runs as `SPLIT` does."""
    words, whole = _encodings(ranks, split)
    n, begin = 0, 0
    for run in LONG_SPACE.finditer(text):
        end = run.end() - (run.end() < len(text))
        n += len(words.encode_ordinary(text[begin : run.start()])) + len(whole.encode_ordinary(text[run.start() : end]))
        begin = end
    return n + len(words.encode_ordinary(text[begin:]))


def token_count(text: Column, ranks_path: str = RANKS_PATH, split: str = SPLIT) -> Column:
    """Number of tokens of a text; null and empty texts have none. The driver reads the vocabulary file."""
    with open(ranks_path, "rb") as file:
        shared = SparkSession.active().sparkContext.broadcast(file.read())

    @F.pandas_udf("bigint")
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series([count_tokens(t, shared.value, split) if t else 0 for t in texts], dtype="int64")

    return count(text)


def length_histogram(docs: DataFrame, **tokenizer) -> DataFrame:
    """(n_tokens, n_docs) for every length that occurs. Repeated rows count each; so do null texts, with length 0.

    Texts count whole, whatever their length and runs of characters. Columns of `docs` other
    than text are not looked at. An empty table gives an empty result.
    """
    return docs.select(token_count(F.col("text"), **tokenizer).alias("n_tokens")).groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def suffix_sums(histogram: DataFrame, block: int = BLOCK) -> DataFrame:
    """What a context limit of each length that occurs would mean.

    Columns: n_tokens (the limit), n_docs (of exactly this length), docs_longer,
    tokens_longer (of the longer documents, whole), tokens_kept (of all, truncated at the
    limit), tokens_lost, share_whole (of the documents, not truncated), docs_all, tokens_all,
    and quantiles: which of `QUANTILES` this length is, as text, empty if none. An empty
    histogram gives an empty result.

    Lengths are summed by block first. The one window over all rows has a row for each
    block; the others are within a block.
    """
    rows = stored(histogram.withColumn("block", F.floor(F.col("n_tokens") / block)))
    tokens = F.col("n_tokens") * F.col("n_docs")
    later = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = rows.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum(tokens).alias("t")).select(
        "block",
        F.coalesce(F.sum("d").over(later), F.lit(0)).alias("docs_after"),
        F.coalesce(F.sum("t").over(later), F.lit(0)).alias("tokens_after"),
        F.sum("d").over(everything).alias("docs_all"),
        F.sum("t").over(everything).alias("tokens_all"),
    )
    longer = Window.partitionBy("block").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.join(stored(blocks), "block").select(
        "n_tokens",
        "n_docs",
        (F.col("docs_after") + F.coalesce(F.sum("n_docs").over(longer), F.lit(0))).alias("docs_longer"),
        (F.col("tokens_after") + F.coalesce(F.sum(tokens).over(longer), F.lit(0))).alias("tokens_longer"),
        "docs_all",
        "tokens_all",
    )
    lost = F.col("tokens_longer") - F.col("n_tokens") * F.col("docs_longer")
    not_longer = F.col("docs_all") - F.col("docs_longer")
    shares = [(F.lit(q), (not_longer / F.col("docs_all") >= q) & ((not_longer - F.col("n_docs")) / F.col("docs_all") < q)) for q in QUANTILES]
    reached = F.concat_ws(",", *[F.when(here, q.cast("string")) for q, here in shares])
    return summed.select(
        "n_tokens",
        "n_docs",
        "docs_longer",
        "tokens_longer",
        (F.col("tokens_all") - lost).alias("tokens_kept"),
        lost.alias("tokens_lost"),
        (not_longer / F.col("docs_all")).alias("share_whole"),
        "docs_all",
        "tokens_all",
        reached.alias("quantiles"),
    )


def context_limits(sums: DataFrame, limits: Sequence[int]) -> DataFrame:
    """(context_limit, docs_longer, tokens_kept) for any limits, whether a document has that length or not."""
    asked = F.array(*[F.lit(int(k)).cast("bigint") for k in limits])
    each = sums.select("n_tokens", "n_docs", F.explode(asked).alias("context_limit"))
    longer = F.col("n_tokens") > F.col("context_limit")
    return each.groupBy("context_limit").agg(
        F.sum(F.when(longer, F.col("n_docs")).otherwise(0)).alias("docs_longer"),
        F.sum(F.least("n_tokens", "context_limit") * F.col("n_docs")).alias("tokens_kept"),
    )


def length_quantiles(sums: DataFrame, quantiles: Sequence[float]) -> dict[float, int | None]:
    """For each share of the documents, the least length that so many do not exceed; None without documents."""
    row = sums.agg(*[F.min(F.when(F.col("share_whole") >= q, F.col("n_tokens"))).alias(str(i)) for i, q in enumerate(quantiles)]).first()
    return {q: row[i] for i, q in enumerate(quantiles)}
