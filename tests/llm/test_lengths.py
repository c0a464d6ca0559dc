"""Length sums: against counting the documents one by one."""

import base64
import random
from pathlib import Path

import pytest
import tiktoken

from messy import ROWS, empty, messy
from rowtide.llm.lengths import RANKS_PATH, SPLIT, context_limits, count_tokens, length_histogram, length_quantiles, suffix_sums


@pytest.mark.parametrize("block", [1, 7, 4096])
def test_sums(spark, block):
    rng = random.Random(2)
    lengths = [rng.choice([0, 1, 2, rng.randint(3, 90), rng.randint(90, 9000)]) for _ in range(400)]
    histogram = spark.createDataFrame([(n,) for n in lengths], "n_tokens bigint").groupBy("n_tokens").count()
    sums = suffix_sums(histogram.withColumnRenamed("count", "n_docs"), block).cache()
    found = {r["n_tokens"]: r for r in sums.collect()}
    assert set(found) == set(lengths)
    for limit, r in found.items():
        assert r["n_docs"] == lengths.count(limit)
        assert r["docs_longer"] == sum(n > limit for n in lengths)
        assert r["tokens_longer"] == sum(n for n in lengths if n > limit)
        assert r["tokens_kept"] == sum(min(n, limit) for n in lengths)
        assert r["tokens_kept"] + r["tokens_lost"] == sum(lengths)
        assert r["share_whole"] == sum(n <= limit for n in lengths) / len(lengths)
    for r in context_limits(sums, [0, 5, 100, 4000, 10**9]).collect():
        assert r["docs_longer"] == sum(n > r["context_limit"] for n in lengths)
        assert r["tokens_kept"] == sum(min(n, r["context_limit"]) for n in lengths)
    ordered = sorted(lengths)
    reached = {q: n for n, r in found.items() for q in r["quantiles"].split(",") if q}
    assert reached == {"0.5": ordered[199], "0.9": ordered[359], "0.99": ordered[395], "0.999": ordered[399]}
    assert {(r["docs_all"], r["tokens_all"]) for r in found.values()} == {(400, sum(lengths))}
    assert length_quantiles(sums, [0.25, 0.5, 1.0]) == {0.25: ordered[99], 0.5: ordered[199], 1.0: ordered[-1]}


@pytest.mark.skipif(not Path(RANKS_PATH).exists(), reason="vocabulary files not present")
def test_histogram_of_documents(spark):
    found = {r["n_tokens"]: r["n_docs"] for r in length_histogram(messy(spark)).collect()}
    assert sum(found.values()) == len(ROWS)
    assert found[0] == 2 and found[1] >= 2  # null and empty; single letters
    assert suffix_sums(length_histogram(empty(spark))).collect() == []
    assert length_quantiles(suffix_sums(length_histogram(empty(spark))), [0.5]) == {0.5: None}


@pytest.mark.skipif(not Path(RANKS_PATH).exists(), reason="vocabulary files not present")
def test_very_long_runs(spark):
    """A million spaces or letters between two words, and shorter runs against the tokenizer in one piece."""
    ranks = Path(RANKS_PATH).read_bytes()
    pairs = [line.split() for line in ranks.splitlines() if line]
    plain = tiktoken.Encoding("plain", pat_str=SPLIT, mergeable_ranks={base64.b64decode(t): int(r) for t, r in pairs}, special_tokens={})
    runs = [" " * 5000, "\n" * 4100, " \n\t\u2003" * 2000, "\x1c" * 5000, " " * 4095, "\u00a0 " * 3000]
    for run in runs:
        for text in (run, "a" + run, run + "b", "a" + run + "b" + run + " c", "a!" + run + "'s"):
            assert count_tokens(text, ranks) == len(plain.encode_ordinary(text))
    long = [("x" + " " * 1_200_000 + "y",), ("x" + "y" * 1_000_000,), ("\n" * 1_000_000,)]
    found = {r["n_tokens"] for r in length_histogram(spark.createDataFrame(long, "text string")).collect()}
    assert len(found) == 3 and 1_200_001 <= max(found) <= 1_200_002
