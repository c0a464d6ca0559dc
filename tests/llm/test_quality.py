"""Quality: accuracy on labelled rows, shrinkage of sparse groups, and rows that lack something."""

import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from messy import ROWS, empty, messy
from rowtide.llm.quality import score_quality

SF_DIR = "/root/testdata/sf0.01"


def corpus(spark):
    """Hosts of good and bad texts; one host is bad but for its path `ok`, one has a single document."""
    rng = random.Random(4)
    good = lambda: " ".join(rng.choice("the river runs under a bridge to the sea".split()) for _ in range(60)) + "."
    bad = lambda: " ".join(rng.choice("a# b# c%% d&& | | 17 99".split()) for _ in range(60))
    rows = [(f"good{h}", "p", good(), 1) for h in range(5) for _ in range(40)]
    rows += [("mixed", "ok", good(), 1) for _ in range(40)] + [("mixed", "bad", bad(), 0) for _ in range(40)]
    rows += [("bad", "p", bad(), 0) for _ in range(60)] + [("single", "p", bad(), 0)]
    docs = [(i, text, path, host, 0, q) for i, (host, path, text, q) in enumerate(rows)]
    return spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint, q int")


def test_rates_and_shrinkage(spark):
    docs = corpus(spark)
    found = score_quality(docs, docs.select("doc_id", F.col("q").alias("quality"))).join(docs.select("doc_id", "source", "lang", "q"), "doc_id").toPandas()
    assert ((found["quality"] > 0.5) == (found["q"] > 0)).all() and (found["keep"] == (found["quality"] >= 0.5)).all()
    rate = found.groupby(["source", "lang"])[["host_rate", "path_rate", "text_score"]].mean()
    assert rate.loc[("bad", "p"), "host_rate"] < 0.1 < 0.9 < rate.loc[("good0", "p"), "host_rate"]
    assert rate.loc[("mixed", "bad"), "path_rate"] < 0.1 < 0.9 < rate.loc[("mixed", "ok"), "path_rate"]
    alone = rate.loc[("single", "p")]  # one document moves its host a little only
    assert alone["text_score"] < 0.1 < 0.2 < alone["host_rate"] < found["text_score"].mean()


def test_rates_against_plain_arithmetic(spark):
    """Strengths, rates and the combination from the scores, group by group; a document is no evidence about itself."""
    docs = corpus(spark).withColumn("lang", F.expr("if(doc_id % 7 = 0, null, lang)"))
    found = score_quality(docs, docs.select("doc_id", F.col("q").alias("quality"))).join(docs.select("doc_id", "source", "lang", "q"), "doc_id")
    rows = [r.asDict() for r in found.collect()]
    overall = sum(r["text_score"] for r in rows) / len(rows)

    def strength(groups):
        extra = sum(n * (good / n - above) ** 2 - above * (1 - above) for n, good, above in groups)
        possible = sum((n - 1) * above * (1 - above) for n, good, above in groups)
        return max(1 / min(extra / possible, 0.5) - 1, 1.0) if extra > 0 and possible > 0 else 1e6

    def totals(*by):
        found = {}
        for r in rows:
            n, good = found.get(tuple(r[c] for c in by), (0, 0.0))
            found[tuple(r[c] for c in by)] = n + 1, good + r["text_score"]
        return found

    hosts, paths = totals("source"), totals("source", "lang")
    k_host = strength([(*g, overall) for g in hosts.values()])
    host_rate = {h: (good + k_host * overall) / (n + k_host) for (h,), (n, good) in hosts.items()}
    k_path = strength([(*g, host_rate[h]) for (h, _), g in paths.items()])
    labelled = (sum(r["q"] for r in rows) + 0.5) / (len(rows) + 1)
    odds = lambda x: np.log(x / (1 - x))
    for r in rows:
        p, (n, good), (host_n, host_good) = r["text_score"], paths[r["source"], r["lang"]], hosts[r["source"],]
        assert r["host_rate"] == pytest.approx(host_rate[r["source"]])
        assert r["path_rate"] == pytest.approx((good + k_path * host_rate[r["source"]]) / (n + k_path))
        above = (host_good - p + k_host * overall) / (host_n - 1 + k_host)
        prior = min(max((good - p + k_path * above) / (n - 1 + k_path), 1e-4), 1 - 1e-4)
        assert r["quality"] == pytest.approx(1 / (1 + np.exp(-(odds(p) - odds(labelled) + odds(prior)))), abs=1e-6)


def test_repeated_labels_count_by_their_number(spark):
    """Labels of one id are summed up before they meet the documents, with the result of having each one."""
    docs = corpus(spark)
    labels = docs.select("doc_id", F.col("q").alias("quality"))
    three = score_quality(docs, labels.unionAll(labels).unionAll(labels.where("doc_id < 20"))).orderBy("doc_id").toPandas()
    each = docs.unionAll(docs.withColumn("doc_id", F.col("doc_id") + 10_000)).unionAll(docs.where("doc_id < 20").withColumn("doc_id", F.col("doc_id") + 20_000))
    apart = score_quality(each, each.select("doc_id", F.col("q").alias("quality"))).where("doc_id < 10000").orderBy("doc_id").toPandas()
    assert np.allclose(three["text_score"], apart["text_score"], atol=1e-6)


@pytest.mark.skipif(not Path(SF_DIR).exists(), reason="supplied data not present")
def test_accuracy_beyond_the_sample(spark):
    docs, labels = (spark.read.parquet(f"{SF_DIR}/{t}.parquet") for t in ("documents", "labels"))
    found = score_quality(docs, labels, sample_rows=150).join(labels.withColumnRenamed("quality", "truth"), "doc_id").toPandas()
    assert ((found["quality"] > 0.5) == (found["truth"] > 0)).mean() > 0.97


def test_messy_rows(spark):
    labels = spark.createDataFrame([(1, 1), (4, 0), (6, 1), (None, 1), (8, None), (10, 1), (10, 0)], "doc_id bigint, quality int")
    found = score_quality(messy(spark), labels).collect()
    assert len(found) == len(ROWS)
    assert all(0 <= r["quality"] <= 1 and r["host_rate"] is not None and r["path_rate"] is not None for r in found)
    none = labels.limit(0)
    assert len({round(r["text_score"], 9) for r in score_quality(messy(spark), none).collect()}) == 1
    assert score_quality(empty(spark), labels).collect() == [] == score_quality(empty(spark), none).collect()
