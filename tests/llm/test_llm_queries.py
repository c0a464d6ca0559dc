"""The registered queries on the smallest supplied data, the pipeline's stages, and the package without them."""

import subprocess
import sys
from collections import defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from messy import ROWS, collected, empty, lower_ascii, messy
from oracle import connect, spark_rows, sql_rows
from rowtide.llm.mixing import mix_sources
from rowtide.llm.queries import QUERIES, SQL

SF_DIR = "/root/testdata/sf0.001"
supplied = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="supplied data not present")


@supplied
@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, name):
    assert spark_rows(QUERIES[name](spark, SF_DIR)) == sql_rows(connect(SF_DIR), SQL[name])


@supplied
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_a_row_for_each_document(spark, name):
    found = QUERIES[name](spark, SF_DIR).collect()
    if name != "op7_token_lengths":
        assert {r["doc_id"] for r in found} == set(range(200)) and len(found) == 200
    else:
        assert sum(r["n_docs"] for r in found) == 200


def test_stages_keep_columns_and_handle_empty_tables(spark):
    for docs in (messy(spark), empty(spark)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, docs, SF_DIR)
            assert kept.columns == docs.columns, name
            assert kept.count() <= 3 * len(ROWS)


def test_decisions_take_effect(spark):
    docs = messy(spark, extra=False)
    stages = dict(corpus_pipeline.STAGES)
    texts = lambda df: sorted((r["text"] or "" for r in df.collect()))
    told = stages["language ID"](spark, docs, SF_DIR)
    assert texts(told) == sorted(t for _, t, *_ in ROWS if t and any(c.isalpha() for c in t))
    unique = stages["exact dedup"](spark, docs, SF_DIR)
    assert sorted(map(lower_ascii, texts(unique))) == sorted({lower_ascii(t) for _, t, *_ in ROWS})
    apart = stages["SimHash near-dedup"](spark, docs, SF_DIR)
    assert sum(r["doc_id"] in (6, 7) for r in apart.collect()) == 1
    mixed = stages["mixing sources"](spark, docs, SF_DIR)
    taken = defaultdict(int)
    for r in mix_sources(docs).collect():
        taken[r["doc_id"]] += r["copies"]
    found = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert found == {i: n for i, n in taken.items() if n}
    encoded = stages["SentencePiece"](spark, unique, SF_DIR)
    assert encoded.count() == unique.count() and encoded.where(~F.col("round_trip")).count() == 0


def test_entry_without_these_modules():
    root = Path(__file__).resolve().parents[2]
    code = "import sys; sys.modules['rowtide.llm'] = None; import __spark_entry__ as e; print(sorted(e.queries()) == sorted(e.oracle_sql()))"
    shown = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True)
    assert shown.stdout.strip() == "True"


def test_nothing_learned_keeps_documents_with_letters(spark):
    docs = messy(spark, extra=False).withColumn("lang", F.lit(None).cast("string"))
    told = corpus_pipeline.language_id(spark, docs, SF_DIR).collect()
    texts = sorted(t for _, t, *_ in ROWS if t and any(c.isalpha() for c in t))
    assert sorted(r["text"] for r in told) == texts


def test_of_repeated_rows_the_first_by_its_other_columns_stays(spark):
    rows = [(1, "same text", "de", "b", 2), (1, "same text", "de", "a", 9), (1, "same text", None, "z", 5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for stage in ("exact dedup", "SimHash near-dedup"):
        for parts in (1, 3):
            kept = dict(corpus_pipeline.STAGES)[stage](spark, df.repartition(parts), SF_DIR).collect()
            assert [tuple(r) for r in kept] == [rows[2]]


def test_stages_as_a_whole(spark):
    """The first four stages against one after the other in plain Python."""
    from rowtide.llm.simhash import fingerprint_of, shingle_hashes

    docs = messy(spark, extra=False)
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = spark.createDataFrame(stage(spark, docs, SF_DIR).collect(), docs.schema)
    rows = [r for r in ROWS if r[1] and any(c.isalpha() for c in r[1])]
    best = {}
    for r in rows:
        key = lower_ascii(r[1])
        if key not in best or (r[0] is not None, r[0] or 0) > (best[key][0] is not None, best[key][0] or 0):
            best[key] = r
    rows = sorted(best.values(), key=lambda r: (r[0] is None, r[0] or 0))
    prints = [fingerprint_of(shingle_hashes(r[1], 3)) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if bin((prints[i] ^ prints[j]) & (1 << 64) - 1).count("1") <= 2:
                group = [group[j] if g == group[i] else g for g in group]
    expected = [r for i, r in enumerate(rows) if group.index(group[i]) == i]
    assert collected(docs) == sorted(expected, key=repr)
