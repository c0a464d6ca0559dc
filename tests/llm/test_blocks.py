"""Exact duplicates: against comparing texts."""

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from messy import ROWS, collected, empty, lower_ascii, messy
from rowtide.llm.blocks import exact_duplicates


def expected(rows):
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[lower_ascii(text)].append(doc_id)
    result = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(text.encode()).hexdigest()
        kept = [i == keep for i in ids]
        if sum(kept) > 1:  # repeated rows: one of them
            first = kept.index(True)
            kept = [k and i == first for i, k in enumerate(kept)]
        result += [(i, keep, len(ids), k, sha) for i, k in zip(ids, kept)]
    return sorted(result, key=repr)


@pytest.mark.parametrize("block_chars, weak", [(7, False), (4096, False), (50, True)])
def test_against_texts(spark, block_chars, weak):
    """With a weak hash nearly all blocks clash, and are told apart by their texts."""
    weakly = {"block_hash": lambda block: F.pmod(F.xxhash64(block), F.lit(5))} if weak else {}
    found = exact_duplicates(messy(spark), block_chars, **weakly)
    assert found.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert collected(found) == expected(ROWS)


def test_empty_table(spark):
    assert exact_duplicates(empty(spark)).collect() == []
