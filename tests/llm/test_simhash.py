"""Fingerprints and links: against plain counting and comparing all pairs."""

import hashlib
import random
from collections import Counter

import pytest
import xxhash

from messy import ROWS, empty, lower_ascii, messy
from rowtide.llm.graph import components
from rowtide.llm.simhash import fingerprint_links, fingerprint_of, near_duplicate_rows, near_duplicates, shingle_hashes


def brute_fingerprint(text, words=3):
    found = lower_ascii(text).encode().split()
    shingles = [b" ".join(found[i : i + words]) for i in range(max(len(found) - words + 1, 1))] if found else []
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_roots(values, linked):
    root = {v: v for v in values}
    changed = True
    while changed:
        changed = False
        for a in values:
            for b in values:
                if linked(a, b) and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    return root


def test_fingerprint():
    for _, text, *_ in ROWS:
        value = fingerprint_of(shingle_hashes(text, 3))
        assert value & (1 << 64) - 1 == brute_fingerprint(text)


def test_documents(spark):
    prints = {text: brute_fingerprint(text) for _, text, *_ in ROWS}
    near = lambda a, b: bin(prints[a] ^ prints[b]).count("1") <= 2
    groups = brute_roots_by_text(list(prints), near)
    expected = Counter()
    for doc_id, text, *_ in ROWS:
        ids = [i for i, t, *_ in ROWS if groups[t] == groups[text] and i is not None]
        expected[(doc_id, f"{prints[text]:016x}", min(ids, default=None))] += 1
    assert Counter(tuple(r) for r in near_duplicates(messy(spark)).collect()) == expected
    assert near_duplicates(empty(spark)).collect() == []


def brute_roots_by_text(texts, linked):
    index = brute_roots(range(len(texts)), lambda a, b: linked(texts[a], texts[b]))
    return {t: index[i] for i, t in enumerate(texts)}


@pytest.mark.parametrize("bucket_rows", [0, 3, 1000])
def test_links_connect_what_two_bits_connect(spark, bucket_rows):
    """Chains and crowds of near fingerprints; the limit decides the way, not the result."""
    rng = random.Random(7)
    values = set()
    for _ in range(6):
        value = rng.getrandbits(64)
        for _ in range(12):
            values.add(value - (1 << 64) if value >> 63 else value)
            for bit in rng.sample(range(64), rng.choice([1, 2, 3])):
                value ^= 1 << bit
    values |= {rng.getrandbits(63) for _ in range(30)}
    df = spark.createDataFrame([(v,) for v in values], "fp bigint")
    roots = {r["node"]: r["root"] for r in components(fingerprint_links(df, bucket_rows=bucket_rows)).collect()}
    expected = brute_roots(sorted(values), lambda a, b: bin((a ^ b) & (1 << 64) - 1).count("1") <= 2)
    assert {v: roots.get(v, v) for v in values} == expected


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(300, 300), (7, 3)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert found == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}


def test_rows_that_stay(spark):
    """One row of each group: the smallest id, then the smallest hash of the text."""
    prints = {text: brute_fingerprint(text) for _, text, *_ in ROWS}
    groups = brute_roots_by_text(list(prints), lambda a, b: bin(prints[a] ^ prints[b]).count("1") <= 2)
    sha = lambda t: hashlib.sha256(lower_ascii(t).encode()).hexdigest()
    expected = {min((i is None, i or 0, sha(t)) for i, t, *_ in ROWS if groups[t] == g) for g in groups.values()}
    found = near_duplicate_rows(messy(spark)).collect()
    assert len(found) == len(ROWS)
    kept = [(r["doc_id"] is None, r["doc_id"] or 0, r["text_sha256"]) for r in found if r["kept"]]
    assert sorted(kept) == sorted(expected)
    assert near_duplicate_rows(empty(spark)).collect() == []
