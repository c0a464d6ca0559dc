"""Sketches: the recovered difference against the difference of the sets of digests."""

import hashlib

import numpy as np
import pytest

from messy import ROWS, empty, messy
from rowtide.llm.sketch import CELLS, differing, edited_text, paragraph_digests, sketched, versions


def digests(text):
    return set(paragraph_digests([text])[0].tolist())


@pytest.mark.parametrize("only_a, only_b, shared", [(0, 0, 0), (0, 0, 50), (1, 0, 10), (3, 2, 1000), (400, 300, 5), (2000, 0, 0)])
def test_difference_is_recovered(only_a, only_b, shared):
    rng = np.random.default_rng(only_a + shared)
    values = np.unique(rng.integers(0, 2**64, only_a + only_b + shared, dtype=np.uint64))
    rng.shuffle(values)
    a, b = values[: only_a + shared], np.concatenate([values[only_a : only_a + shared], values[only_a + shared :]])
    zeros = lambda x: np.zeros(len(x), np.int64)
    tables = sketched(a, zeros(a), 1).minus(sketched(b, zeros(b), 1))
    found, _, sign = differing((a, zeros(a)), (b, zeros(b)), 1, tables)
    assert set(found[sign == 1].tolist()) == set(a.tolist()) - set(b.tolist())
    assert set(found[sign == -1].tolist()) == set(b.tolist()) - set(a.tolist())


def test_an_edit_leaves_the_other_paragraphs():
    text = "\n".join(f"line {i} with a few words of its own" for i in range(60))
    changed = text.replace("line 30 with", "line 30 without")
    assert len(digests(text) ^ digests(changed)) <= 4
    assert digests("") == set() == digests("\n\n")


def test_equal_texts_have_equal_digests_after_any_neighbour():
    texts = [" starts with a space", "I begin. More words", "g h", " ", "x", "a b c"]
    alone = [digests(t) for t in texts]
    for before in ["", "end\n", "end,", "all", "obj", "x]", "plain", "A", '"']:
        for text, expected in zip(texts, alone):
            found, owner = paragraph_digests([before, text, before, text])
            assert set(found[owner == 1].tolist()) == expected == set(found[owner == 3].tolist())
            assert set(found[owner == 0].tolist()) == digests(before)


def brute(rows):
    ordered = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    texts = [r[1] or "" for r in ordered]
    result = []
    for i, (row, text) in enumerate(zip(ordered, texts)):
        following = texts[(i + 1) % len(texts)]
        edited = text[: len(text) - len(text) // 2] + following[: len(text) // 2]
        near = [
            1.0 if not a and not b else 2 * len(a & b) / (len(a) + len(b))
            for a, b in ((digests(text), digests(edited)), (digests(text), digests(following)))
        ]
        result.append((row[0], len(text), hashlib.sha256(edited.encode()).hexdigest(), *[round(n, 9) for n in near]))
    return sorted(result, key=repr)


@pytest.mark.parametrize("parts", [1, 2, 5])
def test_documents_and_the_next_ones(spark, parts):
    found = versions(messy(spark), parts=parts).collect()
    rows = [(r["doc_id"], r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in found]
    assert sorted(rows, key=repr) == brute(ROWS)
    prints = {}
    for r in found:
        assert len(r["fingerprint"]) == CELLS * 32
        text = {(i, len(t or "")): t or "" for i, t, *_ in ROWS}[(r["doc_id"], r["n_chars"])]
        if r["doc_id"] != 12:  # two texts of one length
            assert prints.setdefault(text, r["fingerprint"]) == r["fingerprint"]


def test_one_row_and_none(spark):
    one = messy(spark).where("doc_id = 10")
    (row,) = versions(one).collect()
    assert row["near_next"] == 1.0 and row["n_chars"] == len(ROWS[11][1])
    assert versions(empty(spark)).collect() == []


def test_edited_text():
    assert edited_text("abcdef", "xy") == "abcxy" and edited_text("abcde", "xyz") == "abcxy" and edited_text("", "xyz") == ""
