"""Encoding: chunks against whole texts, whole texts against trying every segmentation, and round trips."""

import functools
import random
import sys
import tracemalloc
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

from messy import LONG, ROWS, empty, messy
from rowtide.llm.pieces import MODEL_PATH, Pieces, _words, boundary_states, decode_documents, encode_documents, product

pytestmark = pytest.mark.skipif(not Path(MODEL_PATH).exists(), reason="vocabulary files not present")


@functools.cache
def pieces():
    return Pieces(Path(MODEL_PATH).read_bytes())


def chunked(text, size):
    p = pieces()
    chunks = p.chunks(text, size)
    states = boundary_states(np.stack([np.array(p.matrix(*c), np.int64).reshape(p.longest, p.longest) for c in chunks]))
    return [i for c, (enter, leave) in zip(chunks, states) for i in p.stretch(*c, enter, leave).tolist()]


def best_score(text):
    """Over all segmentations into pieces and unknown characters."""
    p = pieces()
    known = {piece: p.scores[int.from_bytes(i, sys.byteorder)] for piece, (i, _) in p.weights.items()}

    @functools.cache
    def best(at):
        if at == len(text):
            return 0.0
        found = [known[text[at:end]] + best(end) for end in range(at + 1, min(at + p.longest, len(text)) + 1) if text[at:end] in known]
        return max(found if text[at] in known else [*found, p.unknown_score + best(at + 1)])

    return best(0)


@pytest.mark.parametrize("alphabet", ["abcéßthe▁in 日q\n", "▁theabc", "%=x", "abcdefghij"])
def test_chunks_agree_with_whole_texts(alphabet):
    rng = random.Random(5)
    for _ in range(40):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 170)))
        ids = pieces().encode(text)
        assert pieces().decode(ids) == text
        assert pieces().score(ids) == pytest.approx(best_score(text))
        for size in (16, 29, 64):
            assert chunked(text, size) == ids.tolist()


def test_documents(spark):
    rows = encode_documents(messy(spark)).collect()
    small = encode_documents(messy(spark), chunk_chars=40).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, small))
    assert len(rows) == len(ROWS) and all(r["round_trip"] for r in rows)
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[3]["tokens"] == by_id[4]["tokens"] == [] and by_id[4]["score"] == 0
    assert by_id[6]["n_chars"] == len(LONG) and by_id[6]["n_tokens"] == len(by_id[6]["tokens"])
    assert encode_documents(empty(spark)).collect() == []


def test_decoding(spark):
    docs = messy(spark, extra=False)
    decoded = decode_documents(encode_documents(docs, chunk_chars=100))
    texts = sorted(((r["doc_id"], r["text"]) for r in decoded.collect()), key=repr)
    assert texts == sorted(((i, t or "") for i, t, *_ in ROWS), key=repr)


def test_runs_of_matrices_are_associative():
    """States handed down from products of runs are those of one pass over all matrices, however the runs are cut."""
    p, rng = pieces(), random.Random(8)
    for alphabet in ("abcéßthe▁in 日q\n", "▁theabc", "%=x", "abcdefghij"):
        text = "".join(rng.choice(alphabet) for _ in range(p.longest * 11))
        cubes = np.stack([np.array(p.matrix(*c), np.int64).reshape(p.longest, p.longest) for c in p.chunks(text, p.longest)])
        expected = boundary_states(cubes)
        for cuts in ([0, 1, 11], [0, 4, 8, 11], [0, 5, 6, 7, 11]):
            runs = [cubes[a:b] for a, b in zip(cuts, cuts[1:])]
            above = boundary_states(np.stack([product(r) for r in runs]))
            assert [s for r, ends in zip(runs, above) for s in boundary_states(r, *ends)] == expected


def test_levels_of_products(spark):
    """A document of many more chunks than a run has, beside short ones and one that is all white space."""
    p, rng = pieces(), random.Random(9)
    size = p.longest
    texts = ["".join(rng.choice("the abcin éq") for _ in range(size * n)) for n in (300, 40, 17, 2)] + [" " * (3 * size), "", "mill"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    whole = {r["doc_id"]: r for r in encode_documents(docs).collect()}
    cut = {r["doc_id"]: r for r in encode_documents(docs, chunk_chars=size).collect()}
    assert len(whole) == len(texts) and cut == whole


def test_chunks_shorter_than_a_piece_are_refused(spark):
    with pytest.raises(ValueError):
        encode_documents(messy(spark), chunk_chars=3)


def test_workers_keep_no_words_between_tasks(spark):
    """Idle workers stay with their executor: what they hold is memory that other steps lack."""
    words = "concat_ws(' ', transform(sequence(1, 400), i -> concat('w', id, 'x', i)))"
    encode_documents(spark.range(0, 64, 1, 8).selectExpr("id AS doc_id", f"{words} AS text")).write.format("noop").mode("overwrite").save()

    def held(batches):
        import gc

        for _ in batches:
            pass
        models = [x for x in gc.get_objects() if type(x).__name__ == "Pieces"]
        kept = [len(c) + len(c.before) for x in models for c in (x._words, x._stretches)]
        yield pd.DataFrame({"models": [len(models)], "kept": [sum(kept)]})

    found = spark.range(0, 8, 1, 8).mapInPandas(held, "models int, kept int").agg({"models": "sum", "kept": "sum"}).first()
    assert found["sum(models)"] > 0  # the workers that encoded are the ones asked
    assert found["sum(kept)"] == 0


def test_marks_are_apart_from_words():
    """A word with different marks behind it is kept once; texts are cut only where all paths meet."""
    p = Pieces(Path(MODEL_PATH).read_bytes())
    p.encode_all([p.normalize(f"{word}{mark}") for word in ("mill", "stone") for mark in (".", ",", ";\n", "!!", '"')])
    assert {"▁mill", "▁stone"} <= set(p._words) and len(p._words) <= 7
    rng, chars = random.Random(12), sorted({c for pair in p._joined for c in pair} | set("\n\x00日😀٣½²_"))
    for _ in range(20_000):
        text = "".join(rng.choice(chars if rng.random() < 0.5 else "aé_².▁,b9\n") for _ in range(rng.randint(0, 12)))
        found = p._split(text)
        assert "".join(found) == text
        assert not [a + b for a, b in zip(found, found[1:]) if a[-1] + b[0] in p._joined]


@pytest.mark.parametrize("joined", [set(), {"ab", "b."}, {"ab", ".b", "▁a", "▁."}, {"-b", "]b", "b^", "^-"}])
def test_marks_stay_where_a_model_joins_them(joined):
    pattern, rng = _words(joined), random.Random(13)
    for _ in range(3000):
        text = "".join(rng.choice("ab.-]^▁") for _ in range(rng.randint(0, 9)))
        found = pattern.findall(text)
        assert "".join(found) == text
        assert not [a + b for a, b in zip(found, found[1:]) if a[-1] + b[0] in joined]


def test_memory_of_a_model():
    """Every worker of an executor has its own: 23 MB, and 40 MB with a tuple of numbers for each piece."""
    model = Path(MODEL_PATH).read_bytes()
    tracemalloc.start()
    try:
        kept = Pieces(model)
        assert tracemalloc.get_traced_memory()[0] < 30e6
    finally:
        tracemalloc.stop()
    assert kept.weights


def test_memory_of_words():
    """What a worker holds at most beside its model, while it encodes words with marks: 32 MB, and 49 MB with the marks in the words."""
    p, rng = Pieces(Path(MODEL_PATH).read_bytes()), random.Random(14)
    texts = [p.normalize(" ".join("".join(rng.choice("aeinrst") for _ in range(9)) + rng.choice(".,;") for _ in range(1000))) for _ in range(100)]
    tracemalloc.start()
    try:
        p.encode_all(texts)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 40e6
