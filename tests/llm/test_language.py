"""Languages: held-out accuracy, mixtures, and texts without a letter."""

import random
from pathlib import Path

import numpy as np
import pytest

from messy import ROWS, empty, messy
from rowtide.llm.language import LanguageModel, fit_languages, held_out_predictions, identify, ngrams

SF_DIR = "/root/testdata/sf0.01"
WORDS = {"aa": "brem kolt sirp dast hulk finz", "bb": "ouela mieno auria leosa noelu ebaio", "cc": "xyzzy qwixo jyvex zyqua kyxij wyqoz"}


def sentence(lang, n, rng):
    return " ".join(rng.choice(WORDS[lang].split()) for _ in range(n))


def model(spark):
    rng = random.Random(1)
    rows = [(i, sentence(lang, 30, rng), lang) for i in range(20) for lang in WORDS]
    return fit_languages(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))


def test_mixtures(spark):
    rng = random.Random(2)
    known = model(spark)
    assert known.languages == ("aa", "bb", "cc")
    for lang in WORDS:
        assert known.mixture(sentence(lang, 12, rng)) == ([lang], [1.0])
    names, shares = known.mixture(sentence("aa", 300, rng) + " " + sentence("bb", 100, rng))
    letters = [len(ngrams(sentence(x, 400, rng))) for x in ("aa", "bb")]
    expected = 300 * letters[0] / (300 * letters[0] + 100 * letters[1])
    assert names == ["aa", "bb"] and shares[0] == pytest.approx(expected, abs=0.03)
    assert known.mixture(None) == known.mixture("12 + 3 = ?") == ([], [])


def test_counts_are_those_of_all_rows(spark):
    found = fit_languages(messy(spark))
    for i, lang in enumerate(found.languages):
        counts = sum(np.bincount(ngrams(t), minlength=1 << 15) for _, t, x, *_ in ROWS if x == lang)
        assert np.allclose(found.probabilities[:, i], (counts + 0.5) / (counts + 0.5).sum())


@pytest.mark.skipif(not Path(SF_DIR).exists(), reason="supplied data not present")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    found = held_out_predictions(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (found["lang"] == found["lang_pred"]).mean() > 0.98


def test_messy_rows(spark):
    found = held_out_predictions(messy(spark)).collect()
    assert len(found) == len(ROWS) and all(0 <= r["score"] <= 1 for r in found)
    by_id = {r["doc_id"]: r for r in found}
    assert by_id[3]["lang_pred"] == by_id[4]["lang_pred"] == by_id[5]["lang_pred"] == "und"
    assert by_id[None]["held_out"] is False and by_id[8]["lang_pred"] != "und"
    assert held_out_predictions(empty(spark)).collect() == []


def test_nothing_learned(spark):
    untaught = fit_languages(empty(spark))
    assert isinstance(untaught, LanguageModel) and untaught.languages == ()
    assert {r["lang_pred"] for r in identify(messy(spark, extra=False), untaught).collect()} == {"und"}


def test_many_languages_in_one_text():
    """Seven languages, with a look-alike of the first: the others are found all the same."""
    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyzäöüéèêàß"
    words = {f"l{k}": ["".join(rng.choice(letters[4 * k : 4 * k + 6]) for _ in range(6)) for _ in range(8)] for k in range(7)}
    words["l0x"] = words["l0"]
    table = np.full((1 << 12, len(words)), 0.5)
    for i, of in enumerate(words.values()):
        for word in of:
            table[:, i] += 100 * np.bincount(ngrams(word, 1 << 12), minlength=1 << 12)
    known = LanguageModel(tuple(words), table / table.sum(axis=0))
    text = lambda k, n: " ".join(rng.choice(words[f"l{k}"]) for _ in range(n))
    names, shares = known.mixture(" ".join(text(k, 60) for k in range(7)))
    assert {n[:2] for n in names} == {f"l{k}" for k in range(7)} and len(names) == 7
    assert sum(shares) == pytest.approx(1)
    names, _ = known.mixture(text(0, 100) + " " + text(3, 30))
    assert {n[:2] for n in names} == {"l0", "l3"} and len(names) == 2
