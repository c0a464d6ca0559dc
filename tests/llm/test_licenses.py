"""License rules: base phrases against plain search, overlaps against comparing all finds."""

import itertools
import re


from messy import ROWS, empty, lower_ascii, messy
from rowtide.llm.licenses import _LICENSES, _SENTENCES, BASE_PHRASES, Rule, find_licenses, keep_best, license_rules, scan_licenses, words_of

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
TEXTS = [
    "Released under the MIT License. mit-license; MIT\nLicense",
    "Licensed under the Apache License, Version 2.0. You may not use this file except in compliance with the License.",
    "This work is licensed under the GNU General Public License, version 3. General Public License",
    "GNU Lesser General Public License version 2.1 or later; dual licensed under the terms of the Mozilla Public License 2.0",
    "SPDX-License-Identifier: BSD-3-Clause and Licensed under CC BY-NC 4.0.",
    "smit license, mit licenses, MITLICENSE, submit license: none of these",
    "mit license " * 50,
    "all rights reserved",
    "",
    None,
]


def documents(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")


def base(text):
    words = WORD.findall(lower_ascii(text))
    found = {}
    for phrase, label in BASE_PHRASES.items():
        parts = phrase.split()
        for k in range(len(words)):
            if words[k : k + len(parts)] == parts:
                found[k, label] = True
    starts = [k for k, _ in found]
    return len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


def test_base_phrases_and_labels(spark):
    found = {r["doc_id"]: r for r in scan_licenses(documents(spark)).collect()}
    for i, text in enumerate(TEXTS):
        r = found[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == base(text)
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["labels"])
    assert [found[i]["labels"] for i in range(6)] == [
        "mit",
        "apache,apache-2.0",
        "gpl,gpl-3.0",
        "gpl,lgpl-2.1,mpl-2.0",
        "bsd-3-clause,cc-by-nc-4.0",
        "mit",
    ]


def test_finds_are_where_the_rules_match(spark):
    rules = license_rules()
    assert len(rules) > 300
    words = words_of(documents(spark), rules).cache()
    ids = {r["rid"]: r["doc_id"] for r in words.collect()}
    found = {(ids[r["rid"]], r["rule"], r["start"], r["end"]) for r in find_licenses(words, rules).collect()}
    expected = set()
    for i, text in enumerate(TEXTS):
        line = " " + " ".join(WORD.findall(lower_ascii(text))) + " "
        for k, rule in enumerate(rules):
            if rule.keyword in line and rule.also in line:
                for m in re.finditer(f"(?<= )(?:{rule.pattern})(?= )", line):
                    start = line[: m.start()].count(" ") - 1
                    expected.add((i, k, start, start + m.group().count(" ")))
    assert found == expected


def test_keywords_lose_no_alternative(spark):
    """Every alternative of a rule's name has its keyword, and its finds are those without a first look."""
    texts = []
    for _, keyword, name, _ in _LICENSES:
        plain = re.sub(r"\(\?:[^()]*\)\?", "", name).replace("[cs]", "s").replace(" ?", " ").replace("v?2", "v2").replace("c?", "c")
        plain = re.sub(r"\(\?:([^()|]*)\|[^()]*\)", r"\1", plain)  # of a choice that is left, the first
        for text in plain.split("|"):
            assert re.fullmatch(name, text) and keyword in text, (name, keyword, text)
            texts.append(f"licensed under the {text} license")
    texts += ["GNU Library General Public License version 2", "BSD Zero Clause License", "Zero Clause BSD", "Expat License"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rules = license_rules()
    found = {r["doc_id"]: r["labels"] for r in scan_licenses(df, rules).collect()}
    tried = {r["doc_id"]: r["labels"] for r in scan_licenses(df, [r._replace(keyword="e" if not r.base else r.keyword, also="") for r in rules]).collect()}
    assert found == tried
    assert [found[i] for i in range(len(texts) - 4, len(texts))] == ["gpl,lgpl-2.0", "0bsd", "0bsd", "mit"]


def test_overlaps(spark):
    rows, rule = [], itertools.count()
    for start in range(6):
        for size in range(3):
            for priority in (1, 2, 3):
                rows.append((start % 2, next(rule), "x", priority, 0.5, start == 3 and priority == 1, start, start + size))
    kinds = "rid bigint, rule int, label string, priority int, weight double, base boolean, start bigint, end bigint"
    for step in (1, 4, 7):
        some = rows[::step]
        kept = {r["rule"] for r in keep_best(spark.createDataFrame(some, kinds)).collect()}

        stayed = []  # from the highest priority down, wider finds first
        for d in sorted(some, key=lambda d: (-d[3], d[6], -d[7], d[1])):
            over = [e for e in stayed if e[0] == d[0] and e[6] <= d[7] and d[6] <= e[7]]
            if not any(e[3] > d[3] or (e[6] <= d[6] and d[7] <= e[7]) for e in over):
                stayed.append(d)
        assert kept == {d[1] for d in stayed} | {d[1] for d in some if d[5]}


def test_a_find_that_went_removes_nothing(spark):
    rules = [Rule("low", "aa", "aa bb", 2, 0.2), Rule("mid", "bb", "bb cc", 3, 0.3), Rule("high", "cc", "cc dd", 4, 0.4)]
    docs = spark.createDataFrame([(1, "aa bb cc dd"), (2, "aa bb cc")], "doc_id bigint, text string")
    found = {r["doc_id"]: (r["labels"], r["score"]) for r in scan_licenses(docs, rules).collect()}
    assert found == {1: ("high,low", 0.4), 2: ("mid", 0.3)}


def test_own_texts_of_licenses(spark):
    """Each sentence is found where it stands in other words, with its own label."""
    docs = spark.createDataFrame([(i, f"Note: {t.capitalize()}, etc.") for i, (_, t) in enumerate(_SENTENCES)], "doc_id bigint, text string")
    found = {r["doc_id"]: (r["labels"].split(","), r["score"]) for r in scan_licenses(docs).collect()}
    assert all(label in found[i][0] and found[i][1] == 1.0 for i, (label, _) in enumerate(_SENTENCES))


def test_messy_rows(spark):
    found = scan_licenses(messy(spark)).collect()
    shown = sorted(((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in found), key=repr)
    assert shown == sorted(((i, *base(t)) for i, t, *_ in ROWS), key=repr)
    assert scan_licenses(empty(spark)).collect() == []


def test_own_rules(spark):
    rules = [Rule("a", "stone", "stone(?: bridge)?", 2, 0.5), Rule("b", "old", "old mill", 1, 0.25)]
    found = {r["doc_id"]: (r["labels"], r["score"], r["n_base"]) for r in scan_licenses(messy(spark), rules).collect()}
    assert found[10] == ("a,b", 0.5, 0) and found[11] == ("b", 0.25, 0) and found[1] == ("", 0.0, 0)
