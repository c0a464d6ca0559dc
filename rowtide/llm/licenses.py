"""License statements found by ordered signature rules.

A rule is a regular expression over a text's words, with a keyword, a priority and a
weight. A rule is tried only on documents that have its keyword. Overlapping finds are
resolved from the highest priority down: a find that overlaps one that stayed at a higher
priority goes, and of the others of its priority so does one inside another. A find that
has gone removes nothing.

Rules are made from a table of licenses: each has a name, as an expression over words, and
some have sentences of their own text. A name gives rules for a tag, for a grant
("licensed under the ..."), for the name with the word license, and, if it says enough on
its own, for a bare mention.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import lower_ascii, stored

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


class Rule(NamedTuple):
    label: str
    keyword: str  # must stand in the text's words for the rule to be tried
    pattern: str  # over lower-case words with single spaces between them
    priority: int
    weight: float
    base: bool = False  # a base phrase: all its places count, whatever else is found there
    also: str = ""  # a second keyword that must stand there too


# Phrases that are always looked for, and their labels.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Label, keyword, name as an expression over words, whether the bare name says enough.
_V = r"(?: version| v)?"
_LICENSES = [
    ("0bsd", "0bsd", "0bsd", True),
    ("0bsd", "zero clause", "bsd zero clause|zero clause bsd", True),
    ("afl-2.1", "academic free", rf"academic free(?: license)?{_V} 2 1", True),
    ("afl-3.0", "academic free", rf"academic free(?: license)?{_V} 3 0", True),
    ("agpl-3.0", "affero", rf"(?:gnu )?affero general public license{_V} 3(?: 0)?", True),
    ("agpl-3.0", "agpl", rf"agpl{_V} ?3(?: 0)?(?: only| or later)?", True),
    ("apache-1.0", "apache", rf"apache(?: software)?(?: license)?{_V} 1 0", True),
    ("apache-1.1", "apache", rf"apache(?: software)?(?: license)?{_V} 1 1", True),
    ("apache-2.0", "apache", rf"apache(?: software)?(?: license)?{_V} 2(?: 0)?", True),
    ("apsl-2.0", "apple public", rf"apple public source license{_V} 2 0", True),
    ("artistic-1.0", "artistic", rf"artistic license{_V} 1 0", True),
    ("artistic-2.0", "artistic", rf"artistic license{_V} 2 0", True),
    ("beerware", "beer", "beer ?ware", False),
    ("blueoak-1.0.0", "blue oak", "blue oak model license(?: 1 0 0)?", True),
    ("bsd-2-clause", "bsd", "bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd", False),
    ("bsd-3-clause", "bsd", "bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd", False),
    ("bsd-4-clause", "bsd", "bsd 4 clause|4 clause bsd|original bsd", False),
    ("bsl-1.0", "boost", rf"boost software license{_V}(?: 1 0)?", True),
    ("bsl-1.1", "business source", rf"business source license{_V}(?: 1 1)?", True),
    ("cc0-1.0", "cc0", r"cc0(?: 1 0)?(?: universal)?", True),
    ("cc-by-1.0", "cc by", "cc by 1 0", True),
    ("cc-by-2.0", "cc by", "cc by 2 0", True),
    ("cc-by-3.0", "cc by", "cc by 3 0", True),
    ("cc-by-4.0", "cc by", "cc by 4 0", True),
    ("cc-by-sa-3.0", "cc by sa", "cc by sa 3 0", True),
    ("cc-by-sa-4.0", "cc by sa", "cc by sa 4 0", True),
    ("cc-by-nc-3.0", "cc by nc", "cc by nc 3 0", True),
    ("cc-by-nc-4.0", "cc by nc", "cc by nc 4 0", True),
    ("cc-by-nd-4.0", "cc by nd", "cc by nd 4 0", True),
    ("cc-by-nc-sa-4.0", "cc by nc sa", "cc by nc sa 4 0", True),
    ("cc-by-nc-nd-4.0", "cc by nc nd", "cc by nc nd 4 0", True),
    ("cc-by-4.0", "creative commons", r"creative commons attribution 4 0(?: international)?", True),
    ("cc-by-sa-4.0", "creative commons", r"creative commons attribution share ?alike 4 0(?: international)?", True),
    ("cc-by-nc-4.0", "creative commons", r"creative commons attribution non ?commercial 4 0(?: international)?", True),
    ("cc-by-nd-4.0", "creative commons", r"creative commons attribution no ?derivatives 4 0(?: international)?", True),
    ("cddl-1.0", "cddl", rf"cddl{_V} 1 0", True),
    ("cddl-1.0", "common development", rf"common development and distribution license{_V}(?: 1 0)?", True),
    ("cecill-2.1", "cecill", "cecill(?: free software)?(?: license)?(?: agreement)?(?: 2 1)?", True),
    ("cpl-1.0", "common public", rf"common public license{_V}(?: 1 0)?", True),
    ("ecl-2.0", "educational community", rf"educational community license{_V}(?: 2 0)?", True),
    ("elastic-2.0", "elastic", rf"elastic license{_V} 2(?: 0)?", True),
    ("epl-1.0", "eclipse", rf"eclipse public license{_V} 1 0", True),
    ("epl-2.0", "eclipse", rf"eclipse public license{_V} 2 0", True),
    ("eupl-1.1", "european union public", rf"european union public licen[cs]e{_V} 1 1", True),
    ("eupl-1.2", "european union public", rf"european union public licen[cs]e{_V} 1 2", True),
    ("gfdl-1.3", "free documentation", rf"(?:gnu )?free documentation license{_V}(?: 1 3)?", True),
    ("gpl-1.0", "general public", rf"(?:gnu )?general public license{_V} 1(?: 0)?", True),
    ("gpl-2.0", "general public", rf"(?:gnu )?general public license{_V} 2(?: 0)?", True),
    ("gpl-3.0", "general public", rf"(?:gnu )?general public license{_V} 3(?: 0)?", True),
    ("gpl-2.0", "gpl", rf"gpl{_V} ?2(?: 0)?(?: only| or later)?|gplv2", True),
    ("gpl-3.0", "gpl", rf"gpl{_V} ?3(?: 0)?(?: only| or later)?|gplv3", True),
    ("isc", "isc", "isc", False),
    ("lgpl-2.0", "lesser general", rf"(?:gnu )?lesser general public license{_V} 2(?: 0)?", True),
    ("lgpl-2.0", "library general", rf"(?:gnu )?library general public license{_V} 2(?: 0)?", True),
    ("lgpl-2.1", "lesser general", rf"(?:gnu )?lesser general public license{_V} 2 1", True),
    ("lgpl-3.0", "lesser general", rf"(?:gnu )?lesser general public license{_V} 3(?: 0)?", True),
    ("lgpl-2.1", "lgpl", rf"lgpl{_V} ?2 1(?: only| or later)?", True),
    ("lgpl-3.0", "lgpl", rf"lgpl{_V} ?3(?: 0)?(?: only| or later)?", True),
    ("lppl-1.3c", "latex project", rf"latex project public license{_V}(?: 1 3c?)?", True),
    ("mit", "mit", "mit|mit x11|x11 mit", False),
    ("mit", "expat", "expat", False),
    ("mit-0", "mit", "mit 0|mit no attribution", True),
    ("mpl-1.1", "mozilla", rf"mozilla public license{_V} 1 1", True),
    ("mpl-2.0", "mozilla", rf"mozilla public license{_V} 2(?: 0)?", True),
    ("mpl-2.0", "mpl", rf"mpl{_V} 2(?: 0)?", True),
    ("ms-pl", "microsoft public", "microsoft public", False),
    ("ms-rl", "microsoft reciprocal", "microsoft reciprocal", False),
    ("mulanpsl-2.0", "mulan", r"mulan psl v?2|mulan permissive software license", True),
    ("ncsa", "ncsa", "university of illinois ncsa|ncsa", False),
    ("odbl-1.0", "open database", rf"open database license{_V}(?: 1 0)?", True),
    ("ofl-1.1", "open font", rf"(?:sil )?open font license{_V}(?: 1 1)?", True),
    ("osl-3.0", "open software license", rf"open software license{_V} 3 0", True),
    ("postgresql", "postgresql", "postgresql", False),
    ("psf-2.0", "python software", r"python software foundation(?: license)?(?: version)?(?: 2)?", False),
    ("qpl-1.0", "public license", rf"q public license{_V}(?: 1 0)?", True),
    ("ruby", "ruby", "ruby", False),
    ("sspl-1.0", "server side public", rf"server side public license{_V}(?: 1)?", True),
    ("unicode", "unicode", "unicode(?: dfs 2016)?", False),
    ("unlicense", "unlicense", "unlicense", True),
    ("upl-1.0", "universal permissive", rf"universal permissive license{_V}(?: 1 0)?", True),
    ("vim", "vim", "vim", False),
    ("w3c", "w3c", "w3c(?: software)?", False),
    ("wtfpl", "wtfpl", "wtfpl", True),
    ("zlib", "zlib", "zlib(?: libpng)?", False),
    ("zpl-2.1", "zope", rf"zope public license{_V} 2 1", True),
]

# Sentences of license texts, as label, keyword and words.
_SENTENCES = [
    ("apache-2.0", "you may not use this file except in compliance with the license"),
    ("apache-2.0", "you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-2.0", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license"),
    ("agpl-3.0", "interacting with it remotely through a computer network"),
    ("beerware", "as long as you retain this notice you can do whatever you want with this stuff"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistributions of source code must retain the above copyright notice"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties"),
    ("bsd-3-clause", "nor the names of its contributors may be used to endorse or promote products"),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors"),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display"),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("bsl-1.0", "must be included in all copies of the software in whole or in part and all derivative works of the software"),
    ("cc", "the licensor hereby grants you a worldwide royalty free non sublicensable non exclusive irrevocable license"),
    ("cc", "unless otherwise stated this work is licensed under a creative commons"),
    ("cc0-1.0", "the person who associated a work with this deed has dedicated the work to the public domain"),
    ("cc0-1.0", "to the extent possible under law the author has waived all copyright and related or neighboring rights"),
    ("epl", "the accompanying materials are made available under the terms of the eclipse public license"),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty"),
    ("gpl-2.0", "the licenses for most software are designed to take away your freedom to share and change it"),
    ("gpl-3.0", "the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "you should have received a copy of the gnu general public license along with this program"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "the software is provided as is and the author disclaims all warranties with regard to this software"),
    ("lgpl", "this library is distributed in the hope that it will be useful but without any warranty"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability"),
    ("mpl-1.1", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-2.0", "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("ofl-1.1", "this font software is licensed under the sil open font license"),
    ("postgresql", "for any purpose without fee and without a written agreement is hereby granted"),
    ("psf-2.0", "psf is making python available to licensee on an as is basis"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("wtfpl", "you just do what the fuck you want to"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("zlib", "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("public-domain", "dedicated to the public domain"),
    ("public-domain", "released into the public domain"),
    ("public-domain", "placed in the public domain"),
    ("proprietary", "all rights reserved"),
    ("proprietary", "unauthorized copying of this file via any medium is strictly prohibited"),
    ("proprietary", "proprietary and confidential"),
]

_GRANT = (
    "(?:dual |multi )?(?:licen[cs]ed|released|distributed|published|available|provided|redistributed|covered|governed)"
    " (?:under|by) (?:the )?(?:terms of )?(?:the )?(?:conditions of )?(?:the )?"
)


def license_rules() -> list[Rule]:
    """The rules in order; the first of equal ones wins."""
    rules = [Rule(label, phrase, phrase, 1, 0.6, True) for phrase, label in BASE_PHRASES.items()]
    rules += [Rule(label, text, text, 5, 1.0) for label, text in _SENTENCES]
    for label, keyword, name, enough in _LICENSES:
        tag = " ".join("".join(c if c.isalnum() else " " for c in label).split())
        rules.append(Rule(label, "spdx license identifier", f"spdx license identifier {tag}(?: only| or later)?", 4, 1.0))
        if enough:
            rules.append(Rule(label, keyword, f"{_GRANT}(?:{name})(?: licen[cs]e)?", 3, 0.9))
            rules.append(Rule(label, keyword, f"(?:{name})", 2, 0.7))
        else:  # a common word: it takes the word license to mean one
            rules.append(Rule(label, keyword, f"{_GRANT}(?:{name}) (?:style |type )?licen[cs]e", 3, 0.9, also="licen"))
            rules.append(Rule(label, keyword, f"licen[cs]ed under (?:the )?(?:{name})", 3, 0.85, also="licen"))
        rules.append(Rule(label, keyword, f"(?:{name}) licen[cs]e|licen[cs]e (?:{name})", 2, 0.8, also="licen"))
    return rules


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _rule_table(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    rows = [(i, r.label, r.keyword, f"(?<= )(?:{r.pattern})(?= )", r.priority, r.weight, r.base, r.also) for i, r in enumerate(rules)]
    kinds = "rule int, label string, keyword string, pattern string, priority int, weight double, base boolean, also string"
    return spark.createDataFrame(rows, kinds)


def words_of(docs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """rid, doc_id, n_words, and for documents with any keyword their words, each between spaces."""
    keywords = sorted({r.also or r.keyword for r in rules})
    # A keyword that holds another one adds nothing to the first look.
    shortest = [k for k in keywords if not any(o != k and o in k for o in keywords)]
    words = docs.select("doc_id", F.regexp_extract_all(lower_ascii(F.col("text")), F.lit(WORD), F.lit(0)).alias("words"))
    joined = words.select(
        "doc_id", F.size("words").cast("bigint").alias("n_words"), F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")).alias("line")
    )
    promising = F.lit(False)
    for k in shortest:
        promising = promising | F.contains("line", F.lit(k))
    return stored(
        joined.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "n_words", F.when(promising, F.col("line")).alias("line"))
    )


def find_licenses(words: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """All finds, with the places of their words: rid, rule, label, priority, weight, base, start, end."""
    table = _rule_table(words.sparkSession, rules)
    keywords = F.array(*[F.lit(k) for k in sorted({r.keyword for r in rules})])
    tried = (
        words.where("line IS NOT NULL")
        .select("rid", "line", F.explode(F.filter(keywords, lambda k: F.contains("line", k))).alias("keyword"))
        .join(F.broadcast(table), "keyword")  # as many rows as there are rules
        .where(F.contains("line", "also"))
        .withColumn("hits", F.regexp_extract_all("line", "pattern", F.lit(0)))
        .where(F.size("hits") > 0)
    )
    pieces = tried.withColumn("between", F.split("line", F.col("pattern"), -1)).select(
        "rid", "rule", "label", "priority", "weight", "base", F.posexplode(F.arrays_zip("between", "hits")).alias("i", "p")
    )
    # Words are counted by the spaces before them; the strings stay behind.
    counted = pieces.where("p.hits IS NOT NULL").select(
        "rid", "rule", "label", "priority", "weight", "base", "i",
        _spaces(F.col("p.between")).alias("ahead"), _spaces(F.col("p.hits")).alias("inner"),
    )
    order = Window.partitionBy("rid", "rule").orderBy("i")
    until = order.rowsBetween(Window.unboundedPreceding, 0)
    start = F.sum(F.col("ahead") + F.col("inner")).over(until) - F.col("inner") - 1
    return counted.repartition("rid").withColumn("start", start).select(
        "rid", "rule", "label", "priority", "weight", "base", "start", (F.col("start") + F.col("inner")).alias("end")
    )


def keep_best(finds: DataFrame) -> DataFrame:
    """The finds left when contained and outranked ones are gone; base phrases always stay.

    One priority after the other, from the highest: a find counts against others only if it
    has stayed itself. Of equal places the first rule stays.
    """
    forward = Window.partitionBy("rid").orderBy("start", F.col("end").desc(), F.col("priority").desc(), "rule")
    backward = Window.partitionBy("rid").orderBy(F.col("start").desc(), "end", "priority", F.col("rule").desc())
    before, behind = (w.rowsBetween(Window.unboundedPreceding, -1) for w in (forward, backward))
    no = F.lit(False)
    found = finds.withColumn("stays", no)
    for p in range(5, 0, -1):
        reach = F.max(F.when(F.col("stays"), F.col("end"))).over(before)
        following = F.min(F.when(F.col("stays"), F.col("start"))).over(behind)
        outranked = F.coalesce(reach >= F.col("start"), no) | F.coalesce(following <= F.col("end"), no)
        found = found.withColumn("free", (F.col("priority") == p) & ~outranked)
        inside = F.coalesce(F.max(F.when(F.col("free"), F.col("end"))).over(before) >= F.col("end"), no)
        found = found.withColumn("stays", F.col("stays") | (F.col("free") & ~inside))
    return found.where("base OR stays").drop("free", "stays")


def scan_licenses(docs: DataFrame, rules: Sequence[Rule] | None = None) -> DataFrame:
    """License statements of every document.

    Returns one row per row of `docs`: doc_id, n_words, n_base (all places of base
    phrases), first_word and last_word (the smallest and largest start of these, counted
    from 0, else null), base_labels and labels (distinct, sorted, joined by commas, empty
    if there are none), score (the largest weight of what was found, else 0). A null text
    is empty. Repeated rows are each returned, a null doc_id too. An empty table gives an
    empty result. Columns of `docs` other than doc_id and text are not looked at.
    Priorities are 1 to 5.
    """
    rules = license_rules() if rules is None else rules
    words = words_of(docs, rules)
    base = F.when(F.col("base"), F.col("start"))
    by_row = keep_best(find_licenses(words, rules)).groupBy("rid").agg(
        F.count(base).alias("n_base"),
        F.min(base).cast("bigint").alias("first_word"),
        F.max(base).cast("bigint").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("weight").alias("score"),
    )
    return words.join(stored(by_row), "rid", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("bigint").alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
