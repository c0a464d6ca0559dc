"""A small table of documents with everything that may go wrong in one."""

from __future__ import annotations

import functools

LONG = " ".join(f"word{i % 97} und{i % 13}" for i in range(3000))
PLAIN = "the river runs past the old mill and under the stone bridge before it meets the sea at last"

ROWS = [
    (1, "Plain Text here. MIT License", "en", "a", 1),
    (2, "plain text HERE. mit license", "en", "a", 2),
    (2, "plain text HERE. mit license", "en", "a", 2),  # a repeated row
    (3, None, None, None, None),
    (4, "", "en", "b", 0),
    (5, " \t\n ", None, "b", 3),
    (None, "no id, GNU General  Public\nLicense, version 3", "en", None, 5),
    (6, LONG, "de", "a", None),
    (7, LONG + " end", "de", "a", None),
    (8, "ÉCLAIR été İstanbul ß 日本語 \U0001f600", "fr", "c", 9),
    (9, "éclair été İstanbul ß 日本語 \U0001f600", "fr", "c", 9),
    (10, PLAIN, "en", "b", 4),
    (11, PLAIN.replace("stone", "iron"), "en", "b", 4),
    (12, "x", "en", "c", 1),
    (12, "y", "en", "c", 1),  # one id, two texts
]

# Names that the operators use inside.
CLASHES = ["rid", "pos", "name", "h", "fp", "key", "node", "size", "part", "guest", "line", "rank", "level", "__row", "__key"]


@functools.cache
def _schema(extra: bool) -> str:
    columns = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    return columns + "".join(f", {c} string" for c in CLASHES) if extra else columns


def messy(spark, extra: bool = True):
    rows = [r + ("clash",) * len(CLASHES) if extra else r for r in ROWS]
    return spark.createDataFrame(rows, _schema(extra)).repartition(3)


def empty(spark):
    return spark.createDataFrame([], _schema(False))


def lower_ascii(text: str | None) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def collected(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)
