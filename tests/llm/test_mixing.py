"""Mixing: against filling and drawing one source after the other."""

import hashlib
import re
from collections import defaultdict

import pytest

from messy import ROWS, collected, empty, messy
from rowtide.llm.mixing import mix_sources

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fill(sizes, weights, most):
    """Shares by weight; who is above the limit gets the limit, the others share the rest."""
    left, open_now, target = float(sum(sizes.values())), set(sizes), {}
    while open_now:
        unit = left / sum(weights[s] for s in open_now)
        full = {s for s in open_now if unit * weights[s] > most * sizes[s]}
        if not full:
            return target | {s: unit * weights[s] for s in open_now}
        for s in full:
            target[s] = float(most * sizes[s])
            left -= target[s]
        open_now -= full
    return target


def brute(rows, most=3, bins=None):
    md5 = lambda text: hashlib.md5(text.encode()).hexdigest()
    seen, docs = defaultdict(int), []
    for i, t, _, s, _ in rows:
        twin = md5("|".join(["" if s is None else "=" + s, "" if i is None else str(i), md5(t or "")]))
        docs.append((i, s, len(WORD.findall(t or "")), md5(f"mix:{twin}:{seen[twin]}")))
        seen[twin] += 1
    sizes = defaultdict(int)
    for _, s, n, _ in docs:
        sizes[s] += n
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    target = fill(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}, most)
    boost = lambda n: 1 if n < 16 else 2 if n < 256 else 4
    result = []
    for s in names:
        mine = [d for d in docs if d[1] == s]
        by_boost = defaultdict(int)
        for _, _, n, _ in mine:
            by_boost[boost(n)] += n
        wanted = fill_copies({b: n for b, n in by_boost.items() if n}, target[s], most)
        rest = target[s] - sum(int(wanted[b]) * n for b, n in by_boost.items() if n)
        order = []
        for i, _, n, draw in mine:
            chance = wanted.get(boost(n), 0.0) % 1
            if chance:
                u = (int(draw[:13], 16) + 0.5) / 2**52
                q = u / (1 - u) / (chance / (1 - chance))
                order.append((q / (1 + q), draw, n))
        used, chosen = 0, set()
        for _, draw, n in sorted(order):
            if used + n / 2 <= rest:
                chosen.add(draw)
            used += n
        for i, _, n, draw in mine:
            copies = int(wanted.get(boost(n), 0)) + (draw in chosen)
            result.append((i, n, sizes[s], round(target[s], 6), n * copies))
    return sorted(result, key=repr)


def fill_copies(words, target, most):
    """Copies by weight class, proportional to the weight, at most `most`."""
    copies, left, open_now = {}, target, set(words)
    while open_now:
        rate = left / sum(words[b] * b for b in open_now)
        full = {b for b in open_now if rate * b >= most}
        if not full:
            return copies | {b: rate * b for b in open_now}
        for b in full:
            copies[b] = float(most)
            left -= most * words[b]
        open_now -= full
    return copies


def digest(df):
    return sorted(
        ((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in df.collect()), key=repr
    )


def many():
    return [(i, "w " * (1 + i * i % 37 * (1 if i % 9 else 20)), None, f"s{i % 4 if i % 3 else 0}", 0) for i in range(300)]


@pytest.mark.parametrize("bins", [1, 64])
def test_against_drawing_one_by_one(spark, bins):
    rows = many()
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert digest(mix_sources(df, bins=bins)) == brute(rows)


def test_messy_rows(spark):
    found = mix_sources(messy(spark))
    assert digest(found) == brute(ROWS)
    assert collected(found) == collected(mix_sources(messy(spark).repartition(1)))  # reruns agree
    assert mix_sources(empty(spark)).collect() == []


def test_sources_come_near_their_targets(spark):
    rows = [(i, "w " * (20 + i * 7919 % 300), None, f"s{i % 7}", 0) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    sums = mix_sources(df).join(df.select("doc_id", "source"), "doc_id").groupBy("source", "target").sum("taken").collect()
    for r in sums:
        assert abs(r["sum(taken)"] - r["target"]) <= 160


def test_rows_without_ids_are_drawn_one_by_one(spark):
    """Equal texts, a third of them without an id, and one row many times: targets are met to a document."""
    words = "w " * 20
    rows = [(None if i % 3 == 0 else i, words, None, f"s{i % 2}", 0) for i in range(3000)] + [(-1, words, None, "s1", 0)] * 400
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    found = mix_sources(df)
    assert digest(found) == brute(rows)
    assert digest(found) == digest(mix_sources(df.repartition(7)))
    taken = defaultdict(int)
    for r in found.collect():
        taken[r["target"]] += r["taken"]
    assert len(taken) == 2 and all(abs(n - target) <= 20 for target, n in taken.items())
