"""The manifest: against plain hashing of every tree, and of every proof by hand."""

import hashlib
import zlib

from messy import ROWS, empty, lower_ascii, messy
from rowtide.llm.manifest import manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    doc_id, _, lang, source, n_chars = row
    values = [None if v is None else str(v) for v in (doc_id, source, lang, n_chars, text)]
    return sha(*["-" if v is None else f"{len(v.encode())}:{v}" for v in values])


def levels(nodes):
    """From the leaves to the root."""
    found = [nodes]
    while len(nodes) > 1:
        nodes = [sha(*nodes[k : k + 16]) for k in range(0, len(nodes), 16)]
        found.append(nodes)
    return found


def path(tree, at):
    """Siblings before and after, level by level."""
    beside = []
    for nodes in tree[:-1]:
        first = at // 16 * 16
        beside.append(("".join(nodes[first:at]), "".join(nodes[at + 1 : first + 16])))
        at //= 16
    return beside


def brute(rows):
    by_source = {}
    for row in rows:
        by_source.setdefault(row[3], []).append(row)
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        mine = sorted(by_source[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        trees[s] = mine, levels([leaf(r, r[1]) for r in mine])
    whole = levels([trees[s][1][-1][0] for s in names])
    root, found = whole[-1][0], []
    for k, s in enumerate(names):
        mine, tree = trees[s]
        for at, row in enumerate(mine):
            beside = path(tree, at) + path(whole, k)
            hit = row[0] is not None and row[1] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0
            folded = leaf(row, lower_ascii(row[1]) if hit else row[1])
            for before, after in beside:
                folded = sha(before, folded, after)
            proof = sha(*[before + after for before, after in beside])
            found.append((row[0], tree[0][at], tree[-1][0], root, proof, folded, folded == root))
    return sorted(found, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_messy_rows(spark):
    assert rows_of(manifest(messy(spark))) == brute(ROWS)
    assert manifest(empty(spark)).collect() == []


def test_sources_of_many_sizes(spark):
    """Trees of several heights, more sources than a node has children, one with a third of all rows and null ids."""
    sizes = [1, 2, 15, 16, 17, 33, 257] + [1] * 12
    rows = [(1000 * k + i, f"Text {k} {i}", "en", f"s{k:02}", i) for k, n in enumerate(sizes) for i in range(n)]
    rows += [(None if i % 3 else 90_000 + i, f"Own {i % 5}", None, None, None) for i in range(200)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    found = rows_of(manifest(spark.createDataFrame(rows, schema).repartition(5)))
    assert found == brute(rows)
    assert 0 < sum(not r[-1] for r in found) < len(rows) / 2


def test_one_source_and_one_long_text(spark):
    rows = [(5, "A very LONG text. " * 200_000, "en", "a", 1)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    assert rows_of(manifest(spark.createDataFrame(rows, schema))) == brute(rows)
