"""Fixity: damage found against comparing all records."""

import pytest
from pyspark.sql import functions as F

from rowtide.llm.fixity import archive, audit, build_trees, suspect_ranges

SCHEMA = "page_id bigint, url string, html string, file string, node string"


def pages(spark, n=260):
    rows = [(i, f"http://host/{i}", f"<p>page {i}</p>" * (1 + i % 7), "clash", "clash") for i in range(n)]
    rows += [(None, None, None, None, None), (5, "http://host/5", "<p>page 5</p>" * 6, None, None), (300, "http://host/é", "é" * 500, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def brute(left, right):
    def places(df):
        found = {}
        for r in df.collect():
            found.setdefault((r["file"], r["offset"]), []).append((r["length"], r["digest"]))
        return {k: sorted(v) for k, v in found.items()}

    a, b = places(left), places(right)
    status = lambda k: "missing" if k not in b else "extra" if k not in a else "corrupt"
    return sorted((*k, status(k)) for k in a.keys() | b.keys() if a.get(k) != b.get(k))


@pytest.mark.parametrize("range_bytes, fanout", [(128, 8), (1 << 20, 16)])
def test_damage(spark, range_bytes, fanout):
    whole = pages(spark)
    changed = whole.withColumn("html", F.when(F.col("page_id") % 50 == 7, F.lit("<p>other</p>")).otherwise(F.col("html")))
    damaged = changed.where("page_id IS NULL OR page_id NOT IN (99, 259, 300)").unionAll(whole.where("page_id = 199"))
    left, right = (archive(x, 100).cache() for x in (whole, damaged))
    found = audit(left, right, range_bytes, fanout)
    assert sorted((r["file"], r["offset"], r["status"]) for r in found.collect()) == brute(left, right)


def test_equal_replicas(spark):
    left = archive(pages(spark), 100)
    assert audit(left, archive(pages(spark).repartition(5), 100)).collect() == []
    assert audit(left.limit(0), left.limit(0)).collect() == []
    assert {r["status"] for r in audit(left, left.limit(0)).collect()} == {"missing"}


def test_only_differing_branches_are_followed(spark):
    whole = pages(spark).where("page_id < 260").distinct()
    other = whole.withColumn("html", F.when(F.col("page_id") == 120, F.upper("html")).otherwise(F.col("html")))
    a, b = build_trees([archive(whole, 100), archive(other, 100)], 512, 4)
    assert a.files[-1].count() == 1 and len(a.ranges) == len(b.ranges) >= 3
    (row,) = suspect_ranges(a, b, 4).collect()
    assert row["file"] == 1
    (record,) = audit(archive(whole, 100), archive(other, 100), 512, 4).collect()
    assert record["record_id"] == 120 and record["status"] == "corrupt"


def test_layout_is_that_of_the_files(spark):
    rows = archive(pages(spark), 100).where("file = 1").orderBy("offset").collect()
    at = 0
    for r in rows:
        assert r["offset"] == at
        at += r["length"]
    i, html = 100, "<p>page 100</p>" * (1 + 100 % 7)
    head = f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:{i}>\r\nWARC-Target-URI: http://host/{i}\r\n"
    record = f"{head}Content-Type: text/html\r\nContent-Length: {len(html)}\r\n\r\n{html}\r\n\r\n"
    assert rows[0]["length"] == len(record.encode())
