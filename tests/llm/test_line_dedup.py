import re
import time

from helpers import edge_docs, empty_docs
from pyspark.sql import functions as F

from gridspark.llm import line_dedup as D


def brute(rows, sites):
    bare = lambda x: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", x)
    spread = {}
    for site, text in rows:
        for x in (text or "").split("\n"):
            spread.setdefault(bare(x), set()).add(site)
    common = {x for x, s in spread.items() if x and len(s) >= sites}
    for site, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if bare(x) not in common]
        yield site, text, "\n".join(kept), len(lines), len(lines) - len(kept)


key = lambda r: tuple((x is None, x) for x in r)


def test_spread_around_the_threshold(spark):
    """Lines on one to three hundred sites, near and far from the threshold, with repeats inside a site."""
    rows = []
    for n in (1, 2, 7, 8, 9, 10, 11, 40, 300):
        rows += [(f"s{i}" if i else None, f"own {n} {i}\n  on {n} sites \n\non {n} sites") for i in range(n)] * 2
    docs = spark.createDataFrame([(i, s, t, "a", "b") for i, (s, t) in enumerate(rows)], "doc_id bigint, source string, text string, line string, key string")
    for sites in (2, 10, 250):
        got = [(r.source, rows[r.doc_id][1], r.text, r.n_lines, r.n_removed) for r in D.dedup_lines(docs, sites=sites).collect()]
        assert sorted(got, key=key) == sorted(brute(rows, sites), key=key)


def test_edges(spark):
    docs = edge_docs(spark)
    got = D.dedup_lines(docs, sites=2)
    assert set(docs.columns) <= set(got.columns)
    want = [(a, c, d, e) for a, _, c, d, e in brute([(r.source, r.text) for r in docs.collect()], 2)]
    assert sorted(((r.source, r.text, r.n_lines, r.n_removed) for r in got.collect()), key=key) == sorted(want, key=key)
    assert D.dedup_lines(empty_docs(spark)).count() == 0
    assert D.dedup_lines(docs.limit(0).withColumn("source", F.lit("x"))).count() == 0


def test_many_lines_in_one_document(spark):
    """Work is linear in a document's lines: 200,000 of them on ten sites, common ones and own ones mixed."""
    text = "\n".join(f"common {i % 50}" if i % 3 else f"own {i}" for i in range(200000))
    rows = [(f"s{i}", text.replace("own", f"own {i}") if i % 2 else text) for i in range(10)]
    docs = spark.createDataFrame([(i, s, t) for i, (s, t) in enumerate(rows)], "doc_id bigint, source string, text string")
    t = time.perf_counter()
    got = sorted((r.source, r.text, r.n_lines, r.n_removed) for r in D.dedup_lines(docs).collect())
    assert time.perf_counter() - t < 120
    assert got == sorted((a, c, d, e) for a, _, c, d, e in brute(rows, 10))


def test_places_left_out(spark):
    for n, gone in ((0, []), (1, []), (1, [0]), (5, [0, 4]), (5, [1, 2, 3]), (6, [0, 1, 2, 3, 4, 5]), (7, [3])):
        df = spark.createDataFrame([([str(i) for i in range(n)], gone)], "p array<string>, g array<int>")
        assert df.select(D.without(F.col("p"), F.col("g"))).first()[0] == [str(i) for i in range(n) if i not in gone]
