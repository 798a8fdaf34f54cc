import hashlib
import random
from collections import Counter

import duckdb
from helpers import edge_docs, empty_docs, split_words
from pyspark.sql import functions as F

from gridspark.llm import mixing as M


def fill(budget, nodes):
    """Shares of {name: (weight, limit)} by pouring until nothing moves."""
    share, open_ = {}, {k for k, (w, _) in nodes.items() if w > 0}
    left = budget
    while open_:
        level = left / sum(nodes[k][0] for k in open_)
        full = {k for k in open_ if nodes[k][1] <= level * nodes[k][0]}
        if not full:
            share |= {k: int(level * nodes[k][0]) for k in open_}
            break
        for k in full:
            share[k] = nodes[k][1]
            left -= nodes[k][1]
        open_ -= full
    return share | {k: 0 for k, (w, _) in nodes.items() if w <= 0}


def brute(rows, weights, fraction, epochs, seed):
    leaves = {}
    for doc, path, tokens in rows:
        leaves.setdefault(path, []).append((doc, tokens))
    size = {p: sum(t for _, t in d) for p, d in leaves.items()}
    budget = {(): int(sum(size.values()) * fraction)}
    depth = len(next(iter(leaves)))
    for level in range(depth):
        for parent in [p for p in budget if len(p) == level]:
            kids = {p[:level + 1] for p in leaves if p[:level] == parent}
            nodes = {k: (weights[level].get(k[-1], 1), epochs * sum(n for p, n in size.items() if p[:level + 1] == k)) for k in kids}
            budget |= fill(budget[parent], nodes)
    for path, docs in leaves.items():
        b = budget[path]
        whole = b // size[path] if size[path] else 0
        rest, run = b - whole * size[path], 0
        yield from ((doc, e, *path) for e in range(whole) for doc, _ in docs)
        if rest > 0:
            h = lambda d: hashlib.md5(f"{seed}:{whole}:{'' if d is None else d}".encode()).hexdigest()
            for key in sorted({h(d) for d, _ in docs}):
                tied = [(d, t) for d, t in docs if h(d) == key]
                run += sum(t for _, t in tied)
                if run > rest:
                    break
                yield from ((d, whole, *path) for d, _ in tied)


def levels():
    return {"domain": F.col("d"), "lang": F.col("l"), "source": F.col("s")}


order = lambda rows: sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(M, "RANGE_ROWS", 8)
    rng = random.Random(5)
    rows = [(i, rng.choice("ab"), rng.choice(["x", "y", "z"]), rng.choice(["s1", "s1", "s1", "s2", "s3"]), rng.randrange(60)) for i in range(900)]
    rows += [(5, "a", "x", "s1", 7)] * 3 + [(2000, "c", "x", "s9", 0)]
    docs = spark.createDataFrame([(i, d, l, s, " ".join(["w"] * n)) for i, d, l, s, n in rows], "doc_id bigint, d string, l string, s string, text string")
    flat = [(i, (d, l, s), n) for i, d, l, s, n in rows]
    cases = [({"domain": {"a": 70, "b": 30}, "lang": {"x": 5, "y": 2}, "source": {}}, 0.5, 1), ({"domain": {"a": 1, "b": 40}, "lang": {"z": 0}, "source": {"s1": 9}}, 1.4, 2),
             ({"domain": {}, "lang": {}, "source": {}}, 3.0, 2), ({"domain": {}, "lang": {}, "source": {}}, 0.0, 2)]
    for weights, fraction, epochs in cases:
        got = M.mix(docs, levels(), weights, fraction, epochs, 3).select("doc_id", "epoch", "domain", "lang", "source").collect()
        want = list(brute(flat, [weights[k] for k in levels()], fraction, epochs, 3))
        assert order(map(tuple, got)) == order(want)


def test_edges(spark):
    docs = edge_docs(spark)
    given = {"domain": F.lit("d"), "lang": F.col("lang"), "source": F.col("source")}
    got = M.mix(docs, given, {"lang": {"en": 3}}, 0.5, 2, 3)
    assert set(docs.columns) < set(got.columns)
    rows = [(r.doc_id, ("d", r.lang or "none", r.source or "none"), len(split_words(r.text))) for r in docs.collect()]
    want = list(brute(rows, [{}, {"en": 3}, {}], 0.5, 2, 3))
    assert order(tuple(r) for r in got.select("doc_id", "epoch", "domain", "lang", "source").collect()) == order(want)
    assert M.mix(empty_docs(spark), given, {}, 0.5, 2, 3).count() == 0


def test_sql_covers_all_leaves(spark, sf):
    con = duckdb.connect()
    n = con.execute(f"SELECT count(DISTINCT source) FROM '{sf}/documents.parquet'").fetchall()[0][0]
    from gridspark.llm import catalog
    assert catalog.op8_mixing(spark, sf).select("source").distinct().count() == n


def test_one_id_repeated(spark, monkeypatch):
    """Half of all rows have one id, a third none: their rows are one hash each and stay or go together."""
    monkeypatch.setattr(M, "RANGE_ROWS", 8)
    rows = [(7, "a", "x", "s1", 2)] * 3000 + [(None, "a", "x", "s1", 1)] * 2000 + [(100 + i, "a", "x", "s1", i % 5) for i in range(1000)]
    docs = spark.createDataFrame([(i, d, l, s, " ".join(["w"] * n)) for i, d, l, s, n in rows], "doc_id bigint, d string, l string, s string, text string")
    flat = [(i, (d, l, s), n) for i, d, l, s, n in rows]
    for fraction in (0.2, 0.5, 0.9, 1.3):
        got = M.mix(docs, levels(), {}, fraction, 2, 3).groupBy("doc_id", "epoch").count().collect()
        want = Counter((r[0], r[1]) for r in brute(flat, [{}, {}, {}], fraction, 2, 3))
        assert {(r.doc_id, r.epoch): r["count"] for r in got} == want
