import math
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import edge_docs, empty_docs, rows_of, split_words
from pyspark.sql import functions as F

from gridspark.llm import catalog
from gridspark.llm import lm as L


def held(doc):
    return doc is not None and zlib.crc32(str(doc).encode()) % 7 == 2


def brute(docs):
    """Base scores, and Witten-Bell scores from quantised counts without a filter."""
    texts = [(doc, held(doc), split_words(text)) for doc, text in docs]
    words, pairs = Counter(), Counter()
    for _, out, w in texts:
        if not out:
            words.update([*w, None])
            pairs.update(zip(["<", *w], [*w, None]))
    n, v, begun = sum(words.values()), len(words), sum(not h for _, h, _ in texts)
    follow = Counter(h for h, _ in pairs)
    about = lambda c: L.MEANING[L.level(np.array([c]))[0]] if c else 0
    for doc, out, w in texts:
        plain = [(words[t] + 1) / (n + v + 1) for t in [*w, None]]
        total = 0.0
        for h, t, p in zip(["<", *w], [*w, None], plain):
            c = begun if h == "<" else words[h]
            if c:
                types = max(1, about(follow[h]))
                p = (min(about(pairs[h, t]), c) + types * p) / (c + types)
            total += math.log10(min(p, 1))
        yield doc, out, len(w) + 1, sum(words[t] > 0 for t in [*w, None]), n, sum(map(math.log10, plain)), total


def test_query(spark, sf):
    want = {r[0]: r for r in brute([(r.doc_id, r.text) for r in rows_of(spark, sf, "documents")])}
    got = catalog.op3_lm_scores(spark, sf).collect()
    assert len(got) == len(want)
    near = []
    for r in got:
        w = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[1:5]
        assert r.base_score == pytest.approx(w[5], rel=1e-9)
        assert r.score >= w[6] - 1e-6 * abs(w[6]) - 0.05 * r.n_tokens
        near.append((r.score - w[6]) / r.n_tokens)
    # The filter only errs by false hits, about one level in three hundred.
    assert abs(np.mean(near)) < 0.03
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_shards_and_segments(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    one = {r.doc_id: r for r in L.score(docs).collect()}
    monkeypatch.setattr(L, "SEGMENT_KEYS", 4000)
    many = {r.doc_id: r for r in L.score(docs, shard_bytes=20_000).collect()}
    assert one.keys() == many.keys()
    for k, r in one.items():
        # Pieces of other sizes have other false hits.
        assert abs(many[k].score - r.score) < 0.1 * r.n_tokens and many[k].base_score == pytest.approx(r.base_score) and many[k].n_known == r.n_known


def test_edges(spark):
    docs = edge_docs(spark)
    want = sorted((r[0] is None, r) for r in brute([(r.doc_id, r.text) for r in docs.collect()]))
    got = sorted((r.doc_id is None, tuple(r)) for r in L.score(docs).collect())
    assert len(got) == len(want)
    for (_, g), (_, w) in zip(got, want):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5])
    assert L.score(empty_docs(spark)).count() == 0
    none = L.score(docs, held=F.lit(True)).collect()
    assert all(r.train_tokens == 0 and r.score == pytest.approx(r.base_score) for r in none)


def test_split_histories(spark, monkeypatch):
    """Followers of frequent histories in many parts, most of them empty, whether seen or not: T is that of the whole history."""
    few = [(i, f"hub few{i % 3} a{i}") for i in range(400)]
    many = [(1000 + i, f"wide many{i % 60} b{i}") for i in range(400)]
    new = [(5000 + i, f"hub a{i} wide b{i} hub many{i % 60}") for i in range(200) if held(5000 + i)]
    docs = [*few, *many, *new]
    want = {r[0]: r for r in brute(docs)}
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    for part_tokens, shard_bytes in ((1 << 20, 1 << 20), (5, 1 << 20), (5, 1000)):
        monkeypatch.setattr(L, "PART_TOKENS", part_tokens)
        monkeypatch.setattr(L, "SEGMENT_KEYS", 500)
        got = {r.doc_id: r for r in L.score(df, shard_bytes=shard_bytes).collect()}
        assert got.keys() == want.keys()
        off = np.array([abs(got[d].score - w[6]) / w[2] for d, w in want.items()])
        assert np.mean(off < 0.001) > 0.9 and off.max() < 0.5 and off.mean() < 0.02


def test_each_pass_reads_its_share(spark, sf, monkeypatch):
    """With the same segments, one shard or dozens give the same scores, and together the passes read every seen position once."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    monkeypatch.setattr(L, "SEGMENT_KEYS", 2000)
    one = {r.doc_id: r for r in L.score(docs).collect()}
    read, real = [], L.of_shard

    def counted(dealt, shard):
        part = real(dealt, shard)
        read.append((shard, sum(len(r.work) // L._WORK.itemsize for r in part.collect()), part._jdf.queryExecution().executedPlan().toString()))
        return part
    monkeypatch.setattr(L, "of_shard", counted)
    many = {r.doc_id: r for r in L.score(docs, shard_bytes=5_000).collect()}
    assert len(read) >= 20 and [r[0] for r in read] == list(range(len(read)))
    assert all("PartitionFilters: [isnotnull(shard" in plan for _, _, plan in read)
    # Positions after a history that training has not seen need no filter; all others are read once.
    words = [[None, *split_words(r.text)] for r in docs.collect()]
    learned = {w for r, t in zip(docs.collect(), words) if not held(r.doc_id) for w in t}
    assert sum(n for _, n, _ in read) == sum(w in learned for t in words for w in t)
    assert one.keys() == many.keys()
    for k, r in one.items():
        assert many[k].score == pytest.approx(r.score, rel=1e-9) and many[k].base_score == pytest.approx(r.base_score)
