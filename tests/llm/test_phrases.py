import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from helpers import LOWER, edge_docs, empty_docs

from gridspark.llm import phrases as P


def counts(rows):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, 5):
                f[lang or "und"].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    return f, n


def brute(rows, least=30, top=2000):
    out = []
    f, n = counts(rows)
    for lang, c in f.items():
        candidates = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        gone = {p[i:i + k] for p, a in candidates.items() for k in range(2, len(p)) for i in range(len(p) - k + 1)
                if 100 * a >= 80 * candidates[p[i:i + k]]}
        kept = []
        for p in candidates.keys() - gone:
            score, k = min((2000000 * c[p] // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -c[p], " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


def same(docs, **options):
    rows = [(r.text, r.lang) for r in docs.collect()]
    got = sorted(map(tuple, P.collocations(docs, **options).collect()))
    assert got == brute(rows, options.get("least", 30), options.get("top", 2000))
    return got


def test_whole_table(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert same(docs)
    # Ranges of a few rows, counts handed on often and a filter that lets nearly all through change nothing.
    monkeypatch.setattr(P, "RANGE_ROWS", 40)
    monkeypatch.setattr(P, "FILTER_BITS", 9)
    assert same(docs, least=8, top=25)


def test_a_frequent_word_over_many_ranges(spark, monkeypatch):
    """One first and one last word in nearly all phrases; extensions that cover a phrase and those that just do not."""
    monkeypatch.setattr(P, "RANGE_ROWS", 7)
    rows = [(f"the w{i} of, w{i} the the w{i}; The w{i} the x{i % 7}\tof the.the", "en" if i % 3 else None) for i in range(60)] * 2
    rows += [("alpha beta gamma", "de")] * 8 + [("alpha beta", "de")] * 2 + [("one two three", "de")] * 79 + [("one two", "de")] * 21
    docs = spark.createDataFrame(rows, "text string, lang string")
    got = same(docs, least=2)
    assert "one two" in {r[2] for r in got} and "alpha beta" not in {r[2] for r in got}


def test_wide_products(spark):
    """Counts near 2^62: the products pass 64 bits. The merged stream is given, as no text can hold so many words."""
    big = 2**62
    stream = spark.createDataFrame([("en", 1, None, None, None, big + 5), ("en", 2, None, None, None, big - 3), ("en", 1, 2, None, None, big - 7)],
                                   "lang string, w1 long, w2 long, w3 long, w4 long, f long")
    words = spark.createDataFrame([("en", 1, "a", big + 5, 7), ("en", 2, "b", big - 3, 7)], "lang string, h long, word string, f long, n long")
    with pytest.MonkeyPatch.context() as m:
        m.setattr(P, "phrase_counts", lambda *_: (stream, words))
        got = P.collocations(None).collect()
    assert [(r.phrase, r.score) for r in got] == [("a b", 2000000 * (big - 7) // (2 * big + 2))]


def test_edges(spark):
    docs = edge_docs(spark)
    for least in (1, 3):
        same(docs, least=least)
    same(docs.unionByName(docs), least=2)
    assert P.collocations(empty_docs(spark)).count() == 0
    none = docs.withColumn("text", docs.lang.substr(1, 0))
    assert P.collocations(none).count() == 0


def test_what_is_handed_on_comes_in_small_batches():
    """A task's distinct words and phrases reach the JVM in many batches, whole and counted right."""
    n = 150_000
    texts = [" ".join(f"w{i}" for i in range(k, k + 1000)) for k in range(0, n, 1000)] * 2
    batches = list(P._encode([pa.record_batch({"lang": ["en"] * len(texts), "text": texts})]))
    words = [b for b in batches if b.column("words").null_count]
    assert max(map(len, words)) <= 1 << 16
    total = Counter()
    for b in words:
        total.update(dict(zip(b.column("word").to_pylist(), b.column("n").to_pylist())))
    assert total == {f"w{i}": 2 for i in range(n)}
    coded = [pa.record_batch({"lang": b.column("lang"), "words": b.column("words"), "block": pa.array([3] * len(b), pa.int32())})
             for b in batches if not b.column("words").null_count]

    class Filter:
        value = np.full(1 << (P.FILTER_BITS - 3), 255, np.uint8).tobytes()
    pairs = list(P._hash_counter((2,), 1, Filter, P.FILTER_BITS)(coded))
    assert max(map(len, pairs)) <= 1 << 16
    assert sum(sum(b.column("f").to_pylist()) for b in pairs) == len(texts) * 999
