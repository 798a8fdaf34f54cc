import random
from collections import Counter

from helpers import edge_docs, empty_docs, rows_of, split_words

from gridspark.llm import catalog
from gridspark.llm import near_dedup as N


def brute(docs, per_cent=85):
    """Component of each row by comparing all pairs that share a shingle."""
    sets = [frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
            for w in (split_words(t) for _, t in docs)]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    holders = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        for j in {j for x in s for j in holders[x] if j < i}:
            common = len(s & sets[j])
            if 100 * common >= per_cent * len(s | sets[j]):
                parent[find(i)] = find(j)
    low = {}
    for i, (doc, _) in enumerate(docs):
        r = find(i)
        low[r] = doc if low.get(r) is None else min(low[r], doc) if doc is not None else low[r]
    out = []
    for i, (doc, _) in enumerate(docs):
        comp = low[find(i)] if sets[i] else doc
        out.append((doc, len(sets[i]), comp, doc == comp))
    return out


key = lambda r: tuple((x is None, x) for x in r)
plain = lambda df: sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()), key=key)


def test_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in rows_of(spark, sf, "documents")]
    want = sorted(brute(docs), key=key)
    assert plain(catalog.op1_near_dedup(spark, sf)) == want
    assert not all(r[3] for r in want)


def test_edges(spark):
    docs = edge_docs(spark)
    want = sorted(brute([(r.doc_id, r.text) for r in docs.collect()]), key=key)
    assert plain(N.near_duplicates(docs)) == want
    assert N.near_duplicates(empty_docs(spark)).count() == 0


def test_chains_around_the_threshold(spark, monkeypatch):
    """Drifting copies: neighbours are linked, far ones are not, many pairs lie just below; small blocks."""
    monkeypatch.setattr(N, "BLOCK", 4)
    rng, docs = random.Random(3), []
    for family in range(6):
        words = [f"f{family}w{rng.randrange(10**6)}" for _ in range(120)]
        for step in range(25):
            words = list(words)
            words[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
            if step % 6 == 5:
                words[rng.randrange(120)] = f"y{rng.randrange(10**6)}"
            docs.append((rng.randrange(10**9), " ".join(words)))
    rng.shuffle(docs)
    got = plain(N.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string")))
    assert got == sorted(brute(docs), key=key)


def test_pruning_bounds():
    fewest = N.least_matches(1e-6)
    assert len(fewest) == N.SIZE // N.BATCH and all(a < b for a, b in zip(fewest, fewest[1:]))
    assert 0.70 < fewest[-1] / N.SIZE < 0.80


def test_bands_miss_no_more_at_other_thresholds():
    missed = lambda per_cent: (1 - (per_cent / 100) ** N.ROWS) ** N.bands_for(per_cent)
    assert N.bands_for(85) == N.BANDS and all(missed(p) <= missed(85) < 1e-6 for p in (80, 90, 100))


def test_a_large_bucket_with_few_others(spark, monkeypatch):
    """Blocks of one label are not compared: copies are linear in the bucket, with one or many labels beside it."""
    monkeypatch.setattr(N, "BLOCK", 64)
    rows = [(1, i, 5) for i in range(20000)] + [(1, 30000, 6)] + [(2, i, i % 3) for i in range(900)] + [(3, i, 9) for i in range(500)]
    rows += [(4, i, i // 2) for i in range(40)]
    labelled = spark.createDataFrame(rows, "key long, node long, label long").repartition(5)
    sets = spark.createDataFrame([(n, bytearray(8)) for n in range(30001)], "node long, set binary")
    got = N._blocks(labelled, sets).collect()
    copies = Counter(r.key for r in got)
    assert copies[1] <= 20000 + 20000 / 64 * 2 and copies[3] == 0 and copies[4] == 40
    label = {(k, n): x for k, n, x in rows}
    met = set()
    groups = {}
    for r in got:
        groups.setdefault((r.key, r.i, r.j), []).append(r)
    for (key, i, j), members in groups.items():
        left, right = [r for r in members if r.part == i], [r for r in members if r.part == j]
        if key in (2, 4):
            met |= {(key, *sorted((a.node, b.node))) for a in left for b in right if label[key, a.node] != label[key, b.node]}
    want = {(k, a, b) for k, size in ((2, 900), (4, 40)) for a in range(size) for b in range(a + 1, size) if label[k, a] != label[k, b]}
    assert met == want
    assert {(r.i, r.j) for r in got if r.key == 1 and r.node == 30000} == {(r.i, r.j) for r in got if r.key == 1}


def test_large_sets_make_small_parts(spark, monkeypatch):
    monkeypatch.setattr(N, "SET_BYTES", 1000)
    labelled = spark.createDataFrame([(1, i, i) for i in range(300)], "key long, node long, label long")
    sets = spark.createDataFrame([(n, bytearray(100000)) for n in range(300)], "node long, set binary")
    held = Counter((r.i, r.j) for r in N._blocks(labelled, sets).collect())
    assert max(held.values()) < 30 and len(held) > 1000
