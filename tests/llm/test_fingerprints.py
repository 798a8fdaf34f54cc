import hashlib
import re

import pytest
import xxhash
from helpers import edge_docs, empty_docs, rows_of
from pyspark.sql import functions as F

from gridspark.llm import catalog
from gridspark.llm import fingerprints as P


def test_query(spark, sf):
    docs = sorted((r.doc_id, r.text or "") for r in rows_of(spark, sf, "documents"))
    got = {r.doc_id: r for r in catalog.op7_fingerprints(spark, sf).collect()}
    assert len(got) == len(docs)
    prints = {}
    for i, (doc, text) in enumerate(docs):
        following, k, row = docs[(i + 1) % len(docs)][1], len(text) // 4, got[doc]
        edited = text[:len(text) - k] + following[:k]
        assert row.n_chars == len(text) and row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert prints.setdefault(text, row.fingerprint) == row.fingerprint
        own, other, then = (set(x[j:j + 16] for j in range(0, len(x), 16)) for x in (
            row.fingerprint, row.edited_fingerprint, got[docs[(i + 1) % len(docs)][0]].fingerprint))
        assert row.near_edited == pytest.approx(len(own & other) / len(own | other))
        assert row.near_next == pytest.approx(len(own & then) / len(own | then))
    near = [r.near_edited for r in got.values() if r.n_chars > 500]
    assert 0.5 < sum(near) / len(near) < 0.75


def test_estimates(spark):
    long = " ".join(f"w{i}" for i in range(8000))
    part = " ".join(f"w{i}" for i in range(2000))
    row = spark.createDataFrame([(long, part)], "a string, b string").select(
        P.sketch(F.col("a")).alias("a"), P.sketch(F.col("b")).alias("b")).select(
        "a", "b", P.containment(F.col("b"), F.col("a")).alias("inside"), P.likeness(F.col("a"), F.col("b")).alias("like"),
        P.merged(F.array("a", "b")).alias("both")).first()
    assert row.inside == 1 and abs(row["like"] - 0.25) < 0.03 and row.both == row.a
    assert abs(len(row.a) / 7996 - P.FRACTION) < 0.02


def test_edges(spark):
    out = P.fingerprint_digests(P.fingerprints(edge_docs(spark)))
    rows = out.collect()
    assert len(rows) == edge_docs(spark).count()
    empty = [r for r in rows if r.n_chars == 0]
    assert empty and all(r.fingerprint == "" for r in empty)
    assert len({r.fingerprint for r in rows if r.doc_id == 6}) == 1
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert P.fingerprints(empty_docs(spark)).count() == 0


def test_next_over_sparse_ids(spark):
    ids = [3, 10**15, 7, 10**15 + 1, -5, 999]
    docs = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id bigint, text string")
    got = {r.doc_id: r.next.text for r in P.with_next(docs, per_block=1, blocks_together=2).collect()}
    ids.sort()
    assert got == {a: f"t{b}" for a, b in zip(ids, ids[1:] + ids[:1])}


def plain_hash(words):
    """xxhash64 of several strings in Spark's order: each is hashed with the hash of those before it as seed, the first with 42."""
    h = 42
    for w in words:
        h = xxhash.xxh64_intdigest(w.encode(), seed=h)
    return h - 2**64 if h >= 2**63 else h


def plain_sketch(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
    hashes = [plain_hash(w[i:i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [plain_hash([" ".join(w)])] if w else []
    low = sorted({h for h in hashes if h < -2**63 + int(P.FRACTION * 2**64)})
    return low or ([min(hashes)] if hashes else [])


def test_sketch_against_plain_hashes(spark, sf):
    docs = [(r.doc_id, r.text) for r in rows_of(spark, sf, "documents")] + [(-1, None), (-2, ""), (-3, "a b"), (-4, " é  ß\t漢 x y\nz "), (-5, "same " * 300)]
    got = spark.createDataFrame(docs, "doc_id bigint, text string").select("doc_id", P.sketch(F.coalesce("text", F.lit(""))).alias("s")).collect()
    assert {r.doc_id: r.s for r in got} == {d: plain_sketch(t) for d, t in docs}
