import math
import zlib

import numpy as np
from helpers import edge_docs, empty_docs, rows_of
from pyspark.sql import functions as F

from gridspark.llm import catalog
from gridspark.llm import language as L


def test_query(spark, sf):
    docs = {r.doc_id: r for r in rows_of(spark, sf, "documents")}
    got = catalog.op6_language_id(spark, sf).collect()
    assert len(got) == len(docs)
    langs = {r.lang for r in docs.values() if r.lang}
    right = []
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        text = docs[r.doc_id].text or ""
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in text)) and r.lang_pred in langs | {"und"}
        if r.held_out and docs[r.doc_id].lang:
            right.append(r.lang_pred == docs[r.doc_id].lang)
    assert np.mean(right) > 0.9


def test_only_text_decides(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = L.fit(docs.where("doc_id % 3 > 0"))
    plain = {r.doc_id: r.lang_pred for r in L.predict(docs, model).collect()}
    other = docs.select((F.col("doc_id") + 10**6).alias("doc_id"), "text", F.lit("xx").alias("lang"), F.lit("y").alias("source"))
    assert {r.doc_id - 10**6: r.lang_pred for r in L.predict(other, model).collect()} == plain


def test_codes():
    for n in (2, 3, 4, 7, 8, 20, 100):
        code = L.codewords(n)
        apart = [int((a != b).sum()) for i, a in enumerate(code) for b in code[:i]]
        assert len(code) == n and min(apart) >= (1 if n == 2 else code.shape[1] // 5)
    assert L.codewords(1).shape == (1, 1)


def test_a_wrong_bit_is_corrected():
    code = L.codewords(4)
    model = L.Model(list("abcd"), code, np.zeros((L.BUCKETS, 7), np.float32), np.zeros(7, np.float32), np.ones(7, np.float32))
    margins = 3.0 * code.astype(float)
    margins[np.arange(4), [0, 2, 4, 6]] *= -1
    best, share = model.decode(margins)
    assert best.tolist() == [0, 1, 2, 3]
    assert model.decode(np.zeros((1, 7)))[1][0] < L.SURE < model.decode(3.0 * code[:1].astype(float))[1][0]


def test_edges(spark):
    docs = edge_docs(spark)
    rows = L.identify(docs).collect()
    assert len(rows) == docs.count()
    assert {r.doc_id: r.lang_pred for r in rows if r.lang_pred == "und"}.keys() >= {1, 2, 3, 9}
    assert all(r.score == 0 and not r.ambiguous for r in rows if r.lang_pred == "und")
    assert L.identify(empty_docs(spark)).count() == 0
    none = L.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in none} == {"und"}
    one = L.identify(docs.withColumn("lang", F.lit("en"))).collect()
    assert {r.lang_pred for r in one} == {"und", "en"}
    kept = L.recognised(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.lang_pred != "und" for r in rows)


def plain_buckets(text):
    """Buckets of the 1-, 2- and 3-grams that end at each kept character, by plain arithmetic."""
    kept = []
    for c in text.lower().replace("\n", " "):
        if c.isalpha():
            kept.append(ord(c))
        elif kept and kept[-1] != 32:
            kept.append(32)
    out = []
    for i, x in enumerate(kept):
        a, b = (kept[i - 1] if i > 0 else 32), (kept[i - 2] if i > 1 else 32)
        for h in (x + (1 << 21), (x + (a << 21)) ^ (1 << 62), (x + (a << 21) + (b << 42)) ^ (1 << 63)):
            out.append((h * 0x9E3779B97F4A7C15 % 2**64 >> 51) % L.BUCKETS)
    return out


def plain_decode(model, text):
    """Margins, losses and the share of the best codeword of one text, without arrays."""
    grams = plain_buckets(text)
    margins = [sum(float(model.weights[g, j]) for g in grams) / len(grams) + float(model.bias[j]) for j in range(model.code.shape[1])]
    losses = [sum(float(t) * math.log1p(math.exp(-m * int(c))) for m, c, t in zip(margins, word, model.trust)) for word in model.code]
    best = min(range(len(losses)), key=lambda i: losses[i])
    return model.langs[best], 1 / sum(math.exp(losses[best] - x) for x in losses)


def test_against_plain_arithmetic(spark, sf):
    """Buckets of hard texts; margins, losses and decoding of documents, short texts and mixed ones."""
    texts = ["", "a", "Ab", " x  y ", "Ünder 42 the\n\nBridge!", "漢字 кириллица ß", "é́a", "no-letter-joins_here", "9a9b9c"]
    for t in texts:
        grams, counts = L.ngrams([t])
        assert grams.ravel().tolist() == plain_buckets(t) and counts.tolist() == [len(plain_buckets(t)) // 3]
    together, counts = L.ngrams(texts)
    assert together.ravel().tolist() == [g for t in texts for g in plain_buckets(t)]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = L.fit(docs)
    rows = [(r.doc_id, r.text) for r in docs.where("text IS NOT NULL").orderBy("doc_id").limit(40).collect()]
    rows += [(-1 - i, t) for i, t in enumerate(texts + ["the und le " * 3, rows[0][1][:50] + rows[1][1][:50]])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for r in L.predict(df, model).collect():
        text = dict(rows)[r.doc_id]
        if not any(c.isalpha() for c in text):
            assert (r.lang_pred, r.score) == ("und", 0)
            continue
        lang, share = plain_decode(model, text)
        assert r.lang_pred == lang and abs(r.score - share) < 1e-6 and r.ambiguous == (r.score < L.SURE)


def test_a_repeated_row_changes_nothing(spark, sf):
    """Ten thousand copies of a row, and as many of one without an id, leave the model as one of each does."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    one = docs.where("lang = 'en' AND text IS NOT NULL AND length(text) < 400").orderBy("doc_id").limit(1)
    one = one.unionByName(one.withColumn("doc_id", F.lit(None).cast("bigint")))
    many = one.crossJoin(spark.range(10000)).drop("id").repartition(7)
    once, often = L.fit(docs.unionByName(one)), L.fit(docs.unionByName(many))
    assert once.langs == often.langs and len(once.langs) == 4
    for a, b in ((once.weights, often.weights), (once.bias, often.bias), (once.trust, often.trust)):
        assert np.array_equal(a, b)


def test_the_driver_gets_a_small_part_of_the_counts(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    frames = type(docs)
    sent, collect = [], frames.toArrow
    monkeypatch.setattr(frames, "toArrow", lambda df: sent.append(collect(df)) or sent[-1])
    model = L.fit(docs)
    assert model is not None and sent[0].num_rows > 50
    # A row of counts is 32 kB on the driver; the whole table of them came as that much a row.
    assert sent[0].nbytes < sent[0].num_rows * L.BUCKETS * 4 / 4
