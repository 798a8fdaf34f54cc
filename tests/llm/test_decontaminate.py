import hashlib
import re

from helpers import LOWER, edge_docs, empty_docs, rows_of

from gridspark.llm import catalog
from gridspark.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(docs, items, length=10):
    cut = lambda t: WORD.findall((t or "").translate(LOWER))
    windows = {}
    for item, text in items:
        w = cut(text)
        for i in range(max(1, len(w) - length + 1) if w else 0):
            windows.setdefault(tuple(w[i:i + length]), set()).add(item)
    sizes = {len(w) for w in windows}
    for doc, text in docs:
        w, hit, found = cut(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (who := windows.get(tuple(w[i:i + n]))) is not None:
                    hit.update(range(i, i + n))
                    found |= who
        names = sorted(str(x) for x in found if x is not None)
        yield doc, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)


COLUMNS = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
key = lambda r: tuple((x is None, x) for x in r)
plain = lambda df: sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=key)


def test_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in rows_of(spark, sf, "documents")]
    items = [(r.item_id, r.text) for r in rows_of(spark, sf, "benchmark")]
    want = sorted(brute(docs, items), key=key)
    assert plain(catalog.op10_decontamination(spark, sf)) == want
    assert any(r[-1] for r in want) and not all(r[-1] for r in want)


def test_edges(spark, monkeypatch):
    items = [(1, "brown fox jumps over the lazy DOG and under the"), (2, "the quick brown fox jumps over the lazy dog and ünder the"),
             (3, "word"), (4, None), (5, ""), (6, "lazy dog"), (None, "runs away"), (6, "lazy dog"), (7, "w1 w2 w3 w4"), (8, "нет"),
             (9, "no such words anywhere in these texts at all really none")]
    table = spark.createDataFrame(items, "item_id bigint, text string")
    docs = edge_docs(spark)
    want = sorted(brute([(r.doc_id, r.text) for r in docs.collect()], items), key=key)
    found = D.decontaminate(docs, table)
    assert set(docs.columns) <= set(found.columns)
    assert plain(D.hit_digests(found)) == want
    monkeypatch.setattr(D, "BROADCAST_ROWS", 7)
    assert plain(D.hit_digests(D.decontaminate(docs, table))) == want
    assert D.decontaminate(empty_docs(spark), table).count() == 0
    none = D.decontaminate(docs, table.limit(0))
    assert none.where("n_hit > 0").count() == 0 and none.count() == docs.count()


def test_many_items_of_one_word(spark):
    """A thousand items share their one window; its ids go to a document once, however often the word stands there."""
    items = [(i, "alpha") for i in range(1000)] + [(1000 + i, f"beta w{i % 7}") for i in range(50)] + [(5000, "alpha beta gamma delta")]
    docs = [(1, "alpha " * 3000), (2, "beta w3 alpha, beta w4"), (3, "gamma"), (None, "alpha"), (4, "alpha beta gamma"), (4, "alpha beta gamma delta")]
    table = spark.createDataFrame(items, "item_id bigint, text string")
    found = D.decontaminate(spark.createDataFrame(docs, "doc_id bigint, text string"), table)
    assert plain(D.hit_digests(found)) == sorted(brute(docs, items), key=key)
    assert found.schema["spans"].dataType.elementType.names == ["start", "len", "window"]
