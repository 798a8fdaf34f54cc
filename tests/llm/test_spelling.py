import random
import re
import zlib
from collections import Counter

from helpers import LOWER, edge_docs, empty_docs

from gridspark.llm import spelling as S


def vocabulary(rows, every=31):
    n = Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if every and h % every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    p = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[p + 1:] == b[p + 1:] if len(a) == len(b) else a[p:] == b[p + 1:]


def brute(n):
    words = sorted(n)
    around = {w: [v for v in words if near(w, v)] for w in words}
    form = {}
    for w in words:
        best = min(around[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(around[w]), n[form[w]] if form[w] else None))
    return out


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    n = vocabulary([(r.doc_id, r.text) for r in docs.collect()])
    want = brute(n)
    for letters in (400, S.GROUP_LETTERS):
        assert sorted(map(tuple, S.spelling_variants(docs, group_letters=letters).collect())) == want
    assert any(r[1] for r in want) and len({len(r[0]) for r in want}) > 4


def test_composition_lists_each_pair_once():
    dice = random.Random(3)
    for letters in ("ab", "abc", "aéÿz"):
        for _ in range(60):
            words = sorted({"".join(dice.choice(letters) for _ in range(dice.randint(0, 6))) for _ in range(dice.randint(0, 50))})
            got = sorted(tuple(sorted(p)) for p in S.near_pairs(words))
            assert got == [(i, j) for i in range(len(words)) for j in range(i + 1, len(words)) if near(words[i], words[j])]


def test_acceptor_is_minimal():
    words = sorted(a + b for a in ("pre", "re", "un") for b in ("do", "dos", "load", "loads", "fill", "fills"))
    a = S.Acceptor(words)
    assert a.n[a.start] == len(words)
    language = {}
    for state in range(a.start + 1):
        def spell(p):
            return ([""] if a.final[p] else []) + [c + w for c, t in zip(a.letters[p], a.targets[p]) for w in spell(t)]
        assert language.setdefault(tuple(spell(state)), state) == state


def test_hot_prefixes_and_chains(spark):
    """One prefix holds nearly all words, so that every depth is split; forms point on to forms."""
    dice = random.Random(5)
    n = {"internationalx" + "".join(dice.choice("aab") for _ in range(dice.randint(0, 7))): dice.choice([2, 3, 30, 400, 9000]) for _ in range(300)}
    n |= {"chaining": 2, "chainings": 20, "chainingss": 200, "chainingsss": 2000}
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    for letters in (1, 30, 10**6):
        assert sorted(map(tuple, S.variants(words, group_letters=letters).collect())) == brute(n)
    assert [r[2] for r in brute(n) if r[0] == "chaining"] == ["chainingsss"]


def test_long_words(spark):
    words = {"a" * 50000: 3, "a" * 50001: 40, "b" + "a" * 49999: 2, "b" * 7: 2}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert sorted(map(tuple, S.variants(df).collect())) == brute(words)


def test_edges(spark):
    docs = edge_docs(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, S.spelling_variants(docs).collect())) == brute(vocabulary(rows))
    assert {r.word: r.n for r in S.vocabulary(docs.unionByName(docs), every=None).collect()} == vocabulary(rows * 2, None)
    assert S.spelling_variants(empty_docs(spark)).count() == 0
    assert S.spelling_variants(docs).columns == ["word", "form", "root", "n", "n_near", "form_n"]
