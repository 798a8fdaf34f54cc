import re
import time

from helpers import LOWER, edge_docs, empty_docs
from pyspark.sql import functions as F

from gridspark.llm import licenses as L

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PATTERNS = [re.compile(f"(?<![^ ])(?:{r.pattern})(?![^ ])") for r in L.RULES]


def brute(text):
    words = WORD.findall((text or "").translate(LOWER))
    line, have = " ".join(words), set(words)
    found = []
    for i, (r, pattern) in enumerate(zip(L.RULES, PATTERNS)):
        if have & set(r.keywords):
            for m in pattern.finditer(line):
                first = line[:m.start()].count(" ")
                found.append((first, first + m.group().count(" "), i))

    def stronger(a, b):
        """Whether b holds the interval of a and goes before it."""
        p, q = L.RULES[a[2]].priority, L.RULES[b[2]].priority
        return a != b and b[0] <= a[0] and b[1] >= a[1] and (q > p or q == p and (b[:2] != a[:2] or b[2] < a[2]))
    kept = [a for a in found if not any(stronger(a, b) for b in found)]
    base = [a for a in found if L.RULES[a[2]].base]
    labels = lambda rows: ",".join(sorted({L.RULES[a[2]].label for a in rows}))
    return (len(words), len(base), min((a[0] for a in base), default=None), max((a[0] for a in base), default=None), labels(base),
            labels(kept + base), max((L.RULES[a[2]].confidence for a in kept + base), default=0.0), sorted(kept))


def result(r):
    return (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score,
            sorted((f.start, f.end, f.rule) for f in r.found if f.kept))


NOTICES = [
    "Licensed under the Apache License, Version 2.0", "released under the terms of the GNU Lesser General Public License v2.1 or any later version",
    "GPLv3", "SPDX-License-Identifier: GPL-2.0-or-later", "CC BY-NC-SA 4.0 and cc by, CC-BY", "All rights reserved. All Rights\n\nReserved",
    "GNU General Public License general public license version 3 or later", "mit License; distributed under the MIT license",
    "see https://opensource.org/licenses/MPL-2.0", "creativecommons.org/licenses/by/4.0", "Creative Commons Attribution-ShareAlike 3.0 Unported",
    "mit freundlichen Grüßen, general mozilla apache", "reserved all rights", "EUPL 1.2 Boost Software Licence BSD 3-Clause License"]


def test_rules():
    assert len(L.RULES) > 300 and len({(r.label, r.pattern, r.base) for r in L.RULES}) == len(L.RULES)
    for r in L.RULES:
        assert re.compile(r.pattern).groups == 0 and "'" not in r.pattern + r.label and "\\" not in r.pattern
        assert 0 <= r.priority < L.LEVELS and 0 < r.confidence <= 1
    assert [(r.pattern, r.label) for r in L.RULES if r.base] == [(p, label) for p, label, _ in L.BASE]


def test_notices(spark):
    texts = NOTICES + [" ".join(NOTICES), "\n".join(reversed(NOTICES * 3))]
    docs = spark.createDataFrame([(i, t, "x", -1) for i, t in enumerate(texts)], "doc_id long, text string, found string, kept long")
    got = {r.doc_id: result(r) for r in L.license_scan(docs).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}
    label = {t: got[i][5] for i, t in enumerate(texts)}
    assert label[NOTICES[0]] == "apache-2.0" and label[NOTICES[1]] == "gpl,lgpl-2.1-or-later" and label[NOTICES[2]] == "gpl-3.0"
    assert label[NOTICES[3]] == "gpl-2.0-or-later" and label[NOTICES[11]] == "" and got[5][1:5] == (2, 0, 3, "reserved")


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id: result(r) for r in L.license_scan(docs).collect()} == {d: brute(t) for d, t in texts.items()}


def test_many_matches_in_one_text(spark):
    """Work is linear in the matches but for their order."""
    text = "all rights reserved cc by 4.0 " * 60000
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    L.license_scan(docs.limit(0)).collect()
    t = time.perf_counter()
    r, = L.license_scan(docs).drop("found").collect()
    assert time.perf_counter() - t < 60
    assert (r.n_words, r.n_base, r.first_word, r.last_word) == (7 * 60000, 120000, 0, 7 * 59999 + 3)
    assert r.labels == "cc-by,cc-by-4.0,reserved"


def test_edges(spark):
    docs = edge_docs(spark).unionByName(edge_docs(spark).withColumn("text", F.lit("Cc By")))
    got = L.license_scan(docs)
    rows = got.collect()
    assert len(rows) == docs.count()
    order = lambda x: sorted(x, key=str)
    assert order((r.doc_id, result(r)) for r in rows) == order((r.doc_id, brute(r.text)) for r in docs.collect())
    assert L.license_scan(empty_docs(spark)).count() == 0
