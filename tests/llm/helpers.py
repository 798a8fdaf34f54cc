"""Rows with hard cases, and plain readings of the tables for brute-force comparisons."""

from __future__ import annotations

import re

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, text_h string, _h string, kept string, start string, items string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def edge_docs(spark, n: int = 40):
    """Null, empty, blank, one-word, repeated, tied, junk and very long texts; null ids, languages and sources; clashing names."""
    sentence = "The quick brown fox jumps over the lazy dog and Ünder the bridge runs away from it all"
    rows = [
        (None, "no id here at all but some words", "en", "a"), (None, None, None, None), (1, None, "en", "a"), (2, "", "de", None),
        (3, "  \n\t ", None, "a"), (4, "word", "en", "b"), (5, "Word", "en", "b"), (6, sentence, "en", "a"), (6, sentence, "en", "a"),
        (7, sentence, None, "c"), (8, sentence + " x", "en", "a"), (8, sentence + " y", "en", None), (9, "1234 %% 99", "fr", "a"),
        (10, "\n".join([sentence] * 5), "en", "a"), (11, " ".join(f"w{i}" for i in range(60000)), "en", "a"),
        (12, "a" * 200000, "en", "a"), (13, "é🎉 É ß ſ K 漢字 кириллица", "ru", "d")]
    rows += [(100 + 7 * i, f"{sentence} and number {i % 5} of many", "en" if i % 3 else "de", "hot") for i in range(n)]
    return spark.createDataFrame([(*r, -1, "h", "x", "kept", "start", "items") for r in rows], SCHEMA)


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet").collect()


def split_words(text):
    return WORD.findall((text or "").translate(LOWER))
