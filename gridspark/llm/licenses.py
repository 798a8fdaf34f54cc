"""License scan: ordered signature rules behind a keyword prefilter, overlaps resolved by priority and containment.

Native. A text is reduced to its words, each between two spaces of its own, so that rules are regular expressions over words.
A rule is filed under words of which each match
holds one; only rules with such a word in a text are matched against it. A
match is then dropped if it lies inside a match of higher priority, or of the same priority that is longer or whose rule comes
first. Matches of one text are taken in the order of their places, where one running maximum a priority level decides that, so
work is linear in the matches but for their sorting. Matches of the base phrases are always reported.

Rules are made from the table of licenses below and a few forms: identifier tag, notice, title with and without version, short
name, address. Each has a label, a priority and a confidence; the score of a text is the highest confidence among its matches.

Defined results. Null and empty texts have no words, no matches and score 0. A rule's matches are leftmost and do not overlap;
ties between rules with the same interval and priority go to the first rule of the list. Repeated rows and equal or null ids
give a row each. Texts may be of any length. An empty table gives no rows. Other columns are neither read nor returned.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, text_column

SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


@dataclass(frozen=True)
class Rule:
    """A pattern over words with single spaces between them, without capturing groups; every match holds one of `keywords`."""

    label: str
    pattern: str
    keywords: tuple[str, ...]
    priority: int
    confidence: float
    base: bool = False


#: Label stem, versions, name as a pattern over words, a word the name always holds.
LICENSES = [
    ("afl", "1.1 1.2 2.0 2.1 3.0", "academic free licen[cs]e", "academic"),
    ("agpl", "1.0 3.0", "(?:gnu )?affero general public licen[cs]e", "affero"),
    ("apache", "1.0 1.1 2.0", "apache (?:software )?licen[cs]e", "apache"),
    ("apsl", "1.0 1.1 1.2 2.0", "apple public source licen[cs]e", "apple"),
    ("artistic", "1.0 2.0", "artistic licen[cs]e", "artistic"),
    ("bsl", "1.0", "boost software licen[cs]e", "boost"),
    ("bsd-2-clause", "", "(?:simplified bsd|bsd 2 clause|2 clause bsd|freebsd) licen[cs]e", "bsd|freebsd"),
    ("bsd-3-clause", "", "(?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd) licen[cs]e", "bsd"),
    ("bsd-4-clause", "", "(?:original bsd|bsd 4 clause|4 clause bsd) licen[cs]e", "bsd"),
    ("bsd", "", "bsd(?: style)? licen[cs]e", "bsd"),
    ("busl", "1.1", "business source licen[cs]e", "business"),
    ("cc0", "1.0", "(?:cc0|creative commons zero)", "cc0|zero"),
    ("cddl", "1.0 1.1", "common development and distribution licen[cs]e", "distribution"),
    ("cecill", "1.0 1.1 2.0 2.1", "cecill (?:free software )?licen[cs]e", "cecill"),
    ("cpal", "1.0", "common public attribution licen[cs]e", "attribution"),
    ("cpl", "1.0", "common public licen[cs]e", "common"),
    ("ecl", "1.0 2.0", "educational community licen[cs]e", "educational"),
    ("epl", "1.0 2.0", "eclipse public licen[cs]e", "eclipse"),
    ("eupl", "1.0 1.1 1.2", "european union public licen[cs]e", "european"),
    ("gfdl", "1.1 1.2 1.3", "(?:gnu )?free documentation licen[cs]e", "documentation"),
    ("gpl", "1.0 2.0 3.0", "(?:gnu )?general public licen[cs]e", "general"),
    ("isc", "", "isc licen[cs]e", "isc"),
    ("lgpl", "2.0 2.1 3.0", "(?:gnu )?(?:lesser|library) general public licen[cs]e", "general"),
    ("lppl", "1.0 1.1 1.2 1.3a 1.3c", "latex project public licen[cs]e", "latex"),
    ("mit", "", "(?:mit|expat|x11) licen[cs]e", "mit|expat|x11"),
    ("mpl", "1.0 1.1 2.0", "mozilla public licen[cs]e", "mozilla"),
    ("ms-pl", "", "microsoft public licen[cs]e", "microsoft"),
    ("ms-rl", "", "microsoft reciprocal licen[cs]e", "microsoft"),
    ("mulanpsl", "1.0 2.0", "mulan permissive software licen[cs]e", "mulan"),
    ("odbl", "1.0", "open database licen[cs]e", "database"),
    ("odc-by", "1.0", "open data commons attribution licen[cs]e", "commons"),
    ("ofl", "1.0 1.1", "(?:sil )?open font licen[cs]e", "font"),
    ("osl", "1.0 1.1 2.0 2.1 3.0", "open software licen[cs]e", "open"),
    ("php", "3.0 3.01", "php licen[cs]e", "php"),
    ("psf", "2.0", "python (?:software foundation )?licen[cs]e", "python"),
    ("ruby", "", "ruby licen[cs]e", "ruby"),
    ("unlicense", "", "the unlicense", "unlicense"),
    ("zlib", "", "zlib(?: libpng)? licen[cs]e", "zlib"),
    ("zpl", "1.1 2.0 2.1", "zope public licen[cs]e", "zope"),
]
#: Creative Commons licenses: code, name as a pattern over words.
CREATIVE = [
    ("by", "attribution"), ("by-sa", "attribution share ?alike"), ("by-nd", "attribution no ?derivatives"),
    ("by-nc", "attribution non ?commercial"), ("by-nc-sa", "attribution non ?commercial share ?alike"),
    ("by-nc-nd", "attribution non ?commercial no ?derivatives"),
]
CREATIVE_VERSIONS = "1.0 2.0 2.5 3.0 4.0".split()
#: The phrases that are always reported, with their labels.
BASE = [("cc by", "cc-by", "cc"), ("general public license", "gpl", "general"), ("all rights reserved", "reserved", "reserved")]

NOTICE = ("(?:licensed|released|distributed|published|provided|available|covered|governed) (?:under|by) (?:the )?"
          "(?:terms (?:and conditions )?of )?(?:the )?(?:an? )?")
LATER = " (?:or|and) (?:at your option )?(?:any )?later(?: versions?)?"
GNU = ("gpl", "lgpl", "agpl", "gfdl")
#: Stems that name a program as well, so that stem and number alone are no license.
PRODUCTS = ("php",)
#: Priority and confidence of the forms, from weak to strong.
MENTION, TITLE, SHORT, ADDRESS, VERSION, NOTED, TAG = (0, 0.5), (1, 0.7), (1, 0.75), (2, 0.85), (2, 0.9), (3, 0.95), (4, 1.0)
LEVELS = 5


def _words(label: str) -> str:
    return re.sub("[^a-z0-9]+", " ", label.lower())


def _version(v: str) -> str:
    """A version in words; a zero at its end may be missing."""
    w = _words(v)
    return w[:-2] + "(?: 0)?" if w.endswith(" 0") else w


def _rules() -> list[Rule]:
    rules: list[Rule] = []

    def add(label: str, pattern: str, keywords: str, form: tuple[int, float], base: bool = False) -> None:
        rules.append(Rule(label, pattern, tuple(keywords.split("|")), *form, base))

    for phrase, label, keyword in BASE:
        add(label, phrase, keyword, MENTION, True)
    for stem, versions, name, keywords in LICENSES:
        add(stem, name, keywords, TITLE)
        add(stem, NOTICE + name, keywords, NOTED)
        if not versions:
            add(stem, f"spdx license identifier {_words(stem)}", "spdx", TAG)
            add(stem, f"opensource org licenses? {_words(stem)}", "opensource", ADDRESS)
        for v in versions.split():
            label, versioned = f"{stem}-{v}", f"{name} (?:version |v )?v?{_version(v)}"
            add(label, versioned, keywords, VERSION)
            add(label, NOTICE + versioned, keywords, NOTED)
            add(label, f"spdx license identifier {_words(label)}(?: only)?", "spdx", TAG)
            add(label, f"opensource org licenses? {_words(label)}", "opensource", ADDRESS)
            if stem not in PRODUCTS:
                add(label, f"{_words(stem)} v?{_version(v)}", _words(stem).split()[0], SHORT)
            if stem in GNU:
                add(label, f"{stem}v{_version(v)}", f"{stem}v{v[0]}", SHORT)
                add(f"{label}-or-later", versioned + LATER, keywords, VERSION)
                add(f"{label}-or-later", NOTICE + versioned + LATER, keywords, NOTED)
                add(f"{label}-or-later", f"spdx license identifier {_words(label)} or later", "spdx", TAG)
    for code, name in CREATIVE:
        add(f"cc-{code}", f"creative commons {name}(?: licen[cs]e)?", "creative", TITLE)
        add(f"cc-{code}", f"cc {_words(code)}", "cc", SHORT)
        for v in CREATIVE_VERSIONS:
            label, number = f"cc-{code}-{v}", _version(v)
            add(label, f"creative commons {name}(?: licen[cs]e)? {number}(?: (?:international|unported))?", "creative", VERSION)
            add(label, f"cc {_words(code)} {number}", "cc", VERSION)
            add(label, f"{NOTICE}cc {_words(code)} {number}", "cc", NOTED)
            add(label, f"creativecommons org licenses {_words(code)} {_words(v)}", "creativecommons", ADDRESS)
            add(label, f"spdx license identifier cc {_words(code)} {_words(v)}", "spdx", TAG)
    return rules


RULES = _rules()


def spaced(pattern: str) -> str:
    """The pattern over words that have two spaces between them and one before and after; its match is the one group."""
    return f" ({pattern.replace(' ?', '(?:  )?').replace(' ', '  ').replace('(?:    )?', '(?:  )?')}) "


def word_form(text: Column) -> Column:
    """The words of a lower-cased text with two spaces between them and one before and after; no word: two spaces."""
    return F.concat(F.lit(" "), F.btrim(F.regexp_replace(text, SEPARATORS, "  ")), F.lit(" "))


def _filed(rules: list[Rule]) -> Column:
    """Keyword -> its rules, as a constant; one SQL text, as single columns would be thousands of calls."""
    by_word: dict[str, list[str]] = {}
    for i, r in enumerate(rules):
        for k in r.keywords:
            by_word.setdefault(k, []).append(
                f"named_struct('rule', {i}, 'pattern', '{spaced(r.pattern)}', 'label', '{r.label}', 'priority', {r.priority}, "
                f"'confidence', {r.confidence}D, 'base', {str(r.base).lower()})")
    return F.expr("map(" + ", ".join(f"'{k}', array({', '.join(v)})" for k, v in by_word.items()) + ")")


def matches(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """One row a match (and one a text without any): __row, doc_id, n_words, m (rule, label, priority, confidence, base, start, end).

    start and end are the numbers of a match's first and last word.
    """
    rules = RULES if rules is None else rules
    keywords = F.array(*[F.lit(k) for k in sorted({k for r in rules for k in r.keywords})])
    gap, opened, closed = F.lit("  "), "\x01", "\x02"

    def spans(r: Column) -> Column:
        marked = F.regexp_replace(F.col("__words"), r["pattern"], F.lit(f" {opened}$1{closed} "))
        words = F.split(F.btrim(marked), "  ")
        first = F.filter(F.transform(words, lambda w, i: F.when(F.startswith(w, F.lit(opened)), i)), lambda i: i.isNotNull())
        last = F.filter(F.transform(words, lambda w, i: F.when(F.endswith(w, F.lit(closed)), i)), lambda i: i.isNotNull())
        found = F.zip_with(first, last, lambda a, b: F.struct(
            r["rule"].alias("rule"), r["label"].alias("label"), r["priority"].alias("priority"),
            r["confidence"].alias("confidence"), r["base"].alias("base"), a.cast("long").alias("start"), b.cast("long").alias("end")))
        return F.when(F.rlike(F.col("__words"), r["pattern"]), found)

    words = docs.select(F.monotonically_increasing_id().alias("__row"), "doc_id", word_form(ascii_lower(text_column())).alias("__words"))
    gated = words.select(
        "__row", "doc_id", "__words", F.array_intersect(F.split(F.btrim("__words"), "  "), keywords).alias("__here"),
        F.when(F.col("__words") == gap, F.lit(0)).otherwise(
            F.length("__words") - F.length(F.replace("__words", gap, F.lit(" "))) + 1).cast("long").alias("n_words"))
    picked = F.array_distinct(F.flatten(F.transform("__here", lambda k: F.element_at(_filed(rules), k))))
    found = F.flatten(F.filter(F.transform(picked, spans), lambda s: s.isNotNull()))
    return gated.select("__row", "doc_id", "n_words", F.explode_outer(F.when(F.size("__here") > 0, found)).alias("m"))


def resolved(found: DataFrame) -> DataFrame:
    """`matches` with `kept`: false where a stronger match holds the interval. One row a text and match."""
    order = "PARTITION BY __row ORDER BY m.start, m.end DESC, m.priority DESC, m.rule ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    ahead = F.array(*[F.expr(f"max(CASE WHEN m.priority >= {p} THEN m.end END) OVER ({order})") for p in range(LEVELS)])
    return found.withColumn("__ahead", ahead).withColumn(
        "kept", F.col("m").isNotNull() & ~F.coalesce(F.element_at("__ahead", F.col("m.priority") + 1) >= F.col("m.end"), F.lit(False))
    ).drop("__ahead")


def license_scan(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """One row per row of `docs` (doc_id, text): counts, labels, score and `found`, all matches with their words and fate."""
    rows = resolved(matches(docs, rules))
    base, told = F.col("m.base"), F.col("m.base") | F.col("kept")

    def joined(label: Column) -> Column:
        return F.concat_ws(",", F.array_sort(F.collect_set(label)))
    return rows.groupBy("__row", "doc_id", "n_words").agg(
        F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("m.start"))).alias("first_word"),
        F.max(F.when(base, F.col("m.start"))).alias("last_word"),
        joined(F.when(base, F.col("m.label"))).alias("base_labels"), joined(F.when(told, F.col("m.label"))).alias("labels"),
        F.coalesce(F.max(F.when(told, F.col("m.confidence"))), F.lit(0.0)).alias("score"),
        F.array_sort(F.collect_list(F.when(F.col("m").isNotNull(), F.struct(
            "m.start", "m.end", "m.rule", "m.label", "m.priority", "kept")))).alias("found")).drop("__row")
