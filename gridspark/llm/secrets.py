"""Secret scans: a trigram inverted index picks the documents each rule's regular expression has to be tried on.

Native: DataFrame functions only on the data; the rules' trigram queries are derived once, from the patterns alone.

A rule's pattern is turned into an AND of factors; a factor is an OR of literal strings, a string an AND of its trigrams.
Postings (trigram, doc_id) of exactly those trigrams are built over all texts, intersected, and every candidate is verified
by the pattern on its whole text. A rule without a mandatory trigram scans every text.

Defined results. Null or empty text: no spans. Null ids are scanned like others. Equal ids share their candidates, and each
row is verified on its own text. Spans are in code points, end exclusive, sorted by start, then by the rules' order; an empty
table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from itertools import product
from re import _constants as C
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, bound, text_column


@dataclass(frozen=True)
class Rule:
    """`pattern` in the syntax that Java and Python share; matches whose `group` is shorter than `least` are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The three base kinds, then those added.
BASE_RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
)
ADDED_RULES = (
    Rule("private", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("hosted", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("signed", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
)
RULES = BASE_RULES + ADDED_RULES

#: Literal alternatives followed at once, and members of a character class that still count as alternatives.
MOST_STRINGS, MOST_MEMBERS = 64, 8


def _members(items) -> list[str] | None:
    out: list[str] = []
    for kind, value in items:
        if kind is C.LITERAL:
            out.append(chr(value))
        elif kind is C.RANGE and value[1] - value[0] < MOST_MEMBERS:
            out += [chr(x) for x in range(value[0], value[1] + 1)]
        else:
            return None
    return out if len(out) <= MOST_MEMBERS else None


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """Factors of which all must hold; a factor holds if all trigrams of one of its alternatives occur. Empty: scan fully."""
    factors: list[list[frozenset[str]]] = []
    grams = lambda s: frozenset(s[i:i + 3] for i in range(len(s) - 2))

    def strings(node) -> list[str] | None:
        """All texts a node can match, or None if they are many."""
        kind, value = node
        if kind is C.LITERAL:
            return [chr(value)]
        if kind is C.IN:
            return _members(value)
        if kind is C.SUBPATTERN:
            return sequence(value[3])
        if kind is C.BRANCH:
            parts = [sequence(x) for x in value[1]]
            return None if None in parts else [s for x in parts for s in x]
        if kind in (C.MAX_REPEAT, C.MIN_REPEAT):
            low, high, body = value
            own = sequence(body)
            if own is None or high is C.MAXREPEAT or high > 3 or sum(len(own) ** n for n in range(low, high + 1)) > MOST_STRINGS:
                return None
            return [s for n in range(low, high + 1) for s in map("".join, product(own, repeat=n))]
        return None

    def sequence(nodes) -> list[str] | None:
        parts = [strings(x) for x in nodes]
        if None in parts or reduce(lambda a, b: a * len(b), parts, 1) > MOST_STRINGS:
            return None
        return list(map("".join, product(*parts)))

    def close(run: list[str]) -> None:
        run = [s.lower() for s in run]
        if run and all(len(s) >= 3 for s in run):
            factors.append(sorted({grams(s) for s in run}, key=sorted))

    run = [""]
    for node in parser.parse(pattern):
        own = strings(node)
        if own is not None and len(run) * len(own) <= MOST_STRINGS:
            longer = [a + b for a in run for b in own]
            if min(map(len, own)) == 0 and all(len(s) >= 3 for s in run):
                continue  # optional: what stands before it is a factor as good without it
            run = longer
            continue
        close(run)
        if own is None and node[0] in (C.MAX_REPEAT, C.MIN_REPEAT) and node[1][0] > 0:
            inner = sequence(node[1][2])
            close(inner or [])
        elif own is not None:
            close(own)
        run = [""]
    close(run)
    return factors


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """(trigram, doc_id) for those of `trigrams` that occur in a text in lower case."""
    low = docs.select("doc_id", ascii_lower(text_column()).alias("_low"))
    found = F.array_compact(F.array(*[F.when(F.contains("_low", F.lit(g)), F.lit(g)) for g in trigrams]))
    return low.select("doc_id", F.explode(found).alias("trigram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(doc_id, kinds): the rules with mandatory trigrams whose query a document meets, by intersected postings."""
    spark = docs.sparkSession
    terms, sizes = [], []
    for rule in rules:
        query = trigram_query(rule.pattern)
        sizes += [(rule.kind, len(query))] if query else []
        terms += [(g, rule.kind, i, j, len(alternative)) for i, factor in enumerate(query)
                  for j, alternative in enumerate(factor) for g in alternative]
    if not terms:
        return docs.select("doc_id", F.array().cast("array<string>").alias("kinds")).limit(0)
    # Both tables grow with the rules alone.
    term = F.broadcast(spark.createDataFrame(terms, "trigram string, kind string, factor int, alternative int, need int"))
    size = F.broadcast(spark.createDataFrame(sizes, "kind string, factors int"))
    met = (postings(docs, sorted({t[0] for t in terms})).join(term, "trigram")
           .groupBy("doc_id", "kind", "factor", "alternative", "need").agg(F.count_distinct("trigram").alias("n"))
           .where("n = need"))
    return (met.groupBy("doc_id", "kind").agg(F.count_distinct("factor").alias("n")).join(size, "kind")
            .where("n = factors").groupBy("doc_id").agg(F.collect_set("kind").alias("kinds")))


#: Elements whose sum is taken one by one; sums of such blocks are taken the same way, twice.
BLOCK = 64


def sums_before(values: Column, levels: int = 3) -> Column:
    """For each element of a long array the sum of those before it, by sums of blocks: linear in the array but for its length / BLOCK^2."""
    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0).cast("bigint"), lambda acc, y: acc + y)

    def one_by_one(v: Column) -> Column:
        return F.transform(v, lambda _, i: total(F.slice(v, F.lit(1), i)))

    def by_blocks(v: Column) -> Column:
        count = F.ceil(F.size(v) / F.lit(BLOCK)).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), count - 1), lambda b: total(F.slice(v, b * BLOCK + 1, F.lit(BLOCK))))
        return bound(sums_before(blocks, levels - 1), lambda done: F.transform(v, lambda _, i: F.get(done, F.floor(i / F.lit(BLOCK)).cast("int")) + total(
            F.slice(v, F.floor(i / F.lit(BLOCK)).cast("int") * BLOCK + 1, F.pmod(i, F.lit(BLOCK))))))
    return bound(values, lambda v: F.when(F.size(v) <= BLOCK, one_by_one(v)).otherwise(by_blocks(v)) if levels > 1 else one_by_one(v))


def rule_spans(text: Column, rule: Rule, order: int) -> Column:
    """Spans (start, order, kind, end) of a rule in a text: the lengths of matches and of the gaps between them add up."""
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    tested = whole if rule.group == 0 else F.regexp_extract_all(text, pattern, F.lit(rule.group))
    gaps = F.split(text, rule.pattern, -1)
    # The last gap has no match behind it.
    lengths = F.zip_with(F.zip_with(F.slice(gaps, F.lit(1), F.size(gaps) - 1), whole, lambda g, w: F.struct(
        F.length(g).cast("bigint").alias("gap"), F.length(w).cast("bigint").alias("match"))),
        tested, lambda s, x: F.struct(s["gap"].alias("gap"), s["match"].alias("match"), F.length(x).alias("test")))

    def placed(found: Column) -> Column:
        before = sums_before(F.transform(found, lambda x: x["gap"] + x["match"]))
        spans = F.zip_with(found, before, lambda x, b: F.struct(
            (b + x["gap"]).cast("int").alias("start"), F.lit(order).alias("ord"), F.lit(rule.kind).alias("kind"),
            (b + x["gap"] + x["match"]).cast("int").alias("stop"), x["test"].alias("test")))
        return F.transform(F.filter(spans, lambda s: s["test"] >= max(rule.least, 1)), lambda s: F.struct(
            s["start"].alias("start"), s["ord"].alias("ord"), s["kind"].alias("kind"), s["stop"].alias("stop")))
    none = F.array().cast("array<struct<start:int,ord:int,kind:string,stop:int>>")
    return F.when(F.size(whole) > 0, bound(lengths, placed)).otherwise(none)


def secret_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Each row's doc_id and spans: array of (start, ord, kind, stop), sorted."""
    kinds = candidates(docs, rules).select(F.col("doc_id").alias("_id"), "kinds")
    rows = docs.select("doc_id", text_column().alias("text"))
    flagged = rows.join(kinds, F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    none = F.array().cast("array<struct<start:int,ord:int,kind:string,stop:int>>")
    parts = []
    for i, rule in enumerate(rules):
        found = rule_spans(F.col("text"), rule, i)
        if trigram_query(rule.pattern):
            found = F.when(F.coalesce(F.array_contains("kinds", rule.kind), F.lit(False)), found).otherwise(none)
        elif rule.group == 0 and rule.least and re.fullmatch(r"\[[^\]]+\]\+", rule.pattern):
            # Runs of one class are as long as they can be, so the shorter test finds the same texts in one pass.
            found = F.when(F.col("text").rlike(f"{rule.pattern[:-1]}{{{rule.least},}}"), found).otherwise(none)
        parts.append(found)
    return flagged.select("doc_id", F.array_sort(F.concat(*parts)).alias("spans"))


def span_digests(found: DataFrame, base: tuple[Rule, ...] = BASE_RULES) -> DataFrame:
    """Counts of the base kinds, their digest, and all spans as text."""
    shown = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))
    own = F.filter("spans", lambda s: s["kind"].isin(*[r.kind for r in base]))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select(
        "doc_id", *[count(r.kind).alias(f"n_{r.kind}") for r in base],
        F.sha2(F.array_join(F.transform(own, shown), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", shown), ",").alias("spans"))
