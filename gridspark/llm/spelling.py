"""Spelling variants: the vocabulary's acceptor, composed with a one-edit transducer and with itself, lists all near words.

Free style. The vocabulary is counted in Spark. A state of the composition is (state, edits, state): without an edit both
sides are in one state, which a prefix names, and after the edit both sides read the same letters. So the accepted pairs fall
apart by the prefix read before the edit. Prefixes shared by too many words are taken one letter at a time: pairs edited right
there meet on (place, word without that letter), at most one word a letter of the alphabet, and the longer prefixes go on.
Every other prefix is an initial state of its own: its words, of bounded size, are made a minimal acceptor in one task, the
composition is run from that state and its accepted pairs are listed, each once, with the edit at the first letter that differs.

Defined results. Null and empty texts have no words. A null id counts as an empty one in the checksum. Repeated rows count as
often as they stand. Ties for a form go to the smallest word. Runs and texts may be of any length. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from os.path import commonprefix

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from .common import ascii_lower, text_column, written

LETTERS = "[a-zÀ-ÿ]"
LEAST_LENGTH, LEAST_N, TIMES = 7, 2, 10
#: One run in so many, by checksum, loses a letter.
EVERY = 31
#: Letters of an initial state's words; more go on to longer prefixes.
GROUP_LETTERS = 40_000


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_n: int = LEAST_N, every: int | None = EVERY) -> DataFrame:
    """(word, n) of the runs of letters in `docs` (doc_id, text), A-Z lower-cased; `every` is null to leave all runs whole."""
    pattern = f"{LETTERS}{{{least_length},}}"
    words = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
                        F.explode(F.regexp_extract_all(ascii_lower(text_column()), F.lit(pattern), F.lit(0))).alias("word"))
    if every:
        h = F.crc32(F.concat("id", F.lit(":"), "word").cast("binary"))
        at = F.pmod(F.col("h"), F.length("word")).cast("int")
        cut = F.concat(F.substr("word", F.lit(1), at), F.substr("word", at + 2))
        words = words.withColumn("h", h).select(F.when(F.pmod("h", F.lit(every)) == 0, cut).otherwise(F.col("word")).alias("word"))
    return (words.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n"))
            .where(F.col("n") >= least_n))


class Acceptor:
    """The minimal deterministic acceptor of sorted distinct words. Words are numbered by their rank.

    A state has letters in order, their targets, the rank of the first word behind each, whether it is final, how many words
    it accepts and a bit set of its letters. States are numbered so that targets come first.
    """

    def __init__(self, words: list[str]) -> None:
        self.letters: list[str] = []
        self.targets: list[tuple[int, ...]] = []
        self.ranks: list[tuple[int, ...]] = []
        self.final: list[bool] = []
        self.n: list[int] = []
        self.bits: list[int] = []
        self._known: dict[tuple, int] = {}
        self._bit: dict[str, int] = {}
        # The states of the last word that are still open: letters, targets, final.
        path: list[list] = [["", [], False]]
        last = ""
        for word in words:
            shared = len(commonprefix((last, word)))
            self._close(path, shared)
            for c in word[shared:]:
                path[-1][0] += c
                path.append(["", [], False])
            path[-1][2] = True
            last = word
        self._close(path, 0)
        self.start = self._state(*path[0])

    def _close(self, path: list[list], depth: int) -> None:
        while len(path) > depth + 1:
            state = self._state(*path.pop())
            path[-1][1].append(state)

    def _state(self, letters: str, targets: list[int], final: bool) -> int:
        key = (final, letters, *targets)
        if (found := self._known.get(key)) is not None:
            return found
        self._known[key] = state = len(self.n)
        ranks, at, bits = [], int(final), 0
        for c, t in zip(letters, targets):
            ranks.append(at)
            at += self.n[t]
            bits |= self._bit.setdefault(c, 1 << len(self._bit))
        self.letters.append(letters)
        self.targets.append(tuple(targets))
        self.ranks.append(tuple(ranks))
        self.final.append(final)
        self.n.append(at)
        self.bits.append(bits)
        return state


class OneEdit:
    """Accepted pairs of acceptor, one-edit transducer, acceptor, as ranks of the two words; each unordered pair once."""

    def __init__(self, acceptor: Acceptor) -> None:
        self.a = acceptor
        self._same: dict[tuple[int, int], list[tuple[int, int]]] = {}

    def _step(self, p: int, q: int) -> tuple[list[tuple[int, int]], list[tuple[int, int, int, int]]]:
        """What the edited state (p, q) accepts at once, and the edited states behind its common letters."""
        a = self.a
        done = [(0, 0)] if a.final[p] and a.final[q] else []
        if not a.bits[p] & a.bits[q]:
            return done, []
        second = dict(zip(a.letters[q], zip(a.targets[q], a.ranks[q])))
        return done, [(t, *second[c], r) for c, t, r in zip(a.letters[p], a.targets[p], a.ranks[p]) if c in second]

    def same(self, p: int, q: int) -> list[tuple[int, int]]:
        """Ranks, in p and in q, of the words both states accept: the edit is spent. An own stack, as words may be long."""
        a, known = self.a, self._same
        if p == q:
            return [(i, i) for i in range(a.n[p])]
        if not a.bits[p] & a.bits[q]:
            return [(0, 0)] if a.final[p] and a.final[q] else []
        stack = [(p, q)]
        while stack:
            u, v = stack[-1]
            if (u, v) in known:
                stack.pop()
                continue
            done, behind = self._step(u, v)
            missing = [(s, t) for s, t, _, _ in behind if s != t and (s, t) not in known]
            if missing:
                stack += missing
                continue
            found = list(done)
            for s, t, y, x in behind:
                if s == t:
                    found += [(x + i, y + i) for i in range(a.n[s])]
                else:
                    found += [(x + i, y + j) for i, j in known[s, t]]
            known[u, v] = found
            stack.pop()
        return known[p, q]

    def edits(self, p: int) -> list[tuple[int, int]]:
        """Pairs whose first different letter follows right after p."""
        a, found = self.a, []
        letters, targets, ranks = a.letters[p], a.targets[p], a.ranks[p]
        for k, (c, t, r) in enumerate(zip(letters, targets, ranks)):
            # Another letter in its place.
            for u, x in zip(targets[k + 1:], ranks[k + 1:]):
                if u == t or a.bits[t] & a.bits[u] or a.final[t] and a.final[u]:
                    found += [(r + i, x + j) for i, j in self.same(t, u)]
            # This letter more than the other word, which ends or goes on with another one.
            if a.final[p] and a.final[t]:
                found.append((0, r))
            if a.bits[p] & a.bits[t]:
                inner = dict(zip(a.letters[t], zip(a.targets[t], a.ranks[t])))
                for d, u, x in zip(letters, targets, ranks):
                    if d != c and d in inner:
                        s, y = inner[d]
                        found += [(x + i, r + y + j) for i, j in self.same(u, s)]
        return found

    def pairs(self) -> Iterator[tuple[int, int]]:
        """All accepted pairs from the initial state. States below which nothing is edited are not entered again."""
        a = self.a
        edits = [self.edits(p) for p in range(a.start + 1)]
        fruitful = [False] * len(edits)
        for p, found in enumerate(edits):
            fruitful[p] = bool(found) or any(fruitful[t] for t in a.targets[p])
        stack = [(a.start, 0)]
        while stack:
            p, base = stack.pop()
            for i, j in edits[p]:
                yield base + i, base + j
            stack += [(t, base + r) for t, r in zip(a.targets[p], a.ranks[p]) if fruitful[t]]


def near_pairs(words: list[str]) -> list[tuple[int, int]]:
    """Positions in the sorted list of distinct `words` of the pairs that one edit takes into each other."""
    return list(OneEdit(Acceptor(words)).pairs())


_PAIRS = "word string, n long, near string, near_n long"


def _compose(table: pa.Table) -> pa.Table:
    """The pairs of every initial state among the rows (prefix, word, n) of one bundle."""
    frame = table.select(["prefix", "word", "n"]).to_pandas()
    out: list[list] = [[], [], [], []]
    for prefix, rows in frame.groupby("prefix", sort=False):
        rows = sorted(zip(rows["word"], rows["n"]))
        for i, j in near_pairs([w[len(prefix):] for w, _ in rows]):
            for column, x in zip(out, (*rows[i], *rows[j])):
                column.append(x)
    return pa.table(out, pa.schema([("word", pa.string()), ("n", pa.int64()), ("near", pa.string()), ("near_n", pa.int64())]))


@F.pandas_udf(IntegerType())
def _shared(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([len(commonprefix(x)) for x in zip(a, b)], dtype="int32")


def _edited_here(words: DataFrame) -> DataFrame:
    """Pairs of `words` (word, n, depth) with a common prefix of `depth` letters whose first different letter comes next."""
    at = F.col("depth")
    left = F.concat(F.substr("word", F.lit(1), at), F.substr("word", at + 2))
    cut = words.where(F.length("word") > at).select("depth", left.alias("rest"), "word", "n", F.substr("word", at + 1, F.lit(1)).alias("c"))
    other = cut.select("depth", "rest", F.col("word").alias("near"), F.col("n").alias("near_n"), F.col("c").alias("d"))
    replaced = cut.join(other, ["depth", "rest"]).where(F.col("c") < F.col("d"))
    whole = words.select("depth", F.col("word").alias("rest"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    # Where the letter stands twice, the words differ first at a later place and are found there.
    longer = cut.where(F.col("c") != F.substr("word", at + 2, F.lit(1))).join(whole, ["depth", "rest"])
    return replaced.select("word", "n", "near", "near_n").unionByName(longer.select("word", "n", "near", "near_n"))


def variant_pairs(words: DataFrame, group_letters: int = GROUP_LETTERS) -> DataFrame:
    """(word, n, near, near_n): each unordered pair of `words` (word, n; distinct) one edit apart, once."""
    open_ = words.select("word", "n", F.lit(0).alias("depth"))
    letters = words.agg(F.sum(F.length("word") + 1)).first()[0] or 0
    settled, found = [], []
    while True:
        keyed = open_.withColumn("prefix", F.substr("word", F.lit(1), F.col("depth")))
        large = (keyed.groupBy("prefix").agg(F.sum(F.length("word") + 1).alias("size"), F.min("word").alias("low"), F.max("word").alias("high"))
                 .where(F.col("size") > group_letters).select("prefix", _shared("low", "high").alias("shared")))
        marked = written(keyed.join(large, "prefix", "left"), "prefixes")
        settled.append(marked.where("shared IS NULL").select("prefix", "word", "n"))
        crowded = marked.where("shared IS NOT NULL").select("word", "n", F.col("shared").alias("depth"))
        if crowded.isEmpty():
            break
        found.append(_edited_here(crowded))
        open_ = crowded.where(F.length("word") > F.col("depth")).withColumn("depth", F.col("depth") + 1)
    states = settled[0]
    for more in settled[1:]:
        states = states.unionByName(more)
    bundles = max(1, letters // group_letters)
    pairs = (states.withColumn("bundle", F.pmod(F.xxhash64("prefix"), F.lit(bundles)))
             .groupBy("bundle").applyInArrow(_compose, _PAIRS))
    for more in found:
        pairs = pairs.unionByName(more)
    return pairs


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of `forms` (word, form): forms followed to the last, doubling the steps each round.

    A form is `TIMES` times as frequent as its word, so that a chain has at most 18 links and the rounds are few.
    """
    links = written(forms.select("word", F.col("form").alias("root")), "links")
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = written(links.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"),
                                                               F.col("next").isNotNull().alias("moved")), "links")
        links = step.select("word", "root")
        if step.where("moved").isEmpty():
            return links


def variants(words: DataFrame, times: int = TIMES, group_letters: int = GROUP_LETTERS) -> DataFrame:
    """One row per word of `words` (word, n): form, root, n, n_near, form_n."""
    pairs = written(variant_pairs(words, group_letters), "pairs")
    both = pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("w"))).alias("best"))

    def if_enough(c: Column) -> Column:
        return F.when(-F.col("best.m") >= times * F.col("n"), c)
    named = words.join(best, "word", "left").select(
        "word", if_enough(F.col("best.w")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
        if_enough(-F.col("best.m")).alias("form_n"))
    named = written(named, "variants")
    roots = _roots(named.where("form IS NOT NULL"))
    return named.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, **options) -> DataFrame:
    """`variants` of the vocabulary of `docs` (doc_id, text)."""
    return variants(written(vocabulary(docs), "vocabulary"), **options)
