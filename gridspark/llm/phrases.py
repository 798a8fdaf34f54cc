"""Phrase collocations: count streams in prefix and in suffix order, merged in lockstep for left, right and extension counts.

Free style: numpy in Arrow batches encodes and counts, Spark orders and merges. One pass over the texts writes words as 64-bit
hashes and, once a task, each word with its count. Phrases are counted by hash, those of two words and then longer ones: only
phrases whose words, or whose pairs of words, are all frequent can be frequent, and a bit filter of fixed size over those parts,
which never denies one, leaves out most others. With its count comes the number of one block of texts that a phrase is in; a
last pass has each frequent phrase spelled out there, once. All frequent phrases form one stream, ordered by
language and words. In this prefix order each phrase follows its own first words, so that a merge that remembers the last
phrase of each length gives the counts of its first parts; in suffix order, words reversed, it gives those of its last parts.
Streams are cut into ranges of bounded size, and each range is told the last phrases before it, so that no word, however
frequent, meets in one task. A phrase inside a longer frequent one is inside one that has one word more and is at least as
frequent; so the same two merges tell which phrases an extension covers.

Defined results. Null texts have no words; a null language is `und`. Repeated rows count as often as they stand; ties go by the
phrase's bytes. Texts and words may be of any length. An empty table gives no rows. The identity of words and of
phrases is that of 64-bit hashes. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, small_batches, text_column, written
from .words import mix, text_slices, word_spans

LONGEST, LEAST, TOP = 4, 30, 2000
SCALE = 2_000_000
#: A phrase goes if a longer one holds it and has this share of its count, of 100.
COVER = 80
#: log2 of the bits of the filter of frequent phrases; 2^27 are 16 MB.
FILTER_BITS = 27
#: Rows of one range of a stream.
RANGE_ROWS = 100_000
#: Distinct words or phrases a task holds before it hands them on, and those it hands on at once.
HELD, HANDED = 1 << 18, 1 << 15

_GAPS = np.zeros(256, dtype=bool)
_GAPS[[ord(c) for c in ".,;:!?\n\v\f\r"]] = True
_SPACE = np.uint8(0x20)
_TURN = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]
_KEYS = [f"w{i}" for i in range(1, LONGEST + 1)]


def _salt(langs: pa.Array) -> np.ndarray:
    """A number a language, the same everywhere."""
    code = langs.dictionary_encode()
    each = []
    for x in code.dictionary.to_pylist():
        b = np.frombuffer((x or "").encode() or b"\0", np.uint8).astype(np.uint64)
        each.append(mix(np.array([int((b * np.power(np.uint64(1099511628211), np.arange(len(b), dtype=np.uint64))).sum()) + len(b)], np.uint64))[0])
    return np.array(each, np.uint64)[code.indices.to_numpy(zero_copy_only=False)] if len(code) else np.zeros(0, np.uint64)


def _phrase_hashes(words: np.ndarray, salt: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n consecutive words and their language."""
    out = salt[:len(words) - n + 1].copy()
    for j in range(n):
        out += words[j:len(words) - n + 1 + j] * _TURN[j]
    return mix(out)


class _Held:
    """Counts by hash, in order of the hash, next to other columns of which the first seen counts."""

    def __init__(self) -> None:
        self.h, self.n, self.others = np.zeros(0, np.uint64), np.zeros(0, np.int64), []

    def add(self, h: np.ndarray, others) -> None:
        """Count all of `h`; `others` gives the other columns of the places it is called with, which are new."""
        u, where, n = np.unique(h, return_index=True, return_counts=True)
        at = np.minimum(np.searchsorted(self.h, u), max(len(self.h) - 1, 0))
        old = self.h[at] == u if len(self.h) else np.zeros(len(u), bool)
        self.n[at[old]] += n[old]
        if old.all():
            return
        fresh = others(where[~old])
        h = np.concatenate([self.h, u[~old]])
        order = np.argsort(h, kind="stable")
        self.h, self.n = h[order], np.concatenate([self.n, n[~old]])[order]
        self.others = [np.concatenate([a, b])[order] for a, b in zip(self.others, fresh)] if self.others else [c[order] for c in fresh]

    def full(self) -> bool:
        return len(self.h) > HELD

    def taken(self) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        out = self.h, self.n, self.others
        self.__init__()
        return out


def _encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, words, ...) of texts, 0 between pieces, and rows (lang, word, h, key, n) of the task's distinct words."""
    schema = pa.schema([("lang", pa.string()), ("words", pa.list_(pa.int64())), ("word", pa.string()), ("h", pa.int64()),
                        ("key", pa.int64()), ("n", pa.int64())])

    def rows(**have: pa.Array) -> pa.RecordBatch:
        n = len(next(iter(have.values())))
        return pa.record_batch([have.get(f.name, pa.nulls(n, f.type)).cast(f.type) for f in schema], schema=schema)

    def handed_on() -> pa.RecordBatch:
        key, n, (lang, h, word) = held.taken()
        return rows(lang=pa.array(lang.tolist(), pa.string()), word=pa.array(word.tolist(), pa.string()), h=pa.array(h.view(np.int64)),
                    key=pa.array(key.view(np.int64)), n=pa.array(n))
    held = _Held()
    for batch in batches:
        langs = batch.column("lang")
        for first, last, data, offsets in text_slices(batch.column("text"), 1 << 20):
            gap = _GAPS[data]
            starts, ends, h, counts = word_spans(np.where(gap, _SPACE, data), offsets, fold=False)
            h[h == 0] = 1
            passed = np.zeros(len(data) + 1, dtype=np.int64)
            np.cumsum(gap, out=passed[1:])
            # A break stands before a word if a gap lies between it and the word before.
            broken = np.zeros(len(h), dtype=bool)
            broken[1:] = passed[starts[1:]] > passed[ends[:-1]]
            upto = np.concatenate([[0], np.cumsum(counts)])
            broken[upto[:-1][counts > 0]] = False
            shift = np.cumsum(broken)
            out = np.zeros(len(h) + int(broken.sum()), dtype=np.uint64)
            out[np.arange(len(h)) + shift] = h
            edges = upto + np.concatenate([[0], shift])[upto]
            lang = langs.slice(first, last - first)
            yield rows(lang=lang, words=pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(out.view(np.int64))))
            of, names, body = np.repeat(np.arange(last - first), counts), np.array(lang.to_pylist(), dtype=object), data.tobytes()

            def spelled(at: np.ndarray) -> list[np.ndarray]:
                word = np.empty(len(at), dtype=object)
                word[:] = [body[a:b].decode() for a, b in zip(starts[at].tolist(), ends[at].tolist())]
                return [names[of[at]], h[at], word]
            held.add(_phrase_hashes(h, _salt(lang)[of], 1), spelled)
            if held.full():
                yield from _parts(handed_on())
    if len(held.h):
        yield from _parts(handed_on())


def _parts(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows in batches of `HANDED`, since a batch is held as a whole by the task that reads it."""
    for first in range(0, len(rows), HANDED):
        yield rows.slice(first, HANDED)


def _bit(bits: np.ndarray, hashes: np.ndarray, log_bits: int) -> np.ndarray:
    """Whether the filter has each hash."""
    place = hashes & np.uint64((1 << log_bits) - 1)
    return (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0


def _walk(batches: Iterable[pa.RecordBatch], lengths: tuple[int, ...], part: int, bits: np.ndarray, log_bits: int) -> Iterator[tuple]:
    """For every batch of encoded texts and every length: the phrases whose parts of `part` words pass the filter.

    Gives the length, the phrases' places and hashes, all words, and the rows of the places, the rows' languages and blocks.
    """
    for batch in batches:
        lists, langs = batch.column("words"), batch.column("lang").fill_null("und")
        offsets = np.asarray(lists.offsets)
        words = np.asarray(lists.values)[offsets[0]:offsets[-1]].view(np.uint64)
        if len(words) < part:
            continue
        sizes = np.diff(offsets)
        salt = np.repeat(_salt(langs), sizes)
        row = np.repeat(np.arange(len(sizes)), sizes)
        names, blocks = np.array(langs.to_pylist(), dtype=object), np.asarray(batch.column("block")).astype(np.uint64)
        known = _bit(bits, _phrase_hashes(words, salt, part), log_bits)
        for n in lengths:
            m = len(words) - n + 1
            if m < 1:
                continue
            # Phrases end where their text ends: a place's row must be the same at both ends.
            may = row[:m] == row[n - 1:]
            for j in range(n - part + 1):
                may &= known[j:j + m]
            for j in range(n):
                may &= words[j:j + m] != 0
            at = np.flatnonzero(may)
            if len(at):
                h = salt[at].copy()
                for j in range(n):
                    h += words[at + j] * _TURN[j]
                yield n, at, mix(h), words, row[at], names, blocks


def _hash_counter(lengths: tuple[int, ...], part: int, filtered, log_bits: int):
    """A function that counts phrases of these lengths by hash, and says a block of texts each is in."""
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def handed_on() -> pa.RecordBatch:
            h, f, (block,) = held.taken()
            return pa.record_batch([pa.array(h.view(np.int64)), pa.array(f), pa.array(block.astype(np.int32))], names=["h", "f", "block"])
        bits, held = np.frombuffer(filtered.value, np.uint8), _Held()
        for _, _, h, _, row, _, blocks in _walk(batches, lengths, part, bits, log_bits):
            held.add(h, lambda new: [blocks[row[new]]])
            if held.full():
                yield from _parts(handed_on())
        if len(held.h):
            yield from _parts(handed_on())
    return count


def _spell_out(lengths: tuple[int, ...], part: int, filtered, own, log_bits: int):
    """A function that gives the words of phrases, each from the block that `own`, a filter of hashes and blocks, names for it."""
    def spell(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def handed_on(n: int) -> pa.RecordBatch:
            h, f, (lang, *words) = held[n].taken()
            words = [pa.array(w.view(np.int64)) for w in words] + [pa.nulls(len(f), pa.int64())] * (LONGEST - n)
            return pa.record_batch([pa.array(h.view(np.int64)), pa.array(lang.tolist(), pa.string()), *words], names=["h", "lang", *_KEYS])
        bits, named = np.frombuffer(filtered.value, np.uint8), np.frombuffer(own.value, np.uint8)
        held = {n: _Held() for n in lengths}
        for n, at, h, words, row, names, blocks in _walk(batches, lengths, part, bits, log_bits):
            mine = np.flatnonzero(_bit(named, _with_block(h, blocks[row]), log_bits))
            if not len(mine):
                continue
            at, row = at[mine], row[mine]
            held[n].add(h[mine], lambda new: [names[row[new]], *[words[at[new] + j] for j in range(n)]])
            if held[n].full():
                yield from _parts(handed_on(n))
        for n in held:
            if len(held[n].h):
                yield from _parts(handed_on(n))
    return spell


def _with_block(h: np.ndarray, block: np.ndarray) -> np.ndarray:
    """A hash of a phrase and a block of texts."""
    return mix(h + (block + np.uint64(1)) * _TURN[0])


def _block_hashes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """`_with_block` of rows (h, block)."""
    for batch in batches:
        h, block = np.asarray(batch.column("h")).view(np.uint64), np.asarray(batch.column("block")).astype(np.uint64)
        yield pa.record_batch([pa.array(_with_block(h, block).view(np.int64))], names=["h"])


def _filter_of(hashes: DataFrame, log_bits: int) -> bytes:
    """The bit filter of hashes (h): at most 2^(log_bits - 6) rows come to the driver, whatever their number."""
    place = F.col("h").bitwiseAND(F.lit((1 << log_bits) - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), place.bitwiseAND(F.lit(63)).cast("int"))
    slots = hashes.groupBy(F.shiftright(place, 6).alias("slot")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(1 << (log_bits - 6), dtype=np.int64)
    out[np.asarray(slots.column("slot").combine_chunks())] = np.asarray(slots.column("bits").combine_chunks())
    return out.tobytes()


def phrase_counts(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """The frequent phrases (lang, w1..w4, f), shorter ones with nulls, and the words (lang, h, key, word, f, n) they are made of.

    n is the number of all words of the language.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), ascii_lower(text_column()).alias("text"))
    # The block is the task that encoded a text: its number stays with the text.
    coded = texts.mapInArrow(_encode, "lang string, words array<bigint>, word string, h bigint, key bigint, n bigint")
    coded = written(coded.withColumn("block", F.spark_partition_id()), "coded", compression="zstd")
    # The word is a key too, so that the aggregate hashes; one hash has one word.
    every = written(coded.where("key IS NOT NULL").groupBy("key", "lang", "h", "word").agg(F.sum("n").alias("f")), "words")
    total = every.groupBy("lang").agg(F.sum("f").cast("bigint").alias("n"))
    words = written(every.where(F.col("f") >= least).join(total, "lang").select("lang", "h", "key", "word", "f", "n"), "words")
    texts = coded.where("words IS NOT NULL").select("lang", "words", "block")

    def sent(hashes: DataFrame):
        return spark.sparkContext.broadcast(_filter_of(hashes, FILTER_BITS))

    def frequent(lengths: tuple[int, ...], part: int, filtered) -> DataFrame:
        some = texts.mapInArrow(_hash_counter(lengths, part, filtered, FILTER_BITS), "h bigint, f bigint, block int")
        return written(some.groupBy("h").agg(F.sum("f").alias("f"), F.min("block").alias("block")).where(F.col("f") >= least), "phrases")
    single = sent(words.select(F.col("key").alias("h")))
    pairs = frequent((2,), 1, single)
    longer = frequent((3, 4), 2, sent(pairs))
    found = pairs.unionByName(longer)
    own = sent(found.mapInArrow(_block_hashes, "h bigint"))
    spelled = texts.mapInArrow(_spell_out((2, 3, 4), 1, single, own, FILTER_BITS), "h bigint, lang string, " + ", ".join(f"{k} bigint" for k in _KEYS))
    phrases = spelled.distinct().join(found.select("h", "f"), "h").select("lang", *_KEYS, "f")
    alone = words.select("lang", F.col("h").alias("w1"), *[F.lit(None).cast("bigint").alias(k) for k in _KEYS[1:]], "f")
    return written(alone.unionByName(phrases), "stream"), words


def _length() -> Column:
    return sum((F.col(k).isNotNull().cast("int") for k in _KEYS), F.lit(0))


def _first_parts(stream: DataFrame, keys: list[str], name: str) -> DataFrame:
    """`stream` with the counts of each phrase's first 1, 2 and 3 words in the order of `keys`, as name1, name2, name3.

    The lockstep merge: in this order a phrase's first words came before it, and the last phrase of each length so far is them.
    """
    rows = stream.count()
    ranges = max(1, -(-rows // RANGE_ROWS))
    order = ["lang", *keys]
    dealt = stream.repartitionByRange(ranges, *[F.col(c).asc_nulls_first() for c in order]).withColumn("__range", F.spark_partition_id())
    dealt = written(dealt, "ranges")
    parts = range(1, LONGEST)

    def of_length(k: int) -> Column:
        """The phrase of k words in this row, if it is one."""
        here = F.col(keys[k - 1]).isNotNull()
        if k < LONGEST:
            here &= F.col(keys[k]).isNull()
        return F.when(here, F.struct("lang", *keys[:k], "f"))
    lasts = dealt.groupBy("__range").agg(*[F.max(of_length(k)).alias(f"__end{k}") for k in parts])
    # One row a range: the last phrases before it.
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.select("__range", *[F.last(f"__end{k}", ignorenulls=True).over(before).alias(f"__carry{k}") for k in parts])
    so_far = Window.partitionBy("__range").orderBy(*[F.col(c).asc_nulls_first() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    merged = dealt.select("*", *[F.last(of_length(k), ignorenulls=True).over(so_far).alias(f"__last{k}") for k in parts])
    merged = merged.join(carried, "__range")

    def count_of(k: int) -> Column:
        last = F.coalesce(F.col(f"__last{k}"), F.col(f"__carry{k}"))
        same = F.col("lang") == last["lang"]
        for c in keys[:k]:
            same &= F.col(c) == last[c]
        return F.when(same, last["f"])
    return merged.select(*stream.columns, *[count_of(k).alias(f"{name}{k}") for k in parts])


def _reversed(stream: DataFrame) -> DataFrame:
    """`stream` with v1..v4, its words from the last to the first."""
    back = F.reverse(F.filter(F.array(*_KEYS), lambda w: w.isNotNull()))
    return stream.withColumn("__back", back).select(
        "*", *[F.get("__back", F.lit(i)).alias(f"v{i + 1}") for i in range(LONGEST)]).drop("__back")


def merged_counts(stream: DataFrame) -> DataFrame:
    """`stream` with l1..l3, the counts of a phrase's first words, and r1..r3, those of its last words."""
    back = [f"v{i}" for i in range(1, LONGEST + 1)]
    both = _first_parts(_reversed(stream), back, "r").drop(*back)
    return _first_parts(both, _KEYS, "l")


def _score(k: int, n: int) -> Column:
    """floor(SCALE * f / (l + r)) of the cut after k of n words, in whole numbers."""
    l, r = (f"CAST({c} AS DECIMAL(38,0))" for c in (f"l{k}", f"r{n - k}"))
    return F.expr(f"(CAST(f AS DECIMAL(38,0)) * {SCALE}) div ({l} + {r})")


def collocations(docs: DataFrame, top: int = TOP, least: int = LEAST, cover: int = COVER) -> DataFrame:
    """The first `top` phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    stream, words = phrase_counts(docs, least)
    counted = written(merged_counts(stream).withColumn("length", _length()), "merged")

    def wide(c: Column) -> Column:
        return c.cast("decimal(38,0)")
    cuts = [F.when(F.col("length") == n, F.array(*[
        F.struct(_score(k, n).alias("score"),
                 F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{n - k}").alias("r")) for k in range(1, n)]))
        for n in range(2, LONGEST + 1)]
    candidates = counted.where("length > 1").withColumn("cut", F.array_min(F.coalesce(*cuts)))
    # A phrase's longest own parts, where it has most of their count.
    covered = None
    for n in range(3, LONGEST + 1):
        for keys, count in ((_KEYS[:n - 1], f"l{n - 1}"), (_KEYS[1:n], f"r{n - 1}")):
            part = counted.where((F.col("length") == n) & (wide(F.col("f")) * 100 >= wide(F.col(count)) * cover)).select(
                "lang", *[F.col(k).alias(to) for k, to in zip(keys, _KEYS)],
                *[F.lit(None).cast("bigint").alias(to) for to in _KEYS[n - 1:]])
            covered = part if covered is None else covered.unionByName(part)
    gone = covered.select("lang", F.array(*_KEYS).alias("key")).distinct()
    kept = candidates.withColumn("key", F.array(*_KEYS)).join(gone, ["lang", "key"], "left_anti")
    return _named_top(written(kept.select("lang", *_KEYS, "f", "cut"), "kept"), words, top)


#: Steps of the score by which the first phrases are told before they are named, and parts in which ties at the end are cut.
SCORE_STEP, TIE_PARTS = 4000, 32


def _named_top(kept: DataFrame, words: DataFrame, top: int) -> DataFrame:
    """The first `top` of each language, named.

    Counts by score step, at most 251 a language, tell the step that the last of them is in; only phrases of that step or higher
    are named. They are cut to `top` within parts of each language before they are ordered as a whole, so that no more than
    32 times `top` meet.
    """
    step = F.floor(F.col("cut.score") / SCORE_STEP)
    higher = Window.partitionBy("lang").orderBy(F.col("step").desc()).rowsBetween(Window.unboundedPreceding, -1)
    steps = kept.groupBy("lang", step.alias("step")).agg(F.count("*").alias("k")).withColumn("before", F.coalesce(F.sum("k").over(higher), F.lit(0)))
    needed = steps.where(F.col("before") < top).groupBy("lang").agg(F.min("step").alias("step"))
    named = kept.join(needed, "lang").where(step >= F.col("step")).drop("step")
    for i, k in enumerate(_KEYS):
        names = words.select("lang", F.col("h").alias(k), F.col("word").alias(f"t{i}"))
        named = named.join(names, ["lang", k], "left")
    n = words.select("lang", "n").distinct()
    phrase = F.concat_ws(" ", *[f"t{i}" for i in range(LONGEST)])
    order = [F.col("score").desc(), F.col("a").desc(), "phrase"]
    rows = (named.join(n, "lang").select("lang", phrase.alias("phrase"), F.col("f").alias("a"), F.col("cut.l").alias("l"),
                                         F.col("cut.r").alias("r"), "n", F.col("cut.score").cast("bigint").alias("score"))
            .withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(TIE_PARTS))))
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("place") <= top)
    return (rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint"))
            .where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
