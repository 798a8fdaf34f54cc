"""Language-model scoring with a log-frequency Bloom filter of quantised n-gram counts.

Free style: numpy in Arrow batches; Spark deals, groups and joins packed rows.

1. Texts are cut into blocks of a few megabytes: token numbers, the block's distinct words as 64-bit hashes and their training
   counts, written to the shared folder in buckets of the block, so that later joins move counts and not tokens.
2. Counts of words are summed by hash segment and go back to the blocks that asked, a few bytes a distinct word. They are exact.
3. Training bigrams (history, word), with a begin before and an end after each text, are summed by segment of their history; a
   frequent history is split by its followers. Each segment becomes one piece of the filter: an n-gram of count c is entered
   for the levels 1 .. 1 + floor(log c / log BASE); so is the number of distinct followers of each history. That of a split
   history is summed over its parts and entered once, in a small piece of its own that every shard carries.
4. The filter is broadcast in shards of at most SHARD_BYTES, one at a time, and each token is scored under the shard that holds
   its history. A count is read by probing rising levels until one is missing.

The probability of w after h is Witten-Bell interpolation: (c(h,w) + T(h) p(w)) / (c(h) + T(h)), p(w) = (c(w) + 1) / (N + V + 1),
with c(h,w) and T(h), the number of distinct followers, from the filter, and p(w) alone after a history never seen. A miss of
the filter never happens; a false hit of a level has a probability of about 0.3 %.

Bounds: a broadcast holds SHARD_BYTES, or one segment if that is larger, and some 60 bytes for each split history, of which
there is at most one for PART_TOKENS training tokens. Where the filter has several shards, positions are dealt by shard once
and a pass reads those of its shard, so all passes together read each position once; there are as many as the filter's size
divided by SHARD_BYTES, so give executors of more memory larger shards. A segment's task reads its share of all blocks' words.

Defined results. Null text: empty, so its end alone is a token. A null id is not held out. Repeated rows are scored and learned
from as often as they stand. Without training rows every count is 0 and scores equal base scores. An empty table gives no
rows. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, shared_path, small_batches, text_column, written
from .words import mix, text_slices, word_hashes

BLOCK_BYTES = 4 << 20
#: Keys of a segment, aimed at; training tokens after one history that share a part of it.
SEGMENT_KEYS, PART_TOKENS = 400_000, 1 << 20
SHARD_BYTES = 128 << 20
#: Base of the count levels, bits and probes for each level entered.
BASE, BITS, PROBES = math.sqrt(2), 12, 8
END, BEGIN = np.uint64(0x7465726D696E616C), np.uint64(0x6F70656E696E6773)
_FOLLOWERS, _STEP, _PAIR = np.uint64(0x9D39247E33776D41), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)

BLOCK_ROW = ("block bigint, doc_ids array<bigint>, held array<boolean>, lengths array<bigint>, tokens binary, words binary, "
             "trained binary, n_words bigint")


def _blocks(batches):
    """(doc_id, text, held) rows to one row a block."""
    part, number = TaskContext.get().partitionId(), 0
    for batch in batches:
        for first, last, data, offsets in text_slices(batch.column(1), BLOCK_BYTES):
            h, counts = word_hashes(data, offsets)
            held = np.array(batch.column(2).slice(first, last - first).to_pylist(), bool)
            words, local, total = np.unique(h, return_inverse=True, return_counts=True)
            # Frequent words get small numbers, which compress well.
            rank = np.argsort(-total, kind="stable")
            place = np.empty(len(rank), np.uint32)
            place[rank] = np.arange(len(rank), dtype=np.uint32)
            tokens = place[local]
            trained = np.bincount(tokens[np.repeat(~held, counts)], minlength=len(words)).astype("<u4")
            yield pa.RecordBatch.from_arrays(
                [pa.array([(part << 32) + number], pa.int64()), pa.array([batch.column(0).slice(first, last - first).to_pylist()], pa.list_(pa.int64())),
                 pa.array([held.tolist()], pa.list_(pa.bool_())), pa.array([counts.tolist()], pa.list_(pa.int64())),
                 pa.array([tokens.astype("<u4").tobytes()]), pa.array([words[rank].astype("<u8").tobytes()]),
                 pa.array([trained.tobytes()]), pa.array([len(words)], pa.int64())],
                ["block", "doc_ids", "held", "lengths", "tokens", "words", "trained", "n_words"])
            number += 1


def _segment(h: np.ndarray, n: int) -> np.ndarray:
    """0 .. n-1 from the upper half of a hash."""
    return (((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def _grouped(segment: np.ndarray):
    """Segments that occur and the positions of each, in their order."""
    order = np.argsort(segment, kind="stable")
    found, begin = np.unique(segment[order], return_index=True)
    return found.tolist(), np.split(order, begin[1:])


def _asked(n_segments: int):
    def ask(batches):
        for batch in batches:
            for block, words, trained in zip(*(batch.column(i).to_pylist() for i in range(3))):
                w, c = np.frombuffer(words, "<u8"), np.frombuffer(trained, "<u4")
                found, places = _grouped(_segment(w, n_segments))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found, pa.int32()), pa.array([block] * len(found), pa.int64()), pa.array([w[p].tobytes() for p in places], pa.binary()),
                     pa.array([c[p].tobytes() for p in places], pa.binary())], ["segment", "block", "words", "trained"])
    return ask


def _summed(group: pd.DataFrame) -> pd.DataFrame:
    """Sums of a segment's words, for each block in its own order; the segment's tokens and types on the first row."""
    sizes = [len(x) // 8 for x in group["words"]]
    words, at = np.unique(np.frombuffer(b"".join(group["words"]), "<u8"), return_inverse=True)
    total = np.bincount(at, weights=np.frombuffer(b"".join(group["trained"]), "<u4"), minlength=len(words)).astype("<i8")
    counts = np.split(total[at], np.cumsum(sizes)[:-1])
    n, v = np.zeros(len(group), np.int64), np.zeros(len(group), np.int64)
    n[0], v[0] = total.sum(), (total > 0).sum()
    return pd.DataFrame({"segment": group["segment"], "block": group["block"], "counts": [c.tobytes() for c in counts], "n": n, "v": v})


def _counts(words: np.ndarray, parts, n_segments: int) -> np.ndarray:
    """A block's counts from what its segments sent back."""
    out = np.zeros(len(words), np.int64)
    found, places = _grouped(_segment(words, n_segments))
    sent = {p["segment"]: p["counts"] for p in parts or ()}
    for segment, place in zip(found, places):
        out[place] = np.frombuffer(sent[segment], "<i8")
    return out


def _bigrams(tokens, lengths, words, counts, begun: int):
    """History, follower and history count of every position of a block's texts, ends included, and the place of the ends."""
    ends = np.cumsum(lengths + 1) - 1
    n = len(tokens) + len(lengths)
    is_end = np.zeros(n, bool)
    is_end[ends] = True
    follower, count = np.full(n, END), np.zeros(n, np.int64)
    follower[~is_end], count[~is_end] = words[tokens], counts[tokens]
    history, known = np.empty(n, np.uint64), np.empty(n, np.int64)
    history[1:], known[1:] = follower[:-1], count[:-1]
    starts = np.concatenate([[0], ends[:-1] + 1])
    history[starts], known[starts] = BEGIN, begun
    return history, follower, known, count, is_end


def _place(history, follower, known, n_segments: int, part_tokens: int):
    """Segment of a bigram, and the history with the part of its followers mixed in."""
    parts = known // part_tokens + 1
    part = np.where(parts > 1, (mix(follower ^ _STEP) >> np.uint64(40)).astype(np.int64) % parts, 0)
    place = mix(history + part.astype(np.uint64) * _PAIR)
    return _segment(place, n_segments), place


def _key(place: np.ndarray, follower: np.ndarray) -> np.ndarray:
    return mix(place + (follower >> np.uint64(32)) * _PAIR)


def _followers_key(history: np.ndarray) -> np.ndarray:
    """Key of a history's number of distinct followers, the same for all its parts."""
    return mix(mix(history) ^ _FOLLOWERS)


def _pairs(begun: int, word_segments: int, n_segments: int, part_tokens: int):
    """Blocks to packed training bigrams by segment: distinct (place of the history, upper half of the follower) and their counts.

    The places of split histories are listed with their histories.
    """
    def pack(batches):
        for batch in batches:
            for block, held, lengths, tokens, words, parts in zip(*(batch.column(i).to_pylist() for i in range(6))):
                w = np.frombuffer(words, "<u8")
                counts, lengths = _counts(w, parts, word_segments), np.array(lengths, np.int64)
                history, follower, known, _, _ = _bigrams(np.frombuffer(tokens, "<u4"), lengths, w, counts, begun)
                learn = np.repeat(~np.array(held, bool), lengths + 1)
                history, follower, known = history[learn], follower[learn], known[learn]
                if not len(history):
                    continue
                segment, place = _place(history, follower, known, n_segments, part_tokens)
                low = (follower >> np.uint64(32)).astype(np.uint32)
                order = np.lexsort((low, place))
                place, low, segment = place[order], low[order], segment[order]
                new = np.r_[True, (place[1:] != place[:-1]) | (low[1:] != low[:-1])]
                first = np.flatnonzero(new)
                times = np.diff(np.r_[first, len(place)])
                place, low, segment = place[first], low[first], segment[first]
                # Places rise, and so do the segments they fall in.
                cut = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
                found, stop = segment[cut], np.r_[cut[1:], len(segment)]
                head = np.r_[True, place[1:] != place[:-1]]
                heads = np.flatnonzero(head)
                split = heads[known[order[first[heads]]] >= part_tokens]
                whole = history[order[first[split]]]
                rows = []
                for s, a, b in zip(found.tolist(), cut.tolist(), stop.tolist()):
                    own = np.flatnonzero(head[a:b])
                    x, y = np.searchsorted(split, (a, b))
                    rows.append((s, place[a:b][own].astype("<u8").tobytes(), np.diff(np.r_[own, b - a]).astype("<u4").tobytes(),
                                 low[a:b].tobytes(), times[a:b].astype("<u4").tobytes(),
                                 place[split[x:y]].astype("<u8").tobytes(), whole[x:y].astype("<u8").tobytes()))
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])],
                                                 ["segment", "places", "followers", "low", "times", "split", "whole"])
    return pack


def level(count: np.ndarray) -> np.ndarray:
    """Quantised count: 1 + floor(log count / log BASE)."""
    return 1 + np.floor(np.log(count) / math.log(BASE) + 1e-9).astype(np.int64)


def _meaning() -> np.ndarray:
    """The mean whole count of each level, from a level's bounds; empty levels take their lower bound."""
    out = [0.0]
    for q in range(1, 130):
        low, high = math.ceil(BASE ** (q - 1) - 1e-6), math.ceil(BASE**q - 1e-6) - 1
        out.append((low + high) / 2 if high >= low else BASE ** (q - 1))
    return np.array(out)


MEANING = _meaning()


def _probes(key: np.ndarray, at: int | np.ndarray, bits: int | np.ndarray):
    """The positions of one level of each key, one probe at a time."""
    h = mix(key + np.asarray(at).astype(np.uint64) * _STEP)
    a, b = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    for i in range(PROBES):
        yield (((a + np.uint64(i) * b) & np.uint64(0xFFFFFFFF)) * np.asarray(bits).astype(np.uint64)) >> np.uint64(32)


def _entered(keys: np.ndarray, levels: np.ndarray) -> tuple[int, np.ndarray]:
    """Bits and bytes of a piece of the filter that holds each key up to its level."""
    bits = int(max(64, -(-int(levels.sum()) * BITS // 8) * 8))
    if bits >= 2**32:
        raise ValueError("a segment's filter would need 2^32 bits; lower SEGMENT_KEYS")
    flags = np.zeros(bits, np.uint8)
    q = 1
    while len(keys):
        for position in _probes(keys, q, bits):
            flags[position] = 1
        q += 1
        keep = levels >= q
        keys, levels = keys[keep], levels[keep]
    return bits, np.packbits(flags, bitorder="little")


def _filter(group: pd.DataFrame) -> pd.DataFrame:
    """A segment's piece of the filter, and the distinct followers in it of each part of a split history."""
    places = np.frombuffer(b"".join(group["places"]), "<u8")
    followers = np.frombuffer(b"".join(group["followers"]), "<u4")
    low = np.frombuffer(b"".join(group["low"]), "<u4").astype(np.uint64)
    times = np.frombuffer(b"".join(group["times"]), "<u4")
    place = np.repeat(places, followers)
    keys, first, at = np.unique(mix(place + low * _PAIR), return_index=True, return_inverse=True)
    count = np.bincount(at, weights=times).astype(np.int64)
    histories, distinct = np.unique(place[first], return_counts=True)
    split, at = np.unique(np.frombuffer(b"".join(group["split"]), "<u8"), return_index=True)
    whole = np.frombuffer(b"".join(group["whole"]), "<u8")[at]
    apart = np.isin(histories, split, assume_unique=True)
    # A place that is no part is its history mixed, so this is _followers_key.
    keys = np.concatenate([keys, mix(histories[~apart] ^ _FOLLOWERS)])
    bits, body = _entered(keys, level(np.concatenate([count, distinct[~apart]])))
    return pd.DataFrame({"segment": [int(group["segment"].iloc[0])], "bits": [bits], "body": [body.tobytes()],
                         "split": [whole.view("<i8")], "distinct": [distinct[apart]]})


#: Keys probed together.
AT_ONCE = 1 << 15
_BIT = (1 << np.arange(8)).astype(np.uint8)


class _Shard:
    """Pieces of the filter for the segments from `first` on, that of the split histories' followers last."""

    def __init__(self, first: int, bits: np.ndarray, body: np.ndarray):
        self.first, self.bits, self.body = first, bits, body
        self.start = (np.cumsum(bits) - bits).astype(np.int64)

    def count(self, key: np.ndarray, segment: np.ndarray) -> np.ndarray:
        """Levels of keys, by probing rising levels until one is missing; a few thousand at a time stay in the cache."""
        parts = [self._count(key[i:i + AT_ONCE], segment[i:i + AT_ONCE]) for i in range(0, len(key), AT_ONCE)]
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)

    def _count(self, key: np.ndarray, segment: np.ndarray) -> np.ndarray:
        found, alive = np.zeros(len(key), np.int64), np.flatnonzero(self.bits[segment - self.first] > 0)
        start, size = (x[segment[alive] - self.first].astype(np.uint64) for x in (self.start, self.bits))
        key, q, half = key[alive], 1, np.uint64(32)
        while len(alive):
            h = mix(key + np.uint64(q * int(_STEP) & 0xFFFFFFFFFFFFFFFF))
            a, b = h & np.uint64(0xFFFFFFFF), (h >> half) | np.uint64(1)
            there = None
            for i in range(PROBES):
                at = a if i == 0 else (a + np.uint64(i) * b) & np.uint64(0xFFFFFFFF)
                at = (start + (at * size >> half)).view(np.int64)
                hit = (self.body[at >> 3] & _BIT[at & 7]) != 0
                there = hit if there is None else there & hit
                # Keys that are missing leave when they are many enough to pay for moving the others.
                if i == PROBES - 1 or np.count_nonzero(there) < 0.7 * len(there):
                    alive, key, start, size, a, b = (x[there] for x in (alive, key, start, size, a, b))
                    there = None
                    if not len(alive):
                        break
            found[alive] = q
            q += 1
        return found


def _probed(own, place, follower, history, known, segment, p, last: int, part_tokens: int) -> np.ndarray:
    """Probabilities of seen bigrams whose plain ones are `p`, in the order of `place`: one lookup of followers for each history."""
    c = np.minimum(MEANING[own.count(_key(place, follower), segment)], known)
    head = np.r_[True, place[1:] != place[:-1]]
    piece = np.where(known[head] >= part_tokens, last, segment[head])
    t = np.maximum(MEANING[own.count(_followers_key(history[head]), piece)], 1)[np.cumsum(head) - 1]
    return (c + t * p) / (known + t)


#: What a pass needs of a position, 48 bytes: its text, segment, count and place of the history, follower, history, plain probability.
_WORK = np.dtype([("text", "<i4"), ("segment", "<i4"), ("known", "<i8"), ("place", "<u8"), ("follower", "<u8"), ("history", "<u8"), ("p", "<f8")])


def _texts(block: int, doc_ids, held, lengths, hits, base, score):
    """A block's texts in the columns of SCORED."""
    n = len(lengths)
    return pa.RecordBatch.from_arrays(
        [pa.array([block] * n, pa.int64()), pa.array(np.arange(n), pa.int64()), pa.array(doc_ids, pa.int64()), pa.array(held, pa.bool_()),
         pa.array(lengths + 1), pa.array(hits), pa.array(base), pa.array(score)],
        ["block", "i", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])


def _positions(batches, n_all: int, n_types: int, begun: int, word_segments: int, n_segments: int, part_tokens: int):
    """For each block: its texts' columns, the plain probability of every position, and the work of the seen ones, by place."""
    for batch in batches:
        for block, doc_ids, held, lengths, tokens, words, parts in zip(*(batch.column(i).to_pylist() for i in range(7))):
            w = np.frombuffer(words, "<u8")
            counts, lengths = _counts(w, parts, word_segments), np.array(lengths, np.int64)
            history, follower, known, count, is_end = _bigrams(np.frombuffer(tokens, "<u4"), lengths, w, counts, begun)
            count[is_end] = begun
            starts = np.cumsum(lengths + 1) - (lengths + 1)
            plain = (count + 1) / (n_all + n_types + 1)
            segment, place = _place(history, follower, known, n_segments, part_tokens)
            # In the order of histories: each one's followers are looked up once, and probes stay in one piece for long.
            seen = np.flatnonzero(known > 0)
            at = seen[np.argsort(place[seen])]
            work = np.empty(len(at), _WORK)
            work["text"] = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths + 1)[at]
            for name, x in (("segment", segment), ("known", known), ("place", place), ("follower", follower), ("history", history), ("p", plain)):
                work[name] = x[at]
            add = lambda x: np.add.reduceat(x, starts)
            unseen = np.log10(np.minimum(plain, 1))
            base, hits = add(unseen), add((count > 0).astype(np.int64))
            unseen[at] = 0
            yield block, doc_ids, held, lengths, hits, base, add(unseen), work


def _summed_work(work: np.ndarray, own, last: int, part_tokens: int, n: int) -> np.ndarray:
    """Sums of log10 probabilities by text of the positions in `work`."""
    if not len(work):
        return np.zeros(n)
    c = [np.ascontiguousarray(work[x]) for x in ("place", "follower", "history", "known", "segment", "p")]
    p = _probed(own, *c, last, part_tokens)
    return np.bincount(work["text"], weights=np.log10(np.minimum(p, 1)), minlength=n)


def _scorer(shard, n_all: int, n_types: int, begun: int, word_segments: int, n_segments: int, part_tokens: int, first: int, last: int):
    """Sums of log10 probabilities under one shard, for each text of each block; base sums and known tokens with the first."""
    def score(batches):
        own = shard.value if shard is not None else None
        for batch in batches:
            for block, doc_ids, held, lengths, tokens, words, parts in zip(*(batch.column(i).to_pylist() for i in range(7))):
                w = np.frombuffer(words, "<u8")
                counts, lengths = _counts(w, parts, word_segments), np.array(lengths, np.int64)
                history, follower, known, count, is_end = _bigrams(np.frombuffer(tokens, "<u4"), lengths, w, counts, begun)
                count[is_end] = begun
                starts = np.cumsum(lengths + 1) - (lengths + 1)
                plain = (count + 1) / (n_all + n_types + 1)
                segment, place = _place(history, follower, known, n_segments, part_tokens)
                here = np.flatnonzero((segment >= first) & (segment < last))
                value, p = np.zeros(len(history)), plain[here]
                seen = known[here] > 0
                if own is not None and seen.any():
                    # In the order of histories: each one's followers are looked up once, and probes stay in one piece for long.
                    order = np.flatnonzero(seen)[np.argsort(place[here[seen]])]
                    at = here[order]
                    c = np.minimum(MEANING[own.count(_key(place[at], follower[at]), segment[at])], known[at])
                    head = np.r_[True, place[at[1:]] != place[at[:-1]]]
                    one = at[head]
                    piece = np.where(known[one] >= part_tokens, last, segment[one])
                    t = np.maximum(MEANING[own.count(_followers_key(history[one]), piece)], 1)
                    t = t[np.cumsum(head) - 1]
                    p[order] = (c + t * p[order]) / (known[at] + t)
                value[here] = np.log10(np.minimum(p, 1))
                add = lambda x: np.add.reduceat(x, starts)
                base = add(np.log10(plain)) if first == 0 else np.zeros(len(starts))
                hits = add((count > 0).astype(np.int64)) if first == 0 else np.zeros(len(starts), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block] * len(starts), pa.int64()), pa.array(np.arange(len(starts)), pa.int64()), pa.array(doc_ids, pa.int64()),
                     pa.array(held, pa.bool_()), pa.array(lengths + 1), pa.array(hits), pa.array(base), pa.array(add(value))],
                    ["block", "i", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])
    return score


def _dealer(cuts: list[int], *sizes):
    """Each block's positions dealt by shard, with shard -1 what the texts have without any."""
    def deal(batches):
        for block, doc_ids, held, lengths, hits, base, sums, work in _positions(batches, *sizes):
            told = _texts(block, doc_ids, held, lengths, hits, base, sums)
            n = told.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([-1] * n, pa.int32()), *told.columns, pa.nulls(n, pa.binary())], DEALT_NAMES)
            found, places = _grouped(np.searchsorted(cuts, work["segment"], side="right") - 1)
            k, none = len(found), lambda t: pa.nulls(len(found), t)
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, pa.int32()), pa.array([block] * k, pa.int64()), none(pa.int64()), none(pa.int64()), none(pa.bool_()), none(pa.int64()),
                 none(pa.int64()), none(pa.float64()), none(pa.float64()), pa.array([work[p].tobytes() for p in places], pa.binary())], DEALT_NAMES)
    return deal


def _prober(shard, last: int, part_tokens: int):
    """Sums by text of one shard's positions, from rows (block, work)."""
    def probe(batches):
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                work = np.frombuffer(data, _WORK)
                sums = _summed_work(work, shard.value, last, part_tokens, int(work["text"].max()) + 1)
                texts = np.unique(work["text"])
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(texts), pa.int64()), pa.array(texts.astype(np.int64)), pa.array(sums[texts])],
                                                 ["block", "i", "score"])
    return probe


SCORED = "block bigint, i bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"
DEALT = f"shard int, {SCORED}, work binary"
DEALT_NAMES = [x.split()[0] for x in DEALT.split(", ")]


def of_shard(dealt: DataFrame, shard: int) -> DataFrame:
    """The positions of one shard; the folders of others are not opened."""
    return dealt.where(F.col("shard") == shard).select("block", "work")


def score(docs: DataFrame, held=None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_column().alias("text"),
                       (held if held is not None else held_out(7)).alias("held"))
    path = shared_path(spark, "blocks")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = "llm_" + path.rsplit("-", 1)[1]
    (rows.mapInArrow(_blocks, BLOCK_ROW).write.option("path", path).option("compression", "zstd")
     .bucketBy(buckets, "block").saveAsTable(name, format="parquet"))
    blocks = spark.table(name)

    size = blocks.agg(F.coalesce(F.sum("n_words"), F.lit(0)).alias("words"), F.coalesce(F.sum(F.size(F.filter("held", lambda x: ~x))), F.lit(0)).alias("docs"),
                      F.coalesce(F.sum(F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, x: a + x)), F.lit(0)).alias("tokens")).first()
    word_segments = max(1, size["words"] // SEGMENT_KEYS)
    sums = written(blocks.select("block", "words", "trained").mapInArrow(
        _asked(word_segments), "segment int, block bigint, words binary, trained binary")
        .groupBy("segment").applyInPandas(_summed, "segment int, block bigint, counts binary, n bigint, v bigint"), "counts", compression="zstd")
    total = sums.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v")).first()
    begun = int(size["docs"])
    n_all, n_types = int(total["n"]) + begun, int(total["v"]) + (begun > 0)
    back = sums.groupBy("block").agg(F.collect_list(F.struct("segment", "counts")).alias("parts"))
    counted = blocks.join(back.hint("shuffle_hash"), "block", "left")

    n_segments = max(1, int(size["tokens"]) // SEGMENT_KEYS)
    pieces = written(counted.select("block", "held", "lengths", "tokens", "words", "parts").mapInArrow(
        _pairs(begun, word_segments, n_segments, PART_TOKENS),
        "segment int, places binary, followers binary, low binary, times binary, split binary, whole binary")
        .groupBy("segment").applyInPandas(_filter, "segment int, bits bigint, body binary, split array<bigint>, distinct array<bigint>"), "filter")
    # One row a split history: at most one for PART_TOKENS training tokens.
    types = (pieces.select(F.explode(F.arrays_zip("split", "distinct")).alias("part")).groupBy("part.split")
             .agg(F.sum("part.distinct").alias("n")).collect())
    split_bits, split_body = (_entered(_followers_key(np.array([r[0] for r in types], np.int64).view(np.uint64)), level(np.array([r[1] for r in types])))
                              if types else (0, np.zeros(0, np.uint8)))
    found = dict(pieces.select("segment", "bits").collect())
    bits = np.array([found.get(i, 0) for i in range(n_segments)], np.int64)
    cuts, held_bits = [0], 0
    for i, b in enumerate(bits.tolist()):
        if held_bits and held_bits + b > 8 * shard_bytes:
            cuts.append(i)
            held_bits = 0
        held_bits += b
    columns = counted.select("block", "doc_ids", "held", "lengths", "tokens", "words", "parts")
    sizes = (n_all, n_types, begun, word_segments, n_segments, PART_TOKENS)
    if len(cuts) > 1:
        # Dealt by shard once, so that each pass reads its own positions and the passes together every position once.
        dealt_path = shared_path(spark, "dealt")
        columns.mapInArrow(_dealer(cuts, *sizes), DEALT).write.partitionBy("shard").option("compression", "zstd").parquet(dealt_path)
        dealt = spark.read.schema(DEALT).parquet(dealt_path)
        passes = [dealt.where("shard = -1").drop("shard", "work")]
    else:
        passes = []
    for k, (first, last) in enumerate(zip(cuts, [*cuts[1:], n_segments])):
        size = bits[first:last] // 8
        body, start = np.zeros(int(size.sum()) + len(split_body), np.uint8), np.cumsum(size) - size
        body[len(body) - len(split_body):] = split_body
        # A partition at a time, into one array of at most SHARD_BYTES.
        for r in pieces.where(F.col("segment").between(first, last - 1)).select("segment", "body").toLocalIterator():
            i = r["segment"] - first
            body[start[i]:start[i] + size[i]] = np.frombuffer(r["body"], np.uint8)
        shard = spark.sparkContext.broadcast(_Shard(first, np.append(bits[first:last], split_bits), body))
        # Each pass is written before the next shard is collected, so one shard at a time is held.
        if len(cuts) > 1:
            some = of_shard(dealt, k).mapInArrow(_prober(shard, last, PART_TOKENS), "block bigint, i bigint, score double")
            passes.append(written(some, "scores"))
        else:
            passes.append(written(columns.mapInArrow(_scorer(shard, *sizes, first, last), SCORED), "scores"))
        shard.destroy()
        del body
    # The name goes, the files in the shared folder stay; what is returned reads the scores alone.
    spark.sql(f"DROP TABLE {name}")
    scored = passes[0]
    for more in passes[1:]:
        scored = scored.unionByName(more, allowMissingColumns=True)
    return (scored.groupBy("block", "i").agg(*[F.max(c).alias(c) for c in ("doc_id", "held_out", "n_tokens")],
                                             F.sum("n_known").alias("n_known"), F.sum("base_score").alias("base_score"), F.sum("score").alias("score"))
            .select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_all).cast("bigint").alias("train_tokens"), "base_score", "score"))
