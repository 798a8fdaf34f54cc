"""Words of whole batches of texts as 64-bit hashes, computed on the UTF-8 bytes with numpy.

A word is a run without white space (0x20, 0x09-0x0D); A-Z count as lower case. The hash of a word is a polynomial in its
bytes modulo 2^64, taken from prefix sums, then mixed: equal words have equal hashes everywhere, and different words share
one with a probability of about 2^-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_RNG = np.random.Generator(np.random.PCG64(20260211))
_EXACT = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE = _EXACT.copy()
_BYTE[ord("A"):ord("Z") + 1] = _BYTE[ord("a"):ord("z") + 1]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = int(_RNG.integers(2**61, 2**62)) * 2 + 1
_MASK = 2**64 - 1
_POWERS: dict[int, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int, base: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, kept for the longest n asked for."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 20), base, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _POWERS[base] = have
    return have[:n]


_INVERSE = pow(_BASE, -1, 2**64)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of texts laid end to end in `data`, and the number of words of each text."""
    return word_spans(data, offsets)[2:]


def word_spans(data: np.ndarray, offsets: np.ndarray, fold: bool = True, inner: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Starts, ends and hashes of all words of texts laid end to end in `data`, and the number of words of each text.

    `inner` marks bytes inside words at which another one starts.
    """
    n_docs = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(n_docs, np.int64)
    inside = ~_SPACE[data]
    before = np.empty(len(data), dtype=bool)
    before[0], before[1:] = False, inside[:-1]
    edges = offsets[:-1][np.diff(offsets) > 0]
    before[edges] = False
    if inner is not None:
        before &= ~inner
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(len(data), dtype=bool)
    after[-1], after[:-1] = False, inside[1:]
    after[edges[edges > 0] - 1] = False
    if inner is not None:
        after[:-1] &= ~inner[1:]
    ends = np.flatnonzero(inside & ~after) + 1
    sums = np.empty(len(data) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum((_BYTE if fold else _EXACT)[data] * _powers(len(data), _BASE), out=sums[1:])
    h = (sums[ends] - sums[starts]) * _powers(len(data), _INVERSE)[starts]
    h = mix(h + (ends - starts).astype(np.uint64))
    counts = np.diff(np.searchsorted(starts, offsets))
    return starts, ends, h, counts


def text_slices(texts: pa.Array, limit: int = 4 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about `limit` bytes: first row, row after the last, bytes, offsets. Null counts as empty; a longer text comes alone."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    _, off, body = texts.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        yield first, last, data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first]
        first = last


_FIVE = [int(x) * 2 + 1 for x in _RNG.integers(2**61, 2**62, 16)]


def shingles(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Distinct hashes, ascending, of every k consecutive words; a shorter text is one shingle, an empty one has none."""
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    width = min(k, n)
    out = np.full(n - width + 1, width, dtype=np.uint64)
    for j in range(width):
        out += words[j:n - width + 1 + j] * np.uint64(_FIVE[j])
    return np.unique(mix(out))
