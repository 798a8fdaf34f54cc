"""Token ids of documents in ORC files: run-length encoded ids, row indexes and Bloom filters on the document id.

Free style (Arrow batches for the tokenizer). The texts are dealt by ranges of the document id, sorted, encoded and written; a
file holds one range, so a reader skips files, stripes and row groups by the id's statistics, and looks an id up by its Bloom
filter. Stripes are independent: Spark reads them in parallel.

Defined results. Null text: an empty text, so the end id alone. Null ids come first. Equal ids are ordered by the text's hash;
repeated rows are all kept. An empty table gives a folder with no rows. Other columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small_batches, text_column
from .words import text_slices, word_spans

COLUMNS = "doc_id bigint, seq bigint, n_tokens bigint, ids array<int>"

#: Pieces whose ids one worker keeps, and pieces given to the library in one text.
KEPT_PIECES, TOGETHER = 1_200_000, 64

_SOFT, _HARD = np.zeros(256, bool), np.zeros(256, bool)
_SOFT[list(b".,!?;:")] = True
_HARD[[c for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) != "'"]] = True
_ALNUM = np.array([chr(c).isalnum() and c < 128 for c in range(256)])
#: Letters that normalisation leaves alone and whose lower case is one letter.
_PLAIN = re.compile("[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+").fullmatch
_WORKER: dict[str, _Coder] = {}


def _inner_starts(data: np.ndarray) -> np.ndarray:
    """Where marks follow a letter or digit, or a letter or digit follows marks, inside a run without white space.

    Letters here are ASCII letters and the two-byte letters up to U+023F, which no combining rule joins with a mark.
    """
    lead = (data >= 0xC3) & (data <= 0xC8)
    sign = np.zeros(len(data), bool)  # the two signs among those letters
    sign[:-1] = (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))
    lead &= ~sign
    tail = np.zeros(len(data), bool)
    tail[1:] = lead[:-1]
    out = np.zeros(len(data), bool)
    out[1:] = ((_ALNUM[data] | tail)[:-1] & _SOFT[data[1:]]) | (_HARD[data[:-1]] & (_ALNUM[data] | lead)[1:])
    return out


class _Coder:
    """The library's tokenizer with the ids of recent pieces; one for each worker process.

    A piece is a run without ASCII white space, cut between letters and marks. The tokenizer drops white space, none of its
    tokens crosses it, and it parts letters from marks, so the ids of a text are those of its pieces in a row. `apart` tells
    whether that holds for this tokenizer; otherwise, and where a text has one of its added tokens, whole texts are encoded.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers
        self.library = Tokenizer.from_file(path)
        self.kept: dict[int, bytes] = {}
        added = {i: t.content for i, t in self.library.get_added_tokens_decoder().items()}
        self.added = [t.lower().encode() for t in added.values()]
        self.between = next(((i, f" {t} ") for i, t in added.items() if self.whole([f"a {t} b"])[0].count(np.uint32(i).tobytes()) == 1), None)
        self.lower = self.whole(["AB"]) == self.whole(["ab"])
        probe = "Ab,x1.(y)\u00c9t\u00e9!? z- 'S it's \"q\".\n\tend".encode()
        data, cuts = np.frombuffer(probe, np.uint8), np.array([0, len(probe)])
        starts, ends = word_spans(data, cuts, False, _inner_starts(data))[:2]
        self._quick(Tokenizer, pre_tokenizers)
        self.apart = self.whole([probe.decode()])[0] == b"".join(self.whole([probe[a:b].decode() for a, b in zip(starts, ends)]))

    def _quick(self, tokenizer, pre_tokenizers) -> None:
        """The same model without the rules that change nothing in a word of plain letters, if it marks the ends of words.

        Words are then told apart in the ids of many by the tokens that end one. Sample words decide whether the ids agree.
        """
        suffix = getattr(self.library.model, "end_of_word_suffix", None)
        self.quick = None
        if not suffix:
            return
        quick = tokenizer(self.library.model)
        quick.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = quick.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        words = ["a", "the", "zq", "caf\u00e9", "stra\u00dfe", "\u00ff", "unbelievablenesses", "\u00e0\u00f6\u00f8", "s", "ll"]
        ids = [c.ids for c in quick.encode_batch_fast(words, add_special_tokens=False)]
        if [array("I", x).tobytes() for x in ids] == self.whole(words) and all(self.ends[x].sum() == 1 and self.ends[x[-1]] for x in ids):
            self.quick = quick

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", c.ids).tobytes() for c in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def coded(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces, many to a text: plain words by the quick way, others with an added token between them."""
        plain = [bool(_PLAIN(p)) for p in pieces] if self.quick else [False] * len(pieces)
        words = [p.lower() if self.lower else p for p, x in zip(pieces, plain) if x]
        others = [p for p, x in zip(pieces, plain) if not x]
        coded = {True: iter(self._words(words)), False: iter(self._others(others))}
        return [next(coded[x]) for x in plain]

    def _words(self, words: list[str]) -> list[bytes]:
        if not words:
            return []
        ids = array("I")
        for c in self.quick.encode_batch_fast([" ".join(words[i:i + TOGETHER]) for i in range(0, len(words), TOGETHER)], add_special_tokens=False):
            ids.extend(c.ids)
        stop = (np.flatnonzero(self.ends[np.frombuffer(ids, np.uint32)]) + 1) * 4
        body = ids.tobytes()
        return [body[a:b] for a, b in zip([0, *stop[:-1].tolist()], stop.tolist())]

    def _others(self, pieces: list[str]) -> list[bytes]:
        if self.between is None or not pieces:
            return self.whole(pieces)
        number, between = self.between
        ids = array("I")
        for c in self.library.encode_batch_fast([between.join(pieces[i:i + TOGETHER]) for i in range(0, len(pieces), TOGETHER)], add_special_tokens=False):
            ids.extend(c.ids)
            ids.append(number)
        stop = np.flatnonzero(np.frombuffer(ids, np.uint32) == number) * 4
        body = ids.tobytes()
        return [body[a:b] for a, b in zip([0, *(stop[:-1] + 4).tolist()], stop.tolist())]

    def texts(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by the end id, and the offsets of the texts in them."""
        body = data.tobytes()
        low = body.lower()
        if not self.apart or any(t in low for t in self.added):
            at, end = offsets.tolist(), array("I", [end_id]).tobytes()
            ids = [x + end for x in self.whole([body[a:b].decode("utf-8") for a, b in zip(at, at[1:])])]
            return np.frombuffer(b"".join(ids), np.uint32), np.cumsum([0, *(len(x) // 4 for x in ids)])
        starts, ends, hashes, counts = self._pieces(data, offsets)
        order = np.argsort(hashes)
        ranked = hashes[order]
        head = np.ones(len(order), bool)
        head[1:] = ranked[1:] != ranked[:-1]
        kinds, first = ranked[head], order[head]
        inverse = np.empty(len(order), np.int32)
        inverse[order] = np.cumsum(head, dtype=np.int32) - np.int32(1)
        if len(self.kept) > KEPT_PIECES:
            self.kept.clear()
        kept, keys = self.kept, kinds.tolist()
        ids = list(map(kept.get, keys))
        new = [i for i, x in enumerate(ids) if x is None]
        at = first[new]
        for i, x in zip(new, self.coded([body[a:b].decode("utf-8") for a, b in zip(starts[at].tolist(), ends[at].tolist())])):
            ids[i] = kept[keys[i]] = x
        ids.append(array("I", [end_id]).tobytes())
        lengths = np.fromiter(map(len, ids), np.int32, len(ids)) // np.int32(4)
        table, begin = np.frombuffer(b"".join(ids), np.uint32), np.cumsum(lengths, dtype=np.int32) - lengths
        last = np.cumsum(counts + 1) - 1
        order = np.full(last[-1] + 1, len(kinds), np.int32)
        piece = np.ones(len(order), bool)
        piece[last] = False
        order[piece] = inverse
        size = lengths[order]
        stop = np.cumsum(size, dtype=np.int64)
        at = np.arange(stop[-1], dtype=np.int32)
        at -= np.repeat((stop - size).astype(np.int32) - begin[order], size)
        return table[at], np.concatenate([[0], stop[last]])

    def _pieces(self, data: np.ndarray, offsets: np.ndarray, at_once: int = 1 << 19) -> tuple[np.ndarray, ...]:
        """Starts, ends and hashes of all pieces and their number in each text, some texts at a time to stay in the cache."""
        parts, first = [], 0
        while first < len(offsets) - 1:
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + at_once, side="right")) - 1)
            own = data[offsets[first]:offsets[last]]
            starts, ends, hashes, counts = word_spans(own, offsets[first:last + 1] - offsets[first], self.lower, _inner_starts(own))
            parts.append((starts + offsets[first], ends + offsets[first], hashes, counts))
            first = last
        return tuple(np.concatenate(x) for x in zip(*parts))


def _encoder(tokenizer: str, end_id: int):
    """Arrow batches of (doc_id, seq, text) to (doc_id, seq, n_tokens, ids)."""
    def run(batches):
        coder = _WORKER.get(tokenizer) or _WORKER.setdefault(tokenizer, _Coder(tokenizer))
        for batch in batches:
            for first, last, data, offsets in text_slices(batch.column(2), 8 << 20):
                values, cuts = coder.texts(data, offsets, end_id)
                lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(values.astype(np.int32)))
                own = [batch.column(i).slice(first, last - first) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(np.diff(cuts)), lists], ["doc_id", "seq", "n_tokens", "ids"])
    return run


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, stripe_bytes: int = 64 << 20,
                      index_stride: int = 1000) -> None:
    """Encode `docs` (doc_id, text) and write (doc_id, seq, n_tokens, ids) as ORC in ascending order of the document id.

    `seq` rises along the order of all files: the range in its upper bits, the row in its lower 33.
    """
    small_batches(docs.sparkSession)
    # Reading the texts twice, for the range bounds and for the work, is what a global order costs.
    ordered = (docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_column().alias("text"))
               .repartitionByRange(F.col("doc_id"), F.xxhash64("text"))
               .sortWithinPartitions(F.col("doc_id"), F.xxhash64("text"))
               .select("doc_id", F.monotonically_increasing_id().alias("seq"), "text"))
    coded = ordered.mapInArrow(_encoder(tokenizer, end_id), COLUMNS)
    (coded.write.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01")
     .option("orc.create.index", "true").option("orc.row.index.stride", str(index_stride))
     .option("orc.stripe.size", str(stripe_bytes)).option("compression", "lz4").orc(path))


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Rows (doc_id, seq, n_tokens, ids). A filter on doc_id reaches the files: statistics and Bloom filters skip what cannot match."""
    return spark.read.schema(COLUMNS).orc(path)


def _digests(batches):
    for batch in batches:
        lists = batch.column(2)
        cuts = lists.offsets.to_numpy(zero_copy_only=False)
        ids = lists.values.to_numpy(zero_copy_only=False).astype("<u4")
        crc = [zlib.crc32(ids[a:b]) for a, b in zip(cuts, cuts[1:])]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(np.diff(cuts).astype(np.int64)), pa.array(crc, pa.int64())],
            ["doc_id", "seq", "n_tokens", "ids_crc32"])


def token_digests(tokens: DataFrame) -> DataFrame:
    """Per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Running totals are taken inside a file's range, on three numbers a row; ranges before it add one total each.
    """
    part = F.shiftright("seq", 33).alias("_range")
    rows = tokens.select("doc_id", "seq", "ids").mapInArrow(
        _digests, "doc_id bigint, seq bigint, n_tokens bigint, ids_crc32 bigint").select("*", part)
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = tokens.select("n_tokens", part).groupBy("_range").agg(F.sum("n_tokens").alias("_n"))
    offsets = totals.select("_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_range").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return (rows.withColumn("_local", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(offsets, "_range")
            .select("doc_id", (F.col("_before") + F.col("_local")).alias("start"), "n_tokens", "ids_crc32"))
