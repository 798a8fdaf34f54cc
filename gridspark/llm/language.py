"""Language identification by error-correcting output codes over character n-grams.

Free style: numpy in Arrow batches. Every language has a codeword; one binary classifier a bit, on hashed 1- to 3-grams of
letters, predicts it; the language whose codeword loses least, each bit weighted by its accuracy in training, is chosen, and
close calls are flagged. Words are set apart by one space, letters are in lower case, everything else is left out.

Fitting takes at most SAMPLE labelled rows, an equal number of each language, whole texts, chosen by a hash of the id. The
model's size is fixed by the number of buckets and bits. Prediction reads all rows and the text alone.

Defined results. Null text, or one without letters: `und` with score 0. Without any labelled row every text is `und`; with one
language every text with letters is that one. Null ids are predicted like others and never held out. Repeated rows are
predicted alike. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.selection import limit_per_block
from .common import held_out, small_batches

#: Labelled rows that fitting reads at most, hash buckets of n-grams, longest code, steps and step size of the descent.
SAMPLE, BUCKETS, LONGEST_CODE, STEPS, RATE = 1600, 8192, 63, 80, 0.5
UNKNOWN = "und"
#: A top share below this is flagged as ambiguous.
SURE = 0.6

_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def ngrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of all texts, three for each kept character, and how many each text has (0: no letters)."""
    joined = "\n".join(t.lower().replace("\n", " ") if t else "" for t in texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.cumsum(points == 10) - (points == 10)
    letter = _letters()[points]
    x = np.where(letter, points, 32).astype(np.uint64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep &= points != 10
    x, row = x[keep], row[keep]
    counts = np.bincount(row, minlength=len(texts))
    if not len(x):
        return np.zeros((0, 3), np.int64), counts
    one = np.full(len(x) + 2, 32, np.uint64)
    one[2:] = x
    # A text's first n-grams look back at the text before; a space stands in for it.
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    back1, back2 = one[1:-1].copy(), one[:-2].copy()
    back1[first] = 32
    back2[first] = 32
    second = first + 1
    second = second[second < len(x)]
    back2[second] = 32
    mul = np.uint64(0x9E3779B97F4A7C15)
    h1 = (x + np.uint64(1 << 21)) * mul
    h2 = ((x + (back1 << np.uint64(21))) ^ np.uint64(1 << 62)) * mul
    h3 = ((x + (back1 << np.uint64(21)) + (back2 << np.uint64(42))) ^ np.uint64(1 << 63)) * mul
    return (np.stack([h1, h2, h3], axis=1) >> np.uint64(64 - 13)).astype(np.int64) % BUCKETS, counts


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """A +1/-1 matrix, a row a language: all splits in two for up to 7 languages, else the random code with the largest distance."""
    if n <= 7:
        bits = [[1 if i in part else -1 for i in range(n)] for size in range(1, n) for part in combinations(range(n), size) if 0 in part]
        return np.array(bits or [[1] * n], np.int8).T
    rng, best, apart = np.random.Generator(np.random.PCG64(seed)), None, -1
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], np.int8), (n, min(LONGEST_CODE, 15 * int(np.ceil(np.log2(n))))))
        code = code[:, np.abs(code.sum(axis=0)) < n]
        agree = code.astype(np.int32) @ code.T.astype(np.int32)
        np.fill_diagonal(agree, -n * 64)
        distance = (code.shape[1] - agree.max()) // 2
        if distance > apart:
            best, apart = code, distance
    return best


@dataclass(frozen=True)
class Model:
    langs: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best language of each row of bit margins, and its share of exp(-loss)."""
        signed = margins[:, None, :] * self.code[None, :, :]
        loss = (np.logaddexp(0, -signed) * self.trust).sum(axis=2)
        share = np.exp(loss.min(axis=1, keepdims=True) - loss)
        return loss.argmin(axis=1), 1 / share.sum(axis=1)


def _features(batches):
    for batch in batches:
        texts, vectors, labels = batch.column(0).to_pylist(), [], []
        for text, lang in zip(texts, batch.column(1).to_pylist()):
            grams, counts = ngrams([text])
            if counts[0]:
                # Most buckets of a text are empty, so the driver gets a small part of these bytes.
                vectors.append(zlib.compress(np.bincount(grams.ravel(), minlength=BUCKETS).astype(np.float32).tobytes(), 1))
                labels.append(lang)
        yield pa.RecordBatch.from_arrays([pa.array(labels, pa.string()), pa.array(vectors, pa.binary())], ["lang", "counts"])


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Model from at most `sample` rows of `docs` (doc_id, text, lang) with a language; None if there is none."""
    known = docs.where("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "text", "lang")
    langs = sorted(r[0] for r in known.select("lang").distinct().collect())
    if not langs:
        return None
    each = max(1, sample // len(langs))
    # Ids are ranked without their texts, by hash prefix, so no language is ranked in one task.
    text, key = F.xxhash64("text").alias("_text"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_key")
    distinct = known.select("doc_id", "lang", text, key).distinct()
    ids = limit_per_block(distinct, ["lang"], each, 11, ["_key", "_text"])
    ids = ids.select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang"), F.col("_text").alias("_hash"))
    # One row of each id, language and text, however often it stands: they share their text, so any of them will do.
    chosen = known.withColumn("_text", F.xxhash64("text")).join(F.broadcast(ids), (F.col("doc_id").eqNullSafe(F.col("_id"))) & (
        F.col("lang") == F.col("_lang")) & (F.col("_text") == F.col("_hash"))).select("_id", "_lang", "_hash", "text", "lang")
    chosen = chosen.dropDuplicates(["_id", "_lang", "_hash"]).select("text", "lang")
    rows = chosen.mapInArrow(_features, "lang string, counts binary").toArrow()
    if not rows.num_rows:
        return None
    # In an order that does not depend on where the rows were; one copy of the counts at a time, as this is the driver.
    given, vectors = rows.column("lang").to_pylist(), rows.column("counts")

    def counts(i: int) -> bytes:
        return zlib.decompress(vectors[i].as_buffer())

    order = sorted(range(len(given)), key=lambda i: (given[i], hashlib.blake2b(counts(i)).digest()))
    x = np.empty((len(given), BUCKETS), np.float32)
    for at, i in enumerate(order):
        x[at] = np.frombuffer(counts(i), np.float32)
    del rows, vectors
    x /= x.sum(axis=1, keepdims=True)
    langs = sorted(set(given))
    return _descend(x, np.array([langs.index(given[i]) for i in order]), langs)


def _descend(x: np.ndarray, label: np.ndarray, langs: list[str]) -> Model:
    """Logistic regressions of all bits at once, by gradient steps with momentum on frequencies, which are scaled in place."""
    code = codewords(len(langs))
    y = code[label].astype(np.float32)
    scale = (1 / np.sqrt(x.mean(axis=0) + 1e-5)).astype(np.float32)
    x *= scale
    weights = np.zeros((BUCKETS, code.shape[1]), np.float32)
    bias, speed, bias_speed = np.zeros(code.shape[1], np.float32), np.zeros_like(weights), np.zeros(code.shape[1], np.float32)
    # A mean squared norm near one makes the step size independent of the features' scale.
    rate = RATE * 8 / float(np.einsum("ij,ij->", x, x) / len(x))
    for _ in range(STEPS):
        pull = y / (1 + np.exp(y * (x @ weights + bias))) / len(x)
        speed = 0.9 * speed + rate * (x.T @ pull - 1e-5 * weights)
        bias_speed = 0.9 * bias_speed + RATE * pull.sum(axis=0)
        weights, bias = weights + speed, bias + bias_speed
    right = (np.sign(x @ weights + bias) == y).mean(axis=0)
    return Model(langs, code, weights * scale[:, None], bias, np.clip(2 * right - 1, 0.05, 1).astype(np.float32))


def _predictor(model: Model | None, at_once: int = 1 << 19, rows: int = 128):
    def predict(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            first = 0
            while model is not None and first < len(texts):
                last, size = first, 0
                while last < min(len(texts), first + rows) and (last == first or size + len(texts[last] or "") <= at_once):
                    size += len(texts[last] or "")
                    last += 1
                grams, counts = ngrams(texts[first:last])
                has = np.flatnonzero(counts)
                if len(has):
                    at = np.repeat(np.arange(last - first) * BUCKETS, counts)
                    table = np.zeros((last - first) * BUCKETS, np.int64)
                    for k in range(3):
                        table += np.bincount(at + grams[:, k], minlength=len(table))
                    sums = table.reshape(-1, BUCKETS)[has].astype(np.float64) @ model.weights.astype(np.float64)
                    best, share = model.decode(sums / (3 * counts[has])[:, None] + model.bias)
                    for i, b, s in zip(has.tolist(), best.tolist(), share.tolist()):
                        lang[first + i], score[first + i] = model.langs[b], s
                first = last
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(lang), pa.array(np.clip(score, 0, 1))],
                ["doc_id", "held_out", "lang_pred", "score"])
    return predict


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score, ambiguous."""
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text", held_out(4).alias("held_out"))
    found = rows.mapInArrow(_predictor(model), "doc_id bigint, held_out boolean, lang_pred string, score double")
    return found.withColumn("ambiguous", (F.col("lang_pred") != UNKNOWN) & (F.col("score") < SURE))


def identify(docs: DataFrame) -> DataFrame:
    """Fit on rows that are not held out, then predict all rows."""
    return predict(docs, fit(docs.where(~held_out(4))))


def _named(model: Model | None):
    """The language of each text; without a model null for a text with letters."""
    run = _predictor(model)

    def named(text: pd.Series) -> pd.Series:
        texts = [t if isinstance(t, str) else None for t in text]
        if model is None:
            return pd.Series([None if any(map(str.isalpha, t or "")) else UNKNOWN for t in texts], dtype=object)
        none = pa.nulls(len(texts))
        batch = pa.RecordBatch.from_arrays([none, pa.array(texts, pa.string()), none], ["doc_id", "text", "held_out"])
        return pd.Series(next(run([batch])).column(2).to_pylist(), dtype=object)
    return named


def recognised(docs: DataFrame) -> DataFrame:
    """The rows of `docs` with letters in their text, a null `lang` replaced by the likeliest language, close calls included.

    A given `lang` stays as it is, whatever is predicted. Where no model can be fitted a null `lang` stays null.
    """
    small_batches(docs.sparkSession)
    # As a nondeterministic column it is computed once a row, for the filter and for `lang`.
    predicted = F.pandas_udf(_named(fit(docs.where(~held_out(4)))), "string").asNondeterministic()
    rows = docs.withColumn("__lang_pred", predicted("text"))
    lang = F.coalesce(F.col("lang"), F.col("__lang_pred")).alias("lang")
    return rows.where(F.col("__lang_pred").isNull() | (F.col("__lang_pred") != UNKNOWN)).select(*[lang if c == "lang" else c for c in docs.columns])
