"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Text is lower-cased, whatever is not a letter becomes one space, and n-grams of 1 to 3 characters are hashed into
2 ** `bits` features. A feature's value is its share of the document's n-grams times its inverse document frequency
among all training rows, times a constant. Training is follow-the-regularised-leader (proximal) with L1 and L2
penalties; a temperature is then fitted on a part of the sample that was held back.

The classifier learns from a bounded sample of labelled rows: `sample` rows in all, shared equally by the languages,
chosen by a hash of id and text among rows of at most `sample_chars` characters, equal rows once, so that repeated or
null ids neither swell nor bend it. Document frequencies are counted over all training rows. Whatever is predicted is
predicted over all rows and whole texts. Null texts and texts without letters (as str.isalpha has them) are `und` with
score 0, as is everything if nothing could be learnt.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rows import add_columns
from .store import prepare

UNKNOWN = "und"
FIELDS = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
_SCALE = 100.0
_LETTERS: list[np.ndarray] = []
_SEEDS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _LETTERS[0]


RUN = 1 << 17  #: characters handled at once; a longer text is a run of its own


def ngrams(texts: list[str], bits: int) -> Iterator[tuple[int, int, list[tuple[np.ndarray, np.ndarray]]]]:
    """For runs i..j-1 of texts of about RUN characters: i, j, and by length the n-grams' features and documents (places in the run, rising)."""
    i = 0
    while i < len(texts):
        j, n = i, 0
        while j < len(texts) and (j == i or n + len(texts[j]) < RUN):
            n, j = n + len(texts[j]), j + 1
        lowered = [t.lower() for t in texts[i:j]]
        c = np.frombuffer("".join(f" {t} " for t in lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
        doc = np.repeat(np.arange(j - i, dtype=np.int32), [len(t) + 2 for t in lowered])
        c = np.where(_letters()[c], c, np.uint32(32))
        keep = np.ones(len(c), bool)
        keep[1:] = (c[1:] != 32) | (c[:-1] != 32) | (doc[1:] != doc[:-1])
        c, doc = c[keep], doc[keep]
        found, h = [], np.zeros(len(c), np.uint32)
        for n in range(1, 4):
            m = len(c) - n + 1
            if m <= 0:
                break
            h = h[:m] * np.uint32(0x01000193) + c[n - 1 :] * _SEEDS[n - 1] + np.uint32(n)
            whole = doc[:m] == doc[n - 1 :]
            if n == 1:
                whole &= c != 32
            mixed = h ^ (h >> np.uint32(15))
            mixed = mixed * np.uint32(0x2C1B3C6D)
            found.append(((mixed >> np.uint32(32 - bits))[whole], doc[:m][whole]))
        yield i, j, found
        i = j


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


@dataclass(frozen=True)
class LanguageModel:
    langs: tuple[str, ...]
    weights: np.ndarray  #: features x languages, inverse document frequency and scale multiplied in
    bias: np.ndarray
    temperature: float
    bits: int

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        rows = [k for k, t in enumerate(texts) if t and self.langs and has_letter(t)]
        for i, j, found in ngrams([texts[k] for k in rows], self.bits):
            counts, total = np.zeros(j - i, np.int64), np.zeros((j - i, len(self.langs)))
            for features, doc in found:
                some, starts = np.unique(doc, return_index=True)
                counts += np.bincount(doc, minlength=j - i)
                if len(some):
                    total[some] += np.add.reduceat(self.weights[features], starts, axis=0)
            z = (total / np.maximum(counts, 1)[:, None] + self.bias) / self.temperature
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            for d, (best, value) in enumerate(zip(p.argmax(axis=1).tolist(), p.max(axis=1).tolist(), strict=True)):
                names[rows[i + d]], scores[rows[i + d]] = self.langs[best], value
        return names, scores


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(samples: list[tuple[str, np.ndarray, np.ndarray]], bits: int, epochs: int = 4, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, frequencies: tuple[int, np.ndarray] | None = None) -> LanguageModel:
    """samples: language, features, their shares of the document's n-grams; in the order of training. frequencies: documents, and those that hold each feature."""
    langs = tuple(sorted({s[0] for s in samples}))
    size, k = 1 << bits, len(langs)
    if not samples:
        return LanguageModel((), np.zeros((size, 0), np.float32), np.zeros(0), 1.0, bits)
    held = samples[::5] if len(samples) >= 25 else samples
    train = [s for n, s in enumerate(samples) if n % 5] if len(samples) >= 25 else samples
    if frequencies is None:
        frequencies = len(train), np.bincount(np.concatenate([f for _, f, _ in train]), minlength=size)
    idf = np.log((1 + frequencies[0]) / (1 + frequencies[1])) + 1
    z, n = np.zeros((size + 1, k)), np.zeros((size + 1, k))

    def weights(rows: np.ndarray | slice) -> np.ndarray:
        return -np.sign(z[rows]) * np.maximum(np.abs(z[rows]) - l1, 0) / ((beta + np.sqrt(n[rows])) / alpha + l2)

    vectors = [(langs.index(lang), np.append(f, size), np.append(share * idf[f] * _SCALE, 1.0)) for lang, f, share in train]
    for _ in range(epochs):
        for y, rows, x in vectors:
            w = weights(rows)
            error = _softmax(x @ w)
            error[y] -= 1
            g = x[:, None] * error
            sigma = (np.sqrt(n[rows] + g * g) - np.sqrt(n[rows])) / alpha
            z[rows] += g - sigma * w
            n[rows] += g * g
    w = weights(slice(None))
    logits = np.array([(share * idf[f] * _SCALE) @ w[f] + w[size] for _, f, share in held])
    truth = np.array([langs.index(s[0]) for s in held])
    loss = lambda t: -np.log(np.maximum(_softmax(logits / t)[np.arange(len(truth)), truth], 1e-12)).mean()
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
    temperature = float(min(grid, key=loss))
    return LanguageModel(langs, (w[:size] * (idf * _SCALE)[:, None]).astype(np.float32), w[size], temperature, bits)


def document_frequencies(texts: DataFrame, bits: int) -> tuple[int, np.ndarray]:
    """Rows of texts(text) that hold a letter, and how many of them hold each feature: 2 ** bits numbers, whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((1 << bits) + 1, np.int64)
        for batch in batches:
            held = [t for t in batch.column(0).to_pylist() if has_letter(t)]
            counts[-1] += len(held)
            for _, j, found in ngrams(held, bits):
                f, d = (np.concatenate([x[s] for x in found]) for s in (0, 1))
                counts += np.bincount(np.unique(d.astype(np.int64) << bits | f) & ((1 << bits) - 1), minlength=len(counts))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["f", "n"])

    out = np.zeros((1 << bits) + 1, np.int64)
    for f, n in texts.mapInArrow(run, "f long, n long").groupBy("f").agg(F.sum("n")).collect():
        out[f] = n
    return int(out[-1]), out[:-1]


def train(labelled: DataFrame, sample: int = 4000, sample_chars: int = 20_000, bits: int = 16, text: str = "text", lang: str = "lang", doc: str = "doc_id") -> LanguageModel:
    """Fits on about `sample` rows of labelled(doc, text, lang), in no case over twice as many, shared equally by the languages."""
    prepare(labelled.sparkSession)
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(doc).cast("string").alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    counts = {r[0]: r[1] for r in labelled.where(F.col(lang).isNotNull()).groupBy(lang).count().collect()}
    if not counts:
        return fit([], bits)
    each = max(1, sample // len(counts))
    share = F.create_map(*(x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, each / n)))))[F.col("lang")]
    key = F.xxhash64("id", "text", F.lit("langid"))
    chosen = rows.withColumn("key", key).where((F.pmod("key", F.lit(1 << 20)) < share * (1 << 20)) & (F.length("text") <= sample_chars))
    chosen = chosen.groupBy("lang", "key").agg(F.any_value("id").alias("id"), F.any_value("text").alias("text"))

    def features(batches):
        for batch in batches:
            ids, langs, texts = (batch.column(c).to_pylist() for c in ("key", "lang", "text"))
            keep = [k for k, t in enumerate(texts) if has_letter(t)]
            out = []
            for i, j, found in ngrams([texts[k] for k in keep], bits):
                f, d = (np.concatenate([x[s] for x in found]) for s in (0, 1))
                key, n = np.unique(d.astype(np.int64) << bits | f, return_counts=True)
                total = np.bincount(d, minlength=j - i)
                owner = key >> bits
                cut = np.searchsorted(owner, np.arange(j - i + 1))
                for r in range(j - i):
                    part = slice(cut[r], cut[r + 1])
                    out.append(((key[part] & ((1 << bits) - 1)).astype("<u4").tobytes(), (n[part] / total[r]).astype("<f4").tobytes()))
            yield pa.RecordBatch.from_pydict({"key": [ids[k] for k in keep], "lang": [langs[k] for k in keep], "f": [o[0] for o in out], "s": [o[1] for o in out]}, schema=pa.schema([("key", pa.int64()), ("lang", pa.string()), ("f", pa.binary()), ("s", pa.binary())]))

    got = chosen.mapInArrow(features, "key long, lang string, f binary, s binary").orderBy("key").limit(2 * sample).collect()
    got.sort(key=lambda r: (zlib.crc32(f"order{r['key']}".encode()), r["key"], r["lang"], r["f"]))
    samples = [(r["lang"], np.frombuffer(r["f"], "<u4").astype(np.int64), np.frombuffer(r["s"], "<f4").astype(float)) for r in got]
    return fit(samples, bits, frequencies=document_frequencies(rows.select("text"), bits))


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", fields: T.StructType = FIELDS) -> DataFrame:
    """docs with lang_pred and score (0 to 1), or under the names of `fields`. The model's size is fixed by its parameters, so it is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return add_columns(docs, fields, lambda batch: list(shared.value.predict(batch.column(text).to_pylist())))
