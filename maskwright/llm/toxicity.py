"""Toxicity by multiple-instance learning: sentences are scored, noisy-or combines them, documents' labels train them.

A sentence's score is p = sigmoid(bias + sum of the weights of the features present in it); a document is toxic with
probability 1 - product of (1 - p). The gradient of the document's likelihood reaches each sentence through the noisy-or,
so labels of documents alone locate the offending sentences: those whose own p is at least `threshold`.

Features are hashed lower-cased words (letters only) and their first characters, once a sentence. Sentences end at .!? and
line ends, and after `SENTENCE_WORDS` words. The model is fitted on a bounded sample of labelled rows (`sample` of each
label, texts of at most `sample_chars` characters, chosen by a hash of id and text, equal rows once, so that repeated ids
don't swell it), weighted back to the labels' true shares; every row is scored over its whole text. Null and empty texts have no sentence and score 0; without labels of both kinds all scores are 0.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernels import Words, chunks, mix, text_bytes
from .rows import add_columns, code_points
from .store import prepare

BITS, SENTENCE_WORDS, PREFIX = 18, 50, 4  #: bits of a feature; words of a sentence at most; bytes of a word's beginning
LETTERS = np.zeros(256, bool)
LETTERS[0x61:0x7B] = LETTERS[0x80:] = True
STOPS = np.zeros(256, bool)
STOPS[[0x0A, 0x21, 0x2E, 0x3F]] = True
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("p", T.DoubleType())]))
FIELDS = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("n_sentences", T.LongType()), T.StructField("offending", SPANS)])


@dataclass
class Sentences:
    """Documents i..j-1: each sentence's document and byte bounds, and its features (sentence, feature), each pair once."""

    i: int
    j: int
    doc: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    owner: np.ndarray
    feature: np.ndarray


def sentences(column: pa.Array) -> Iterator[Sentences]:
    data, off = text_bytes(pc.utf8_lower(column.fill_null("")))
    for i, j in chunks(off):
        w = Words(data, off, i, j, LETTERS)
        if not len(w):
            empty = np.zeros(0, np.int64)
            yield Sentences(i, j, empty, empty, empty, empty, empty)
            continue
        stop = np.cumsum(STOPS[w.low])[w.starts]
        fresh = np.ones(len(w), bool)
        fresh[1:] = (stop[1:] != stop[:-1]) | (w.doc[1:] != w.doc[:-1])
        place = np.arange(len(w))
        place -= np.maximum.accumulate(np.where(fresh, place, 0))
        fresh |= place % SENTENCE_WORDS == 0
        sentence = np.cumsum(fresh) - 1
        hashes = (w.hashes, w.heads(PREFIX) ^ np.uint64(0x5851F42D4C957F2D))
        key = np.unique(np.concatenate([sentence.astype(np.uint64) << np.uint64(BITS) | mix(h) >> np.uint64(64 - BITS) for h in hashes]))
        first = np.flatnonzero(fresh)
        last = np.append(first[1:], len(w)) - 1
        yield Sentences(i, j, w.doc[first], w.starts[first], w.ends[last], (key >> np.uint64(BITS)).astype(np.int64), (key & np.uint64((1 << BITS) - 1)).astype(np.int64))


@dataclass(frozen=True)
class ToxicityModel:
    weights: np.ndarray
    bias: float
    slope: float = 1.0  #: of the calibration, on the log-odds of the noisy-or
    shift: float = 0.0
    threshold: float = 0.5

    def score(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, list]:
        scores, counts, offending = np.zeros(len(column)), np.zeros(len(column), np.int64), [[] for _ in range(len(column))]
        if not len(self.weights):
            return scores, counts, offending
        texts = None
        for s in sentences(column):
            z = np.bincount(s.owner, self.weights[s.feature], minlength=len(s.doc)) + self.bias
            p = 1 / (1 + np.exp(-z))
            counts[s.i : s.j] = np.bincount(s.doc, minlength=s.j - s.i)
            odds = log_odds(np.bincount(s.doc, np.logaddexp(0, z), minlength=s.j - s.i))
            scores[s.i : s.j] = np.where(counts[s.i : s.j] > 0, 1 / (1 + np.exp(-self.slope * odds - self.shift)), 0)
            found = np.flatnonzero(p >= self.threshold)
            if len(found):
                texts = texts or text_bytes(pc.utf8_lower(column.fill_null("")))
                data, off = texts
                for d in np.unique(s.doc[found]).tolist():
                    base, cp = int(off[s.i + d] - off[s.i]), code_points(data[off[s.i + d] : off[s.i + d + 1]])
                    offending[s.i + d] = [{"start": int(cp[s.starts[k] - base]), "end": int(cp[s.ends[k] - base]), "p": float(p[k])} for k in found[s.doc[found] == d].tolist()]
        return scores, counts, offending


def log_odds(total: np.ndarray) -> np.ndarray:
    """Log-odds of 1 - exp(-total), the noisy-or of sentences whose log(1 - p) sum up to -total."""
    total = np.clip(total, 1e-9, 30)
    return np.log(-np.expm1(-total)) + total


def calibrated(odds: np.ndarray, y: np.ndarray, weight: np.ndarray, prior: float = 1.0) -> tuple[float, float]:
    """Slope and shift of the log-odds by logistic regression, drawn towards 1 and 0; Newton's method."""
    x, b, start = np.stack([odds, np.ones(len(odds))], 1), np.array([1.0, 0.0]), np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ b))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + prior * np.eye(2), x.T @ (weight * (p - y)) + prior * (b - start))
        b = b - np.clip(step, -1, 1)
    return (float(b[0]), float(b[1])) if b[0] > 0 else (1.0, 0.0)


def fit(docs: list[tuple[float, float, np.ndarray, np.ndarray]], epochs: int = 40, rate: float = 0.5, l2: float = 3e-5, rare: int | None = None, start: float = 1.0) -> ToxicityModel:
    """docs: label, weight, and (sentence, feature) pairs, sentences numbered from 0. Adagrad over small batches; features of fewer than `rare` documents (3, or a 300th of them) stay out."""
    if len({y for y, *_ in docs}) < 2:
        return ToxicityModel(np.zeros(0), 0.0)
    seen = np.zeros(1 << BITS, np.int64)
    for *_, f in docs:
        seen[np.unique(f)] += 1
    common = seen >= (max(3, len(docs) // 300) if rare is None else rare)
    docs = [(y, weight, s[k := common[f]], f[k]) for y, weight, s, f in docs]
    held = docs[::5] if len(docs) >= 100 else []
    docs = [d for k, d in enumerate(docs) if k % 5] if held else docs
    w, b = np.zeros(1 << BITS), -5.0
    sum_w, sum_b = np.full(1 << BITS, start), 1e-6
    rng = np.random.Generator(np.random.PCG64(7))
    size = 64
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for a in range(0, len(docs), size):
            part = [docs[k] for k in order[a : a + size].tolist()]
            counts = [int(s[-1]) + 1 if len(s) else 0 for _, _, s, _ in part]
            base = np.concatenate(([0], np.cumsum(counts)))
            owner = np.concatenate([s + o for (_, _, s, _), o in zip(part, base, strict=False)])
            feature = np.concatenate([f for *_, f in part])
            z = np.bincount(owner, w[feature], minlength=base[-1]) + b
            doc = np.repeat(np.arange(len(part)), counts)
            total = np.bincount(doc, np.logaddexp(0, z), minlength=len(part))
            y, weight = np.array([d[0] for d in part]), np.array([d[1] for d in part])
            slope = np.where(y > 0, -np.exp(-total) / np.maximum(-np.expm1(-total), 1e-9), 1.0) * weight
            g = slope[doc] / (1 + np.exp(-z))
            used, where = np.unique(feature, return_inverse=True)
            gw = np.bincount(where, g[owner]) + l2 * len(part) * w[used]
            sum_w[used] += gw * gw
            w[used] -= rate * gw / np.sqrt(sum_w[used])
            gb = g.sum()
            sum_b += gb * gb
            b -= 0.05 * gb / np.sqrt(sum_b)
    totals = np.array([np.logaddexp(0, np.bincount(s, w[f]) + b).sum() if len(s) else 0.0 for _, _, s, f in held])
    slope, shift = calibrated(log_odds(totals), np.array([d[0] for d in held]), np.array([d[1] for d in held])) if len({d[0] for d in held}) == 2 else (1.0, 0.0)
    return ToxicityModel(w.astype(np.float32), float(b), slope, shift)


def train(docs: DataFrame, labels: DataFrame, sample: int = 6000, sample_chars: int = 20_000, text: str = "text", doc: str = "doc_id", label: str = "toxic") -> ToxicityModel:
    """Fits on about `sample` rows of each label of labels(doc, label), 0 or 1, in no case over 4 * sample in all; the rest of labels is ignored."""
    prepare(docs.sparkSession)
    known = labels.where(F.col(label).isin(0, 1) & F.col(doc).isNotNull()).select(F.col(doc).alias("id"), F.col(label).cast("int").alias("y")).distinct()
    counts = {r[0]: r[1] for r in known.groupBy("y").count().collect()}
    if len(counts) < 2:
        return fit([])
    share = F.create_map(*(x for y, n in counts.items() for x in (F.lit(y), F.lit(min(1.0, sample / n)))))[F.col("y")]
    some = known.where(F.pmod(F.xxhash64("id", F.lit("toxicity")), F.lit(1 << 20)) < share * (1 << 20))
    # of both labels together no more than about 2 * sample rows of two numbers: a bound by parameter, small enough to broadcast
    texts = docs.where(F.col(text).isNotNull() & (F.length(text) <= sample_chars)).select(F.col(doc).alias("id"), F.col(text).alias("text"))
    chosen = texts.join(F.broadcast(some), "id").withColumn("key", F.xxhash64("id", "text", F.lit("toxicity rows")))
    rows_of = {r[0]: r[1] for r in chosen.groupBy("y").count().collect()}
    share = F.create_map(*(x for y in counts for x in (F.lit(y), F.lit(min(1.0, sample / rows_of.get(y, 1))))))[F.col("y")]
    chosen = chosen.where(F.pmod("key", F.lit(1 << 20)) < share * (1 << 20)).groupBy("y", "key").agg(F.any_value("text").alias("text"))

    def features(batches):
        for batch in batches:
            rows = {"key": [], "y": [], "s": [], "f": []}
            keys, ys = (batch.column(c).to_pylist() for c in ("key", "y"))
            for s in sentences(batch.column("text")):
                first = np.searchsorted(s.doc, np.arange(s.j - s.i + 1))
                cut = np.searchsorted(s.owner, first)
                for d in range(s.j - s.i):
                    part = slice(cut[d], cut[d + 1])
                    rows["key"].append(keys[s.i + d])
                    rows["y"].append(ys[s.i + d])
                    rows["s"].append((s.owner[part] - first[d]).astype("<u4").tobytes())
                    rows["f"].append(s.feature[part].astype("<u4").tobytes())
            yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("key", pa.int64()), ("y", pa.int32()), ("s", pa.binary()), ("f", pa.binary())]))

    got = chosen.mapInArrow(features, "key long, y int, s binary, f binary").orderBy("key").limit(4 * sample).collect()
    got.sort(key=lambda r: (zlib.crc32(f"order{r['key']}".encode()), r["key"], r["y"], r["f"]))
    weights = {y: n / max(1, sum(r["y"] == y for r in got)) for y, n in counts.items()}
    mean = sum(weights[r["y"]] for r in got) / max(1, len(got))
    return fit([(float(r["y"]), weights[r["y"]] / mean, np.frombuffer(r["s"], "<u4").astype(np.int32), np.frombuffer(r["f"], "<u4").astype(np.int32)) for r in got])


def score(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """docs with score, n_sentences and offending (start, end in code points of the lower-cased text, p). The model is of fixed size."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return add_columns(docs, FIELDS, lambda batch: list(shared.value.score(batch.column(text))))
