"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned over training word windows.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z. A window is `n` consecutive words of one item; an
item of fewer words, but not none, is one window. Window hashes of documents are looked up in the items' sorted
hashes and every hit is verified word by word, so a hash collision changes nothing.

Items are taken in blocks of about `block_bytes` of text (an item beyond that is a block with it); each block is one
broadcast of some arrays, a small multiple of its text, and one scan, so the benchmark may grow without the broadcast growing. Null texts have no words; items with null ids take no part; repeated item ids
count once; no items give rows without hits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernels import ALNUM, Words, chunks, text_bytes, windows
from .rows import add_columns, code_points, reserved

FIELDS = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("hit_items", T.ArrayType(T.StringType())), T.StructField("hit_spans", T.ArrayType(T.ArrayType(T.IntegerType())))])
_RUNS, _SEEN = "_mw_runs", "_mw_seen"
_STATE = T.StructType([T.StructField(_RUNS, T.ArrayType(T.IntegerType())), T.StructField(_SEEN, T.ArrayType(T.StringType()))])


@dataclass(frozen=True)
class Windows:
    """The distinct windows of m words, by hash: where each lies in the items' words, and the items that hold it (flat, with bounds)."""

    m: int
    hashes: np.ndarray
    at: np.ndarray
    items: np.ndarray
    off: np.ndarray


@dataclass(frozen=True)
class Index:
    """A block of items in a few arrays: about 30 bytes a word, in the driver, the broadcast and each worker alike."""

    names: np.ndarray
    low: bytes
    starts: np.ndarray
    ends: np.ndarray
    windows: tuple[Windows, ...]

    def words(self, at: int, m: int) -> bytes:
        return _joined(self.low, self.starts, self.ends, at, m)


def _index(items: list[tuple[str, str]], n: int) -> Index:
    data, off = text_bytes(pa.array([t for _, t in items], pa.string()))
    w = Words(data, off, 0, len(items), ALNUM)
    low, counts = w.low.tobytes(), np.diff(w.first)
    names, code = np.unique(np.array([i for i, _ in items], object), return_inverse=True) if items else (np.zeros(0, object), np.zeros(0, np.int64))
    sizes, found = np.minimum(counts, n), []
    for m in np.unique(sizes[sizes > 0]).tolist():
        hashes = windows(w.hashes, m)
        at = np.flatnonzero((w.doc[: len(hashes)] == w.doc[m - 1 :]) & (sizes[w.doc[: len(hashes)]] == m))
        h = hashes[at]
        by = np.lexsort((code[w.doc[at]], h))
        at, h = at[by], h[by]
        group, kinds = np.zeros(len(at), np.int64), 0
        for a, b in _runs(h):  # windows of one hash: equal ones, but for a collision
            seen: dict[bytes, int] = {}
            for k in range(a, b):
                group[k] = seen.setdefault(_joined(low, w.starts, w.ends, int(at[k]), m) if b - a > 1 else b"", kinds + len(seen))
            kinds += len(seen)
        pairs = np.unique(group << 32 | code[w.doc[at]])
        _, first = np.unique(group, return_index=True)
        found.append(Windows(m, h[first], at[first].astype(np.int32), (pairs & 0xFFFFFFFF).astype(np.int32), np.searchsorted(pairs >> 32, np.arange(kinds + 1)).astype(np.int32)))
    return Index(names, low, w.starts.astype(np.int32), w.ends.astype(np.int32), tuple(found))


def _runs(h: np.ndarray) -> Iterator[tuple[int, int]]:
    cuts = np.flatnonzero(np.diff(h)) + 1
    return zip([0, *cuts.tolist()], [*cuts.tolist(), len(h)], strict=True)


def _joined(raw: bytes, starts: np.ndarray, ends: np.ndarray, at: int, m: int) -> bytes:
    return b" ".join([raw[s:e] for s, e in zip(starts[at : at + m].tolist(), ends[at : at + m].tolist(), strict=True)])


def _scan(batch: pa.RecordBatch, text: str, index: Index) -> tuple[list, list]:
    """Per document the merged runs of hit words (flat: from, to, from, to, ...) and the items hit."""
    data, off = text_bytes(batch.column(text))
    runs, seen = [[] for _ in range(batch.num_rows)], [set() for _ in range(batch.num_rows)]
    for i, j in chunks(off):
        w = Words(data, off, i, j, ALNUM)
        raw = None
        hit = np.zeros(len(w) + 1, np.int32)
        for some in index.windows:
            hashes = windows(w.hashes, some.m)
            first, last = (np.searchsorted(some.hashes, hashes, side=side) for side in ("left", "right"))
            for at in np.flatnonzero((last > first) & (w.doc[: len(hashes)] == w.doc[some.m - 1 :])).tolist():
                raw = w.low.tobytes() if raw is None else raw
                mine = _joined(raw, w.starts, w.ends, at, some.m)
                for k in range(first[at], last[at]):
                    if index.words(int(some.at[k]), some.m) == mine:
                        hit[at] += 1
                        hit[at + some.m] -= 1
                        seen[i + int(w.doc[at])].update(some.items[some.off[k] : some.off[k + 1]].tolist())
        if hit.any():
            on = np.cumsum(hit)[:-1] > 0
            for d in np.unique(w.doc[on]).tolist():
                a, b = int(w.first[d]), int(w.first[d + 1])
                runs[i + d] = np.flatnonzero(np.diff(np.concatenate(([0], on[a:b].astype(np.int8), [0])))).tolist()
    return runs, [sorted(index.names[list(x)].tolist()) for x in seen]


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, text: str = "text", item: str = "item_id", item_text: str = "text", block_bytes: int = 4 << 20, fields: T.StructType = FIELDS) -> DataFrame:
    """docs with n_words, n_hit, hit_items (sorted strings) and hit_spans ([start, end] in code points, end exclusive), or under the names of `fields`."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item).cast("string").alias("item"), F.col(item_text).alias("words")).where("item is not null and words is not null")
    size = items.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    out = docs
    for k in range(blocks):
        mine = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == k)
        shared = spark.sparkContext.broadcast(_index([(r[0], r[1]) for r in mine.collect()], n))
        if k:
            out = out.withColumnsRenamed({c: f"{c}0" for c in _STATE.names})
        out = add_columns(out, *_pass(shared, text, k == 0, k == blocks - 1, fields)).drop(*(f"{c}0" for c in _STATE.names))
    return out


def _pass(shared: Broadcast, text: str, first: bool, last: bool, fields: T.StructType) -> tuple:
    """One block's scan, added to what the blocks before found; the last one gives the results."""

    def make(batch: pa.RecordBatch) -> list:
        runs, seen = _scan(batch, text, shared.value)
        if not first:
            old = zip(batch.column(f"{_RUNS}0").to_pylist(), batch.column(f"{_SEEN}0").to_pylist(), strict=True)
            for d, (r, s) in enumerate(old):
                runs[d], seen[d] = _merged([*zip(r[::2], r[1::2], strict=True), *zip(runs[d][::2], runs[d][1::2], strict=True)]), sorted({*s, *seen[d]})
        return _finish(batch, text, runs, seen) if last else [runs, seen]

    return (fields if last else _STATE), make


def _merged(spans: list[tuple[int, int]]) -> list[int]:
    flat: list[int] = []
    for a, b in sorted(spans):
        if flat and a <= flat[-1]:
            flat[-1] = max(flat[-1], b)
        else:
            flat += [a, b]
    return flat


def _finish(batch: pa.RecordBatch, text: str, runs: list, seen: list) -> list:
    data, off = text_bytes(batch.column(text))
    n_words, n_hit, spans = np.zeros(batch.num_rows, np.int64), [sum(r[1::2]) - sum(r[::2]) for r in runs], [[] for _ in runs]
    for i, j in chunks(off):
        w = Words(data, off, i, j, ALNUM, hashed=False)
        n_words[i:j] = np.diff(w.first)
        for d in range(i, j):
            if runs[d]:
                first, base = int(w.first[d - i]), int(off[d] - off[i])
                cp = code_points(data[off[d] : off[d + 1]])
                spans[d] = [[int(cp[w.starts[first + a] - base]), int(cp[w.ends[first + b - 1] - base])] for a, b in zip(runs[d][::2], runs[d][1::2], strict=True)]
    return [n_words, n_hit, seen, spans]


def removed(docs: DataFrame, benchmark: DataFrame, n: int = 10, drop_share: float = 0.5, text: str = "text") -> DataFrame:
    """docs without contamination: hit spans are cut out of a text; a document of which `drop_share` or more of the words is hit goes.

    Columns stay as they are, whatever their names; clean documents stay unchanged.
    """
    found = decontaminate(docs, benchmark, n, text, fields=reserved(FIELDS))
    kept = found.where((F.col("_mw_n_hit") == 0) | (F.col("_mw_n_hit") < F.lit(drop_share) * F.col("_mw_n_words")))
    cut = F.aggregate(F.reverse("_mw_hit_spans"), F.col(text), lambda t, s: F.concat(t.substr(F.lit(1), s[0]), t.substr(s[1] + 1, F.length(t))))
    return kept.withColumn(text, F.when(F.size("_mw_hit_spans") > 0, cut).otherwise(F.col(text))).select(*docs.columns)
