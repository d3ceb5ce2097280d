"""Substring deduplication: paragraph MinHash banding, exact verification, and clusters by connected components.

Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z. A paragraph is a line of `least` words or more, or successive shorter
lines without a blank one between (wrapped text, lists) if they make up as many. Equal paragraphs are one node. A
paragraph's MinHash signature is cut into bands, tuned for high recall at the threshold; paragraphs that share a band are
verified by the exact Jaccard similarity of their shingles, and components of verified links are classes.

A passage that documents share need not be a paragraph: it may lie inside different ones, or inside one document twice.
So windows of `least` words are compared by equality too, all those at anchors that depend on the content only: where a
shingle's hash is the smallest of `least` + 1 successive ones. Any shared run of 2 * `least` words holds such a window
whole. Anchors leave the ends of a run open, up to `least` words: where the places of an anchor do not all go on to the same
next anchor, the words beside it are compared in all of these places, word by word. So spans reach as far as the shared run
does. For that, places are dealt by anchor and first word beside it and sorted by the words; of an anchor of more than
`crowd` places those with the same words count once.

Of a class, and of equal windows, the first occurrence (smallest doc id, rows without an id last, then place) stays, every
other is to be removed. Every row is a document of its own, whatever its id. Null texts have no paragraphs. Nothing is
capped or sampled; runs under 2 * `least` words inside longer lines, and lines under `least` words that stand alone, are
not looked for, so that licence lines do not count as copies.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .kernels import NOT_SPACE, Words, _powers, mix, windows
from .rows import add_columns, join_classes
from .similar import Banding, band_keys, bitmap, marked, units, verified_links
from .store import discard, keyed, materialize, prepare, release

_POSITION = 20
_LEFT = 0x5A4D3C2B1A09F8E7  #: turns a hash that is looked for on its left side
ROW = ("_mw_file", "_mw_row")


@dataclass(frozen=True)
class Settings(Banding):
    recall: float = 0.995
    hashes: int = 32
    large: int = 4096
    least: int = 25
    crowd: int = 1 << 16  #: places of an anchor that a task may hold, of about 450 bytes each


class Paragraphs:
    """Words of documents i..j-1, and the paragraphs a..b (words) among them."""

    def __init__(self, data: np.ndarray, off: np.ndarray, i: int, j: int, s: Settings):
        w = Words(data, off, i, j, NOT_SPACE)
        self.words, self.s = w, s
        raw = data[off[i] : off[j]]
        self.points = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
        self.base = self.points[off[i : j + 1] - off[i]]
        self.shingles = windows(w.hashes, s.shingle)
        line = np.cumsum(raw == 0x0A)[w.starts] if len(w) else np.zeros(0, np.int64)
        fresh = np.ones(len(w), bool)
        fresh[1:] = (line[1:] != line[:-1]) | (w.doc[1:] != w.doc[:-1])
        a = np.flatnonzero(fresh)
        size = np.diff(np.append(a, len(w)))
        long = size >= s.least
        new = np.ones(len(a), bool)  # a line that does not go on with the short ones before it
        if len(a):
            new[1:] = long[1:] | long[:-1] | (line[a[1:]] - line[a[:-1]] > 1) | (w.doc[a[1:]] != w.doc[a[:-1]])
        a = a[new]
        b = np.append(a[1:], len(w)).astype(np.int64)
        keep = b - a >= s.least
        self.a, self.b = a[keep], b[keep]

    def hashes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of the words a..b-1, signed."""
        power, inverse = _powers(len(self.words) + 1)
        total = np.zeros(len(self.words) + 1, np.uint64)
        np.cumsum(self.words.hashes * power[: len(self.words)], out=total[1:])
        return mix((total[b] - total[a]) * inverse[a]).view(np.int64)

    def places(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        doc = self.words.doc[a]
        return doc, self.points[self.words.starts[a]] - self.base[doc], self.points[self.words.ends[b - 1]] - self.base[doc]

    def bands(self) -> np.ndarray:
        """Band keys, paragraphs x bands. Bounds of reduceat alternate: shingles of a paragraph, those up to the next."""
        bounds = np.empty(2 * len(self.a), np.int64)
        bounds[::2], bounds[1::2] = self.a, self.b - self.s.shingle + 1
        return band_keys(np.append(self.shingles[: bounds[-1] if len(bounds) else 0], np.uint64(0)), bounds, 2, self.s)

    def anchors(self) -> np.ndarray:
        """First words of the windows of `least` words at anchors, within one document each."""
        n, span = len(self.shingles), self.s.least + 1
        if n < span:
            return np.zeros(0, np.int64)
        low = np.uint64((1 << _POSITION) - 1)
        step = 1 << _POSITION
        found = []
        for begin in range(0, n - span + 1, step // 2):
            part = self.shingles[begin : begin + step // 2 + span - 1]
            v, size = (part & ~low) | (low - np.arange(len(part), dtype=np.uint64)), 1
            while size < span:
                hop = min(size, span - size)
                v, size = np.minimum(v[:-hop], v[hop:]), size + hop
            found.append(begin + (low - (np.unique(v) & low)).astype(np.int64))
        return self.whole(np.unique(np.concatenate(found)))

    def whole(self, a: np.ndarray) -> np.ndarray:
        """Those of the places at which a window of `least` words of one document begins."""
        a = a[(a >= 0) & (a + self.s.least <= len(self.words))]
        return a[self.words.doc[a] == self.words.doc[a + self.s.least - 1]]

    def batch(self, ids: pa.Array, i: int, a: np.ndarray, b: np.ndarray) -> tuple[list, list[str]]:
        """Columns doc, start, end, word (its number in the document) and h of the words a..b-1."""
        doc, start, end = self.places(a, b)
        word = a - self.words.first[doc]
        return [ids.take(pa.array(doc + i)), *(pa.array(x.astype(np.int32)) for x in (start, end, word)), pa.array(self.hashes(a, b))], ["doc", "start", "end", "word", "h"]


def _kind(docs: DataFrame) -> str:
    return f"doc {docs.schema['doc'].dataType.simpleString()}, start int, end int, word int, h long"


def _found(docs: DataFrame, s: Settings) -> DataFrame:
    """(doc, start, end, word, h, size, bands) per paragraph, and with null bands per window at an anchor: one pass over the texts."""
    count = s.bands[0]

    def make(ids, i, data, off, j):
        p = Paragraphs(data, off, i, j, s)
        at = p.anchors()
        a, b = np.concatenate((p.a, at)), np.concatenate((p.b, at + s.least))
        columns, names = p.batch(ids, i, a, b)
        keys = p.bands()
        bounds = np.minimum(np.arange(len(a) + 1), len(p.a)) * count
        nulls = pa.array(np.arange(len(a)) >= len(p.a))
        lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(keys.ravel().view(np.int64)), mask=nulls)
        return pa.RecordBatch.from_arrays([*columns, pa.array((b - a).astype(np.int32)), lists], names=[*names, "size", "bands"])

    return units(docs, f"{_kind(docs)}, size int, bands array<long>", make)


def _sets(docs: DataFrame, wanted: DataFrame, s: Settings) -> DataFrame:
    """(h, shingles) of the paragraphs in wanted(h). A bitmap spares most others the shuffle; the join drops the rest."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(wanted))

    def make(ids, i, data, off, j):
        p = Paragraphs(data, off, i, j, s)
        h = p.hashes(p.a, p.b)
        take = marked(shared.value, h)
        _, first = np.unique(h[take], return_index=True)
        take = take[np.sort(first)]
        shingles = [np.unique(p.shingles[a : b - s.shingle + 1]).astype("<u8").tobytes() for a, b in zip(p.a[take].tolist(), p.b[take].tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(h[take]), pa.array(shingles, pa.binary())], names=["h", "shingles"])

    found = units(docs, "h long, shingles binary", make)
    return found.join(wanted, "h", "left_semi").groupBy("h").agg(F.any_value("shingles").alias("shingles"))


def _again(found: DataFrame) -> DataFrame:
    """Rows of found(.., h) whose h occurs more than once, and a few others. Only hashes and counts are dealt for it."""
    twice = found.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    shared = found.sparkSession.sparkContext.broadcast(bitmap(twice))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.take(pa.array(marked(shared.value, batch.column("h").to_numpy())))

    return found.mapInArrow(run, found.schema)


def _repeated(found: DataFrame) -> DataFrame:
    """(h, n, kept) of equal windows that occur more than once."""
    return found.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "start")).alias("kept")).where("n > 1")


def _repeats(found: DataFrame, stored: DataFrame) -> DataFrame:
    """found(.., h) with kept, where h occurs more than once; the table it reads from is discarded once it is read."""
    some = materialize(_again(found))
    discard(stored)
    classes = materialize(_repeated(some))
    out = materialize(join_classes(some, classes, "h", "n"))
    discard(some)
    discard(classes)
    release(out.sparkSession)
    return out


def _edges(spans: DataFrame, s: Settings) -> DataFrame:
    """(h, n) of the repeated anchors after which a shared run may end, and turned by _LEFT of those before which one may begin; n places have it.

    It may where the places do not all have the same next anchor at the same distance, or where none follows on.
    """

    def code(h: np.ndarray, gap: np.ndarray, follows: np.ndarray) -> np.ndarray:
        return np.where(follows, mix(h.view(np.uint64) + gap.astype(np.uint64)) | np.uint64(1), np.uint64(0)).view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, nothing = None, np.zeros(1, np.int64)
        left = nothing
        for batch in batches:
            file, at, word, h = (np.append(x, c.to_numpy()) for x, c in zip(held or [np.zeros(0, np.int64)] * 4, batch.columns, strict=True))
            if not len(h):
                continue
            gap = np.diff(word)
            follows = (file[1:] == file[:-1]) & (at[1:] == at[:-1]) & (gap <= s.least)
            before = np.append(left, code(h[:-1], gap, follows))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h[:-1], code(h[1:], gap, follows), before[:-1])], names=["h", "right", "left"])
            held, left = [x[-1:] for x in (file, at, word, h)], before[-1:]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (held[3], nothing, left)], names=["h", "right", "left"])

    rows = spans.select("doc._mw_file", "doc._mw_row", F.col("word").cast("long").alias("word"), "h").repartition(*ROW).sortWithinPartitions(*ROW, "word")
    sides = rows.mapInArrow(run, "h long, right long, left long").groupBy("h").agg(F.count(F.lit(1)).alias("n"), *(f(c).alias(f"{k}_{c}") for c in ("right", "left") for k, f in (("low", F.min), ("high", F.max))))
    open_ = lambda c: (F.col(f"low_{c}") != F.col(f"high_{c}")) | (F.col(f"low_{c}") == 0)
    sought = F.array(F.when(open_("right"), F.col("h")), F.when(open_("left"), F.col("h").bitwiseXOR(F.lit(_LEFT))))
    return sides.select("n", F.explode(sought).alias("h")).where("h is not null").groupBy("h").agg(F.max("n").alias("n"))


def _beside(docs: DataFrame, edges: DataFrame, s: Settings) -> DataFrame:
    """(g, doc, start, words, starts, ends) of each place of an anchor in edges(h), and of a few others: the words beside it, outwards, the bounds of
    the windows that take in one more each, and a hash of the anchor and the first of these words. Without a word beside it a place is left out."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(edges))
    reach = np.arange(s.least + 1)

    def make(ids, i, data, off, j):
        p = Paragraphs(data, off, i, j, s)
        at = p.anchors()
        h = p.hashes(at, at + s.least)
        right, left = marked(shared.value, h), marked(shared.value, h ^ _LEFT)
        a, h = at[np.concatenate((right, left))], np.concatenate((h[right], h[left] ^ _LEFT))
        after, of = np.arange(len(a)) < len(right), p.words.doc[a]
        more = np.where(after, p.words.first[of + 1] - a - s.least, a - p.words.first[of])
        a, h, after, more = (x[more > 0] for x in (a, h, after, more))
        doc, start, _ = p.places(a, a + s.least)
        inside = reach < more[:, None]
        count = inside.sum(1)
        first = (a[:, None] + np.where(after[:, None], reach + 1, -reach - 1))[inside]  # of the windows
        last = first + s.least - 1
        base = np.repeat(p.base[doc], count)
        words = np.where(np.repeat(after, count), last, first)
        bounds = np.concatenate(([0], np.cumsum(count))).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(bounds), pa.array(x.astype(np.int32))) for x in (p.points[p.words.starts[first]] - base, p.points[p.words.ends[last]] - base)]
        held = pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer((bounds * 8).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(p.words.hashes[words]))])
        g = mix(h.view(np.uint64) + p.words.hashes[words[bounds[:-1]]]).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(g), ids.take(pa.array(doc + i)), pa.array(start.astype(np.int32)), held, *lists], names=["g", "doc", "start", "words", "starts", "ends"])

    return units(docs, f"g long, doc {docs.schema['doc'].dataType.simpleString()}, start int, words binary, starts array<int>, ends array<int>", make)


def _ranks(keys: list[pa.Array]) -> np.ndarray:
    """Places of rows in the order of the keys, structs field by field."""
    flat = [y for x in keys for y in (x.flatten() if pa.types.is_struct(x.type) else [x])]
    flat = [x.cast(pa.int8()) if pa.types.is_boolean(x.type) else x for x in flat]
    return pc.sort_indices(pa.table(flat, names=[str(k) for k in range(len(flat))]), sort_keys=[(str(k), "ascending") for k in range(len(flat))]).to_numpy().astype(np.int64)


def _joined(held: pa.RecordBatch | None, batch: pa.RecordBatch) -> pa.RecordBatch:
    return batch if held is None else pa.concat_batches([held, batch])


def _reach(t: pa.RecordBatch, width: int, twice: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows(g, doc, start, words) sorted by g and words: how many words another place shares, from how many on the row is the first place that has
    them, and the row that is so for one word. Rows in `twice` stand for several places."""
    g, raw = t.column("g").to_numpy(), t.column("words").to_pylist()
    size = np.array([len(x) for x in raw]) // 8
    inside = np.arange(width) < size[:, None]
    words = np.zeros((len(t), width), np.uint64)
    words[inside] = np.frombuffer(b"".join(raw), np.uint64)
    same = (words[1:] == words[:-1]) & inside[1:] & inside[:-1] & (g[1:] == g[:-1])[:, None]
    common = np.concatenate(([0], np.logical_and.accumulate(same, axis=1).sum(1), [0]))
    upto = np.where(twice, size, np.maximum(common[:-1], common[1:]))
    order = _ranks([t.column("doc"), t.column("start")])
    rank = np.empty(len(t), np.int64)
    rank[order] = np.arange(len(t))
    since, first = upto + 1, np.arange(len(t))
    for k in range(upto.max(initial=0), 0, -1):
        fresh = common[:-1] < k
        least = np.minimum.reduceat(rank, np.flatnonzero(fresh))[np.cumsum(fresh) - 1]
        since[(least == rank) & (upto >= k)] = k
        first = order[least]
    return upto, since, first


def _beside_spans(t: pa.RecordBatch, upto: np.ndarray, since: np.ndarray, first: pa.Array) -> pa.RecordBatch:
    """Spans of rows(doc, start, starts, ends): the windows up to `since`, kept by the place `first`, and those from it on, kept by the row's own."""
    doc = t.column("doc")
    starts, ends = (t.column(c).flatten().to_numpy() for c in ("starts", "ends"))
    size = pc.list_value_length(t.column("starts")).to_numpy().astype(np.int64)
    at = np.cumsum(size) - size
    gone, stay = np.flatnonzero((since > 1) & (upto > 0)), np.flatnonzero(since <= upto)
    who = np.concatenate((gone, stay))
    low = at[who] + np.concatenate((np.zeros(len(gone), np.int64), since[stay] - 1))
    high = at[who] + np.concatenate((since[gone] - 2, upto[stay] - 1))
    kept = pa.concat_arrays([first.take(pa.array(gone)), _place(t).take(pa.array(stay))])
    return pa.RecordBatch.from_arrays([doc.take(pa.array(who)), pa.array(np.minimum(starts[low], starts[high])), pa.array(np.maximum(ends[low], ends[high])), kept, pa.array(np.arange(len(who)) < len(gone))], names=["doc", "start", "end", "kept", "removed"])


def _place(t: pa.RecordBatch) -> pa.StructArray:
    return pa.StructArray.from_arrays([t.column("doc"), t.column("start")], names=["doc", "start"])


def _by_group(make: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of rows sorted by g through make, so that rows of one g stay together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            g = batch.column("g").to_numpy()
            if not len(g):
                continue
            fresh = np.flatnonzero(g[1:] != g[:-1]) + 1
            if held and held[-1].column("g")[-1].as_py() != g[0]:
                fresh = np.append(0, fresh)
            if len(fresh):
                done = [*held, batch.slice(0, int(fresh[-1]))]
                yield make(pa.concat_batches([x for x in done if len(x)]))
                held = []
            held.append(batch.slice(int(fresh[-1]) if len(fresh) else 0))
        if held:
            yield make(pa.concat_batches(held))

    return run


def _ends(docs: DataFrame, edges: DataFrame, s: Settings) -> list[DataFrame]:
    """(doc, start, end, kept, removed) of the windows beside the anchors edges(h, n) that occur more than once, in stored parts."""
    kind = docs.schema["doc"].dataType.simpleString()
    spans, width = f"doc {kind}, start int, end int, kept struct<doc: {kind}, start: int>, removed boolean", s.least + 1
    few, many = edges.where(F.col("n") <= s.crowd), edges.where(F.col("n") > s.crowd)

    def each(t: pa.RecordBatch) -> pa.RecordBatch:
        upto, since, first = _reach(t, width, np.zeros(len(t), bool))
        return _beside_spans(t, upto, since, _place(t).take(pa.array(first)))

    def kinds(t: pa.RecordBatch) -> pa.RecordBatch:
        n = t.column("n")
        upto, since, first = _reach(t, width, n.to_numpy() > 1)
        return pa.RecordBatch.from_arrays([t.column("c"), n, pa.array(upto), pa.array(since), _place(t), _place(t).take(pa.array(first))], names=["c", "n", "upto", "since", "least", "first"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            if len(t):
                upto, since = t.column("upto").to_numpy(), t.column("since").to_numpy()
                own = t.column("is_least").to_numpy(zero_copy_only=False)
                yield _beside_spans(t, upto, np.where(own, since, upto + 1), t.column("first"))

    dealt = lambda rows: rows.repartition("g").sortWithinPartitions("g", "words")
    out = [materialize(dealt(_beside(docs, few, s)).mapInArrow(_by_group(each), spans))]
    if not many.isEmpty():
        rows = materialize(_beside(docs, many, s).withColumn("c", F.xxhash64("g", "words")))
        alike = rows.groupBy("c").agg(F.any_value("g").alias("g"), F.any_value("words").alias("words"), F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "start")).alias("least"))
        alike = dealt(alike.select("c", "g", "words", "n", "least.doc", "least.start"))
        made = materialize(alike.mapInArrow(_by_group(kinds), f"c long, n long, upto long, since long, least struct<doc: {kind}, start: int>, first struct<doc: {kind}, start: int>"))
        known = join_classes(rows, made, "c", "n").withColumn("is_least", F.struct("doc", "start").eqNullSafe(F.col("least")))
        out.append(materialize(known.select("doc", "start", "starts", "ends", "upto", "since", "first", "is_least").mapInArrow(joined, spans)))
        discard(rows)
        discard(made)
    release(docs.sparkSession)
    return out


def _passages(rows: DataFrame, s: Settings) -> DataFrame:
    """rows(doc: id and place of a row, text) -> (doc, start, end, kept, removed), spans merged within a row."""
    found = materialize(_found(rows, s))
    paragraphs, anchored = found.where("bands is not null"), found.where("bands is null")
    place = F.struct("doc", "start")
    nodes = materialize(paragraphs.groupBy("h").agg(F.any_value("size").alias("size"), F.any_value("bands").alias("bands"), F.count(F.lit(1)).alias("n"), F.min(place).alias("first")))
    linked = components(verified_links(nodes.select("h", "size", "bands"), lambda wanted: _sets(rows, wanted, s), s))
    rooted = nodes.join(linked, nodes["h"] == linked["node"], "left").select("h", "n", "first", F.coalesce("component", "h").alias("root"))
    firsts = rooted.groupBy("root").agg(F.sum("n").alias("all"), F.min("first").alias("kept")).where("all > 1").select("root", "kept")
    classes = materialize(rooted.join(firsts, "root").select("h", "n", "kept"))
    columns = ["doc", "start", "end", "kept", "removed"]
    decided = lambda spans: spans.withColumn("removed", ~place.eqNullSafe(F.col("kept"))).select(columns)
    parts = [materialize(decided(join_classes(paragraphs.select("doc", "start", "end", "h"), classes, "h", "n")))]
    discard(nodes)
    discard(classes)
    release(rows.sparkSession)
    windows_ = _repeats(anchored.select("doc", "start", "end", "word", "h"), found)
    edges = materialize(_edges(windows_, s))
    parts.append(materialize(decided(windows_)))
    discard(windows_)
    release(rows.sparkSession)
    parts += _ends(rows, edges, s)
    merged = materialize(_merged(reduce(lambda a, b: a.unionByName(b), parts)))
    for used in (edges, *parts):
        discard(used)
    return merged


def _merged(spans: DataFrame) -> DataFrame:
    """(doc, start, end, kept, removed): overlapping spans of a row with the same fate become one. Rows stream through a sorted shuffle."""
    schema = T.StructType([T.StructField("doc", spans.schema["doc"].dataType), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kept", spans.schema["kept"].dataType), T.StructField("removed", T.BooleanType())])

    def merge(t: pa.RecordBatch) -> pa.RecordBatch:
        doc, kept = t.column("doc"), t.column("kept")
        start, end, removed = (t.column(c).to_numpy(zero_copy_only=False) for c in ("start", "end", "removed"))
        fresh, other = np.ones(len(t), bool), removed[1:] != removed[:-1]
        for x in (doc.field(c).to_numpy() for c in ROW):
            other |= x[1:] != x[:-1]
        turn = np.concatenate(([0], np.cumsum(other))) << 32
        fresh[1:] = other | (start[1:] > (np.maximum.accumulate(end + turn) - turn)[:-1])
        at, span = np.flatnonzero(fresh), np.cumsum(fresh)
        order = _ranks([pa.array(span), *kept.flatten()])
        least = order[np.flatnonzero(np.append(True, np.diff(span[order]) > 0))]
        return pa.RecordBatch.from_arrays([doc.take(pa.array(at)), pa.array(start[at]), pa.array(np.maximum.reduceat(end, at)), kept.take(pa.array(least)), pa.array(removed[at])], schema=t.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if len(batch):
                out = merge(_joined(held, batch))
                yield out.slice(0, len(out) - 1)
                held = out.slice(len(out) - 1)
        if held is not None:
            yield held

    rows = spans.select(*schema.names).withColumns({c: F.col(f"doc.{c}") for c in ROW})
    return rows.repartition(*ROW).sortWithinPartitions(*ROW, "removed", "start", "end").select(*schema.names).mapInArrow(run, schema)


def _identified(docs: DataFrame, text: str, doc: str) -> tuple[DataFrame, DataFrame]:
    """docs with the place of each row, and (doc, text) under which passages are looked for."""
    rows = keyed(docs)
    row = F.struct(F.col(doc).isNull().alias("nameless"), F.col(doc).alias("id"), *ROW)
    return rows, rows.select(row.alias("doc"), F.col(text).alias("text")).where("text is not null")


def repeated_passages(docs: DataFrame, settings: Settings | None = None, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """(doc, start, end, kept_doc, removed): spans in code points that occur again, also in altered form, merged within a row.

    removed is false where a span is the first occurrence, which stays; kept_doc is the document that keeps the passage.
    """
    prepare(docs.sparkSession)
    found = _passages(_identified(docs, text, doc)[1], settings or Settings())
    return found.select(F.col("doc.id").alias(doc), "start", "end", F.col("kept.doc.id").alias("kept_doc"), "removed")


def without_repeats(docs: DataFrame, settings: Settings | None = None, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """docs with every repeated passage cut but where it occurs first: what belongs to a first occurrence stays. Columns stay as they are."""
    prepare(docs.sparkSession)
    rows, narrow = _identified(docs, text, doc)
    listed = lambda which: F.array_sort(F.collect_list(F.when(which, F.struct("start", "end"))))
    cuts = _passages(narrow, settings or Settings()).groupBy("doc._mw_file", "doc._mw_row").agg(listed(F.col("removed")).alias("_mw_cuts"), listed(~F.col("removed")).alias("_mw_kept"))
    joined = rows.join(cuts, list(ROW), "left")

    def make(batch: pa.RecordBatch) -> list:
        out = []
        for t, cut, kept in zip(*(batch.column(c).to_pylist() for c in (text, "_mw_cuts", "_mw_kept")), strict=True):
            out.append(t if not cut else _without(t, [(x["start"], x["end"]) for x in cut], [(x["start"], x["end"]) for x in kept]))
        return [out]

    return add_columns(joined, T.StructType([T.StructField("_mw_text", T.StringType())]), make).withColumn(text, F.col("_mw_text")).select(*docs.columns)


def _without(text: str, cuts: list[tuple[int, int]], kept: list[tuple[int, int]]) -> str:
    """text without the cuts, but for what lies in a kept span; each list is sorted and disjoint."""
    parts, at = [], 0
    for a, b in cuts:
        parts.append(text[at:a])
        for x, y in kept:
            if x < b and y > a:
                parts.append(text[max(a, x) : min(b, y)])
        at = b
    return "".join([*parts, text[at:]])
