"""Verified links among sets of shingles: MinHash bands find candidates, exact Jaccard similarity decides.

Nodes that share a band are compared within the bucket, where a search compares a node with those not reached yet, so a
bucket of near copies costs little more than its size and only a spanning forest is emitted. Buckets with the same members
are compared once. A bucket that weighs more than `large`, by nodes or by shingles, is compared in chunks with some of its
nodes at a time, so no task grows with a bucket and no pair of one is left out. What a search finds depends on the
bucket's members only, not on the order in which they arrive.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .kernels import chunks, mix, text_bytes
from .store import discard, materialize

BITMAP = 1 << 26  #: bits of the filter that spares most rows a shuffle: 8 MB, whatever the input
WEIGHT = 1024  #: shingles that count as one more node in a bucket


@dataclass(frozen=True)
class Banding:
    shingle: int = 5
    threshold: float = 0.8
    recall: float = 0.9999  #: probability that a pair at the threshold shares a band
    hashes: int = 64
    large: int = 2048
    pivots: int = 256
    radius: int = 3  #: bits in which SimHash fingerprints of candidates may differ, for whole documents

    @property
    def bands(self) -> tuple[int, int]:
        return tune(self.threshold, self.recall, self.hashes)


def tune(threshold: float, recall: float, most: int) -> tuple[int, int]:
    """(bands, rows): the most rows a band, so the fewest false candidates, for which `most` hashes give the recall at the threshold."""
    for rows in range(most, 0, -1):
        bands = int(np.ceil(np.log(1 - recall) / np.log1p(-(threshold**rows))))
        if bands * rows <= most:
            return bands, rows
    return most, 1


def band_keys(shingles: np.ndarray, bounds: np.ndarray, step: int, s: Banding) -> np.ndarray:
    """Band keys, sets x bands; every `step`-th segment of shingles between bounds is a set."""
    count, rows = s.bands
    rng = np.random.Generator(np.random.PCG64(3))
    out = np.zeros((len(bounds[::step]), count), np.uint64)
    for k in range(count):
        for _ in range(rows):
            m, c = (np.uint64(x) for x in rng.integers(1, 2**63, 2))
            least = np.minimum.reduceat(shingles * (m | np.uint64(1)) ^ c, bounds)[::step] if len(bounds) else np.zeros(0, np.uint64)
            out[:, k] = mix(out[:, k] * np.uint64(0x9E3779B97F4A7C15) + least)
        out[:, k] = mix(out[:, k] + np.uint64(k + 1))
    return out


def units(docs: DataFrame, schema: str, make: Callable) -> DataFrame:
    """docs(doc, text) through make(ids, first document, bytes, offsets, last document) -> record batch, some documents at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = text_bytes(batch.column("text"))
            for i, j in chunks(off):
                yield make(batch.column("doc"), i, data, off, j)

    return docs.mapInArrow(run, schema)


def bitmap(wanted: DataFrame) -> np.ndarray:
    """BITMAP bits, one set for each of wanted(h)."""
    bit = F.pmod("h", F.lit(BITMAP))
    rows = wanted.select(F.shiftright(bit, 15).alias("part"), bit.bitwiseAND(32767).alias("bit")).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    out = np.zeros(BITMAP // 8, np.uint8)
    for r in rows:
        out[r["part"] * 4096 : (r["part"] + 1) * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def marked(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places of those hashes (signed) whose bit is set: all that are wanted and a few others."""
    at = h % BITMAP
    return np.flatnonzero(bits[at >> 3] >> (at & 7).astype(np.uint8) & 1)


def similar(sets: list[np.ndarray], threshold: float) -> list[tuple[int, int]]:
    """A spanning forest of the graph that links sets of a Jaccard similarity of threshold or more."""
    sizes = np.array([len(x) for x in sets])
    _, local = np.unique(np.concatenate(sets), return_inverse=True)
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    mark = np.zeros(local.max() + 1 if len(local) else 0, bool)
    rest, out = np.arange(len(sets)), []
    flat, owner = local, np.repeat(np.arange(len(sets)), sizes)
    queue: list[int] = []
    while len(rest) or queue:
        if not queue:
            queue, rest = [int(rest[0])], rest[1:]
        x = queue.pop()
        if not len(rest):
            continue
        if len(owner) > 2 * sizes[rest].sum():  # what is reached leaves the arrays
            alive = np.zeros(len(sets), bool)
            alive[rest] = True
            keep = alive[owner]
            flat, owner = flat[keep], owner[keep]
        mark[local[offsets[x] : offsets[x + 1]]] = True
        both = np.bincount(owner[mark[flat]], minlength=len(sets))[rest]
        mark[local[offsets[x] : offsets[x + 1]]] = False
        near = both >= threshold * (sizes[rest] + sizes[x] - both) - 1e-9
        if near.any():
            new = rest[near].tolist()
            out += [(x, y) for y in new]
            queue += new
            rest = rest[~near]
    return out


def verified_links(nodes: DataFrame, sets_of: Callable[[DataFrame], DataFrame], s: Banding) -> DataFrame:
    """Links (a, b) among nodes(h, size, bands), stored; sets_of(wanted(h)) gives (h, shingles: sorted distinct, as bytes)."""
    keys = nodes.select("h", "size", F.explode("bands").alias("k"))
    weight = F.greatest(F.count(F.lit(1)), F.ceil(F.sum("size") / WEIGHT)).alias("n")
    sizes = keys.groupBy("k").agg(F.count(F.lit(1)).alias("m"), weight).where("m > 1").drop("m")
    shared = materialize(keys.drop("size").join(sizes, "k"))
    sets = materialize(sets_of(shared.select("h").distinct()))
    small = shared.where(F.col("n") <= s.large).groupBy("k").agg(F.array_sort(F.collect_list("h")).alias("hs"))
    once = small.groupBy("hs").agg(F.min("k").alias("k")).select("k", F.explode("hs").alias("h"))
    links = materialize(_links(once.join(sets, "h").select("k", "h", "shingles"), s.threshold))
    hot = shared.where(F.col("n") > s.large)
    if not hot.isEmpty():
        rows = materialize(hot.join(sets, "h"))
        links = pivoted(rows, links, s)
        discard(rows)
    discard(shared)
    discard(sets)
    return links


def _links(buckets: DataFrame, threshold: float) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("h")
        h = table.column("h").to_numpy()
        pairs = similar([np.frombuffer(x.as_py(), "<u8") for x in table.column("shingles")], threshold)
        return pa.table({"a": pa.array([int(h[x]) for x, _ in pairs], pa.int64()), "b": pa.array([int(h[y]) for _, y in pairs], pa.int64())})

    return buckets.groupBy("k").applyInArrow(run, "a long, b long")


def pivoted(rows: DataFrame, links: DataFrame, s: Banding) -> DataFrame:
    """links with those within the buckets of rows(k, h, shingles, n), of any weight n, in tasks of `large` + `pivots` nodes.

    Each round some nodes of a bucket, its pivots, are compared with all others of it, dealt into chunks. Two unlinked
    components of a bucket can't both be its largest, so it is enough that every node outside the largest component has
    been a pivot once, which bounds the rounds. Near copies of one text are one component after the first round.
    """
    done = None
    while True:
        known = components(links)
        state = rows.select("k", "h").join(known, rows["h"] == known["node"], "left").select("k", "h", F.coalesce("component", "h").alias("root"))
        weight = state.groupBy("k", "root").agg(F.count(F.lit(1)).alias("m"))
        top = weight.groupBy("k").agg(F.max(F.struct("m", "root")).alias("top"))
        rest = state.join(top, "k").where(F.col("root") != F.col("top.root")).select("k", "h")
        rest = rest if done is None else rest.join(done, ["k", "h"], "left_anti")
        turn = F.row_number().over(Window.partitionBy("k").orderBy("h"))
        pivots = materialize(rest.withColumn("turn", turn).where(F.col("turn") <= s.pivots).select("k", "h"))
        if pivots.isEmpty():
            return links
        chunk_count = F.ceil(F.col("n") / s.large).cast("int")
        every = rows.join(state, ["k", "h"])
        asking = every.join(pivots, ["k", "h"]).withColumn("chunk", F.explode(F.sequence(F.lit(0), chunk_count - 1))).withColumn("pivot", F.lit(True))
        asked = every.withColumn("chunk", F.pmod(F.xxhash64("h"), chunk_count).cast("int")).withColumn("pivot", F.lit(False))
        columns = ["k", "chunk", "h", "root", "shingles", "pivot"]
        found = asking.select(columns).unionByName(asked.select(columns)).groupBy("k", "chunk").applyInArrow(_compared(s.threshold), "a long, b long")
        links = materialize(links.unionByName(found).distinct())
        done = pivots if done is None else materialize(done.unionByName(pivots))


def _compared(threshold: float) -> Callable[[pa.Table], pa.Table]:
    """Links from a chunk's pivots to its other nodes, one to each component of theirs."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("h", "ascending"), ("pivot", "ascending")])
        h, root, pivot = (table.column(c).to_numpy() for c in ("h", "root", "pivot"))
        sets = [np.frombuffer(x.as_py(), "<u8") for x in table.column("shingles")]
        sizes = np.array([len(x) for x in sets])
        _, local = np.unique(np.concatenate(sets), return_inverse=True)
        owner, offsets = np.repeat(np.arange(len(sets)), sizes), np.concatenate(([0], np.cumsum(sizes)))
        mark, a, b = np.zeros(local.max() + 1, bool), [], []
        for x in np.flatnonzero(pivot).tolist():
            mine = local[offsets[x] : offsets[x + 1]]
            mark[mine] = True
            both = np.bincount(owner[mark[local]], minlength=len(sets))
            mark[mine] = False
            near = np.flatnonzero((both >= threshold * (sizes + sizes[x] - both) - 1e-9) & (root != root[x]) & ~pivot)
            _, first = np.unique(root[near], return_index=True)
            a += [int(h[x])] * len(first)
            b += h[near[first]].tolist()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run
