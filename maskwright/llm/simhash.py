"""SimHash near-duplicates found by covering locality-sensitive hashing.

Fingerprint: words `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z, shingles of `shingle` words joined by a space, repeats
included (fewer words: the whole sequence), each hashed by XXH64 with seed 42; a bit is 1 if set in over half of the
hashes. Without words it is zero and linked like any other; null texts have no words.

Covering family for radius r: each bit i gets a nonzero vector phi(i) of r + 1 bits, and table v (nonzero, of r + 1
bits) keeps the bits with <phi(i), v> = 1. Any r bits have vectors orthogonal to some v, so two fingerprints that differ
in r bits or fewer agree on all that v keeps: every pair within the radius collides in some table.

Equal fingerprints are one node, so thousands of copies cost one row. A bucket of more than `large` nodes is dealt again
through a second family; together the two keep so many bits that a bucket of the second kind holds at most
2 ** (free bits) fingerprints, a bound that no input exceeds. Within a bucket a search visits nodes that are not reached
yet, so links between all different fingerprints are found but only a spanning forest of their components is emitted; in a
large bucket the partners of a node are looked up by flipping the few bits in which its members differ.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .kernels import LOWER, chunks, text_bytes
from .rows import add_columns, join_classes
from .store import materialize

BITS = 64


def covering_masks(radius: int, seed: int) -> list[int]:
    """2 ** (radius + 1) - 1 masks of 64 bits, phi dealt evenly over the nonzero vectors."""
    size = (1 << (radius + 1)) - 1
    phi = np.random.Generator(np.random.PCG64(seed)).permutation(np.arange(BITS) % size + 1)
    odd = lambda a, v: bin(int(a) & v).count("1") & 1
    return [sum(1 << i for i in range(BITS) if odd(phi[i], v)) for v in range(1, size + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _fingerprint(raw: bytes, shingle: int) -> int:
    words = raw.split()
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return h(b" ".join(words), 42)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    counts, total = np.zeros(BITS, np.int64), len(words) - shingle + 1
    for a in range(0, total, 1 << 16):
        b = min(total, a + (1 << 16))
        some = np.array([h(joined[s:e], 42) for s, e in zip((ends[a:b] - lengths[a:b]).tolist(), ends[a + shingle - 1 : b + shingle - 1].tolist(), strict=True)], np.uint64)
        bits = np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += np.add.reduce(bits, axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > total, bitorder="little").view(np.uint64)[0])


def fingerprints_of(data: np.ndarray, off: np.ndarray, i: int, j: int, shingle: int = 3) -> np.ndarray:
    """Of documents i..j-1 of bytes at offsets, signed."""
    low = LOWER[data[off[i] : off[j]]].tobytes()
    return np.array([_signed(_fingerprint(low[off[d] - off[i] : off[d + 1] - off[i]], shingle)) for d in range(i, j)], np.int64)


def fingerprints(docs: DataFrame, shingle: int = 3, text: str = "text") -> DataFrame:
    """docs with fingerprint, the 64 bits as a signed long."""

    def make(batch: pa.RecordBatch) -> list:
        data, off = text_bytes(batch.column(text))
        return [np.concatenate([np.zeros(0, np.int64), *(fingerprints_of(data, off, i, j, shingle) for i, j in chunks(off))])]

    return add_columns(docs, T.StructType([T.StructField("fingerprint", T.LongType())]), make)


def spanning_links(nodes: np.ndarray, radius: int, few: int = 1 << 13) -> tuple[np.ndarray, np.ndarray]:
    """A forest with the components of the graph that links values differing in `radius` bits or fewer."""
    free = [1 << i for i in range(BITS) if (int(np.bitwise_or.reduce(nodes ^ nodes[0])) >> i) & 1] if len(nodes) else []
    flips = [sum(c) for n in range(1, radius + 1) for c in combinations(free, n)] if len(nodes) > few and len(free) <= 24 else []
    if flips:
        return _by_flips(np.sort(nodes), np.array(flips, np.uint64))
    a, b, rest = [], [], nodes
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = np.bitwise_count(rest ^ x) <= radius
            if near.any():
                new = rest[near]
                a.append(np.full(len(new), x, np.uint64))
                b.append(new)
                queue.extend(new)
                rest = rest[~near]
    empty = np.zeros(0, np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (empty, empty)


def _by_flips(nodes: np.ndarray, flips: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for distinct sorted values, whose least of each component is linked to all others of it."""
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        for m in flips:
            at = np.searchsorted(nodes, nodes ^ m)
            at[at == len(nodes)] = 0
            x = np.flatnonzero(nodes[at] == nodes ^ m)  # a flip pairs nodes off, so each is written once
            label[x] = np.minimum(label[x], label[at[x]])
        label = label[label]
        if (label == before).all():
            others = np.flatnonzero(label != np.arange(len(nodes)))
            return nodes[label[others]], nodes[others]


def _links(buckets: DataFrame, radius: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("fps")
            values, off = lists.values.to_numpy(zero_copy_only=False).view(np.uint64), lists.offsets.to_numpy()
            found = [spanning_links(values[off[k] : off[k + 1]], radius) for k in range(len(lists))]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[s] for f in found]).view(np.int64)) for s in (0, 1)], names=["a", "b"])

    return buckets.mapInArrow(run, "a long, b long")


def _masked(nodes: DataFrame, masks: list[int], *held: str) -> DataFrame:
    """A row for each node and table: what the table's mask keeps of it."""
    table = F.explode(F.array(*(F.struct(F.lit(t).alias("t"), F.lit(_signed(m)).alias("m")) for t, m in enumerate(masks)))).alias("x")
    return nodes.select("*", table).select("fp", *held, F.col("x.t").alias("t"), F.col("fp").bitwiseAND(F.col("x.m")).alias("k"))


def near_links(nodes: DataFrame, radius: int = 3, large: int = 2048) -> DataFrame:
    """(a, b): a spanning forest, table by table, of all links among the distinct fingerprints nodes(fp)."""
    keys = _masked(nodes.select("fp"), covering_masks(radius, 1))
    sizes = keys.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = materialize(keys.join(sizes, ["t", "k"]))
    # sorted, so that a search finds the same whatever the order of arrival
    listed = F.array_sort(F.collect_list("fp")).alias("fps")
    small = shared.where(F.col("n") <= large).groupBy("t", "k").agg(listed).select("fps")
    hot = shared.where(F.col("n") > large).select("fp", F.col("t").alias("t1"), F.col("k").alias("k1"))
    again = _masked(hot, covering_masks(radius, 2), "t1", "k1").groupBy("t1", "k1", "t", "k").agg(listed).where("size(fps) > 1").select("fps")
    return _links(small.unionByName(again), radius)


def near_duplicates(docs: DataFrame, radius: int = 3, shingle: int = 3, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """(doc, fingerprint, component_id) for each row: 16 hex digits, and the smallest doc id reachable over links.

    Repeated rows give repeated rows. Rows with null ids take part as links; a component of such rows only has a null id.
    """
    prints = materialize(fingerprints(docs.select(doc, text), shingle, text).select(F.col(doc).alias("doc"), F.col("fingerprint").alias("fp")))
    nodes = prints.groupBy("fp").agg(F.min("doc").alias("least"), F.count(F.lit(1)).alias("n"))
    comp = components(near_links(nodes, radius))
    rooted = materialize(nodes.join(comp, nodes["fp"] == comp["node"], "left").select("fp", "n", "least", F.coalesce("component", "fp").alias("root")))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = materialize(rooted.join(least, "root").select("fp", "n", "component_id"))
    return join_classes(prints, classes, "fp", "n").select(F.col("doc").alias(doc), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
