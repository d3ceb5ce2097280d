"""Near-duplicate documents by the exact Jaccard similarity of their word shingles.

Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z; a document is the set of its runs of `shingle` words, or with fewer
words its whole sequence. Documents of equal sequences are one node, so thousands of copies cost one row each and nothing
more. Candidates are found by operator 7: SimHash fingerprints that differ in `radius` bits or fewer, by covering LSH, so no
such pair is missed. A pair at the threshold may differ in more bits, so nodes that share a band of their MinHash
signature, tuned for the recall there, are candidates too. Every link is verified by the sets themselves. Shingles are
compared by 64-bit hashes.

Null and empty texts are without words, and equal to each other. Every row is a document, whatever its id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .components import components
from .kernels import NOT_SPACE, Words, _powers, mix, windows
from .rows import join_classes
from .similar import Banding, band_keys, bitmap, marked, units, verified_links
from .store import keyed, materialize, prepare


class Shingled:
    """Shingle hashes of documents i..j-1, document by document, repeats included; `off` are their bounds."""

    def __init__(self, data: np.ndarray, off: np.ndarray, i: int, j: int, s: Banding):
        w = Words(data, off, i, j, NOT_SPACE)
        n = np.diff(w.first)
        self.sizes = np.where(n >= s.shingle, n - s.shingle + 1, np.minimum(n, 1))
        self.off = np.concatenate(([0], np.cumsum(self.sizes)))
        at = np.arange(self.off[-1]) - np.repeat(self.off[:-1] - w.first[:-1], self.sizes)
        self.values = np.append(windows(w.hashes, s.shingle), np.zeros(s.shingle, np.uint64))[at]
        for k in range(1, s.shingle):
            short = np.flatnonzero(n == k)
            if len(short):
                self.values[self.off[short]] = mix(windows(w.hashes, k)[w.first[short]] + np.uint64(k))

    def hashes(self) -> np.ndarray:
        """Of the whole sequences; 0 without words."""
        power, inverse = _powers(len(self.values) + 1)
        total = np.zeros(len(self.values) + 1, np.uint64)
        np.cumsum(self.values * power[: len(self.values)], out=total[1:])
        a, b = self.off[:-1], self.off[1:]
        return np.where(b > a, mix((total[b] - total[a]) * inverse[a] + (b - a).astype(np.uint64)), np.uint64(0))


def _signatures(docs: DataFrame, s: Banding) -> DataFrame:
    """(doc, h, size, bands, fp) per document, fp being its SimHash fingerprint."""
    count = s.bands[0]

    def make(ids, i, data, off, j):
        d = Shingled(data, off, i, j, s)
        bounds = np.concatenate(([0], np.cumsum(d.sizes > 0))) * count
        keys = band_keys(d.values, d.off[:-1][d.sizes > 0], 1, s)
        lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(keys.ravel().view(np.int64)))
        prints = pa.array(simhash.fingerprints_of(data, off, i, j))
        return pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(d.hashes().view(np.int64)), pa.array(d.sizes.astype(np.int64)), lists, prints], names=["doc", "h", "size", "bands", "fp"])

    return units(docs, f"doc {docs.schema['doc'].dataType.simpleString()}, h long, size long, bands array<long>, fp long", make)


def _with_classes(nodes: DataFrame, radius: int) -> DataFrame:
    """nodes(h, size, bands) with one more band for those whose fingerprint others reach within `radius` bits: they meet whole, as operator 7 has them."""
    linked = components(simhash.near_links(nodes.where("size > 0").select("fp").distinct(), radius))
    class_ = F.xxhash64("component", F.lit("simhash"))
    # equal fingerprints of different sequences meet too
    joined = nodes.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    return joined.select("h", "size", F.when(F.col("size") > 0, F.concat("bands", F.array(class_))).otherwise(F.col("bands")).alias("bands"))


def _sets(docs: DataFrame, wanted: DataFrame, s: Banding) -> DataFrame:
    """(h, shingles) of the nodes in wanted(h). A bitmap spares most others the shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(wanted))

    def make(ids, i, data, off, j):
        d = Shingled(data, off, i, j, s)
        h = d.hashes().view(np.int64)
        take = marked(shared.value, h)
        _, first = np.unique(h[take], return_index=True)
        take = take[np.sort(first)]
        shingles = [np.unique(d.values[d.off[k] : d.off[k + 1]]).astype("<u8").tobytes() for k in take.tolist()]
        return pa.RecordBatch.from_arrays([pa.array(h[take]), pa.array(shingles, pa.binary())], names=["h", "shingles"])

    found = units(docs, "h long, shingles binary", make)
    return found.join(wanted, "h", "left_semi").groupBy("h").agg(F.any_value("shingles").alias("shingles"))


def _rooted(docs: DataFrame, s: Banding) -> tuple[DataFrame, DataFrame]:
    """docs(doc, text) -> (doc, h) per row, and (h, n, least, root) per node: its rows, the least of them, its component."""
    rows = materialize(_signatures(docs, s))
    nodes = materialize(rows.groupBy("h").agg(F.any_value("size").alias("size"), F.any_value("bands").alias("bands"), F.any_value("fp").alias("fp"), F.min("doc").alias("least"), F.count(F.lit(1)).alias("n")))
    linked = components(verified_links(_with_classes(nodes, s.radius), lambda wanted: _sets(docs, wanted, s), s))
    rooted = nodes.join(linked, nodes["h"] == linked["node"], "left").select("h", "n", "least", F.coalesce("component", "h").alias("root"))
    return rows.select("doc", "h"), materialize(rooted)


def near_duplicates(docs: DataFrame, settings: Banding | None = None, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """(doc, component_id) for each row: the smallest doc id reachable over links; null where all of a component are."""
    prepare(docs.sparkSession)
    rows, rooted = _rooted(docs.select(F.col(doc).alias("doc"), F.col(text).alias("text")), settings or Banding())
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = materialize(rooted.join(least, "root").select("h", "n", "component_id"))
    return join_classes(rows, classes, "h", "n").select(F.col("doc").alias(doc), "component_id")


def distinct_documents(docs: DataFrame, settings: Banding | None = None, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """docs with one row of each component: that of the smallest id, rows without an id last, of equal ids the first stored.

    Decided by row, so rows that share an id stay or go each for its own text. Texts are dealt once, by row.
    """
    prepare(docs.sparkSession)
    rows = keyed(docs)
    row = F.struct(F.col(doc).isNull().alias("nameless"), F.col(doc).alias("id"), "_mw_file", "_mw_row")
    _, rooted = _rooted(rows.select(row.alias("doc"), F.col(text).alias("text")), settings or Banding())
    kept = rooted.groupBy("root").agg(F.min("least").alias("kept")).select("kept._mw_file", "kept._mw_row")
    return rows.join(kept, ["_mw_file", "_mw_row"], "left_semi").select(*docs.columns)
