"""Exact top-k inner products by distributed histogram selection.

Components become floor(scale * x), so scores are integers. For each query the k-th best score is located by histograms:
all rows are scored, each task counts its scores by bin (from the top down to its own k-th, as lower bins can't hold the
k-th best of all), counts are added up over tasks, and the bin that holds the k-th score is cut into bins of its own,
until bins are one score wide. Then a last scoring emits what lies above the k-th score, and of each task's ties the
smallest ids; ranks order both. Every count is over all rows; nothing is sampled or approximated.

Queries are taken in chunks of at most `chunk` rows and `chunk_bytes`, each broadcast and carried through all rounds;
vectors stay where they are, packed in blocks, and are never shuffled. Vectors that are null or hold null or non-finite
components, and rows with null ids, take no part. Shorter vectors count as padded with zeros. Repeated rows are rows of
their own. Components or scores that 64 bits can't hold raise an OverflowError.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import materialize, prepare

BLOCK, BINS, QUERY_ROWS = 4096, 64, 256
_EXACT = float(1 << 53)


def _integers(values: np.ndarray, scale: int) -> np.ndarray:
    out = np.floor(scale * values)
    if len(out) and np.abs(out).max() >= 2.0**62:
        raise OverflowError("a component is beyond 64 bits")
    return out.astype(np.int64)


def vector_blocks(vectors: DataFrame, scale: int, id_col: str, vector: str) -> DataFrame:
    """(block, n, width, top, ids, matrix): rows packed as little-endian longs; top is the largest norm squared."""
    prepare(vectors.sparkSession)

    def packed(block: int, ids: list[int], rows: list[np.ndarray]) -> pa.RecordBatch:
        width = max(map(len, rows))
        m = np.zeros((len(rows), width), "<i8")
        for k, r in enumerate(rows):
            m[k, : len(r)] = r
        top = float((m.astype(float) ** 2).sum(axis=1).max()) if width else 0.0
        return pa.RecordBatch.from_pydict({"block": [block], "n": [len(rows)], "width": [width], "top": [top], "ids": [np.array(ids, "<i8").tobytes()], "matrix": [m.tobytes()]}, schema=pa.schema([("block", pa.int64()), ("n", pa.int64()), ("width", pa.int64()), ("top", pa.float64()), ("ids", pa.binary()), ("matrix", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, rows = TaskContext.get().partitionId() << 32, [], []
        for batch in batches:
            for i, v in zip(batch.column(0), batch.column(1), strict=True):
                if i.is_valid and v.is_valid and not v.values.null_count and np.isfinite(x := v.values.to_numpy(zero_copy_only=False).astype(float)).all():
                    ids.append(i.as_py())
                    rows.append(_integers(x, scale))
                    if len(rows) == BLOCK:
                        yield packed(block, ids, rows)
                        block, ids, rows = block + 1, [], []
        if rows:
            yield packed(block, ids, rows)

    return materialize(vectors.select(F.col(id_col).cast("long"), vector).mapInArrow(run, "block long, n long, width long, top double, ids binary, matrix binary"))


def _unpacked(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for block, n, width, ids, m in zip(*(batch.column(c).to_pylist() for c in ("block", "n", "width", "ids", "matrix")), strict=True):
        yield block, np.frombuffer(ids, "<i8"), np.frombuffer(m, "<i8").reshape(n, width)


class Queries:
    """A chunk of queries with what is known of each one's k-th score: it is at most high, and `above` scores exceed high."""

    def __init__(self, rows: list, top: float):
        width = max((r["width"] for r in rows), default=0)
        self.matrix = np.zeros((len(rows), width), np.int64)
        for k, r in enumerate(rows):
            self.matrix[k, : r["width"]] = np.frombuffer(r["vector"], "<i8")
        self.ids = np.array([r["id"] for r in rows], np.int64)
        self.blocks = np.array([r["block"] for r in rows], np.int64)
        self.places = np.array([r["place"] for r in rows], np.int64)
        reach = np.ceil(np.sqrt((self.matrix.astype(float) ** 2).sum(axis=1)) * np.sqrt(top)) + 1
        self.exact = bool((reach < _EXACT / 4).all())
        if len(rows) and reach.max() >= 2.0**62:
            raise OverflowError("a score may be beyond 64 bits")
        reach = reach.astype(np.int64)
        self.high = reach
        self.step = np.maximum(1, -(-2 * (reach + 1) // BINS))
        self.above = np.zeros(len(rows), np.int64)
        self.open = np.ones(len(rows), bool)  #: the k-th score isn't known yet
        self.all = np.zeros(len(rows), bool)  #: fewer than k candidates

    def scores(self, block: int, vectors: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """By some queries at a time: their scores, and which of those are the query's own row."""
        width = min(self.matrix.shape[1], vectors.shape[1])
        kind = np.float64 if self.exact else np.int64
        right = vectors[:, :width].astype(kind).T
        for a in range(0, len(self.ids), QUERY_ROWS):
            part = slice(a, a + QUERY_ROWS)
            s = (self.matrix[part, :width].astype(kind) @ right).astype(np.int64)
            own = np.zeros(s.shape, bool)
            mine = np.flatnonzero(self.blocks[part] == block)
            own[mine, self.places[part][mine]] = True
            yield part, s, own


def _histograms(blocks: DataFrame, shared, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        counts = np.zeros((len(q.ids), BINS + 2), np.int32)
        for batch in batches:
            for block, _, vectors in _unpacked(batch):
                for part, s, own in q.scores(block, vectors):
                    high, step = q.high[part, None], q.step[part, None]
                    bins = np.clip((high - s) // step, -1, BINS) + 1  # 0: above, BINS + 1: below
                    bins[own] = BINS + 1
                    bins += np.arange(len(s))[:, None] * (BINS + 2)
                    counts[part] += np.bincount(bins.ravel(), minlength=len(s) * (BINS + 2)).reshape(len(s), -1).astype(np.int32)
        inner = counts[:, 1:-1]
        wanted = (inner > 0) & (q.above[:, None] + np.cumsum(inner, axis=1) - inner < k) & q.open[:, None]
        at, bin_ = np.nonzero(wanted)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(bin_), pa.array(inner[wanted].astype(np.int64))], names=["q", "bin", "n"])

    return blocks.mapInArrow(run, "q long, bin long, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))


def _winners(blocks: DataFrame, shared, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        ties: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, ids, vectors in _unpacked(batch):
                for part, s, own in q.scores(block, vectors):
                    high = q.high[part, None]
                    take = ((s > high) | q.all[part, None]) & ~own
                    row, col = np.nonzero(take)
                    yield _rows(q, row + part.start, ids[col], s[row, col])
                    row, col = np.nonzero((s == high) & ~own & ~q.all[part, None])
                    for r in np.unique(row).tolist():
                        some = np.concatenate((ties.get(r + part.start, np.zeros(0, np.int64)), ids[col[row == r]]))
                        ties[r + part.start] = np.sort(some)[: k - int(q.above[r + part.start])]
        if ties:
            at = np.concatenate([np.full(len(v), r) for r, v in ties.items()])
            yield _rows(q, at, np.concatenate(list(ties.values())), q.high[at])

    return blocks.mapInArrow(run, "q long, query_id long, vec_id long, score long")


def _rows(q: Queries, at: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(q.ids[at]), pa.array(ids), pa.array(scores)], names=["q", "query_id", "vec_id", "score"])


def exact_top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64, id_col: str = "vec_id", vector: str = "embedding", chunk: int = 16_384, chunk_bytes: int = 64 << 20) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows whose id is divisible by `every`, against every row but the query's own."""
    spark = vectors.sparkSession
    blocks = vector_blocks(vectors, scale, id_col, vector)

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, ids, m in _unpacked(batch):
                at = np.flatnonzero(ids % every == 0)
                yield pa.RecordBatch.from_pydict({"block": [block] * len(at), "place": at, "id": ids[at], "width": [m.shape[1]] * len(at), "vector": [m[a].tobytes() for a in at]}, schema=pa.schema([("block", pa.int64()), ("place", pa.int64()), ("id", pa.int64()), ("width", pa.int64()), ("vector", pa.binary())]))

    asked = materialize(blocks.mapInArrow(chosen, "block long, place long, id long, width long, vector binary"))
    top, width = blocks.agg(F.coalesce(F.max("top"), F.lit(0.0)), F.coalesce(F.max("width"), F.lit(0))).first()
    n = asked.count()
    parts = max(1, -(-n // max(1, min(chunk, chunk_bytes // (8 * max(1, width))))))
    results = []
    for c in range(parts):
        mine = asked if parts == 1 else asked.where(F.pmod(F.xxhash64("block", "place"), F.lit(parts)) == c)
        q = Queries(mine.collect(), top)
        while q.open.any():
            shared = spark.sparkContext.broadcast(q)
            found = _histograms(blocks, shared, k)
            order = Window.partitionBy("q").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
            located = found.withColumn("upto", F.sum("n").over(order)).toPandas()
            _refine(q, located, k)
            shared.unpersist()
        shared = spark.sparkContext.broadcast(q)
        winners = _winners(blocks, shared, k)
        order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc("vec_id"))
        ranked = winners.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        results.append(ranked if parts == 1 else materialize(ranked))
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out


def _refine(q: Queries, located, k: int) -> None:
    """Narrows each open query to the bin in which its count reaches k; one without such a bin has fewer candidates than k."""
    hit = located[located["upto"] + q.above[located["q"].to_numpy()] >= k].sort_values(["q", "bin"]).drop_duplicates("q")
    at, b = hit["q"].to_numpy(), hit["bin"].to_numpy()
    lacking = q.open.copy()
    lacking[at] = False
    q.all[lacking], q.open[lacking] = True, False
    q.above[at] += (hit["upto"] - hit["n"]).to_numpy()
    q.high[at] -= b * q.step[at]
    done = at[q.step[at] == 1]
    q.open[done] = False
    more = at[q.step[at] > 1]
    q.step[more] = np.maximum(1, -(-q.step[more] // BINS))
