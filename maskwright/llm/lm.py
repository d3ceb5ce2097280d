"""Language-model scoring by a weighted backoff automaton.

Tokens are words `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z, and one end token a text, which also stands before a text's
first word. Every n-gram of the training texts is in the model: none is cut by count, share or size of the corpus. An n-gram
shorter than `order` is a state; arcs leave it for the words seen after it, and a failure arc with a weight leads to the
state of its suffix. The empty state has an arc for every word, unknown ones included. Probabilities are smoothed towards the
suffix, p(w | h) = (n(hw) + mu * p(w | suffix of h)) / (n(h) + mu), those of the empty state additively, so every state's
arcs and failures are a distribution. A text is read once from left to right: the state is carried from token to token, and
a token without an arc follows failure arcs, whose weights are added, until there is one.

Counts live in tables that grow with the corpus, and nothing of them is broadcast. Texts are packed into blocks of about
`block_tokens` tokens, stored with their keys. A block hands each n-gram it holds, once, with its count among the block's
training texts, to the task of the n-gram's key range; that one adds up over all blocks and returns the totals. So a block
gets the part of the automaton that its texts can reach, however large the whole is, and a frequent n-gram costs a task one
number a block. Many pieces of texts are walked at once: a piece starts `order` - 1 tokens early, after which its state is
that of the whole text, as no state is longer.

N-grams are compared by 64-bit hashes. Null texts are empty (one end token); repeated rows are scored each; a text longer
than a block is a block of its own. Without training texts all counts are zero.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernels import NOT_SPACE, Words, chunks, text_bytes, windows
from .store import materialize, prepare

END = np.uint64(0x1F83D9ABFB41BD6B)  #: the end token's hash
PIECE = 256  #: tokens that a lane of the traversal reads


@dataclass(frozen=True)
class Settings:
    order: int = 2
    smoothing: float = 0.1  #: added to a word's count in the empty state
    mu: tuple[float, ...] = (160.0, 10.0)  #: weight of the suffix's distribution, for states of 1, 2, ... words
    block_tokens: int = 1_000_000
    range_keys: int = 2_000_000  #: n-grams of one order that a task adds up at once, about


def pack(values: np.ndarray) -> bytes:
    """Whole numbers, compressed byte place by byte place: small ones cost little."""
    return pa.compress(np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes(), codec="zstd", asbytes=True) if len(values) else b""


def unpack(blob: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.uint64)
    raw = np.frombuffer(pa.decompress(blob, decompressed_size=8 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, n).T).view("<u8").ravel()


@dataclass
class Tokens:
    """Token hashes of some texts: an end token, then each text's words and end token. Places count from a text's first token."""

    hashes: np.ndarray
    doc: np.ndarray  #: -1 for the end token that comes before all texts
    place: np.ndarray


def tokens(column: pa.Array) -> Tokens:
    data, off = text_bytes(column)
    hashes, doc = [np.array([END])], [np.array([-1])]
    for i, j in chunks(off):
        w = Words(data, off, i, j, NOT_SPACE)
        h = np.full(len(w) + j - i, END)
        h[np.arange(len(w)) + w.doc] = w.hashes
        hashes.append(h)
        doc.append(np.repeat(np.arange(i, j), np.diff(w.first) + 1))
    d = np.concatenate(doc)
    starts = np.searchsorted(d, np.arange(len(column)))
    return Tokens(np.concatenate(hashes), d, np.arange(len(d)) - np.concatenate(([0], starts))[d + 1])


@dataclass
class Grams:
    """The distinct n-grams of one order, sorted by key, and which of them ends at each token (-1: none of this order does)."""

    keys: np.ndarray
    at: np.ndarray

    def last(self) -> np.ndarray:
        """A token at which each n-gram ends."""
        out = np.zeros(len(self.keys), np.int64)
        some = np.flatnonzero(self.at >= 0)
        out[self.at[some]] = some
        return out


def grams(t: Tokens, order: int) -> list[Grams]:
    """N-grams of 1..order tokens. The history may begin with the end token before a text but not further back."""
    out = []
    for n in range(1, order + 1):
        whole = np.flatnonzero((t.place >= n - 2) & (t.doc >= 0)) if n > 1 else np.arange(len(t.hashes))
        hashes = t.hashes if n == 1 else windows(t.hashes, n)[whole - n + 1]
        at = np.full(len(t.hashes), -1, np.int64)
        keys, at[whole] = np.unique(hashes, return_inverse=True)
        out.append(Grams(keys, at))
    return out


class Automaton:
    """What texts can reach of the whole automaton: states are numbered from 0, the empty one; counts are of the whole corpus."""

    def __init__(self, some: list[Grams], counts: list[np.ndarray], total: int, distinct: int, s: Settings):
        words = some[0]
        self.words, self.start = len(words.keys), 0
        p = [(counts[0] + s.smoothing) / (total + s.smoothing * (distinct + 1))]
        self.base = np.log10(p[0])
        states, size = [], 1
        for n in range(1, s.order):  # an n-gram is a state if it was seen
            known = counts[n - 1] > 0
            states.append(np.where(known, size + np.cumsum(known) - 1, 0))
            size += int(known.sum())
        self.fail, self.weight = np.zeros(size, np.int64), np.zeros(size)
        self.first = states[0] if states else np.zeros(self.words, np.int64)  #: where the empty state's arcs lead
        arcs, logs, targets = [], [], []
        for n in range(2, s.order + 1):
            g, mu = some[n - 1], s.mu[n - 2]
            seen = np.flatnonzero(counts[n - 1] > 0)
            end = g.last()
            history, suffix = some[n - 2].at[end - 1], some[n - 2].at[end]
            of = counts[n - 2][history]
            p.append((counts[n - 1] + mu * p[-1][suffix]) / (of + mu))
            arcs.append(states[n - 2][history[seen]] * self.words + words.at[end[seen]])
            logs.append(np.log10(p[-1][seen]))
            targets.append((states[n - 1] if n < s.order else states[n - 2][suffix])[seen])
            if n < s.order:
                self.fail[states[n - 1][seen]] = states[n - 2][suffix[seen]]
            from_ = np.flatnonzero(counts[n - 2] > 0)
            self.weight[states[n - 2][from_]] = np.log10(mu / (counts[n - 2][from_] + mu))
        keys = np.concatenate(arcs) if arcs else np.zeros(0, np.int64)
        by = np.argsort(keys)
        self.arcs = keys[by]
        self.logs, self.targets = (np.concatenate(x)[by] if arcs else np.zeros(0, k) for x, k in ((logs, float), (targets, np.int64)))
        if END in words.keys:
            self.start = int(self.first[np.searchsorted(words.keys, END)])

    def walk(self, t: Tokens, word: np.ndarray, order: int) -> np.ndarray:
        """log10 of each token's probability, 0 for the end token before all texts."""
        n, early = len(word), order - 1
        out = np.zeros(n)
        begin = np.arange(1, n, PIECE)
        state = np.zeros(len(begin), np.int64)
        for step in range(-early, min(PIECE, max(n - 1, 0))):
            at = begin + step
            lanes = np.flatnonzero((at >= 1) & (at < n))
            at = at[lanes]
            here, w = np.where(t.place[at] == 0, self.start, state[lanes]), word[at]
            log, open_ = np.zeros(len(at)), np.arange(len(at))
            while len(open_):
                inner = open_[here[open_] > 0]
                empty = open_[here[open_] == 0]
                log[empty] += self.base[w[empty]]
                here[empty] = self.first[w[empty]]
                found = _find(self.arcs, here[inner] * self.words + w[inner])
                taken, failed = inner[found >= 0], inner[found < 0]
                log[taken] += self.logs[found[found >= 0]]
                here[taken] = self.targets[found[found >= 0]]
                log[failed] += self.weight[here[failed]]
                here[failed] = self.fail[here[failed]]
                open_ = failed
            state[lanes] = here
            if step >= 0:
                out[at] = log
        return out


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of wanted in sorted keys, or -1."""
    if not len(keys):
        return np.full(len(wanted), -1, np.int64)
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return np.where(keys[at] == wanted, at, -1)


def _blocks(docs: DataFrame, s: Settings) -> DataFrame:
    """docs(doc, text, learn) -> (block, n_tokens, docs, learn, sizes, texts): texts packed and compressed, stored."""
    kind = docs.schema["doc"].dataType
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("docs", T.ArrayType(kind)), T.StructField("learn", T.BinaryType()), T.StructField("sizes", T.BinaryType()), T.StructField("texts", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, size = TaskContext.get().partitionId() << 32, [], 0

        def packed() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            ids = table.column("doc").combine_chunks()
            data, off = text_bytes(table.column("text"))
            sizes, raw = np.diff(off), data[off[0] : off[-1]].tobytes()
            learn = np.asarray(table.column("learn").fill_null(False).to_numpy(zero_copy_only=False), np.uint8).tobytes()
            n = sum(len(Words(data, off, i, j, NOT_SPACE, hashed=False)) for i, j in chunks(off)) + len(sizes)
            lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([n]), lists, pa.array([learn]), pa.array([pack(sizes)]), pa.array([pa.compress(raw, codec="zstd", asbytes=True)])], names=schema.names)

        for batch in batches:
            data, off = text_bytes(batch.column("text"))
            # a word and its separator are 6 bytes, about
            for i, j in chunks(off, 6 * s.block_tokens):
                if held and size + off[j] - off[i] > 6 * s.block_tokens:
                    yield packed()
                    block, held, size = block + 1, [], 0
                held.append(batch.slice(i, j - i))
                size += int(off[j] - off[i])
        if held:
            yield packed()

    return materialize(docs.select("doc", "text", "learn").mapInArrow(run, schema))


def _texts(row: dict) -> tuple[pa.Array, np.ndarray]:
    """The texts of a stored block, and whether each is for training."""
    learn = np.frombuffer(row["learn"], np.uint8).astype(bool)
    off = np.concatenate(([0], np.cumsum(unpack(row["sizes"], len(learn)).astype(np.int64))))
    raw = pa.decompress(row["texts"], decompressed_size=int(off[-1]), codec="zstd") if off[-1] else pa.py_buffer(b"")
    return pa.Array.from_buffers(pa.large_string(), len(learn), [None, pa.py_buffer(off), raw]), learn


def _offered(blocks: DataFrame, ranges: int, s: Settings) -> DataFrame:
    """(n, part, block, m, keys, counts): each block's distinct n-grams by order and key range, with their training counts there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                texts, learn = _texts(row)
                t = tokens(texts)
                counted = np.append(learn, False)[t.doc]  # the last: the end token before all texts
                out: dict[str, list] = {c: [] for c in ("n", "part", "block", "m", "keys", "counts")}
                for n, g in enumerate(grams(t, s.order), 1):
                    counts = np.bincount(g.at[counted & (g.at >= 0)], minlength=len(g.keys))
                    cut = np.searchsorted(g.keys, _bounds(ranges)).tolist()
                    for part, (a, b) in enumerate(zip([0, *cut], [*cut, len(g.keys)], strict=True)):
                        if b > a:
                            values = (n, part, row["block"], b - a, pack(np.diff(g.keys[a:b], prepend=np.uint64(0))), pack(counts[a:b]))
                            for column, v in zip(out.values(), values, strict=True):
                                column.append(v)
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("n", pa.int32()), ("part", pa.int64()), ("block", pa.int64()), ("m", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())]))

    return blocks.mapInArrow(run, "n int, part long, block long, m long, keys binary, counts binary")


def _bounds(ranges: int) -> np.ndarray:
    """Keys that separate `ranges` equal ranges."""
    return np.array([(k << 64) // ranges for k in range(1, ranges)], np.uint64)


def _added(table: pa.Table) -> pa.Table:
    """Totals over all blocks of one order's n-grams in one key range, in the order in which each block offered them."""
    n, part, block, m = (table.column(c).to_numpy() for c in ("n", "part", "block", "m"))
    keys = np.concatenate([np.cumsum(unpack(x.as_py(), k)) for x, k in zip(table.column("keys"), m.tolist(), strict=True)])
    counts = np.concatenate([unpack(x.as_py(), k) for x, k in zip(table.column("counts"), m.tolist(), strict=True)])
    distinct, at = np.unique(keys, return_inverse=True)
    totals = np.bincount(at, counts.astype(float), minlength=len(distinct)).astype(np.int64)
    mine, off = totals[at], np.concatenate(([0], np.cumsum(m)))
    blobs = [pack(mine[a:b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
    only = np.zeros((2, len(m)), np.int64)  # the range's own sums, on one of its rows
    only[:, 0] = totals.sum(), (totals > 0).sum()
    return pa.table({"n": n, "part": part, "block": block, "m": m, "totals": pa.array(blobs, pa.binary()), "seen": only[0], "kinds": only[1]})


SCORES = [("learn", T.BooleanType(), pa.bool_()), ("n_tokens", T.LongType(), pa.int64()), ("n_known", T.LongType(), pa.int64()), ("train_tokens", T.LongType(), pa.int64()), ("base_score", T.DoubleType(), pa.float64()), ("score", T.DoubleType(), pa.float64())]


def score(docs: DataFrame, learn: Column, settings: Settings | None = None, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """(doc, learn, n_tokens, n_known, train_tokens, base_score, score) for each row; the model is that of all rows where `learn` holds.

    base_score sums the empty state's log-probabilities, score those of the traversal. To score texts by a model of others,
    unite both with `learn` true for those others.
    """
    s = settings or Settings()
    prepare(docs.sparkSession)
    blocks = _blocks(docs.select(F.col(doc).alias("doc"), F.col(text).alias("text"), F.coalesce(learn, F.lit(False)).alias("learn")), s)
    count, n_tokens = blocks.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    ranges = max(1, -(-n_tokens // s.range_keys))
    deal = lambda df, count, *keys: df.repartition(max(count, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)
    offered = deal(_offered(blocks, ranges, s), ranges * s.order, "n", "part")
    added = offered.groupBy("n", "part").applyInArrow(_added, "n int, part long, block long, m long, totals binary, seen long, kinds long")
    totals = materialize(added)
    total, distinct = totals.where("n = 1").agg(F.coalesce(F.sum("seen"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
    schema = T.StructType([T.StructField("doc", docs.schema[doc].dataType), *(T.StructField(n, t) for n, t, _ in SCORES)])

    def scored(block: pa.Table, answers: pa.Table) -> pa.Table:
        row = block.select(["learn", "sizes", "texts"]).to_pylist()[0]
        texts, learn = _texts(row)
        t = tokens(texts)
        some = grams(t, s.order)
        answers = answers.sort_by([("n", "ascending"), ("part", "ascending")])
        of, blobs = answers.column("n").to_numpy(), [unpack(x.as_py(), k) for x, k in zip(answers.column("totals"), answers.column("m").to_pylist(), strict=True)]
        counts = [np.concatenate([np.zeros(0, np.uint64), *(b for b, k in zip(blobs, of.tolist(), strict=True) if k == n)]).astype(np.int64) for n in range(1, s.order + 1)]
        model = Automaton(some, counts, total, distinct, s)
        word, own = some[0].at, t.doc >= 0
        sums = [np.bincount(t.doc[own], x[own], minlength=len(learn)) for x in (np.ones(len(word)), (counts[0][word] > 0).astype(float), model.base[word], model.walk(t, word, s.order))]
        n, known, base, walked = sums
        columns = [learn, n.astype(np.int64), known.astype(np.int64), np.full(len(learn), total), base, walked]
        ids = block.column("docs").combine_chunks()
        ids = ids.chunk(0).flatten() if isinstance(ids, pa.ChunkedArray) else ids.flatten()
        return pa.table([ids, *(pa.array(c, k[2]) for c, k in zip(columns, SCORES, strict=True))], names=schema.names)

    left, right = (deal(x, count, "block").groupBy("block") for x in (blocks, totals))
    result = left.cogroup(right).applyInArrow(scored, schema)
    return result.withColumnRenamed("doc", doc)
