"""Best-fit packing by sum of squares over tokenised documents.

A document's tokens are its ids by a fixed tokenizer and one end id. Documents longer than a sequence are cut into
full pieces and a rest; full pieces are sequences of their own. Every other piece goes where the sum over gaps of
(number of open bins with that gap) squared becomes smallest, a new bin being one of the places; of equal places the
one that leaves the smallest gap wins. Pieces are taken from the longest on; the shortest, which fill what is left, come last
and shuffled, as equal ones in a row would leave equal gaps behind.

Only lengths are packed, never texts or ids. Pieces are dealt at random (by a stored salt, so that copies of a row do not
meet) into shards of about `shard_rows`; each shard's bins are its own. A shard leaves a handful of bins open, so the
number of sequences stays within some per mille of the least possible whatever the input's size.
"""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer, pre_tokenizers

from .store import materialize, prepare

CACHE_WORDS = 300_000
_ENCODERS: dict[int, Encoder] = {}
_LATIN = "\u0250"  #: below it, letters are composed already and have one lower form each


class Encoder(dict):
    """Ids by word, as little-endian unsigned 32-bit bytes; a dict that works out what it lacks.

    A tokenizer that drops white space gives a text the ids of its words. Where its definition is the kind known here
    (NFC, lower case, split by an expression, byte-level BPE), a printable word of Latin letters, digits and signs is
    lowered and split here, and only its parts go to the BPE model; most new words are made
    of known parts. Any other word, and any word that holds a special token, goes to the tokenizer whole.
    """

    def __init__(self, definition: str):
        super().__init__({"": b""})
        self.tokenizer = Tokenizer.from_str(definition)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        marks = "|".join(map(regex.escape, special))
        self.holds_special = regex.compile(marks).search if marks else lambda _: None
        self.parts = self._splitter(json.loads(definition))
        chars = sorted(pre_tokenizers.ByteLevel.alphabet())
        visible = [b for b in range(256) if chr(b) in chars]
        self.bytes_to_chars = {b: chr(b) for b in visible} | dict(zip([b for b in range(256) if b not in visible], [c for c in chars if ord(c) > 255], strict=True))

    @staticmethod
    def _splitter(d: dict) -> regex.Pattern | None:
        normal, pre = d.get("normalizer") or {}, d.get("pre_tokenizer") or {}
        kinds = [x["type"] for x in normal.get("normalizers", [])], [x["type"] for x in pre.get("pretokenizers", [])]
        if kinds != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) or d["model"]["type"] != "BPE":
            return None
        split, level = pre["pretokenizers"]
        plain = split["behavior"] == "Removed" and split["invert"] and not level["add_prefix_space"] and not level["use_regex"]
        return regex.compile(split["pattern"]["Regex"]) if plain and "Regex" in split["pattern"] else None

    def __missing__(self, word: str) -> bytes:
        if self.parts is None or max(word) >= _LATIN or "\u0130" in word or not word.isprintable() or self.holds_special(word):
            out = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        else:
            low = word.lower()
            parts = [low] if low.isalpha() else self.parts.findall(low)
            if parts != [word]:
                out = b"".join([self[p] for p in parts])
            else:
                ids = [t.id for t in self.tokenizer.model.tokenize(word.encode().decode("latin-1").translate(self.bytes_to_chars))]
                out = struct.pack(f"<{len(ids)}I", *ids)
        if len(self) > CACHE_WORDS:
            self.clear()
            self[""] = b""
        self[word] = out
        return out

    def encode(self, text: str) -> bytes:
        if self.parts is not None:
            text = self._plainer(text)
        return b"".join(map(self.__getitem__, text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")))

    def _plainer(self, text: str) -> str:
        """A text of the same ids with fewer different words: ASCII is lowered, and a sign after a Latin letter stands alone.

        Not after a letter whose lower form ends in a mark, which joins the sign.
        """
        if text.isascii() and not self.holds_special(low := text.lower()):
            text = low
        for stop in (", ", ". ", ".\n"):
            pieces = text.split(stop)
            if all(p[-1:].isalpha() and p[-1] < _LATIN and p[-1] != "\u0130" for p in pieces[:-1]):
                text = f" {stop}".join(pieces)
        return text


def _encoder(definition: str) -> Encoder:
    key = zlib.crc32(definition.encode())
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(definition)
    return _ENCODERS[key]


def pieces(docs: DataFrame, tokenizer_path: str, size: int = 4096, end_id: int = 1, text: str = "text", doc: str = "doc_id", keep_ids: bool = False) -> DataFrame:
    """(doc, piece, start, length, ids_crc32, salt[, ids]) per piece; salts differ. Null text is empty: it has the end id only.

    The tokenizer's file is read on the driver and broadcast (a vocabulary: its size is fixed).
    """
    prepare(docs.sparkSession)
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    longs = ["piece", "start", "length", "ids_crc32", "salt"]
    schema = T.StructType([T.StructField(doc, docs.schema[doc].dataType), *(T.StructField(c, T.LongType()) for c in longs), *([T.StructField("ids", T.BinaryType())] if keep_ids else [])])
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encode, salt = _encoder(shared.value).encode, TaskContext.get().partitionId() << 40
        for batch in batches:
            rows, out, ids = [], [[] for _ in longs], []
            for r, t in enumerate(batch.column(text)):
                raw = encode(t.as_py() or "") + end
                for k, a in enumerate(range(0, len(raw), 4 * size)):
                    part = raw[a : a + 4 * size]
                    rows.append(r)
                    for column, v in zip(out, (k, a // 4, len(part) // 4, zlib.crc32(part), salt), strict=True):
                        column.append(v)
                    if keep_ids:
                        ids.append(part)
                    salt += 1
            if rows:
                arrays = [batch.column(doc).take(pa.array(rows)), *(pa.array(c, pa.int64()) for c in out)]
                yield pa.RecordBatch.from_arrays([*arrays, *([pa.array(ids, pa.binary())] if keep_ids else [])], names=schema.names)

    return docs.select(doc, text).mapInArrow(run, schema)


def order(lengths: np.ndarray, size: int) -> np.ndarray:
    """Places of the lengths in the order of packing: from the longest down to a 16th of the size, then the short ones shuffled."""
    long, short = np.flatnonzero(lengths >= size // 16), np.flatnonzero(lengths < size // 16)
    return np.concatenate((long[np.argsort(-lengths[long], kind="stable")], np.random.Generator(np.random.PCG64(len(short))).permutation(short)))


def pack(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length, 1..size; bins are numbered from 0."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    counts = np.zeros(size + 1, np.int32)  #: open bins by gap
    stacks: dict[int, list[int]] = {}
    used, never = 0, np.iinfo(np.int32).max
    for k in order(lengths, size).tolist():
        n = int(lengths[k])
        gap = size
        if n < size:
            here = counts[n:size]
            change = np.where(here > 0, 2 * (counts[: size - n] - here) + 2, never)
            change[0] = 1 - 2 * here[0] if here[0] else never  # the bin becomes full and counts no more
            best = int(np.argmin(change))
            if change[best] <= 1 + 2 * counts[size - n]:
                gap = n + best
        if gap < size:
            b = stacks[gap].pop()
            counts[gap] -= 1
        else:
            b, used = used, used + 1
        bins[k], offsets[k] = b, size - gap
        if gap > n:
            stacks.setdefault(gap - n, []).append(b)
            counts[gap - n] += 1
    return bins, offsets


def pack_pieces(parts: DataFrame, size: int = 4096, shard_rows: int = 60_000) -> DataFrame:
    """parts (with length, salt and others) with sequence_id and offset. They are stored before they are dealt: salts must not change."""
    parts = materialize(parts)
    shards = max(1, -(-parts.count() // shard_rows))
    dealt = parts.drop("ids").withColumn("_mw_shard", F.pmod(F.xxhash64("salt"), F.lit(shards)))
    placed = T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    schema = T.StructType([*(f for f in parts.schema.fields if f.name != "ids"), *placed.fields])

    def run(table: pa.Table) -> pa.Table:
        bins, offsets = pack(table.column("length").to_numpy(), size)
        shard = table.column("_mw_shard")[0].as_py()
        return table.drop_columns(["_mw_shard"]).append_column("sequence_id", pa.array(bins + (shard << 36))).append_column("offset", pa.array(offsets))

    out = dealt.groupBy("_mw_shard").applyInArrow(run, schema)
    return out.join(parts.select("salt", "ids"), "salt") if "ids" in parts.columns else out


def pack_documents(docs: DataFrame, tokenizer_path: str, size: int = 4096, end_id: int = 1, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """(doc, piece, start, length, ids_crc32, sequence_id, offset) per piece of docs; repeated rows are packed each."""
    return pack_pieces(pieces(docs, tokenizer_path, size, end_id, text, doc), size).drop("salt")


def sequences(docs: DataFrame, tokenizer_path: str, size: int = 4096, end_id: int = 1, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """(sequence_id, ids array, doc_ids array): the sequences themselves, each of `size` ids at most."""
    placed = pack_pieces(pieces(docs, tokenizer_path, size, end_id, text, doc, keep_ids=True), size)
    schema = T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("doc_ids", T.ArrayType(docs.schema[doc].dataType))])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("offset")
        ids = np.frombuffer(b"".join(x.as_py() for x in table.column("ids")), "<u4").astype(np.int64)
        return pa.table({"sequence_id": table.column("sequence_id")[:1], "ids": pa.array([ids]), "doc_ids": pa.array([table.column(doc).to_pylist()], pa.list_(table.schema.field(doc).type))})

    return placed.groupBy("sequence_id").applyInArrow(run, schema)
