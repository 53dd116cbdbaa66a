"""Line deduplication by sharded minimal perfect hashes.

A line's key is the line without white space at its ends and with A-Z in lower
case. Keys of at least ``min_chars`` code points that at least ``min_docs``
documents hold lose their lines, except in the largest ``doc_id`` that holds
them. Documents don't join lines: the distinct line hashes that more than one
document holds are indexed by minimal perfect hashes, one a shard, whose
numbers point into compact arrays of fingerprints, counts of documents and
keepers. Documents probe the arrays, and the counts decide.

Up to ``broadcast_bytes`` the index is broadcast and documents are rewritten in
one pass. Beyond it the shards stay where they are: documents send their line
hashes to them, a shard's rows dealt out over salts, and get back which lines
go.

Null or empty text: one empty line, kept. Rows that repeat a doc_id are one
document, and all rows of the largest id keep their lines. Each row with a null
id is a document, of an id less than any other; a key that only null ids hold stays.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievespark.llm.common import append_columns, bound_batches, code_points, free_name, materialize, mix64, partitions, slices, texts_of

MIN_CHARS = 20
MIN_DOCS = 3
KEYS_A_SHARD = 1 << 17
BROADCAST_BYTES = 64 << 20
SALTS = 64
_NULL_ID = -(1 << 63)


def line_keys(text: bytes | None, min_chars: int = MIN_CHARS) -> list[tuple[int, bytes]]:
    """Place and key of each line that is long enough."""
    if not text:
        return []
    out = []
    for i, line in enumerate(text.split(b"\n")):
        if len(line) >= min_chars:
            key = line.strip()
            if len(key) >= min_chars and (len(key) >= 4 * min_chars or code_points(key) >= min_chars):
                out.append((i, key.lower()))
    return out


def hash_pair(key: bytes) -> tuple[int, int]:
    """Two 64-bit halves of a 128-bit hash, signed for Spark."""
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h >> 64, h & 0xFFFFFFFFFFFFFFFF
    return a - (a >> 63 << 64), b - (b >> 63 << 64)


class PerfectHash:
    """A minimal perfect hash over distinct 64-bit keys.

    Level by level, a key that is alone in its slot keeps it and the others go
    to the next level; the number of kept slots before a key's is its index.
    """

    def __init__(self, keys: np.ndarray, gamma: float = 2.0) -> None:
        self.sizes: list[int] = []
        bits = []
        while len(keys):
            if len(self.sizes) > 200:
                raise ValueError("keys repeat")
            size = max(8, int(gamma * len(keys)))
            at = self.slots(keys, len(self.sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            self.sizes.append(size)
            bits.append(alone)
            keys = keys[~alone[at]]
        flags = np.concatenate(bits) if bits else np.empty(0, bool)
        self.words = np.packbits(np.concatenate((flags, np.zeros(-len(flags) % 64, bool))), bitorder="little").view("<u8")
        self._open()

    @staticmethod
    def slots(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix64(keys + np.uint64(level * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) % np.uint64(size)).astype(np.int64)

    def _open(self) -> None:
        """A count of the kept slots before each 64 of them: the rest of a slot's rank is counted in its word."""
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.uint32))).astype(np.uint32)

    def __getstate__(self) -> tuple:
        return self.sizes, self.words

    def __setstate__(self, state: tuple) -> None:
        self.sizes, self.words = state
        self._open()

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key; of a key that isn't among those of the hash, any index or -1."""
        out = np.full(len(keys), -1, np.int64)
        todo, base = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            at = base + self.slots(keys[todo], level, size)
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = word & ((np.uint64(1) << bit) - np.uint64(1))
            out[todo[hit]] = self.before[at[hit] >> 6] + np.bitwise_count(below[hit])
            todo = todo[~hit]
            base += size
            if not len(todo):
                break
        return out


class Shard:
    """A perfect hash with arrays of fingerprints, counts and keepers."""

    def __init__(self, first: np.ndarray, second: np.ndarray, counts: np.ndarray, keep: np.ndarray) -> None:
        keys = first.view(np.uint64)
        self.hash = PerfectHash(keys)
        at = self.hash.find(keys)
        self.prints, self.counts, self.keep = np.empty_like(second), np.empty(len(keys), np.uint32), np.empty_like(keep)
        self.prints[at], self.counts[at], self.keep[at] = second, np.minimum(counts, 0xFFFFFFFF), keep

    def probe(self, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count (0: not indexed) and keeper of each line hash."""
        if not len(self.prints):
            return np.zeros(len(first), np.int64), np.full(len(first), _NULL_ID)
        at = np.maximum(self.hash.find(first.view(np.uint64)), 0)
        known = self.prints[at] == second
        return np.where(known, self.counts[at], 0), self.keep[at]


def line_table(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``first, second`` (halves of the hash), ``doc_id`` and ``text_hash`` of the distinct keys of each row."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = [(*h, doc, own) for doc, text, own in zip(part.column(0).to_pylist(), texts_of(part), part.column(2).to_pylist(), strict=True) for h in {hash_pair(k) for _, k in line_keys(text, min_chars)}]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["first", "second", "doc_id", "text_hash"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, "first long, second long, doc_id long, text_hash long")


def build_index(lines: DataFrame, keys_a_shard: int = KEYS_A_SHARD) -> tuple[DataFrame, int]:
    """The shards ``(shard, content)`` over the keys of more than one document, and their number.

    Documents are told apart before they are counted, and both steps add up
    partly before their shuffles, so a key that every document holds is as
    cheap as any.
    """
    held = lines.groupBy("first", "second", "doc_id").agg(F.count(F.lit(1)).alias("rows"))
    documents = F.when(F.col("doc_id").isNull(), F.col("rows")).otherwise(1)
    counted = held.groupBy("first", "second").agg(F.sum(documents).alias("n"), F.coalesce(F.max("doc_id"), F.lit(_NULL_ID)).alias("keep"))
    counted = materialize(counted.where("n > 1"))
    n_shards = max(1, -(-counted.count() // keys_a_shard))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        shard = Shard(*(pdf[c].to_numpy() for c in ("first", "second", "n", "keep")))
        return pd.DataFrame({"shard": [pdf["shard"].iat[0]], "content": [pickle.dumps(shard)]})

    sharded = counted.withColumn("shard", F.pmod(F.col("first"), F.lit(n_shards)).cast("int"))
    return materialize(sharded.groupBy("shard").applyInPandas(build, "shard int, content binary")), n_shards


def without(text: bytes, drop: set[int]) -> bytes:
    return b"\n".join([line for i, line in enumerate(text.split(b"\n")) if i not in drop])


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``docs`` with ``text`` rewritten, and ``n_lines`` (before), ``n_dropped``."""
    lines = materialize(line_table(docs, min_chars))
    index, n_shards = build_index(lines)
    size = index.agg(F.sum(F.octet_length("content"))).first()[0] or 0
    if size <= broadcast_bytes:
        return _rewrite_by_broadcast(docs, index, n_shards, min_chars, min_docs)
    return _rewrite_by_routing(docs, lines, index, n_shards, min_chars, min_docs)


_FIELDS = [T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())]


def _rewritten(texts: list[bytes | None], drops: list[set[int]]) -> list:
    new = [without(t, d) if d else t for t, d in zip(texts, drops, strict=True)]
    return [pa.array(new, pa.binary()).cast(pa.string()), [t.count(b"\n") + 1 if t else 1 for t in texts], [len(d) for d in drops]]


def _rewrite_by_broadcast(docs: DataFrame, index: DataFrame, n_shards: int, min_chars: int, min_docs: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast({r.shard: bytes(r.content) for r in index.collect()})
    opened: dict[int, Shard] = {}
    docs = _free(docs)

    def run(batch: pa.RecordBatch) -> list:
        if not opened:
            opened.update({s: pickle.loads(c) for s, c in shared.value.items()})
        texts = texts_of(batch)
        ids = batch.column(batch.schema.get_field_index("doc_id")).cast(pa.int64()).to_pylist()
        at = [(row, i, *hash_pair(k)) for row, text in enumerate(texts) for i, k in line_keys(text, min_chars)]
        drops: list[set[int]] = [set() for _ in texts]
        if at and opened:
            row, _, first, second = np.array(at, np.int64).T
            own = np.array([_NULL_ID if i is None else i for i in ids])[row]
            shard = first % n_shards
            for s in np.unique(shard).tolist():
                if s in opened:
                    mine = np.flatnonzero(shard == s)
                    count, keep = opened[s].probe(np.ascontiguousarray(first[mine]), np.ascontiguousarray(second[mine]))
                    for k in mine[(count >= min_docs) & (keep != own[mine])].tolist():
                        drops[at[k][0]].add(at[k][1])
        return _rewritten(texts, drops)

    return append_columns(docs, _FIELDS, run).select(*docs.columns, "n_lines", "n_dropped")


def _free(docs: DataFrame) -> DataFrame:
    """Without columns whose names the result's take."""
    return docs.select(*[c for c in docs.columns if c.lower() not in {"n_lines", "n_dropped"}])


def _rewrite_by_routing(docs: DataFrame, lines: DataFrame, index: DataFrame, n_shards: int, min_chars: int, min_docs: int) -> DataFrame:
    salts = max(SALTS, 4 * partitions(docs.sparkSession) // n_shards)
    asks = lines.select("first", "second", "doc_id", "text_hash", F.pmod("first", F.lit(n_shards)).cast("int").alias("shard"), F.pmod(F.xxhash64("doc_id", "second", "text_hash"), F.lit(salts)).cast("int").alias("salt"))
    shards = index.select("shard", "content", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))

    def probe(asked: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        if asked.empty or shard.empty:
            return pd.DataFrame({c: pd.Series(dtype="Int64") for c in ("doc_id", "text_hash", "first", "second")})
        count, keep = pickle.loads(shard["content"].iat[0]).probe(asked["first"].to_numpy(), asked["second"].to_numpy())
        own = asked["doc_id"].fillna(_NULL_ID).astype("int64").to_numpy() if asked["doc_id"].isna().any() else asked["doc_id"].to_numpy(np.int64)
        return asked.loc[(count >= min_docs) & (keep != own), ["doc_id", "text_hash", "first", "second"]].astype({"doc_id": "Int64"})

    hits = asks.groupBy("shard", "salt").cogroup(shards.groupBy("shard", "salt")).applyInPandas(probe, "doc_id long, text_hash long, first long, second long")
    # rows of one id, or of none, are told apart by their texts
    by_row = hits.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("first", "second")).alias("gone"))
    docs = _free(docs)
    gone = free_name(docs, "__gone")
    by_row = by_row.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__text"), F.col("gone").alias(gone))
    joined = docs.join(by_row, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__text")), "left").drop("__id", "__text")

    def run(batch: pa.RecordBatch) -> list:
        texts, drops = texts_of(batch), []
        for text, pairs in zip(texts, batch.column(batch.schema.get_field_index(gone)).to_pylist(), strict=True):
            out = {(p["first"], p["second"]) for p in pairs or ()}
            drops.append({i for i, k in line_keys(text, min_chars) if hash_pair(k) in out} if out else set())
        return _rewritten(texts, drops)

    return append_columns(joined, _FIELDS, run).select(*docs.columns, "n_lines", "n_dropped")
